"""The eight-table marketplace model as one value passed to every job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from marketlens.sources.schemas import SCHEMAS

TABLE_NAMES = tuple(SCHEMAS)


@dataclass(frozen=True)
class Tables:
    """Lazily defined DataFrames for the eight tables.

    Nothing here is read until a job asks for columns, so Catalyst prunes
    every column (and raw input) a query does not touch.  ``hot`` has, by column of the items,
    the values that are known to hold a large share of them (``common.hot_keys``).
    """

    customers: DataFrame
    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    sellers: DataFrame
    payments: DataFrame
    reviews: DataFrame
    geolocation: DataFrame
    hot: Mapping[str, list] = field(default_factory=dict, compare=False)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES}

    def replace(self, **changed) -> "Tables":
        return Tables(**{**self.as_dict(), "hot": self.hot, **changed})

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession


def from_parquet(spark: SparkSession, root: str) -> Tables:
    """Read published marts (``<root>/<table>``) with their declared schemas."""
    return Tables(
        **{
            name: spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
            for name, schema in SCHEMAS.items()
        }
    )


def from_rows(spark: SparkSession, **rows: list[tuple]) -> Tables:
    """Small hand-made tables for rule and boundary tests; missing tables are empty."""
    return Tables(
        **{
            name: spark.createDataFrame(rows.get(name, []), schema)
            for name, schema in SCHEMAS.items()
        }
    )
