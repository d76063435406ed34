"""Load coercion ledger: what a load that does not reject rows would have to bend.

The published load runs without strict mode: a blank number becomes 0, text in a number
column becomes 0, an impossible date becomes the zero date and a long string is cut, each with a warning that nobody
reads.  Here every field is read once, as the string that it is, and tried against its declared type; a
row's failures are one bitmask, with one bit for each column and reason.  The masks are counted
(there are few different ones) and then opened into counts by table, column and reason.

``coerce`` gives the typed rows with the mask: failing fields are NULL, or, with ``as_server``, what the
published load stores.  A missing field (NULL) counts as blank, as CSV files cannot tell the two apart; blank strings are values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegerType, StringType, StructField, StructType, TimestampNTZType

from marketlens.operators.common import sort_small
from marketlens.sources.csv import MULTILINE_TABLES, TIMESTAMP_FORMAT
from marketlens.sources.schemas import SCHEMAS, VARCHAR_WIDTHS
from marketlens.sources.tables import Tables

REASONS = ("blank", "not_a_number", "not_whole", "out_of_range", "bad_date", "too_wide")
MASK = "_coerced"


def read_strings(spark: SparkSession, table: str, path: str) -> DataFrame:
    """One table's CSV with every field as it is written, bound by position to the declared columns."""
    schema = StructType([StructField(f.name, StringType(), True) for f in SCHEMAS[table]])
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", True)
    return reader.option("multiLine", table in MULTILINE_TABLES).option("mode", "PERMISSIVE").csv(path)


def strings_of(t: Tables) -> dict[str, DataFrame]:
    """Typed tables as an export would write them: every field a string."""
    return {name: df.select([F.col(f.name).cast("string").alias(f.name) for f in SCHEMAS[name]]) for name, df in t.as_dict().items()}


#: How dates are written that a cast reads as the format does (all others take the slower format).
PLAIN_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def _plain(kind: DataType) -> str:
    """Trimmed strings in a plain form: of a number, one that any column of the type takes as it is."""
    if isinstance(kind, TimestampNTZType):
        return PLAIN_TIME
    if isinstance(kind, IntegerType):
        return r"^-?[0-9]{1,9}\z"
    return rf"^-?[0-9]{{1,{kind.precision - kind.scale - 1}}}([.][0-9]{{1,10}})?\z"


def _tried(strings: DataFrame, table: str, values: bool = True) -> DataFrame:
    """The strings, and for each column that is not text its trimmed string (``__t``), whether that is
    plain (``__p``) and what it reads as (``__v``; without ``values``, numbers in a plain form are not read).

    Projections of their own, so that a string is trimmed and tried once however many conditions look at it."""
    typed = [f for f in SCHEMAS[table] if not isinstance(f.dataType, StringType)]
    if not typed:
        return strings
    trimmed = strings.withColumns({f"__t_{f.name}": F.coalesce(F.trim(F.col(f.name)), F.lit("")) for f in typed})
    formed = trimmed.withColumns({f"__p_{f.name}": F.col(f"__t_{f.name}").rlike(_plain(f.dataType)) for f in typed})
    read = {}
    for f in typed:
        t, plain = F.col(f"__t_{f.name}"), F.col(f"__p_{f.name}")
        if isinstance(f.dataType, TimestampNTZType):
            value = F.when(plain, t.try_cast("timestamp")).when(t != "", F.try_to_timestamp(t, F.lit(TIMESTAMP_FORMAT)))
        else:
            value = F.when((t != "") if values else ~plain & (t != ""), t.try_cast("decimal(38,10)"))
        read[f"__v_{f.name}"] = value
    return formed.withColumns(read)


def _failures(name: str, kind: DataType, width: int | None) -> dict[str, Column]:
    """By reason, when a tried field fails (NULL: it does not); at most one holds."""
    if isinstance(kind, StringType):
        return {"too_wide": F.length(name) > width} if width else {}
    value, blank = F.col(f"__v_{name}"), F.col(f"__t_{name}") == ""
    if isinstance(kind, TimestampNTZType):
        return {"blank": blank, "bad_date": ~blank & value.isNull()}
    out = {"blank": blank, "not_a_number": ~blank & value.isNull()}
    if isinstance(kind, IntegerType):
        out["not_whole"] = value != F.floor(value)
        out["out_of_range"] = (value == F.floor(value)) & ~value.between(-(1 << 31), (1 << 31) - 1)
    elif isinstance(kind, DecimalType):
        limit = F.lit("1" + "0" * (kind.precision - kind.scale)).cast("decimal(38,10)")
        out["out_of_range"] = F.round(F.abs(value), kind.scale) >= limit
    return out


def bits(table: str) -> list[tuple[str, str]]:
    """(column, reason) of each bit of a table's masks, lowest first."""
    widths = VARCHAR_WIDTHS.get(table, {})
    return [(f.name, reason) for f in SCHEMAS[table] for reason in _failures(f.name, f.dataType, widths.get(f.name))]


def _mask(table: str) -> Column:
    """The bitmask of a row of tried strings: which fields fail, and why."""
    widths = VARCHAR_WIDTHS.get(table, {})
    fields, bit = [], 0
    for f in SCHEMAS[table]:
        passes = F.col(f"__p_{f.name}") if isinstance(f.dataType, IntegerType | DecimalType) else F.lit(False)
        failing = F.when(passes, F.lit(0).cast("bigint"))
        for c in _failures(f.name, f.dataType, widths.get(f.name)).values():
            failing = failing.when(c, F.lit(1 << bit).cast("bigint"))
            bit += 1
        fields.append(failing.otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda a, b: a + b, fields)


def coerce(strings: DataFrame, table: str, as_server: bool = False) -> DataFrame:
    """The declared columns of ``strings`` and their mask (``MASK``).

    Failing fields are NULL.  ``as_server``: blank and unreadable numbers are 0, numbers out of range the largest or
    smallest, fractions rounded, long strings cut; dates stay NULL (there is no zero date here)."""
    widths = VARCHAR_WIDTHS.get(table, {})
    out = []
    for f in SCHEMAS[table]:
        raw, value, kind = F.col(f.name), F.col(f"__v_{f.name}"), f.dataType
        failing = _failures(f.name, kind, widths.get(f.name))
        fails = F.coalesce(reduce(lambda a, b: a | b, failing.values()), F.lit(False)) if failing else F.lit(False)
        if isinstance(kind, StringType):
            out.append((F.substring(raw, 1, widths[f.name]) if as_server else F.when(~fails, raw)) if f.name in widths else raw)
        elif isinstance(kind, TimestampNTZType):
            out.append(value.cast(kind))
        elif not as_server:
            out.append(F.when(~fails, value.try_cast(kind)))
        else:
            number = F.coalesce(value, F.lit(0).cast("decimal(38,10)"))
            if isinstance(kind, IntegerType):
                top = F.lit((1 << 31) - 1).cast("decimal(38,10)")
                least = F.lit(-(1 << 31)).cast("decimal(38,10)")
            else:
                top = F.lit("9" * (kind.precision - kind.scale) + "." + "9" * kind.scale).cast("decimal(38,10)")
                least = -top
            whole = F.round(number, getattr(kind, "scale", 0))
            out.append(F.least(F.greatest(whole, least), top).try_cast(kind))
    return _tried(strings, table).select(*(v.alias(f.name) for v, f in zip(out, SCHEMAS[table])), _mask(table).alias(MASK))


def coercion_counts(strings: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, reason, rows: how many fields of each column fail for each reason.

    One scan and one small aggregate of masks a table; reasons that never occur are not listed.  Rows
    without failures stay until their mask is opened: a filter on the mask would try every field twice."""
    frames = []
    for table, df in strings.items():
        masks = _tried(df, table, values=False).select(_mask(table).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
        opened = F.array(*(F.when(F.col("m").bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(c).alias("column_name"), F.lit(w).alias("reason"))) for i, (c, w) in enumerate(bits(table))))
        each = masks.select(F.lit(table).alias("table_name"), F.explode(opened).alias("b"), "n").where("b is not null")
        frames.append(each.select("table_name", "b.*", "n"))
    counts = reduce(DataFrame.unionByName, frames).groupBy("table_name", "column_name", "reason").agg(F.sum("n").alias("rows"))
    return counts.transform(sort_small, "table_name", "column_name", "reason")


def coercion_counts_of_csv(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return coercion_counts({table: read_strings(spark, table, path) for table, path in paths.items()})


# ---------------------------------------------------------------- faults of an export, for tables without any

#: table: (column whose digits choose the rows, {column: [(every so many rows, what stands there)]}).
FAULTS = {
    "customers": ("customer_id", {"customer_state": [(61, "unknown state")]}),
    "orders": ("order_id", {"order_status": [(53, "delivered to a neighbour")], "order_approved_at": [(29, ""), (31, "0000-00-00 00:00:00"), (37, "yesterday")]}),
    "order_items": ("order_id", {"order_item_id": [(47, "1.5")], "price": [(37, " "), (41, "n/a"), (43, "99999999999.00")], "freight_value": [(67, "12,50")]}),
    "products": ("product_id", {"product_weight_g": [(7, "")], "product_photos_qty": [(11, "4000000000")]}),
    "payments": ("order_id", {"payment_installments": [(39, " ")], "payment_value": [(71, "free")]}),
    "reviews": ("order_id", {"review_score": [(59, "five")], "review_creation_date": [(73, "1998-02-30 00:00:00")]}),
}


def with_faults(strings: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same rows with the faults that exports have, at rows chosen by the digits of their key."""
    out = dict(strings)
    for table, (key, columns) in FAULTS.items():
        digits, number = F.regexp_replace(key, "[^0-9]", "").try_cast("bigint"), F.col("__number")
        changed = {}
        for column, faults in columns.items():
            value = F.col(column)
            for every, text in reversed(faults):
                value = F.when(number % every == 0, F.lit(text)).otherwise(value)
            changed[column] = value
        # The number in a projection of its own: one replacement a row, however many faults look at it.
        out[table] = out[table].withColumn("__number", digits).withColumns(changed).drop("__number")
    return out


def load_coercion_audit(t: Tables) -> DataFrame:
    """The ledger of the eight tables, written out as an export with faults."""
    return coercion_counts(with_faults(strings_of(t)))
