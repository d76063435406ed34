"""Derive the eight marketplace tables from the driver's TPC-H-ish parquet.

The derivation is deterministic (integer modulo on non-negative keys, no
hashing, no random numbers) and is written with the DataFrame API: every
table is a narrow projection of one raw table, except

* ``customers``  — orders joined to customer on the customer key, and
* ``reviews``    — orders left-joined to the per-order minimum supplier key
                   (a partial + final aggregate over lineitem).

Because the tables are lazy projections, a query that needs only
``orders.order_status`` scans only ``o_orderkey``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.schemas import COORD, MONEY, SCHEMAS
from marketlens.sources.tables import Tables

RAW_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")


def _str(prefix: str, *parts: Column | str) -> Column:
    out = [F.lit(prefix)]
    for p in parts:
        out.append(F.lit(p) if isinstance(p, str) else p.cast("string"))
    return F.concat(*out)


def _plus(ts: Column, days: Column | int, hours: Column | int = 0) -> Column:
    def as_int(v: Column | int) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast("int")

    return ts + F.make_dt_interval(as_int(days), as_int(hours))


def _cents(e: Column) -> Column:
    return (e * F.lit(0.01).cast("decimal(3,2)")).cast(MONEY)


def _conform(df: DataFrame, name: str) -> DataFrame:
    schema = SCHEMAS[name]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    root = sf_dir.rstrip("/")
    return {t: spark.read.parquet(f"{root}/{t}.parquet") for t in RAW_TABLES}


def derive(raw: dict[str, DataFrame]) -> Tables:
    o = raw["orders"]
    k = F.col("o_orderkey")
    odate = F.col("o_orderdate").cast("timestamp_ntz")

    customers = o.join(raw["customer"], F.col("o_custkey") == F.col("c_custkey")).select(
        _str("c", k).alias("customer_id"),
        _str("u", F.col("o_custkey"), "-", k % 7).alias("customer_unique_id"),
        _str("Z", F.col("c_nationkey")).alias("customer_zip_code_prefix"),
        _str("city_", F.col("c_nationkey")).alias("customer_city"),
        _str("S", F.col("c_nationkey")).alias("customer_state"),
    )

    status = (
        F.when(k % 20 == 0, "canceled")
        .when(k % 20 == 1, "unavailable")
        .when(k % 20 == 2, "invoiced")
        .when(k % 20 == 3, "processing")
        .when(k % 20 == 4, "shipped")
        .otherwise("delivered")
    )
    late_shift = F.when(k % 11 == 0, (k * 7919 + 7) % 60).otherwise(-((k * 7919) % 20))
    orders = o.select(
        _str("o", k).alias("order_id"),
        _str("c", k).alias("customer_id"),
        status.alias("order_status"),
        odate.alias("order_purchase_timestamp"),
        F.when(k % 50 == 0, F.lit(None)).otherwise(_plus(odate, 0, 1 + k % 23)).alias("order_approved_at"),
        F.when(k % 20 < 4, F.lit(None)).otherwise(_plus(odate, 1 + k % 5)).alias("order_delivered_carrier_date"),
        F.when((k % 20 < 5) | (k % 97 == 0), F.lit(None))
        .otherwise(_plus(odate, 10 + k % 31 + late_shift, k % 24))
        .alias("order_delivered_customer_date"),
        _plus(odate, 10 + k % 31).alias("order_estimated_delivery_date"),
    )

    li = raw["lineitem"]
    lk, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    seller = (
        F.when(pk % 20 < 12, _str("A", sk - sk % 3))
        .when(pk % 20 < 16, _str("B", sk - sk % 4))
        .otherwise(_str("C", sk))
    )
    price_units = (
        F.when(lk % 211 == 0, F.lit(0).cast("bigint"))
        .when(pk % 4 == 0, F.floor(F.col("l_extendedprice")).cast("bigint"))
        .otherwise(F.floor(F.col("l_extendedprice") / 40).cast("bigint"))
    )
    order_items = li.select(
        _str("o", lk).alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        _str("p", pk).alias("product_id"),
        seller.alias("seller_id"),
        _plus(F.col("l_shipdate").cast("timestamp_ntz"), 3).alias("shipping_limit_date"),
        _cents(price_units).alias("price"),
        _cents(100 + (lk * 31 + F.col("l_linenumber") * 1709 + pk * 7) % 2000).alias("freight_value"),
    )

    p = raw["part"]
    ppk = F.col("p_partkey")
    products = p.select(
        _str("p", ppk).alias("product_id"),
        F.when(ppk % 101 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        (ppk % 3000).alias("product_description_length"),
        (1 + ppk % 6).alias("product_photos_qty"),
        (F.col("p_size") * 100).alias("product_weight_g"),
        F.col("p_size").alias("product_length_cm"),
        (1 + ppk % 40).alias("product_height_cm"),
        (1 + ppk % 50).alias("product_width_cm"),
    )

    s = raw["supplier"]
    ssk = F.col("s_suppkey")
    seller_ids = (
        s.where(ssk % 3 == 0).select(_str("A", ssk).alias("sid"), F.col("s_nationkey").alias("nk"))
        .unionByName(s.where(ssk % 4 == 0).select(_str("B", ssk).alias("sid"), F.col("s_nationkey").alias("nk")))
        .unionByName(s.select(_str("C", ssk).alias("sid"), F.col("s_nationkey").alias("nk")))
    )
    sellers = seller_ids.select(
        F.col("sid").alias("seller_id"),
        _str("Z", F.col("nk")).alias("seller_zip_code_prefix"),
        _str("city_", F.col("nk")).alias("seller_city"),
        _str("S", F.col("nk")).alias("seller_state"),
    )

    # Second payment / review rows come from a bounded per-row explode, not a cross join.
    n = F.col("n")
    pay_rows = o.select("*", F.explode(F.when(k % 17 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"))
    pay_type = (
        F.when(n == 2, "voucher")
        .when(k % 20 < 15, "credit_card")
        .when(k % 20 < 17, "bank_slip")
        .when(k % 20 < 19, "voucher")
        .otherwise("debit_card")
    )
    installments = F.when((n == 2) | (k % 20 >= 15), 1).when(k % 50 == 0, 0).otherwise(1 + k % 12)
    payments = pay_rows.select(
        _str("o", k).alias("order_id"),
        n.alias("payment_sequential"),
        pay_type.alias("payment_type"),
        installments.alias("payment_installments"),
        _cents(F.floor(F.col("o_totalprice") / 10).cast("bigint")).alias("payment_value"),
    )

    first_supp = li.groupBy(F.col("l_orderkey").alias("rk")).agg(F.min("l_suppkey").alias("s"))
    rev_rows = (
        o.where(k % 13 != 0)
        .join(first_supp, k == F.col("rk"), "left")
        .select("*", F.explode(F.when(k % 29 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"))
    )
    low_share = F.when(F.col("s") % 12 < 3, 60).otherwise(12)
    score = (
        F.when((k * 31 + n * 7) % 100 < low_share, 1 + k % 3)
        .when((k * 17) % 10 < 7, 5)
        .otherwise(4)
    )
    reviews = rev_rows.select(
        _str("r", k, "-", n).alias("review_id"),
        _str("o", k).alias("order_id"),
        score.alias("review_score"),
        F.when(k % 3 == 0, _str("title ", k % 10)).alias("review_comment_title"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(_str("message ", k)).alias("review_comment_message"),
        _plus(odate, 45 + n).alias("review_creation_date"),
        _plus(odate, 47 + n, k % 24).alias("review_answer_timestamp"),
    )

    nk = F.col("n_nationkey")
    geo_rows = raw["nation"].select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    geolocation = geo_rows.select(
        _str("Z", nk).alias("geolocation_zip_code_prefix"),
        (nk * F.lit(1.25).cast("decimal(3,2)") - 20).cast(COORD).alias("geolocation_lat"),
        (n * F.lit(0.01).cast("decimal(3,2)") - 40 - nk).cast(COORD).alias("geolocation_lng"),
        _str("city_", nk).alias("geolocation_city"),
        _str("S", nk).alias("geolocation_state"),
    )

    frames = dict(
        customers=customers,
        orders=orders,
        order_items=order_items,
        products=products,
        sellers=sellers,
        payments=payments,
        reviews=reviews,
        geolocation=geolocation,
    )
    return Tables(**{name: _conform(df, name) for name, df in frames.items()})


_DERIVED: dict[tuple[int, str], Tables] = {}


def from_testdata(spark: SparkSession, sf_dir: str, reuse: bool = True) -> Tables:
    """The eight tables derived from ``<sf_dir>/<raw>.parquet``.

    The result is only a set of lazy plans, so it is kept per session and
    directory: building it costs a few hundred driver-side expression calls,
    reading it costs nothing until a job runs.
    """
    key = (id(spark._jsparkSession), sf_dir.rstrip("/"))
    if not reuse or key not in _DERIVED:
        _DERIVED[key] = derive(read_raw(spark, sf_dir))
    return _DERIVED[key]
