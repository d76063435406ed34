"""The figures behind the executive summary, from a state that can be merged.

``state_of`` reduces the tables to seven small tables of sums, counts, minima and maxima: per
order group (status and delivery tier, person, delivery date), per customer person, per seller, per product,
per category of a product, for all payments and per instalment tier.  The state of two sets of orders is the
``merged`` state of each, so new orders are added without reading the old ones again:
``write_state`` keeps a state beside the marts, ``add_to_state`` merges the orders of a day into it,
``open_state`` reads it.  ``figures_of`` turns a state into the one row of figures; the reference date
and the size of a seller's business are applied there, all other rules when the state is made.

An order arrives whole: its items, payments, reviews and customer row come with it and once
(`split_by_purchase` cuts tables that way).  Products and sellers may come again only if they are new.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import rules as R
from marketlens.functions.numeric import as_dec2, avg2, pct, r, ratio
from marketlens.operators import delivery, payments, revenue, sellers
from marketlens.operators.common import fanout_weight, hashed_review_stats, review_score_cnt, review_score_sum
from marketlens.sources import marts
from marketlens.sources.tables import Tables


@dataclass(frozen=True)
class SummaryRules:
    """Every threshold and status of the analyses behind the summary."""

    delivery: R.DeliveryRule = R.DeliveryRule()
    rfm: R.RfmRule = R.RfmRule()
    segments: R.SegmentRuleB = R.SegmentRuleB()
    seller: R.SellerRule = R.SellerRule()
    payment: R.PaymentRiskRule = R.PaymentRiskRule()
    cancelled: str = R.CANCELED
    delivered: str = R.DELIVERED
    excluded: tuple[str, ...] = R.EXCLUDED_STATUSES
    pipeline: tuple[str, ...] = R.PIPELINE_STATUSES
    credit: str = R.CREDIT_CARD
    min_orders: int = 10


DEFAULT_RULES = SummaryRules()


@dataclass(frozen=True)
class State:
    """Mergeable tables; ``KEYS`` has their keys, ``LEAST`` and ``MOST`` the columns that are not sums."""

    orders: DataFrame
    people: DataFrame
    sellers: DataFrame
    products: DataFrame
    items: DataFrame
    payments: DataFrame
    tiers: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


KEYS = {
    "orders": ("kind", "a", "b"),
    "people": ("customer_unique_id",),
    "sellers": ("seller_id",),
    "products": ("product_id", "product_category_name"),
    "items": ("product_id",),
    "payments": (),
    "tiers": ("payment_risk_tier",),
}
LEAST = {"least_late"}
MOST = {"most_late", "worst", "last_bought"}


# ---------------------------------------------------------------- tables -> state

def _order_facts(t: Tables) -> DataFrame:
    """One row per order (or order id of items): status, dates, item sums, review stats, person."""
    orders = t.orders.select(
        "order_id",
        "customer_id",
        F.lit(1).alias("is_order"),
        "order_status",
        F.col("order_purchase_timestamp").alias("bought"),
        F.col(delivery.DELIVERED_AT).alias("arrived"),
        F.col(delivery.ESTIMATED_AT).alias("promised"),
    )
    items = t.order_items.groupBy("order_id").agg(
        F.sum("price").alias("price_sum"), F.count("price").alias("price_cnt"), F.count(F.lit(1)).alias("items")
    )
    people = t.customers.select("customer_id", "customer_unique_id", F.lit(1).alias("known"))
    return orders.join(items, "order_id", "full").join(hashed_review_stats(t.reviews), "order_id", "left").join(people, "customer_id", "left")


def _packed(late: Column, on: Column) -> Column:
    """A delay and its date as one number in the same order: a maximum of numbers is found by hashing, one of structs needs sorted rows."""
    return late.cast("bigint") * (1 << 32) + (F.unix_date(on).cast("bigint") + (1 << 31))


def _unpacked(worst: Column) -> Column:
    late = F.shiftright(worst, 32).cast("int")
    return F.struct(late.alias("late"), F.date_from_unix_date((worst - late.cast("bigint") * (1 << 32) - (1 << 31)).cast("int")).alias("on"))


def _order_groups(t: Tables, rules: SummaryRules) -> DataFrame:
    """Every order goes to up to three groups: its status and delivery tier, its person and,
    if critically late, its delivery date.  One aggregation makes all groups."""
    c = F.col
    status = c("order_status")
    late = F.datediff("arrived", "promised")
    dated = (status == rules.delivered) & c("arrived").isNotNull() & c("promised").isNotNull()
    tier = F.when(dated, F.substring(rules.delivery.label(c("arrived"), c("promised"), tiered=True), 1, 1))
    kept = (c("is_order") == 1) & ~status.isin(*rules.excluded)
    none = F.lit(None).cast("string")
    grain = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    groups = F.array(
        grain("status", status, tier),
        F.when(kept & (c("known") == 1), grain("person", c("customer_unique_id"), none)),
        F.when(tier == "4", grain("date", F.to_date("arrived").cast("string"), none)),
    )
    has_items = (c("is_order") == 1) & c("items").isNotNull()
    w = fanout_weight()
    rows = _order_facts(t).withColumn("late", late).withColumn("w", w).withColumn("has_items", has_items).withColumn("g", F.explode(groups))
    return rows.where(c("g").isNotNull()).groupBy("g.kind", "g.a", "g.b").agg(
        F.sum("is_order").alias("n"),
        F.count(F.when(c("has_items"), 1)).alias("n_items"),
        F.sum(F.when(c("has_items"), c("price_sum"))).alias("price_sum"),
        F.sum(F.when(c("has_items"), c("price_cnt"))).alias("price_cnt"),
        F.sum(F.when(c("is_order") == 1, c("w"))).alias("w"),
        F.sum(F.when(c("is_order") == 1, review_score_sum())).alias("rv_sum"),
        F.sum(F.when(c("is_order") == 1, review_score_cnt())).alias("rv_cnt"),
        F.sum(c("items") * review_score_sum()).alias("item_rv_sum"),
        F.sum(c("items") * review_score_cnt()).alias("item_rv_cnt"),
        F.min("late").alias("least_late"),
        F.max("late").alias("most_late"),
        F.max(_packed(c("late"), F.to_date("arrived"))).alias("worst"),
        F.max(F.when(c("has_items"), c("bought"))).alias("last_bought"),
    ).withColumn("worst", _unpacked(c("worst")))


def _seller_sums(t: Tables, rules: SummaryRules) -> DataFrame:
    """Per seller: what its items sum to (reviews multiply them, as published), and its rows in the sellers table."""
    sold = sellers.seller_sums(t, rules.cancelled)
    listed = t.sellers.groupBy("seller_id").agg(F.count(F.lit(1)).alias("listed"))
    return sold.unionByName(listed, allowMissingColumns=True).groupBy("seller_id").agg(*(F.sum(c).alias(c) for c in [*sold.columns[1:], "listed"]))


def _payment_sums(t: Tables, rules: SummaryRules) -> DataFrame:
    """All payments in one row.  They are summed by order first: orders are then counted as rows,
    where two distinct counts would keep each order three times in a task's hash tables."""
    credit = F.col("payment_type") == rules.credit
    instalments = F.when(credit, F.col("payment_installments"))
    by_order = t.payments.groupBy("order_id").agg(
        F.sum(instalments).alias("instalment_sum"),
        F.count(instalments).alias("instalment_cnt"),
        F.count(F.when(credit, 1)).alias("credit_rows"),
    )
    return by_order.agg(
        F.count(F.when(F.col("credit_rows") > 0, F.col("order_id"))).alias("credit_orders"),
        F.count("order_id").alias("paid_orders"),
        F.sum("instalment_sum").alias("instalment_sum"),
        F.coalesce(F.sum("instalment_cnt"), F.lit(0)).alias("instalment_cnt"),
        F.coalesce(F.sum("credit_rows"), F.lit(0)).alias("credit_rows"),
    )


def state_of(t: Tables, rules: SummaryRules = DEFAULT_RULES) -> State:
    """The state of all orders of the tables."""
    return State(
        orders=_order_groups(t, rules),
        people=t.customers.groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("customer_rows")),
        sellers=_seller_sums(t, rules),
        products=t.products.groupBy("product_id", "product_category_name").agg(F.count(F.lit(1)).alias("copies")),
        items=revenue.product_freight_sums(t),
        payments=_payment_sums(t, rules),
        tiers=payments.tier_sums(t, rules.payment, rules.credit),
    )


def merged(*states: State) -> State:
    """The state of all orders of several states; of one, itself."""
    if len(states) == 1:
        return states[0]
    out = {}
    for name, keys in KEYS.items():
        rows = reduce(DataFrame.unionByName, [getattr(s, name) for s in states])
        if "worst" in rows.columns:
            rows = rows.withColumn("worst", _packed(F.col("worst.late"), F.col("worst.on")))
        how = {c: F.min if c in LEAST else F.max if c in MOST else F.sum for c in rows.columns if c not in keys}
        kinds = dict(getattr(states[0], name).dtypes)
        out[name] = rows.groupBy(*keys).agg(*((_unpacked(f(c)) if c == "worst" else f(c).cast(kinds[c])).alias(c) for c, f in how.items()))
    return State(**out)


def split_by_purchase(t: Tables, since: dt.date | str) -> tuple[Tables, Tables]:
    """The tables cut into orders bought before ``since`` (or at no known time) and the rest,
    each order with its items, payments, reviews and customer row; products, sellers and places come with the first part."""
    late = F.col("order_purchase_timestamp") >= F.lit(str(since)).cast("timestamp_ntz")
    new = t.orders.where(late)
    ids, people = new.select("order_id").distinct(), new.select("customer_id").distinct()
    before, after = {"orders": t.orders.where(F.coalesce(~late, F.lit(True)))}, {"orders": new}
    for name in ("order_items", "payments", "reviews"):
        before[name], after[name] = (getattr(t, name).join(ids, "order_id", how) for how in ("left_anti", "left_semi"))
    before["customers"], after["customers"] = (t.customers.join(people, "customer_id", how) for how in ("left_anti", "left_semi"))
    known = {name: getattr(t, name).where(F.lit(False)) for name in ("products", "sellers", "geolocation")}
    return t.replace(**before), t.replace(**after, **known)


# ---------------------------------------------------------------- state -> figures

def _side_by_side(frames: list[DataFrame]) -> DataFrame:
    # Each frame is a global aggregate: exactly one row, so the product is one row.
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def _pick(label_col: str, label: str, value_col: str, agg=F.max) -> Column:
    return agg(F.when(F.col(label_col) == label, F.col(value_col)))


def _order_figures(s: State, as_of: dt.date | str, rules: SummaryRules) -> DataFrame:
    """Revenue, delivery and customer figures."""
    c = F.col
    grouped = s.orders.join(s.people, (c("kind") == "person") & (c("a") == c("customer_unique_id")), "left")
    is_status, is_person = c("kind") == "status", c("kind") == "person"
    spend, days = r("price_sum"), F.datediff(F.lit(str(as_of)).cast("date"), c("last_bought"))
    segment = rules.segments.label(rules.rfm.recency_score(c("days")), rules.rfm.frequency_score(c("n_items")), rules.rfm.monetary_score(c("spend")), c("days"), c("n_items"), c("spend"))
    grouped = grouped.withColumns({"spend": spend, "days": days}).withColumn("segment", F.when(is_person & (c("n_items") > 0), segment))

    def of(condition: Column, value: Column | str) -> Column:
        return F.sum(F.when(condition, c(value) if isinstance(value, str) else value))

    cancelled = is_status & (c("a") == rules.cancelled)
    pipeline = is_status & c("a").isin(*rules.pipeline)
    on_time, critical = is_status & (c("b") == "1"), is_status & (c("b") == "4")
    some = is_status & (c("n_items") > 0)
    person = is_person & c("a").isNotNull()
    champion, cold = c("segment") == R.SEG_CHAMPION, c("segment") == R.SEG_CANNOT_LOSE

    def mean(condition: Column, value: Column, n: int = 2) -> Column:
        return r(ratio(of(condition, value), F.count(F.when(condition, value))), n)

    repeat = of(person, F.when(c("n") >= 2, c("customer_rows")).otherwise(0)).cast("bigint")
    date = F.max(F.when(c("kind") == "date", F.struct(c("n"), c("a").alias("on"), "least_late", "most_late")))
    figures = grouped.agg(
        r(of(some, "price_sum")).alias("gross_revenue"),
        r(of(cancelled & some, "price_sum")).alias("cancel_revenue"),
        of(cancelled & some, "n_items").alias("cancel_orders"),
        r(of(pipeline & some, "price_sum")).alias("pipeline_revenue"),
        of(pipeline & some, "n_items").alias("pipeline_orders"),
        of(some, "n_items").alias("orders_with_items"),
        r(ratio(of(some, "price_sum"), of(some, "price_cnt"))).alias("avg_item_price"),
        pct(of(cancelled, "n"), of(is_status, "n")).alias("cancel_share_pct"),
        pct(of(on_time, "w"), of(is_status & c("b").isNotNull(), "n")).alias("on_time_pct"),
        r(ratio(of(on_time, "rv_sum"), of(on_time, "rv_cnt"))).alias("on_time_review"),
        r(ratio(of(critical, "rv_sum"), of(critical, "rv_cnt"))).alias("critical_review"),
        of(critical, "w").alias("critical_rows"),
        F.max(F.when(is_status & c("b").isNotNull(), c("worst"))).alias("worst"),
        date.alias("date"),
        F.count(F.when(person, 1)).alias("total_unique_customers"),
        repeat.alias("repeat_customers"),
        pct(repeat, F.count(F.when(person, 1))).alias("retention_rate_pct"),
        of(champion, F.lit(1)).alias("champions"),
        mean(champion, as_dec2("spend")).alias("champion_spend"),
        of(cold, F.lit(1)).alias("cold_customers"),
        mean(cold, as_dec2("spend")).alias("cold_spend"),
        mean(cold, c("days"), 0).alias("cold_days"),
        r(ratio(of(is_status, "item_rv_sum"), of(is_status, "item_rv_cnt"))).alias("platform_review"),
    )
    return figures.select(
        "*",
        c("worst.late").alias("worst_delay_days"),
        F.year("worst.on").alias("worst_year"),
        c("date.on").alias("date_on"),
        c("date.n").alias("date_orders"),
        c("date.least_late").alias("date_least"),
        c("date.most_late").alias("date_most"),
    ).drop("worst", "date")


def _freight_figures(s: State) -> DataFrame:
    # Top-5 loss categories once; the first of them by the report order
    # (loss desc, category asc with NULL first) is the top category.
    sold = s.items.join(s.products, "product_id")
    copies = F.col("copies")
    sums = [(copies * F.col(c)).alias(c) for c in s.items.columns if c != "product_id"]
    top = revenue.category_freight(sold.select("product_category_name", *sums), k=5)
    first = F.min_by(
        F.struct("product_category_name", "avg_freight_pct"),
        F.struct((-F.col("total_money_lost")).alias("neg_loss"), F.col("product_category_name")),
    )
    return top.agg(r(F.sum("total_money_lost")).alias("freight_loss_top5"), first.alias("top1")).select(
        "freight_loss_top5",
        F.col("top1.product_category_name").alias("top_freight_category"),
        F.col("top1.avg_freight_pct").alias("top_freight_pct"),
    )


def _seller_figures(s: State, rules: SummaryRules) -> DataFrame:
    """Sizes and averages of the seller classes, and the number of sellers, in one aggregation."""
    c = F.col
    base = sellers.base_of_sums(s.sellers, "listed")
    known = sellers.classify(base, rules.seller).withColumn("seller_classification", F.when(c("seller_id").isNotNull() & (c("listed") > 0) & (c("total_orders") >= rules.min_orders), c("seller_classification")))

    def of(label: str) -> Column:
        return c("seller_classification") == label

    def size(label: str) -> Column:  # a class that nobody is in has no row, so no number
        return F.sum(F.when(of(label), 1))

    return known.agg(
        F.coalesce(F.sum("listed"), F.lit(0)).alias("sellers"),
        size(R.SELLER_ELITE).alias("elite_sellers"),
        avg2(F.when(of(R.SELLER_ELITE), as_dec2("total_revenue"))).alias("elite_revenue"),
        size(R.SELLER_HIGH_CANCEL).alias("high_cancel_sellers"),
        avg2(F.when(of(R.SELLER_HIGH_CANCEL), as_dec2("cancellation_rate"))).alias("high_cancel_rate"),
        size(R.SELLER_UNDERMONETISED).alias("undermonetised_sellers"),
        avg2(F.when(of(R.SELLER_UNDERMONETISED), as_dec2("avg_review_score"))).alias("undermonetised_review"),
        avg2(F.when(of(R.SELLER_UNDERMONETISED), as_dec2("total_revenue"))).alias("undermonetised_revenue"),
    )


def _payment_figures(s: State) -> list[DataFrame]:
    tiers = payments.tiers_of_sums(s.tiers)
    return [
        s.payments.select(
            F.when(F.col("credit_rows") > 0, pct("credit_orders", "paid_orders")).alias("credit_share"),
            r(ratio("instalment_sum", "instalment_cnt")).alias("credit_installments"),
        ),
        tiers.agg(
            _pick("payment_risk_tier", R.PAY_HIGH, "total_exposure").alias("high_risk_exposure"),
            _pick("payment_risk_tier", R.PAY_HIGH, "total_orders").alias("high_risk_rows"),
            _pick("payment_risk_tier", R.PAY_HIGH, "avg_review_score").alias("high_risk_review"),
            F.min("avg_review_score").alias("least_tier_review"),
            _pick("payment_risk_tier", R.PAY_NONE, "total_orders").alias("paid_in_full_rows"),
            _pick("payment_risk_tier", R.PAY_NONE, "avg_review_score").alias("paid_in_full_review"),
        ),
    ]


def figures_of(s: State, as_of: dt.date | str = R.DEFAULT_AS_OF, rules: SummaryRules = DEFAULT_RULES) -> DataFrame:
    """One row with every number the summary needs, from a state made with the same rules."""
    wide = _side_by_side([_order_figures(s, as_of, rules), _freight_figures(s), _seller_figures(s, rules), *_payment_figures(s)])
    return wide.withColumn("dormant_value", F.col("cold_customers").cast("double") * F.col("cold_spend"))


def figures(t: Tables, as_of: dt.date | str = R.DEFAULT_AS_OF, rules: SummaryRules = DEFAULT_RULES) -> DataFrame:
    """One row with every number the summary needs."""
    return figures_of(state_of(t, rules), as_of, rules)


def incremental_figures(t: Tables, since: dt.date | str, as_of: dt.date | str = R.DEFAULT_AS_OF, rules: SummaryRules = DEFAULT_RULES) -> DataFrame:
    """The same row from two states, of the orders bought before ``since`` and of the rest."""
    return figures_of(merged(*(state_of(part, rules) for part in split_by_purchase(t, since))), as_of, rules)


# ---------------------------------------------------------------- a state kept beside the marts

def write_state(s: State, root: str, rules: SummaryRules = DEFAULT_RULES) -> State:
    """Write a state as a new version under ``root`` (see ``marts``: it appears whole or not at all)."""
    spark = s.orders.sparkSession
    root = root.rstrip("/")
    snapshot = f"{root}/data/{uuid.uuid4().hex}"
    for name, df in s.as_dict().items():
        df.write.parquet(f"{snapshot}/{name}")
    body = {"rules": repr(rules), "tables": {name: {"path": f"{snapshot}/{name}"} for name in KEYS}, "schemas": {name: df.schema.json() for name, df in s.as_dict().items()}}
    return open_state(spark, root, rules, marts._commit(spark, root, body))


def open_state(spark: SparkSession, root: str, rules: SummaryRules = DEFAULT_RULES, version: int | None = None) -> State:
    """The newest state under ``root`` (or the one of a version); it must have been made with these rules."""
    from pyspark.sql.types import StructType

    body = marts.manifest(spark, root, version)
    if body["rules"] != repr(rules):
        raise ValueError("this state was made with other rules")
    schema = {name: StructType.fromJson(marts.json.loads(text)) for name, text in body["schemas"].items()}
    return State(**{name: spark.read.schema(schema[name]).parquet(found["path"]) for name, found in body["tables"].items()})


def add_to_state(new: Tables, root: str, rules: SummaryRules = DEFAULT_RULES) -> State:
    """Merge the orders of ``new`` into the newest state under ``root``; only that state and ``new`` are read."""
    return write_state(merged(open_state(new.spark, root, rules), state_of(new, rules)), root, rules)
