"""Payment behaviour and the instalment risk proxy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import as_dec10, avg2, pct, r, ratio
from marketlens.functions.rules import CREDIT_CARD, PaymentRiskRule
from marketlens.operators.common import (
    fanout_weight,
    review_score_cnt,
    review_score_sum,
    review_stats,
    sort_small,
    with_scalar,
)
from marketlens.sources.tables import Tables


def payment_type_breakdown(t: Tables) -> DataFrame:
    p = t.payments
    by_type = p.groupBy("payment_type").agg(
        F.countDistinct("order_id").alias("total_orders"),
        r(F.sum("payment_value")).alias("total_payment_value"),
        avg2("payment_value").alias("avg_payment_value"),
        avg2("payment_installments").alias("avg_installments"),
    )
    # An order can pay with several types, so the base is its own distinct count.
    paid_orders = p.agg(F.countDistinct("order_id").alias("paid_orders"))
    return with_scalar(by_type, paid_orders).select(
        "payment_type",
        "total_orders",
        "total_payment_value",
        "avg_payment_value",
        "avg_installments",
        pct("total_orders", "paid_orders").alias("pct_of_orders"),
    ).transform(sort_small, F.col("total_orders").desc(), F.col("payment_type").asc_nulls_first())


def credit_payments(t: Tables, payment_type: str = CREDIT_CARD) -> DataFrame:
    return t.payments.where((F.col("payment_type") == payment_type) & (F.col("payment_installments") > 0))


def _weighted_avg(c: str, w: Column) -> Column:
    return r(ratio(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))))


def installment_satisfaction(t: Tables, payment_type: str = CREDIT_CARD) -> DataFrame:
    """Per instalment count over payment × review rows (as published)."""
    w = fanout_weight()
    rows = credit_payments(t, payment_type).join(review_stats(t.reviews), "order_id", "left")
    return rows.groupBy("payment_installments").agg(
        F.countDistinct("order_id").alias("total_orders"),
        r(ratio(F.sum(review_score_sum()), F.sum(review_score_cnt()))).alias("avg_review_score"),
        _weighted_avg("payment_value", w).alias("avg_order_value"),
        r(F.sum(F.col("payment_value") * w)).alias("total_revenue"),
    ).transform(sort_small, F.col("payment_installments").asc_nulls_first())


def tier_sums(t: Tables, rule: PaymentRiskRule = PaymentRiskRule(), payment_type: str = CREDIT_CARD) -> DataFrame:
    """Per risk tier: sums over payment × review rows, from which ``tiers_of_sums`` makes the report."""
    w = fanout_weight()
    rows = credit_payments(t, payment_type).withColumn(
        "payment_risk_tier", rule.label(F.col("payment_installments"), F.col("payment_value"))
    ).join(review_stats(t.reviews), "order_id", "left")
    weighted = lambda c: (F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w)))
    (value_sum, value_cnt), (instalment_sum, instalment_cnt) = weighted("payment_value"), weighted("payment_installments")
    return rows.groupBy("payment_risk_tier").agg(
        F.sum(w).alias("total_orders"),
        value_sum.alias("value_sum"),
        value_cnt.alias("value_cnt"),
        instalment_sum.alias("instalment_sum"),
        instalment_cnt.alias("instalment_cnt"),
        F.sum(review_score_sum()).alias("rv_sum"),
        F.sum(review_score_cnt()).alias("rv_cnt"),
    )


def tiers_of_sums(sums: DataFrame) -> DataFrame:
    return sums.select(
        "payment_risk_tier",
        "total_orders",
        r(ratio("value_sum", "value_cnt")).alias("avg_order_value"),
        r(ratio("instalment_sum", "instalment_cnt")).alias("avg_installments"),
        r(ratio("rv_sum", "rv_cnt")).alias("avg_review_score"),
        r("value_sum").alias("total_exposure"),
    )


def payment_risk_tiers(t: Tables, rule: PaymentRiskRule = PaymentRiskRule(), payment_type: str = CREDIT_CARD) -> DataFrame:
    return tiers_of_sums(tier_sums(t, rule, payment_type)).transform(
        sort_small, F.col("total_exposure").desc_nulls_last(), F.col("payment_risk_tier").asc_nulls_first()
    )


def payment_risk_by_payment(t: Tables, rule: PaymentRiskRule = PaymentRiskRule(), payment_type: str = CREDIT_CARD) -> DataFrame:
    """Corrected tiers: one row per payment, reviews averaged per order first."""
    per_order_review = review_stats(t.reviews).select(
        "order_id", as_dec10(ratio("rv_sum", "rv_cnt")).alias("order_review")
    )
    rows = credit_payments(t, payment_type).withColumn(
        "payment_risk_tier", rule.label(F.col("payment_installments"), F.col("payment_value"))
    ).join(per_order_review, "order_id", "left")
    return rows.groupBy("payment_risk_tier").agg(
        F.count(F.lit(1)).alias("total_orders"),
        avg2("payment_value").alias("avg_order_value"),
        avg2("payment_installments").alias("avg_installments"),
        avg2("order_review").alias("avg_review_score"),
        r(F.sum("payment_value")).alias("total_exposure"),
    ).transform(sort_small, F.col("total_exposure").desc_nulls_last(), F.col("payment_risk_tier").asc_nulls_first())
