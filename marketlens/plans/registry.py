"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the driver's raw tables under ``sf_dir`` through the
derivation in ``sources.testdata`` and runs over the whole tables.  The
derived data ends in 1998, so the recency reference date is
``TESTDATA_AS_OF`` instead of the published 2018-10-01.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.functions.rules import TESTDATA_AS_OF
from marketlens.operators import customers, delivery, payments, quality, report, revenue, sellers, summary
from marketlens.plans import oracle
from marketlens.sources import ledger
from marketlens.sources.marts import open_marts
from marketlens.sources.tables import Tables
from marketlens.sources.testdata import from_testdata

Query = Callable[[SparkSession, str], DataFrame]

#: Input directory -> root of marts published from it (see ``use_marts``), and the tables
#: opened there by session.
_MARTS: dict[str, str] = {}
_OPENED: dict[tuple[int, str], Tables] = {}


def use_marts(sf_dir: str, root: str | None) -> None:
    """From now on queries on ``sf_dir`` read the marts published at ``root``
    (``sources.marts.publish_marts``), in the version that is the newest one at the first query;
    naming the root again takes the newest one.  None goes back to the derivation."""
    for key in [k for k in _OPENED if k[1] == sf_dir.rstrip("/")]:
        del _OPENED[key]
    if root is None:
        _MARTS.pop(sf_dir.rstrip("/"), None)
    else:
        _MARTS[sf_dir.rstrip("/")] = root


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """The eight tables for ``sf_dir``: published marts if the caller named some,
    otherwise lazy projections of the raw tables.  Nothing is written here."""
    root = _MARTS.get(sf_dir.rstrip("/"))
    if root is None:
        return from_testdata(spark, sf_dir)
    key = (id(spark._jsparkSession), sf_dir.rstrip("/"))
    if key not in _OPENED:
        _OPENED[key] = open_marts(spark, root)
    return _OPENED[key]


def _on_testdata(job: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(tables_for(spark, sf_dir))

    run.__name__ = getattr(job, "__name__", "query")
    run.__wrapped__ = job  # the same job on any Tables (tests use hand-made ones)
    return run


AS_OF = TESTDATA_AS_OF
#: Orders bought from this day on are the new ones of the incremental summary.
NEW_SINCE = "1998-06-01"

QUERIES: dict[str, Query] = {
    # load checks and audits
    "table_row_counts": _on_testdata(quality.table_row_counts),
    "key_uniqueness_audit": _on_testdata(quality.key_uniqueness_audit),
    "blank_value_audit": _on_testdata(quality.blank_value_audit),
    "orphan_and_length_audit": _on_testdata(quality.orphan_and_length_audit),
    "heavy_hitter_audit": _on_testdata(quality.heavy_hitter_audit),
    "collation_audit": _on_testdata(quality.collation_audit),
    "join_loss_by_statement": _on_testdata(quality.join_loss_by_statement),
    "load_coercion_audit": _on_testdata(ledger.load_coercion_audit),
    # revenue leakage
    "order_status_breakdown": _on_testdata(revenue.order_status_breakdown),
    "revenue_leakage_by_status": _on_testdata(revenue.revenue_leakage_by_status),
    "average_order_value": _on_testdata(revenue.average_order_value),
    "seller_cancellation_ranking": _on_testdata(revenue.seller_cancellation_ranking),
    "seller_cancellation_by_order": _on_testdata(revenue.seller_cancellation_by_order),
    "freight_margin_risk_items": _on_testdata(revenue.freight_margin_risk_items),
    "category_margin_risk": _on_testdata(revenue.category_margin_risk),
    # delivery
    "late_delivery_orders": _on_testdata(delivery.late_delivery_orders),
    "delivery_scorecard": _on_testdata(delivery.delivery_scorecard),
    "delivery_scorecard_by_order": _on_testdata(delivery.delivery_scorecard_by_order),
    # customers
    "rfm_scores": _on_testdata(lambda t: customers.rfm_scores(t, AS_OF)),
    "rfm_segments": _on_testdata(lambda t: customers.rfm_segments(t, AS_OF)),
    "rfm_segment_summary": _on_testdata(lambda t: customers.rfm_segment_summary(t, AS_OF)),
    "cohort_retention": _on_testdata(customers.cohort_retention),
    "overall_retention": _on_testdata(customers.overall_retention),
    "overall_retention_by_person": _on_testdata(customers.overall_retention_by_person),
    # sellers
    "seller_category_benchmark": _on_testdata(sellers.seller_category_benchmark),
    "seller_classification": _on_testdata(sellers.seller_classification),
    "seller_classification_summary": _on_testdata(sellers.seller_classification_summary),
    "seller_classification_by_order": _on_testdata(sellers.seller_classification_by_order),
    # payments
    "payment_type_breakdown": _on_testdata(payments.payment_type_breakdown),
    "installment_satisfaction": _on_testdata(payments.installment_satisfaction),
    "payment_risk_tiers": _on_testdata(payments.payment_risk_tiers),
    "payment_risk_by_payment": _on_testdata(payments.payment_risk_by_payment),
    # executive summary, computed from the analyses above
    "kpi_dashboard": _on_testdata(lambda t: report.kpi_dashboard(t, AS_OF)),
    "kpi_dashboard_incremental": _on_testdata(lambda t: report.kpi_table(summary.incremental_figures(t, NEW_SINCE, AS_OF))),
    "recommendations": _on_testdata(lambda t: report.recommendations(t, AS_OF)),
    "dashboard_cards": _on_testdata(lambda t: report.dashboard_cards(t, AS_OF)),
}

_AS_OF_SQL = {"rfm_scores", "rfm_segments", "rfm_segment_summary", "kpi_dashboard", "kpi_dashboard_incremental", "recommendations", "dashboard_cards"}

ORACLE_SQL: dict[str, str] = {
    name: (getattr(oracle, name)(AS_OF) if name in _AS_OF_SQL else getattr(oracle, name)())
    for name in QUERIES
    if hasattr(oracle, name)
}
