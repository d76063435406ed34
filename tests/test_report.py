"""The computed summary: published names, own thresholds, and how often it reads its tables."""

from __future__ import annotations

import datetime as dt
import html
import os
import re
from pathlib import Path

import pytest
from conftest import SF001

from marketlens.functions import rules as R
from marketlens.operators import delivery, report
from marketlens.plans import registry
from marketlens.sources.marts import publish_marts
from marketlens.sources.testdata import from_testdata

#: The published page, where the environment names it.
PAGE = Path(os.environ.get("MARKETLENS_PAGE", "/nonexistent"))


@pytest.mark.skipif(not PAGE.exists(), reason="the published page is not here")
def test_cards_equal_the_page(spark):
    """Sections, labels, tones, order and which cards have notes, read from the page."""
    text = PAGE.read_text(encoding="utf-8")
    want = []
    for part in text.split('<div class="section">')[1:]:
        section = html.unescape(re.search(r'class="section-tag[^"]*">([^<]*)<', part).group(1))
        for card in part.split('<div class="findings">')[0].split('<div class="card ')[1:]:
            tone = card.split('"')[0]
            label = html.unescape(re.search(r'card-label">([^<]*)<', card).group(1))
            want.append((section, label, tone, "card-note" in card))
    got = registry.QUERIES["dashboard_cards"](spark, SF001).orderBy("position").collect()
    assert [(r.section, r.label, r.tone, r.note != "") for r in got] == want


def test_thresholds_reach_the_summary(spark):
    t = from_testdata(spark, SF001)
    as_of = registry.AS_OF
    rules = report.SummaryRules(delivery=R.DeliveryRule(slight_days=3, very_days=10), payment=R.PaymentRiskRule(high=(5, 50.0)))
    kpis = {r.kpi: r.value_num for r in report.kpi_dashboard(t, as_of, rules).collect()}
    tiers = {r.delivery_tier[0]: r for r in delivery.delivery_scorecard(t, rules.delivery).collect()}
    assert kpis["Critically Late Avg Review Score"] == tiers["4"].avg_review_score
    from marketlens.operators import payments

    exposure = {r.payment_risk_tier: r.total_exposure for r in payments.payment_risk_tiers(t, rules.payment).collect()}
    assert kpis["High Risk Instalment Exposure"] == exposure[R.PAY_HIGH]


def test_recommendation_five_comes_from_the_data(spark):
    t = from_testdata(spark, SF001)
    late = {}
    for r in delivery.late_delivery_orders(t, k=None).dropDuplicates(["order_id"]).collect():
        if r.days_late > 30:
            late.setdefault(r.actual_delivery, []).append(r.days_late)
    n, on = max((len(v), k) for k, v in late.items())
    row = registry.QUERIES["recommendations"](spark, SF001).where("priority = '5'").first()
    assert row.evidence == f"{n} orders {min(late[on])}-{max(late[on])} days late all sharing the delivery date {on}"


def test_building_a_report_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    t = from_testdata(spark, SF001)
    spark.sparkContext.setJobGroup("building", "no jobs")
    try:
        delivery.late_delivery_orders(t)
        report.figures(t, dt.date(2001, 8, 31))
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _scans(df) -> list[str]:
    """Names of the tables that the plan scans, once for each scan."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    found = re.findall(r"FileScan parquet .*?Location: [^\n]*?/(\w+)\]", plan)
    assert len(found) == plan.count("FileScan parquet"), "a location is cut or has another form"
    return found


def test_scans_of_the_summary(spark, tmp_path):
    """With automatic broadcasts off, as for large tables."""
    root = str(tmp_path / ("a long folder name " * 6).replace(" ", "-") / "m")
    publish_marts(from_testdata(spark, SF001), root)
    registry.use_marts(SF001, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else long paths are cut
    try:
        audit = _scans(registry.QUERIES["orphan_and_length_audit"](spark, SF001))
        df = registry.QUERIES["kpi_dashboard"](spark, SF001)
        df.collect()  # the plan that ran reads a repeated part once
        kpi = _scans(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        registry.use_marts(SF001, None)
    assert len(audit) == 12, audit
    assert {t: kpi.count(t) for t in ("orders", "reviews", "payments")} == {t: min(2, kpi.count(t)) for t in ("orders", "reviews", "payments")}, kpi
    assert len(kpi) == 13, kpi
