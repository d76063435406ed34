"""The mergeable summary: states of parts merge to the state of all, written or not."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from marketlens.functions import rules as R
from marketlens.operators import report, summary
from marketlens.plans.registry import AS_OF
from marketlens.sources.tables import from_rows
from marketlens.sources.testdata import from_testdata

@pytest.fixture(scope="module")
def t(spark):
    return from_testdata(spark, SF001)


@pytest.fixture(scope="module")
def last_day(t):
    return str(t.orders.agg(F.to_date(F.max("order_purchase_timestamp"))).first()[0])


def _same(a, b):
    """All columns of the figures rows, as text (sums of decimals are exact, so nothing is rounded)."""
    return [str(r) for r in a.collect()] == [str(r) for r in b.collect()]


def test_parts_hold_every_row_once(t):
    before, after = summary.split_by_purchase(t, "1997-01-01")
    for name, df in t.as_dict().items():
        a, b = getattr(before, name), getattr(after, name)
        assert a.count() + b.count() == df.count()
    assert after.orders.count() > 100 and after.products.count() == after.sellers.count() == 0


@pytest.mark.parametrize("since", ["1992-01-01", "1995-06-17", "2030-01-01"])
def test_merged_figures_equal_the_whole(t, since):
    assert _same(summary.incremental_figures(t, since, AS_OF), summary.figures(t, AS_OF))


def test_a_day_is_added_to_a_written_state(spark, t, last_day, tmp_path):
    root = str(tmp_path / "state")
    before, day = summary.split_by_purchase(t, last_day)
    assert 0 < day.orders.count() < 20
    summary.write_state(summary.state_of(before), root)
    new = str(tmp_path / "new")
    for name, df in day.as_dict().items():
        df.write.parquet(f"{new}/{name}")
    from marketlens.sources.tables import from_parquet

    arrived = from_parquet(spark, new)
    pending = summary.merged(summary.open_state(spark, root), summary.state_of(arrived))
    read = {f for df in pending.as_dict().values() for f in df.inputFiles()}
    assert read and all(f"{root}/data/" in f or f"{new}/" in f for f in read)  # nothing of the old orders
    state = summary.add_to_state(arrived, root)
    figures = summary.figures_of(state, AS_OF)
    assert _same(figures, summary.figures(t, AS_OF))
    assert report.kpi_table(figures).collect() == report.kpi_dashboard(t, AS_OF).collect()
    assert report.recommendation_rows(figures).collect() == report.recommendations(t, AS_OF).collect()
    assert report.card_rows(figures).collect() == report.dashboard_cards(t, AS_OF).collect()
    old = summary.figures_of(summary.open_state(spark, root, version=1), AS_OF)
    assert _same(old, summary.figures(before, AS_OF))


def test_a_state_of_other_rules_is_refused(spark, t, tmp_path):
    root = str(tmp_path / "state")
    other = summary.SummaryRules(delivery=R.DeliveryRule(slight_days=3, very_days=10))
    summary.write_state(summary.state_of(t, other), root, other)
    with pytest.raises(ValueError):
        summary.open_state(spark, root)
    assert _same(summary.figures_of(summary.open_state(spark, root, other), AS_OF, other), summary.figures(t, AS_OF, other))


def test_messy_orders_merge(spark):
    """Null statuses, dates, prices and keys, several reviews, orphans, sellers that sell nothing."""
    at = lambda y: dt.datetime(y, 5, 1)
    orders = [(f"o{i}", f"c{i}", ["delivered", "canceled", None, "invoiced"][i % 4], at(1996 + i % 3) if i % 7 else None, None, None, at(1996 + i % 3) + dt.timedelta(days=i), at(1996 + i % 3) + dt.timedelta(days=10)) for i in range(60)]
    items = [(f"o{i}", n, f"p{i % 3}" if i % 5 else None, f"s{i % 2}" if i % 11 else None, None, D(i) if i % 9 else None, D(i % 13)) for i in range(70) for n in range(1 + i % 2)]
    t = from_rows(
        spark,
        orders=orders,
        customers=[(f"c{i}", f"u{i // 2}" if i % 8 else None, "Z", "x", "S") for i in range(55)],
        order_items=items,
        products=[("p0", "a", 1, 1, 1, 1, 1, 1, 1), ("p1", None, 1, 1, 1, 1, 1, 1, 1), ("p1", "b", 1, 1, 1, 1, 1, 1, 1)],
        sellers=[("s0", "Z", "c", "S"), ("s1", "Z", "c", "S"), ("s7", "Z", "c", "S"), (None, "Z", "c", "S")],
        payments=[(f"o{i}", 1, ["credit_card", "voucher", None][i % 3], i % 12 if i % 4 else None, D(100 * i)) for i in range(65)],
        reviews=[(f"r{i}", f"o{i % 40}", i % 6 or None, None, None, None, None) for i in range(50)],
    )
    whole = summary.figures(t, "1999-01-01")
    assert _same(summary.incremental_figures(t, "1997-03-01", "1999-01-01"), whole)
    empty = from_rows(spark)
    assert _same(summary.figures_of(summary.merged(summary.state_of(t), summary.state_of(empty)), "1999-01-01"), whole)
    assert summary.figures(empty, "1999-01-01").count() == 1
