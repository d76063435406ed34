"""CSV ingest: quoting, embedded newlines, blanks, malformed rows, both modes."""

from __future__ import annotations

import os

import pytest

from marketlens.operators import quality
from marketlens.sources.csv import corrupt_row_counts, ingest_csv, load_csv, read_csv
from marketlens.sources.schemas import SCHEMAS

FILES = {
    "customers": ["c1,u1,01001,sao paulo,SP", "c2,u1,01001,sao paulo,SP"],
    "orders": [
        "o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,2018-01-02 00:00:00,2018-01-09 12:00:00,2018-01-10 00:00:00",
        "o2,c2,delivered,2018-01-02 10:00:00,,,,2018-01-12 00:00:00",
    ],
    "order_items": ["o1,1,p1,s1,2018-01-03 00:00:00,10.50,2.25", "o2,1,p1,s1,2018-01-04 00:00:00,20.00,30.00"],
    "products": ["p1,cat,10,,1,100,1,1,1"],
    "sellers": ["s1,02002,rio,RJ"],
    "payments": ["o1,1,credit_card,3,12.75", "o2,1,boleto,1,50.00"],
    "reviews": [
        'r1,o1,5,"Great ""item""","line one',
        'line two",2018-01-11 00:00:00,2018-01-12 00:00:00',
        "r2,o2,notanint,t,m,2018-01-13 00:00:00,2018-01-14 00:00:00",
    ],
    "geolocation": ["01001,-23.550000000000000,-46.630000000000000,sao paulo,SP"],
}


@pytest.fixture()
def csv_paths(tmp_path):
    paths = {}
    for table, lines in FILES.items():
        header = ",".join(f.name for f in SCHEMAS[table])
        p = tmp_path / f"{table}.csv"
        p.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
        paths[table] = str(p)
    return paths


def test_lenient_load(spark, csv_paths):
    t = load_csv(spark, csv_paths, lenient=True)
    counts = quality.table_row_counts(t).first().asDict()
    assert counts == {"customers": 2, "orders": 2, "order_items": 2, "products": 1, "sellers": 1, "payments": 2, "reviews": 2, "geolocation": 1}
    r1 = t.reviews.where("review_id = 'r1'").first()
    assert r1.review_comment_title == 'Great "item"' and r1.review_comment_message == "line one\nline two"
    o2 = t.orders.where("order_id = 'o2'").first()
    assert o2.order_approved_at is None and o2.order_delivered_customer_date is None
    assert t.products.first().product_description_length is None
    assert str(t.order_items.where("order_id = 'o1'").first().price) == "10.50"
    assert [f.dataType for f in t.orders.schema] == [f.dataType for f in SCHEMAS["orders"]]
    bad = {r.table_name: r.corrupt_rows for r in corrupt_row_counts(spark, csv_paths).collect()}
    assert bad["reviews"] == 1 and sum(bad.values()) == 1


def test_strict_load_fails_on_malformed_row(spark, csv_paths):
    t = load_csv(spark, csv_paths, lenient=False)
    assert t.orders.count() == 2  # well-formed tables read fine
    with pytest.raises(Exception):
        t.reviews.collect()


def test_ingest_publishes_bucketed_marts(spark, csv_paths, tmp_path):
    t = ingest_csv(spark, csv_paths, str(tmp_path / "marts"), buckets=4)
    assert t.order_items.count() == 2 and t.reviews.count() == 2
    audit = {r.table_name: r.duplicate_rows for r in quality.key_uniqueness_audit(t).collect()}
    assert audit == {"customers": 0, "orders": 0, "products": 0, "sellers": 0}
    # With broadcasting off (as for two large tables), the join of two
    # order-keyed marts reads co-located buckets and needs no shuffle.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = t.order_items.join(t.orders, "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Exchange" not in plan, plan


# ---------------------------------------------------------------- records over many lines, read in splits

def _review_csv(path, n=400):
    import csv

    rows = [(f"r{i}", f"o{i}", str(i % 5 + 1), "t" * (i % 7), ["plain", "two\nlines", 'a "quote"\nand, comma\n\nblank', "", "x\n" * (i % 40)][i % 5], "2018-01-01 00:00:00", "2018-01-02 03:04:05") for i in range(n)]
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow([f"c{i}" for i in range(7)])
        out.writerows(rows)
    return rows


@pytest.mark.parametrize("split_bytes", ["134217728", "3000", "300", "64"])
def test_records_that_cross_splits(spark, tmp_path, split_bytes):
    """The same rows whatever the size of the splits, many of which lie inside one quoted field."""
    os.makedirs(tmp_path / "csv")
    rows = _review_csv(tmp_path / "csv" / "a.csv") + _review_csv(tmp_path / "csv" / "b.csv", 30)
    settings = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "0"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = read_csv(spark, "reviews", str(tmp_path / "csv")).collect()
        parts = spark.read.text(str(tmp_path / "csv")).rdd.getNumPartitions()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert split_bytes != "300" or parts > 50
    want = sorted((r[0], r[1], int(r[2]), r[3] or None, r[4] or None) for r in rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.review_id, r.order_id, r.review_score, r.review_comment_title, r.review_comment_message) for r in got), key=key) == sorted(want, key=key)
    assert all(r._corrupt_record is None for r in got)


def test_split_records_equal_the_whole_reader(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    with open(path, "wb") as f:
        f.write(b'h,o,s,t,m,c,a\r\n"r1","o1",5,"x","one\r\ntwo",2018-01-01 00:00:00,\r\n\r\nr2,o2,bad,,,2018-13-01 00:00:00,2018-01-01 00:00:00\r\nr3,o3,1\r\n')
    split, whole = (sorted(map(str, ((r.review_id, r.review_score, r.review_creation_date, r._corrupt_record is None) for r in read_csv(spark, "reviews", path, whole_files=w).collect()))) for w in (False, True))
    assert split == whole and len(split) == 3 and sum("False" in r for r in split) == 2
    with pytest.raises(Exception):
        read_csv(spark, "reviews", path, lenient=False).collect()
