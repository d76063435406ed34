"""Operator 13 against brute force and its SQL."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import negatives

from .llm_tables import SF, sf

SCHEMA = "vec_id long, embedding array<float>, label int"


def floats(x):
    return [float(np.float32(v)) for v in x]


def brute(rows, positives=5, count=10):
    """The contract, row by row."""
    kept = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(v is None or not math.isfinite(v) for v in e):
            continue
        kept[(i, label, tuple(floats(e)))] = (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * v) for v in floats(e)])
    vectors = list(kept.values())
    out = set()
    for i, label, a in vectors:
        if i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in vectors))
        best = [(j, -s) for s, j, other in scored if other == label and j != i][:positives]
        for j, p in best:
            fit = [(k, -s) for s, k, other in scored if other != label and 30 * p <= -100 * s <= 90 * p][:count]
            out |= {(i, j, n, k, p, s) for n, (k, s) in enumerate(fit, 1)}
    return out


def messy(seed=5, n=700):
    rng = random.Random(seed)
    near = [[rng.gauss(0, 0.2) for _ in range(20)] for _ in range(4)]
    rows = [(i, [v + rng.gauss(0, 0.1) for v in near[i % 4]], rng.randrange(10)) for i in range(n)]
    rows += [(i, rows[3][1], i % 3) for i in range(1000, 1200)]  # one vector, many times
    rows += [rows[0], rows[100], rows[1]]  # repeated rows
    rows += [(200, [0.5] * 20, 1), (2000, None, 1), (2100, [1.0, None], 2), (2200, [float("nan")] * 20, 1), (2300, [float("inf")] * 20, 1), (2400, [0.1] * 20, None), (None, [0.1] * 20, 3), (2500, [], 4), (2600, [0.3] * 9, 4), (2700, [300.0, -200.0], 4)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return messy()


def found(spark, rows, schema=SCHEMA):
    return [tuple(r) for r in negatives.report(spark.createDataFrame(rows, schema).repartition(3)).collect()]


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for top in (3, 200, 1 << 20, 1 << 40):
        for wide in (1, 8, 13, 64):
            a, c = (rng.integers(-top, top, (n, wide)) for n in (70, 3000))
            pad = ((0, 0), (0, -wide % 8))
            want = a.astype(object) @ c.T.astype(object)
            assert (negatives.scores(np.pad(a, pad), np.pad(c, pad)) == np.clip(want, -(2**63) + 1, 2**63 - 1)).all()


def test_huge_components_saturate():
    import pyarrow as pa

    v = negatives.integers(pa.array([[1e30, -1e30], [0.5, 1e308], [-1.0, 0.0]], pa.list_(pa.float64())), 256)
    assert v[0].tolist()[:2] == [int(1e30) * 256, -int(1e30) * 256] and v[1].tolist()[:2] == [128, int(1e308) * 256]
    got = negatives.scores(v, v)
    assert got[0].tolist()[:2] == [2**63 - 1, -(2**63) + 1] and got[2][2] == 65536


def test_query_matches_brute_force(spark, rows):
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_many_small_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    assert set(found(spark, rows)) == brute(rows)


def test_query_matches_sql(spark):
    got = {tuple(r) for r in negatives.report(sf(spark, "embeddings")).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    cursor = con.execute(negatives.ORACLE_SQL)
    assert [d[0] for d in cursor.description] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got == set(cursor.fetchall()) and got


def test_empty_and_clashing_columns(spark, rows):
    assert found(spark, []) == []
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *(F.lit("y").alias(c) for c in ("x", "a", "c", "anchor", "found", "nth", "other", "rank", "anchor_id")))
    assert {tuple(r) for r in negatives.report(clash).collect()} == brute(rows)


def test_bands_and_counts_are_parameters(spark, rows):
    df = negatives.relabelled(spark.createDataFrame(rows, SCHEMA))
    got = negatives.mine(df, F.col("vec_id") == 100, n_positives=2, n_negatives=3, low=0, high=50).collect()
    assert got and all(0 <= 100 * r.negative_score <= 50 * r.positive_score for r in got) and max(r.rank for r in got) == 3
    assert len({r.positive_id for r in got}) <= 2
