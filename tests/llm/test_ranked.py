"""Operator 12 against brute force and its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import ranked

from .conftest import DOCS, WORDS, corpus, counted
from .llm_tables import SF, sf

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    """Every document scored for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, bag, sum(bag.values())) for i, bag in bags if bag]
    n_all, l_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        want = Counter(terms(text))
        scored = []
        for i, bag, n in bags:
            m = 100 - 25 + (25 * n * n_all) // l_all
            s = sum(q * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, q in want.items() if bag[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def questions(seed=2):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice(WORDS).title() for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    out += [(30, "same same a b c"), (30, "same same a b c"), (30, "another text of one id: one"), (31, None), (32, ""), (33, "?!, --"), (34, "nowhere"), (35, "ünï ÇÖDÉ £"), (None, "kedel"), (36, "kedel " * 50), (37, " ".join(WORDS * 3))]
    return out


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(questions(), "item_id long, text string")


@pytest.fixture(scope="module")
def want():
    return brute([(r[0], r[1]) for r in corpus()], questions())


def test_query_matches_brute_force(documents, items, want):
    assert counted(ranked.rank(documents, items).collect()) == counted(want)


def test_small_shards_and_blocks(documents, items, want, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD", 200)
    monkeypatch.setattr(ranked, "BLOCK", 60)
    monkeypatch.setattr(ranked, "FIRST", 1)
    assert counted(ranked.rank(documents, items).collect()) == counted(want)


def test_query_matches_sql(spark):
    got = ranked.rank(sf(spark, "documents"), sf(spark, "benchmark")).collect()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    cursor = con.execute(ranked.ORACLE_SQL)
    assert [d[0] for d in cursor.description] == ["item_id", "rank", "doc_id", "score"]
    assert counted(got) == counted(cursor.fetchall()) and got


def test_stops_before_the_end_and_not_at_a_tie(monkeypatch):
    """A list of falling impacts ends early; equal scores are read on until the smallest ids are sure."""
    monkeypatch.setattr(ranked, "FIRST", 1)
    n = 4000
    doc = np.arange(n, dtype=np.int32)
    impact = np.arange(n, 0, -1)
    index = ranked.Lists(np.tile(doc, 2), np.repeat([0, 1], n), np.tile(impact, 2), n, 2)
    reads = []
    plain = np.searchsorted
    monkeypatch.setattr(ranked.np, "searchsorted", lambda a, v, *r, **k: (reads.append(len(v)), plain(a, v, *r, **k))[1])
    docs, totals = index.best(np.array([0, 1]), np.array([2, 3]), 20)
    assert docs.tolist() == list(range(20)) and totals.tolist() == [5 * v for v in range(n, n - 20, -1)]
    assert sum(reads) < 200
    level = ranked.Lists(doc[::-1].copy(), np.zeros(n, int), np.full(n, 7), n, 1)
    docs, totals = level.best(np.array([0]), np.array([1]), 20)
    assert docs.tolist() == list(range(20)) and set(totals.tolist()) == {7}


def test_best_positions_count_direct_accesses():
    """Random lists: the result equals the full ranking whatever was skipped."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m = int(rng.integers(1, 300)), int(rng.integers(1, 8))
        table = rng.integers(0, 30, (m, n)) * (rng.random((m, n)) < 0.5)
        term, doc = np.nonzero(table)
        index = ranked.Lists(doc.astype(np.int32), term, table[term, doc], n, m)
        weights = rng.integers(0, 5, m)
        docs, totals = index.best(np.arange(m), weights, 10)
        full = weights @ table
        top = [i for i in np.lexsort((np.arange(n), -full)) if full[i] > 0][:10]
        assert docs.tolist() == top and totals.tolist() == full[top].tolist()


def test_empty_tables_and_clashing_columns(spark, documents, empty, items, want):
    assert ranked.rank(empty, items).collect() == []
    assert ranked.rank(documents, items.limit(0)).collect() == []
    clash = lambda df: df.select("*", *(F.lit("y").alias(c) for c in ("n", "terms", "counts", "x", "term", "q", "df", "weight", "shard", "block", "score", "rank")))
    assert counted(ranked.rank(clash(documents.drop("n")), clash(items)).collect()) == counted(want)


def test_a_repeated_id_counts_as_documents(spark):
    rows = [(1, "alpha beta", None, None, None)] * 30 + [(2, "gamma", None, None, None)]
    got = ranked.rank(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(5, "alpha")], "item_id long, text string"), k=25).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(n, 1) for n in range(1, 26)]
