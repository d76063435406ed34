"""Operator 11 against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import tiles

from .conftest import DOCS, WORDS, corpus, counted
from .llm_tables import sf
from .test_dedup import components


def found(df, **how):
    return counted(tiles.join(df, **how).select("doc_id", "n_shingles", "component_id").collect())


@pytest.fixture(scope="module")
def want():
    return counted(components([(r[0], r[1]) for r in corpus()], 5))


def test_join_matches_brute_force(documents, want):
    assert found(documents) == want


def test_join_on_the_table(spark):
    docs = sf(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == counted(components(rows, 5))


def edited(seed, n, changes):
    """Copies of one text, each with some words changed: linked with some of each other only."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(i) for i in range(80)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes)):
            words[rng.randrange(len(words))] = f"new{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    return rows


@pytest.mark.parametrize("cell", [4, 512])
def test_near_copies_around_the_threshold(spark, cell, monkeypatch):
    """Chains of links beside the centre are found in the cells, small or large."""
    monkeypatch.setattr(tiles, "CELL", cell)
    monkeypatch.setattr(tiles, "GROUP", 40)
    rows = edited(1, 70, 6) + [(1000 + r[0], *r[1:]) for r in edited(2, 60, 9)]
    got = found(spark.createDataFrame(rows, DOCS).repartition(4))
    assert got == counted(components([(r[0], r[1]) for r in rows], 5))
    assert len({c for _, _, c in got}) > 10


def test_many_exact_copies(spark):
    rows = [(i, "one two three four five six seven", None, None, None) for i in range(300)] + [(500, "ONE two three four five six seven", None, None, None), (501, "other", None, None, None)]
    got = found(spark.createDataFrame(rows, DOCS).repartition(5))
    assert got == counted([(i, 3, 0) for i in [*range(300), 500]] + [(501, 1, 501)])


def test_empty_and_clashing_columns(documents, empty, want):
    assert tiles.join(empty).collect() == []
    clash = documents.drop("n").select("*", *(F.lit("y").alias(c) for c in ("x", "n", "s", "t", "rep", "c", "salt", "set", "bits", "component_id", "_h")))
    assert found(clash) == want


def test_other_sizes_and_shares(documents):
    rows = [(r[0], r[1]) for r in corpus()]
    assert found(documents, size=4) == counted(components(rows, 4))


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = (int(v) for v in rng.integers(1, 900, 2))
        pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, k)) for k in (n, m))
        x, y = tiles.bitmap(a)[None, :], tiles.bitmap(b)[None, :]
        words = min(x.shape[1], y.shape[1])
        bound = tiles.overlap_bound(tiles.folded(x, words), tiles.folded(y, words), len(a), len(b))[0]
        both = len(np.intersect1d(a, b))
        assert both <= bound <= (len(a) + len(b)) // 2 and tiles.common(a, b) == both


def test_heads_of_linked_sets_share_enough():
    """The bound behind the first filter, over random linked pairs."""
    rng = np.random.default_rng(6)
    tried = 0
    while tried < 300:
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 62, n)
        b = np.concatenate((a[: max(1, int(n * rng.uniform(0.75, 1)))], rng.integers(0, 1 << 62, int(n * rng.uniform(0, 0.25)))))
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not tiles.linked(both, len(a), len(b), 80):
            continue
        tried += 1
        head = [s[: len(s) - tiles.least(len(s), 80) + 1 + len(s) // tiles.EXTRA] for s in (a, b)]
        for s in (a, b):
            assert len(np.intersect1d(*head)) >= 1 + tiles.least(len(s), 80) // tiles.EXTRA
