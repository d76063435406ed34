"""Operators 2, 5 and 8 against brute force, on messy and on small real tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from .llm_tables import sf
from pyspark.sql import functions as F

from marketlens.llm import bwt, graph, minhash, rlz, suffix

from .conftest import corpus, counted


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(rows, size):
    """Brute force: (doc_id, number of shingles, component) of every row."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = list({(i, s) for i, s in sets if s and i is not None})
    for n, (i, a) in enumerate(some):
        for j, b in some[:n]:
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


@pytest.mark.parametrize("size", [4, 5])
def test_groups_match_brute_force(documents, size):
    got = minhash.groups(documents, size).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = [(i, n, c, i is None or i == c) for i, n, c in components([(r[0], r[1]) for r in corpus()], size)]
    assert counted(got) == counted(want)


def test_groups_on_the_table(spark):
    docs = sf(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = minhash.groups(docs, 4).select("doc_id", "n_shingles", "component_id").collect()
    assert counted(got) == counted(components(rows, 4))


def test_chain_of_links_is_one_group(spark):
    """Neighbours are linked, the ends of the chain are not: one component."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:i] + [f"edit{i}{j}" for j in range(0)] + base[i * 2 :]) for i in range(0, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.groups(docs, 4).collect()}
    assert got == {i: c for i, _, c in components(list(enumerate(texts)), 4)}


def test_keep_one_keeps_columns_and_one_row_of_each_group(wide):
    got = minhash.keep_one(wide, 5)
    assert got.columns == wide.columns
    ids = [r.doc_id for r in got.collect()]
    want = {i for i, _, c in components([(r[0], r[1]) for r in corpus()], 5) if i == c and i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2
    assert all((r.kept_id, r.kept_hash, r.cut_text) == ("7", "8", "9") for r in got.collect())


def removed_words(rows, window):
    """Brute force: per row (n_words, n_removed, sha256 of the kept words)."""
    first: dict = {}
    for i, t in rows:
        words = (t or "").encode().split()
        if i is not None:
            for k in range(len(words) - window + 1):
                w = tuple(words[k : k + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("table", ["documents", "wide"])
def test_substring_dedup_matches_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = rlz.deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert counted(got) == counted(removed_words([(r[0], r[1]) for r in corpus()], rlz.WINDOW))


def test_substring_dedup_on_the_table(spark):
    docs = sf(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert counted(rlz.report(docs).drop("n_factors").collect()) == counted(removed_words(rows, 50))


def test_factors_point_at_equal_earlier_words(documents):
    words = {r[0]: (r[1] or "").encode().split() for r in corpus()[:-3]}
    seen = 0
    for r in rlz.deduplicate(documents).where(F.size("factors") > 0).collect():
        for f in r.factors:
            seen += 1
            a, b = words[r.doc_id], words[f.ref_doc]
            assert f.ref_doc < r.doc_id and f.length >= rlz.WINDOW
            assert a[f.start : f.start + f.length] == b[f.ref_start : f.ref_start + f.length]
    assert seen > 5


def test_clean_keeps_rows_and_columns_and_cuts_text(wide):
    got = rlz.clean(wide)
    assert got.columns == wide.columns and got.count() == wide.count()
    assert all((r.kept_id, r.kept_hash, r.cut_text) == ("7", "8", "9") for r in got.collect())
    want = Counter()
    for i, n, gone, _ in removed_words([(r[0], r[1]) for r in corpus()], rlz.WINDOW):
        want[i] += n - gone
    have = Counter()
    for r in got.collect():
        have[r.doc_id] += len((r.text or "").encode().split())
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in want.items() if v}


def removed_bytes(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(t[k : k + length] for _, t in raw for k in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_halves_keep_every_string_once():
    """All strings of a block, each in one half; equal strings have equal keys."""
    import pyarrow as pa

    length, k = 20, 6
    rng = random.Random(8)
    strings: dict = {}
    for r in range(40):
        gram = rng.randrange(0, length - k + 1)
        left, right = "".join(rng.choice("ab") for _ in range(gram)), "".join(rng.choice("ab") for _ in range(length - k))
        block = (left + "GRAMMY" + right[: rng.randrange(length - k - gram, length - k + 1)]).encode()
        for i in range(len(block) - length + 1):
            strings[r, i] = block[i : i + length]
        parts = [(r, 0, 0, gram, 7, block, 0, length - k)]
        got = {}
        while parts:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), suffix.PART_TYPES)], suffix.PART_NAMES)
            out = [row for made in suffix.halved(length)(iter([batch])) for row in made.to_pylist()]
            parts = []
            for row in out:
                assert row["block"][row["gram"] : row["gram"] + 6] == b"GRAMMY"
                if row["a"] == row["b"]:
                    assert len(row["block"]) == length and (r, row["start"]) not in got
                    got[r, row["start"]] = row["key"]
                else:
                    parts.append(tuple(row[n] for n in suffix.PART_NAMES))
        assert set(got) == {key for key in strings if key[0] == r}
        strings |= {(key, "k"): v for key, v in got.items()}
    keys = {}
    for (r, i), text in [x for x in strings.items() if x[0][1] != "k"]:
        assert keys.setdefault((text.find(b"GRAMMY"), text), strings[(r, i), "k"]) == strings[(r, i), "k"]
    assert len(set(keys.values())) == len(keys)


@pytest.mark.parametrize("group_bytes", [suffix.GROUP_BYTES, 1500, 400])
def test_suffix_dedup_matches_brute_force(documents, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix, "GROUP_BYTES", group_bytes)
    got = suffix.report(documents).collect()
    assert counted(got) == counted(removed_bytes([(r[0], r[1]) for r in corpus()], suffix.LENGTH))


def test_suffix_dedup_on_the_table(spark):
    docs = sf(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert counted(suffix.report(docs).collect()) == counted(removed_bytes(rows, 200))


@pytest.mark.parametrize("length", [1, 2, 3, 7, 20])
def test_interval_expansion(length):
    import random

    rng = random.Random(length)
    for _ in range(60):
        letters = rng.choice([b"ab", b"abc", bytes(range(256)), b"\0a", b"a"])
        base = bytes(rng.choice(letters) for _ in range(50))
        blocks = [bytes(rng.choice(letters) for _ in range(rng.randrange(25))) + base[rng.randrange(40) :][: rng.randrange(30)] for _ in range(rng.randrange(1, 7))]
        counts = Counter(b[i : i + length] for b in blocks for i in range(len(b) - length + 1))
        want = [[i for i in range(len(b) - length + 1) if counts[b[i : i + length]] > 1] for b in blocks]
        assert [list(x) for x in bwt.repeated_windows(blocks, length)] == want


def test_empty_tables(empty):
    assert minhash.groups(empty).count() == 0
    assert minhash.keep_one(empty).columns == empty.columns
    assert rlz.report(empty).count() == 0
    assert rlz.clean(empty).count() == 0
    assert suffix.report(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(3, 1), (2, 3), (7, 7), (90, 5), (5, 90), (91, 90), (91, 92)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 1: 1, 2: 1, 3: 1, 5: 5, 90: 5, 91: 5, 92: 5}
