"""Operators 1, 3, 4, 6, 7, 9 and 10."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from .llm_tables import SF, sf
from pyspark.sql import functions as F

from marketlens.llm import bpe, brown, crf, decontaminate, html_text, quality, queries, rules
from marketlens.llm.common import crc_mod

from .conftest import DOCS, corpus, counted

VOCABULARY = queries.vocabulary_path()


# -- 4: encoding ------------------------------------------------------------------------
TEXTS = [
    "ΑΣ σΣ İstanbul ﬁ é don't I'LL 123 ½ x y a<|endoftext|>b <|startoftext|> \x1c\x1d z 你好 😀👍🏽",
    "x" * 300 + "hello" * 50,
    "́abc \x85 q",
    "ab" * 2000,
    "<|endoftext|><|endoftext|>",
    "it's we'll 'twas o'clock 3.14 a_b #tag @you",
]


def reference_codes(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def digests(ids, decoded):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_encoding_equals_the_tokenizer(spark, wide):
    rows = [r[:2] for r in corpus()] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    docs = wide.select("doc_id", "text", "kept", "x").union(spark.createDataFrame([(1000 + i, t, "", "") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string, x string"))
    want = [(i, *digests(*c)) for (i, _), c in zip(rows, reference_codes([t for _, t in rows]))]
    assert counted(bpe.round_trip(docs, VOCABULARY).collect()) == counted(want)


def test_encode_and_decode_apart(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, ""])]
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY)
    got = {r.doc_id: r.decoded for r in bpe.decode(coded.withColumn("more", F.lit(1)), VOCABULARY).collect()}
    assert got == {i: c[1] for (i, _), c in zip(rows, reference_codes([t for _, t in rows]))}


def test_encoding_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in sf(spark, "documents").select("doc_id", "text").collect()]
    want = [(i, *digests(*c)) for (i, _), c in zip(rows, reference_codes([t for _, t in rows]))]
    assert counted(queries.op4_bpe_round_trip(spark, SF).collect()) == counted(want)


def test_both_trees_merge_alike():
    tool = bpe.codec(VOCABULARY)
    for piece in (b"internationalization", b"a", b"aaaaaaaaaaaaaaaa", "äöüßéè".encode(), b"thththth"):
        flat, n = tool.symbols([piece])
        assert tool.merge_many(flat, n, 64)[0].tolist() == tool.merge_one(flat).tolist()


def test_small_cache_gives_the_same_codes(monkeypatch):
    texts = [(t or "").encode() for _, t, *_ in corpus()]
    want = bpe.Codec(VOCABULARY).encode(texts)
    monkeypatch.setattr(bpe, "_CACHE_PIECES", 20)
    tool = bpe.Codec(VOCABULARY)
    assert [tool.encode([t])[0] for t in texts] == want


# -- 6: rules ---------------------------------------------------------------------------
def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_rule_measurements(wide):
    got = rules.verdicts(wide).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert counted(got) == counted((r[0], *measures(r[1])) for r in corpus())
    for r in rules.verdicts(wide).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op6_quality_rules(spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({rules.ORACLE_SQL})").fetchall()
    assert counted(got.collect()) == counted(want)


def test_policies_and_ablations_come_from_the_bits(documents):
    rows = rules.ledger(documents).cache()
    bits = [r.fail_bits for r in rows.collect()]
    for policy, names in rules.POLICIES.items():
        mask = rules.mask(policy)
        assert rules.apply_policy(rows, policy).where("kept").count() == sum((b & (mask | rules.mask("base-1"))) == 0 for b in bits)
        got = {r.rule: (r.n, r.n_failed, r.n_only) for r in rules.ablations(rows, policy).collect()}
        assert got == {n: (len(bits), sum(bool(b & rules.bit(n)) for b in bits), sum((b & mask) == rules.bit(n) for b in bits)) for n in names}


def test_rules_run_no_python(documents):
    plan = rules.verdicts(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 7: decontamination ----------------------------------------------------------------------
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    windows: dict = {}
    for i, t in items:
        words = WORD.findall((t or "").encode().lower())
        for k in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[k : k + 13]), set()).add(i)
    out = []
    for i, t in docs:
        words = WORD.findall((t or "").encode().lower())
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if items_ := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= items_
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def test_contamination_matches_brute_force(spark, wide):
    texts = [r[1] for r in corpus()]
    part = lambda t, a, b: " ".join(t.split()[a:b])
    long = max((t for t in texts if t), key=len)
    items = [(1, part(long, 100, 130)), (2, part(long, 120, 140)), (3, "Two, WORDS"), (4, "one"), (5, None), (6, "--"), (7, part(texts[40] or "", 2, 30)), (7, part(texts[40] or "", 2, 30))]
    items += [(10, "a b c d a b c d a b c d a b"), (None, part(long, 300, 320)), (11, "words"), (12, "nothing of the kind is in there at all for sure you know that well")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(wide, benchmark).drop("n_spans").collect()
    assert counted(got) == counted(contamination([r[:2] for r in corpus()], items))
    kept = decontaminate.drop_contaminated(wide, benchmark)
    assert kept.columns == wide.columns
    assert counted(r[0] for r in kept.select(F.array("doc_id")).collect()) == counted((x[0],) for x in contamination([r[:2] for r in corpus()], items) if not x[5])


def test_blocks_of_items_give_the_same_result(spark, monkeypatch):
    want = queries.op7_decontamination(spark, SF).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (300,))
    monkeypatch.setattr(decontaminate, "GROUP_BLOCKS", 2)
    assert counted(queries.op7_decontamination(spark, SF).collect()) == counted(want)
    docs = [(r.doc_id, r.text) for r in sf(spark, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in sf(spark, "benchmark").select("item_id", "text").collect()]
    assert counted(r[:6] for r in want) == counted(contamination(docs, items))


def test_cleaned_text_loses_its_spans(spark):
    docs = spark.createDataFrame([(1, "Before it. " + " ".join(f"w{i}" for i in range(20)) + " and after."), (2, "nothing here")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, " ".join(f"W{i}" for i in range(20)))], "item_id long, text string")
    found = decontaminate.scan(docs, benchmark)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()} == {1: [(2, 22)], 2: []}
    cleaned = decontaminate.without_spans(found)
    assert {r.doc_id: r.cleaned for r in cleaned.collect()} == {1: "Before it.  and after.", 2: "nothing here"}


# -- 9: html ------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>var a="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li>About</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=menu><a href=x>More</a></div><!-- ad <p>no</p> -->
<main><article class="post"><header><h1>Real  title</h1></header><p>First&nbsp;para &lt;b&gt; <b>bold</b>ly<br>
here<p>Second<ul><li>one<li>two</ul><div class="ad">Buy now</div><form><p>Your mail</p><input name=q></form>
<aside>Aside</aside><blockquote>A quote &amp; so</blockquote><style>p{x:1}</style>
<section class="comments"><h2>Comments</h2><p>I like this one a lot and say so at length</p></section></article></main>
<div class="sidebar"><p>Side bar text that is rather long and has quite a few words in it</p></div><footer>&copy; me</footer></body>"""


def test_article_text():
    tree = html_text.grow(html_text.labelled_table())
    assert html_text.main_text(PAGE, tree) == "Real title\nFirst para <b> boldly here\nSecond\none\ntwo\nA quote & so"
    assert html_text.main_text("", tree) == "" == html_text.main_text("<script>never closed <p>x", tree)


def test_tree_learns_its_table():
    rows = html_text.labelled_table()
    tree = html_text.grow(rows)
    assert all(html_text.decide(tree, x) == y for x, y in rows)


def test_page_without_article_element():
    tree = html_text.grow(html_text.labelled_table())
    page = "<div><a href=a>Home</a> <a href=b>News</a></div><div class=content><h1>Title here</h1><p>" + "long text of words " * 20 + "</p><p>short.</p><p>" + "more text of words " * 20 + "</p></div><div>Copyright 2020</div>"
    assert html_text.main_text(page, tree).split("\n")[0] == "Title here"
    assert html_text.main_text(page, tree).count("\n") == 3 and "Copyright" not in html_text.main_text(page, tree)


def test_pages_of_the_table(spark):
    import html

    got = {r.page_id: r for r in queries.op9_html_text(spark, SF).collect()}
    for r in sf(spark, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_pages_with_nulls_and_extra_columns(spark):
    rows = [(1, "u", None, "t"), (None, None, "<p>a", "t"), (2, "u", "", "t"), (2, "u", "", "t")]
    got = html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id != None] == [""] * 3  # noqa: E711
    assert html_text.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- 10: language model ----------------------------------------------------------------------------
def base_scores(rows):
    counts: Counter = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        score = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(words), sum(counts[w] > 0 for w in words), n, round(score, 6)))
    return out


@pytest.mark.parametrize("head", [brown.HEAD, 40])
def test_base_scores_match_brute_force(wide, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)
    got = brown.scores(wide).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()
    assert counted(got) == counted(base_scores([r[:2] for r in corpus()]))


def test_model_beats_word_frequencies_on_held_out_texts(spark):
    row = queries.op10_brown_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert row[0] / row[2] > -3.87 and row[1] / row[2] < -4.09


def test_scores_without_training_texts(spark, empty):
    assert brown.scores(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in brown.scores(docs).collect())
    assert got == [(1, 0, 0.0, 0.0), (4, 0, 0.0, 0.0)]


def test_exchange_finds_alternating_classes(spark):
    """Words of one half are always followed by words of the other: two classes, and no word moves at the end."""
    rng = random.Random(1)
    halves = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    texts = [" ".join(rng.choice(halves[k % 2]) for k in range(400)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    counts = brown.materialize(brown.word_counts(docs), "test-counts")
    _, labels = brown.train(docs, counts)
    got = {r.w: (r.c, r.label) for r in labels.collect()}
    hashes = brown.signed(brown.Words(brown.pa.array([" ".join(halves[0] + halves[1])]), brown.LOWER).hash).tolist()
    assert len(got) == 60 and {w for w in got} == set(hashes)
    assert not {got[w][1] for w in hashes[:30]} & {got[w][1] for w in hashes[30:]}


def model_of(docs):
    counts = brown.materialize(brown.word_counts(docs), "test-counts")
    return counts, *brown.train(docs, counts)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, *model_of(docs)


def test_probabilities_sum_to_one(trained):
    """After every kind: all training words, the end of a text and one unseen word for each shape."""
    _, counts, model, labels = trained
    words = counts.where(F.col("w") != brown.END).join(labels.select("w", "label"), "w", "left").select("shape", "c", F.coalesce("label", F.lit(-1)).alias("label"))
    got = words.toPandas()
    shape, c, label = (np.append(got[k].to_numpy(), v) for k, v in (("shape", np.arange(brown.SHAPES)), ("c", np.zeros(brown.SHAPES)), ("label", np.full(brown.SHAPES, -1))))
    for before in (0, 5, brown.CLASSES - 1, brown.CLASSES, brown.CLASSES + 77, brown.KINDS - 1):
        sum_ = model.mixed(np.full(len(c), before), shape, c.astype(float), label).sum()
        end = model.weight * model.move[before, -1] + (1 - model.weight) * (model.end_count + brown.ADD) / model.total
        assert abs(sum_ + end - 1) < 1e-9


def brute_scores(rows, labels, head):
    """The model's log10 probability of each text, word by word from dictionaries. ``labels``: class by word hash."""
    train = [(t or "") for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    both = lambda t: (lambda w: list(zip(brown.signed(w.hash).tolist(), brown.shapes(w).tolist())))(brown.Words(brown.pa.array([t]), brown.LOWER))
    counts = Counter(x for t in train for x in both(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    end, k, s = brown.KINDS - 1, brown.CLASSES, brown.SHAPES
    kind = lambda x: labels[x[0]] if x[0] in labels else k + x[1]
    before_kind = lambda x: kind(x) if x[0] in head else k + x[1]
    pairs, firsts = Counter(), Counter()
    for t in train:
        last = end
        for x in both(t):
            pairs[last, kind(x)] += 1
            firsts[last] += 1
            last = before_kind(x)
        pairs[last, end] += 1
        firsts[last] += 1
    mass, kinds = Counter(), Counter()
    for x, c in counts.items():
        mass[kind(x)] += c
        kinds[kind(x)] += 1
    overall = {j: mass[j] + (0.1 if k <= j < end else 0) for j in range(end)} | {end: len(train)}
    whole, total = sum(overall.values()), n + 0.1 * (v + 1)

    def p(last, x):
        j = end if x is None else kind(x)
        move = (pairs[last, j] + 10 * overall[j] / whole) / (firsts[last] + 10)
        if x is None:
            return 0.92 * move + 0.08 * (len(train) + 0.1) / total
        c = counts[x]
        emitted = c / mass[j] if j < k else (c + 0.1) / (mass[j] + 0.1 * (kinds[j] + 1))
        return 0.92 * move * emitted + 0.08 * ((c + 0.1) if c else 0.1 / s) / total

    out = []
    for i, t in rows:
        last, sum_ = end, 0.0
        for x in both(t or ""):
            sum_ += math.log10(p(last, x))
            last = before_kind(x)
        out.append((i, round(sum_ + math.log10(p(last, None)), 6)))
    return out


@pytest.mark.parametrize("head", [brown.HEAD, 40])
def test_scores_match_brute_force(documents, monkeypatch, head):
    """Also with classes that only the join knows, repeated rows, ties, nulls and one long text."""
    monkeypatch.setattr(brown, "HEAD", head)
    monkeypatch.setattr(brown, "LEAST", 15)
    counts, model, labels = model_of(documents)
    known = {r.w: r.label for r in labels.collect()}
    among = set(model.head.sorted.tolist())
    assert len(known) > 40 and (len(among) <= 40 if head == 40 else set(known) <= among)
    got = brown.score(documents, counts, model, labels).select("doc_id", F.round("score", 6)).collect()
    rows = [r[:2] for r in corpus()]
    close = lambda pairs: sorted(((i is None, i or 0), s) for i, s in pairs)
    for (a, x), (b, y) in zip(close(map(tuple, got)), close(brute_scores(rows, known, among)), strict=True):
        assert a == b and abs(x - y) < 1e-4


def test_clustered_words_grow_with_the_corpus(spark, trained):
    docs, counts, _, labels = trained
    assert labels.count() == counts.where((F.col("c") >= brown.LEAST) & (F.col("w") != brown.END)).count()
    half = docs.where("doc_id % 2 = 0")
    fewer = brown.word_counts(half).where((F.col("c") >= brown.LEAST) & (F.col("w") != brown.END)).count()
    assert fewer < labels.count()


def test_contexts_merge_in_levels(trained, monkeypatch):
    docs, counts, model, _ = trained
    docs = docs.repartition(5)
    words = counts.where(F.col("w") != brown.END)
    top = model.head.sorted[np.argsort(model.head.order)]
    read = lambda: sorted((r.w, bytes(r.side), bytes(r.n)) for r in brown.contexts(docs, words, top).collect())
    one = read()
    monkeypatch.setattr(brown, "FAN", 2)
    monkeypatch.setattr(brown, "ENTRIES", 3000)
    monkeypatch.setattr(brown, "TOKENS", 2000)
    assert read() == one and len(one) > 100


# -- 3: language -------------------------------------------------------------------------------------
def test_held_out_languages(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.98 and 0 <= row[1] and row[2] <= 1


def test_languages_of_odd_texts(spark, wide, empty):
    langs = {r.lang_pred for r in crf.report(wide).collect()}
    assert langs <= {"en", "de", "und"}
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 -- 4!", "en"), (4, "42 … ©", "en"), (5, "plain words here", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in crf.identify(odd).select("doc_id", "lang_pred").collect()} == {1: "und", 2: "und", 3: "und", 4: "und", 5: "en"}
    assert crf.report(empty).count() == 0


def test_code_switched_words_are_labelled(spark):
    model = crf.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    text = "the thing of and that thble le queeuxai des ouieré les éeaux der die und nicht sch geheit"
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")
    assert [(r.lang, r.n) for r in crf.identify(docs, model).first().runs] == [("en", 6), ("fr", 6), ("de", 6)]


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than any limit, a rare one, and one whose texts are all long."""
    monkeypatch.setattr(crf, "STEPS", 20)
    rows = [(i, f"word{i % 203} {'abcdefghij'[i % 10] * 5}", f"l{i % 203}") for i in range(203 * 6)]
    rows += [(5000 + i, "zuvo qexi " * 2500, "long") for i in range(8)] + [(6000 + i, "tail wozu", "rare") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % crf.FOLDS != crf.HELD_OUT]
    assert {r[2] for r in train} >= {"long", "rare"}
    sample = crf.training_rows(docs, sample_bytes=1000).collect()
    assert {r.lang for r in sample} == {r[2] for r in train}
    assert sum(r.lang == "long" for r in sample) == 1 and {len(r.text) for r in sample if r.lang == "long"} == {25000}
    model = crf.train(docs)
    assert set(model.langs) == {r[2] for r in train}
    assert model.label(crf.pa.array(["zuvo qexi zuvo"]))[0] == ["long"]


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    e, move = rng.normal(size=(9, 3)), np.exp(rng.normal(size=(3, 3)))
    first = np.array([0, 4, 4, 9])
    moves = np.zeros((3, 3))
    got = crf.forward_backward(e, first, move, moves)
    want, pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 9)):
        total = 0.0
        part, part_pairs = np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.exp(sum(e[a + t, y] for t, y in enumerate(path))) * np.prod([move[x, y] for x, y in zip(path, path[1:])])
            total += p
            for t, y in enumerate(path):
                part[t, y] += p
            for x, y in zip(path, path[1:]):
                part_pairs[x, y] += p
        want[a:b], pairs = part / total, pairs + part_pairs / total
    assert np.allclose(got, want) and np.allclose(moves, pairs)


# -- 1: quality ------------------------------------------------------------------------------------
def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where(crc_mod("doc_id", 2) == 0)
    got = quality.classify(docs, train).join(labels.where(crc_mod("doc_id", 2) == 1), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    row = got.agg(F.avg(F.when(bad, (~F.col("kept")).cast("int"))), F.avg(F.when(~bad, F.col("kept").cast("int")))).first()
    assert row[0] > 0.97 and row[1] > 0.99


def test_sparse_sites_shrink_to_their_prior(spark):
    rows = [(i, i, f"h{i % 2}", "p", 0.9 if i % 2 else 0.02, 0.0) for i in range(200)]
    rows += [(900, 900, "h1", "rare", 0.3, 0.0), (901, 901, "new", "rare", 0.3, 0.0)]
    got = {r.doc_id: r for r in quality.decide(spark.createDataFrame(rows, "doc_id long, _h long, host string, path string, p_low double, p_toxic double")).collect()}
    assert got[1].host_rate > 0.8 and got[0].host_rate < 0.1
    assert got[900].path_rate > got[901].path_rate  # a new path leans on its host, a new host on all
    assert got[900].p_reject > got[901].p_reject


def test_sample_holds_the_rare_labels(spark):
    """Ten label rows an id, 8 toxic ids of 2,000: 200 ids are used, all toxic ones among them."""
    docs = spark.createDataFrame([(i, "plain words of a text", "s", "en") for i in range(2000)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 250 == 7)) for i in range(2000) for _ in range(10)], "doc_id long, quality int, toxic int")
    rows = quality.training_rows(docs, labels, 200).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 200 and sum(r.toxic for r in rows) == 8
    model = quality.train(docs, labels, 200)
    p = model.predict(quality.Measured(quality.pa.array(["plain words of a text"])))[0]
    assert abs(p[1] - 8 / 2000) < 0.0005 and p[0] < 0.01
    assert quality.deal([1, 100, 5], 30) == [1, 24, 5] and quality.deal([3, 4], 100) == [3, 4]


def test_classifier_takes_odd_tables(spark, wide, empty):
    labels = spark.createDataFrame([(i, i % 5 and 1, 0) for i in range(40)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    out = quality.classify(wide, labels)
    assert out.count() == wide.count() and out.where("kept is null or p_reject is null").count() == 0
    kept = quality.keep_good(wide, labels)
    assert kept.columns == wide.columns and kept.count() == out.where("kept").count()
    none = spark.createDataFrame([], labels.schema)
    assert quality.classify(wide, none).count() == wide.count()
    assert quality.classify(empty, none).count() == 0


# -- all -------------------------------------------------------------------------------------------
def test_empty_tables(spark, empty):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert bpe.round_trip(empty, VOCABULARY).count() == 0
    assert rules.verdicts(empty).count() == 0
    assert decontaminate.report(empty, benchmark).count() == 0
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    assert decontaminate.report(docs, benchmark).first().contaminated is False
