"""The five stages against brute force, stage by stage."""

from __future__ import annotations

import corpus_pipeline
import pytest

from marketlens.llm import quality
from marketlens.llm.common import table

from .conftest import counted
from .test_dedup import components, removed_words
from .test_text import contamination, digests, reference_codes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and what it made."""
    docs, out = table(spark, SF, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(spark, stages):
    columns = table(spark, SF, "documents").dtypes
    assert all(made.dtypes == columns for _, made in stages[:-1])
    assert [made.count() for _, made in stages][0] < 200


def test_quality_stage(spark, stages):
    docs, made = stages[0]
    kept = {r.doc_id for r in quality.classify(docs, table(spark, SF, "labels")).where("kept").collect()}
    assert counted(pairs(made)) == counted(p for p in pairs(docs) if p[0] in kept)


def test_near_dedup_stage(stages):
    docs, made = stages[1]
    kept = {i for i, _, c in components(pairs(docs), 5) if i == c}
    assert counted(pairs(made)) == counted(p for p in pairs(docs) if p[0] in kept)


def test_substring_stage(stages):
    docs, made = stages[2]
    want = {i: n - gone for i, n, gone, _ in removed_words(pairs(docs), 50)}
    assert {i: len((t or "").encode().split()) for i, t in pairs(made)} == want
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_decontamination_stage(spark, stages):
    docs, made = stages[3]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {x[0] for x in contamination(pairs(docs), items) if x[5]}
    assert bad and counted(pairs(made)) == counted(p for p in pairs(docs) if p[0] not in bad)


def test_encoding_stage(stages):
    docs, made = stages[4]
    rows = pairs(docs)
    want = [(i, *digests(*c)) for (i, _), c in zip(rows, reference_codes([t for _, t in rows]))]
    assert counted(made.collect()) == counted(want)


def test_run_gives_the_last_stage(spark, stages):
    assert counted(corpus_pipeline.run(spark, SF).collect()) == counted(stages[-1][1].collect())
