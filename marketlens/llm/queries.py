"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import bpe, brown, crf, decontaminate, html_text, minhash, negatives, quality, ranked, rlz, rules, suffix, tiles
from marketlens.llm.common import table

#: Vocabulary of the encoding query: the installed package's file, the same on every executor.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_h")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), size=4).drop("_h")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.report(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op10_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.join(table(spark, sf_dir, "documents")).drop("_h")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES = {q.__name__: q for q in (op1_quality_classifier, op2_minhash_dedup, op3_language_id, op4_bpe_round_trip, op5_substring_dedup, op6_quality_rules, op7_decontamination, op8_suffix_dedup, op9_html_text, op10_brown_scores, op11_jaccard_join, op12_ranked_search, op13_hard_negatives)}
ORACLE_SQL = {"op6_quality_rules": rules.ORACLE_SQL, "op12_ranked_search": ranked.ORACLE_SQL, "op13_hard_negatives": negatives.ORACLE_SQL}
