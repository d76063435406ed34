"""Operator 6 [native]: quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements and one
failure bit per rule.  A policy is a named, versioned mask over those bits, so applying
or changing a policy never reads the texts again (``apply_policy``), and leaving one rule
out of a policy is a question about bits alone (``ablations``, one aggregation).  All of
it is built-in DataFrame functions; a text's own repetitions are found inside its row, so
no word or window is shuffled.

Defined results: null, empty or blank text has no words and fails ``few_words``; null
doc_id is kept as it is; repeated rows are judged one by one; other columns are ignored;
an empty table gives an empty ledger (and ablation rows with zero counts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import text_rows

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5


def fails() -> dict[str, Column]:
    """Rule name -> the condition over the measurements under which it fails; a rule's bit is its place here."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 10 * c("word_chars"),
        "repeated_lines": 100 * c("n_dup_lines") > 60 * c("n_lines"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "shouting": 100 * c("n_upper") > 60 * c("word_chars"),
    }


RULE_NAMES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "shouting")

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "web-2": RULE_NAMES,
}


def bit(rule: str) -> int:
    return 1 << RULE_NAMES.index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), use)[0]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows that the array holds twice or more."""

    def covered(grams: Column) -> Column:
        tagged = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(rows: Column) -> Column:
            twin = F.transform(
                rows,
                lambda r, i: F.when(
                    ((i > 0) & (F.get(rows, i - 1)["g"] == r["g"])) | F.coalesce(F.get(rows, i + 1)["g"] == r["g"], F.lit(False)),
                    r["i"],
                ),
            )
            return F.sort_array(F.filter(twin, lambda p: p.isNotNull()))

        return F.aggregate(
            let(tagged, places),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id and the measurements) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda s: F.struct(F.size(s).alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines")))
    n = F.length(text)
    found = text_rows(docs).select(
        "doc_id",
        by_words.alias("w"),
        by_lines.alias("s"),
        F.length(without(text, SPACES)).alias("word_chars"),
        (n - F.length(without(text, SYMBOLS))).alias("n_symbols"),
        (n - F.length(without(text, UPPER))).alias("n_upper"),
    )
    fields = ("w.n_words", "word_chars", "n_symbols", "s.n_dup_lines", "w.n_repeat_words", "s.n_lines", "n_upper")
    return found.select("doc_id", *(F.col(f).cast("long").alias(f.split(".")[-1]) for f in fields))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits`` (bit i set: rule i of RULE_NAMES failed)."""
    rules = fails()
    bits = sum((F.when(rules[r], F.lit(bit(r))).otherwise(F.lit(0)) for r in RULE_NAMES), F.lit(0))
    return measure(docs).withColumn("fail_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: str = "web-2") -> DataFrame:
    """The ledger with base_failed and the policy's verdict, from the bits alone."""
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base-1"))) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy) | mask("base-1"))) == 0
    )


def ablations(rows: DataFrame, policy: str = "web-2") -> DataFrame:
    """Per rule of the policy: documents it fails, and those that only it rejects.

    One pass and one row of counters per task; the counters are unpivoted afterwards.
    """
    whole = F.lit(mask(policy))
    failed = F.col("fail_bits").bitwiseAND(whole)
    counters = [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_or(failed), F.lit(0)).alias("any_bits")]
    for r in POLICIES[policy]:
        counters += [
            F.count_if(failed.bitwiseAND(F.lit(bit(r))) != 0).alias(f"fails_{r}"),
            F.count_if(failed == bit(r)).alias(f"only_{r}"),
        ]
    entries = [F.struct(F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only")) for r in POLICIES[policy]]
    return rows.agg(*counters).select(F.lit(policy).alias("policy"), "n", F.explode(F.array(*entries)).alias("e")).select("policy", "e.rule", "n", "e.n_failed", "e.n_only")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), grams AS (
  SELECT r, i, ws[i:i + 4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twins AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twins, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN covered c USING (r)
), f AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (100 * n_symbols > 10 * word_chars)::INT + 8 * (100 * n_dup_lines > 60 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (100 * n_upper > 60 * word_chars)::INT)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, fail_bits
FROM f
"""


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: the measurements, base_failed, kept and the ledger's bits."""
    return apply_policy(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "fail_bits"
    )
