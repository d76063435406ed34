"""Small hand-made tables for the corpus operators."""

from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti") for b in ("ban", "del", "for", "gus", "hem", "jol", "kat", "lim")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = "kept string, _h string, start string, key string, n string, x string, component_id string, kept_id string, kept_hash string, cut_text string, r string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", ",", ".")) for _ in range(n))


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, ties, nulls, empty and long texts."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts: list[str | None] = [prose(rng, rng.randrange(5, 160)) for _ in range(n)]
    texts += [texts[i] for i in (1, 1, 2, 5)]  # exact copies
    for i in (3, 4, 4, 6):  # near copies
        words = texts[i].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    for _ in range(6):  # a passage within different texts
        texts.append(prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 25))
    texts += [None, "", "  \t\n", "one", "two words", "Ünï çödé £ " * 40, "same same " * 200, prose(rng, 4000), "x" * 3000, "a b c d " * 120]
    texts += ["tail " + "a b c d " * 120, texts[-3], "\x00 zero\x0b vertical"]
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[62]]  # repeated rows
    rows += [(None, texts[1], "en", "src1", 1), (None, None, None, None, None), (9, "another text under a known id", "de", None, 3)]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def wide(spark):
    """The documents with extra columns of clashing names."""
    rows = [(*r, *(str(j) for j in range(len(CLASH.split(","))))) for r in corpus()]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASH}").repartition(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def counted(rows) -> dict:
    """Multiset of rows."""
    out: dict = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out
