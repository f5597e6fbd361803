"""Small inputs with everything that must not crash an operator."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    base = words(rng, 300)
    rows = [
        (0, base, "en", "a"),
        (1, base, "en", "a"),
        (1, base, "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n\x0b\x0c\r ", None, "b"),
        (5, "one", "de", "b"),
        (6, "eins zwei", "de", None),
        (None, "a text of no identifier", None, "c"),
        (None, None, None, "c"),
        (7, words(rng, 40_000), "en", "hot"),
        (8, "123 456 !!! ###", "en", "hot"),
        (9, "éè naïve 中文 \U0001f600 café", "fr", "é"),
        (-5, base.upper(), "en", "hot"),
        (1 << 40, base + " tail", "en", "hot"),
    ]
    rows += [(100 + i, words(rng, rng.randint(1, 400)), "en", "hot") for i in range(40)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def edge_docs(spark):
    """The rows, with more columns whose names clash."""
    return spark.createDataFrame(
        [(*r, "x", 7) for r in edge_rows()], SCHEMA + ", TEXT string, doc_ID int"
    )


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
