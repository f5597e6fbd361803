"""Quality rules by a hashed n-gram log-likelihood ratio.

Runs of ``order`` words of a text are hashed into buckets. One multinomial over the
buckets is estimated from trusted documents and one from the whole corpus; a text's score is the mean
over its n-grams of the logarithm of the ratio of the two, and every document is held against the same
threshold. DataFrame functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import SPACE, pick, table, text_or_empty

BUCKETS = 1 << 14
THRESHOLD = -0.15
#: Identifiers of trusted documents that are broadcast at most; more are shuffled.
BROADCAST_IDS = 2_000_000
SMOOTHING = 1.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    """The words in order: stretches free of space and U+0009 to U+000D."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _bucket(*cols: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that the text has more than once.

    Windows are compared by 64-bit hashes. Those of a text are sorted with their positions, so equal
    ones meet; a text without equal ones is done before that.
    """

    def marked(sorted_: Column) -> Column:
        same = lambda x, i: F.get(sorted_, i)["h"] == x["h"]
        return F.sort_array(
            F.transform(
                F.filter(sorted_, lambda x, i: F.coalesce(same(x, i - 1) | same(x, i + 1), same(x, i + 1), F.lit(False))),
                lambda x: x["at"],
            )
        )

    def covered(starts: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda s, at: F.struct(
            at.alias("last"), (s["n"] + F.least(F.lit(window), at - s["last"])).alias("n")
        )
        return F.aggregate(starts, start, step, lambda s: s["n"])

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        found = _let(F.sort_array(pairs), lambda s: covered(marked(s)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    firsts = F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0)))
    hashes = F.transform(firsts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, window)]))
    return _let(hashes, count)


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """The rule columns of a text, by the names of ``RULES``."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE[1:]}"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": F.get(
            F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 0
        ).cast("long"),
        "n_repeat_words": repeated_window_words(words).cast("long"),
    }


def _bucket_counts(rows: DataFrame, buckets: int, order: int) -> list[int]:
    """How many n-grams of the rows' texts each bucket has."""
    words = rows.select(words_of(text_or_empty()).alias("w0"))
    # Each word with those after it; a row for each.
    shifted = [F.slice("w0", k + 1, F.size("w0")).alias(f"w{k}") for k in range(1, order)]
    grams = words.select(F.explode(F.arrays_zip("w0", *shifted)).alias("g"))
    if order > 1:
        grams = grams.where(F.col(f"g.w{order - 1}").isNotNull())
    bucket = _bucket(*[F.col(f"g.w{k}") for k in range(order)], buckets=buckets)
    counts = [0] * buckets
    for r in grams.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect():  # at most one row a bucket
        counts[r["bucket"]] = r["n"]
    return counts


def log_ratios(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    order: int = 1,
    broadcast_ids: int = BROADCAST_IDS,
) -> list[float]:
    """For each bucket the logarithm of its share of the trusted n-grams over its share of all.

    The corpus side counts every n-gram of every document, the trusted side every n-gram of every
    document with a label of quality 1, however many those are: their identifiers are broadcast, or
    shuffled with the documents beyond ``broadcast_ids``. All zero without a trusted document.
    """
    trusted = pick(labels, doc_id="long", quality="int").where("quality = 1 and doc_id is not null")
    trusted = trusted.select("doc_id").distinct()
    few = trusted.count() <= broadcast_ids
    rows = pick(docs, doc_id="long", text="string")
    aimed = rows.where("doc_id is not null").join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi")
    corpus, target = (_bucket_counts(r, buckets, order) for r in (rows, aimed))
    if not sum(target):
        return [0.0] * buckets
    share = lambda n, total: math.log((n + smoothing) / (total + smoothing * buckets))
    all_, good = sum(corpus), sum(target)
    return [round(share(t, good) - share(c, all_), 6) for c, t in zip(corpus, target, strict=True)]


def score(words: Column, ratios: list[float], order: int = 1) -> Column:
    """Mean log ratio over a text's n-grams; 0 if it has none."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    n = F.greatest(F.size(words) - (order - 1), F.lit(0))

    def step(total: Column, word: Column) -> Column:
        return total + F.get(table, _bucket(word, buckets=len(ratios)))

    if order == 1:
        total = F.aggregate(words, F.lit(0.0), step)
    else:
        grams = F.transform(
            F.slice(words, 1, n),
            lambda w, i: F.get(
                table, _bucket(w, *[F.get(words, i + k) for k in range(1, order)], buckets=len(ratios))
            ),
        )
        total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + b)
    return total / F.greatest(n, F.lit(1))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    carry: tuple[str, ...] = (),
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    smoothing: float = SMOOTHING,
    order: int = 1,
) -> DataFrame:
    """The rule columns and the verdict for every row of ``docs``.

    docs: doc_id, text; labels: doc_id, quality. Columns: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), score (double), and those of
    ``carry`` as they are. ``kept`` is false if the base rules fail, else whether the score reaches
    ``threshold``.

    A null or empty text has no words, so its counts and score are 0 and it fails. Rows that repeat
    are judged alike. Labels without a doc_id or quality count for nothing; without a trusted
    document every score is 0 and base rules alone decide. An empty table gives no rows. Other
    columns of either table are ignored.
    """
    ratios = log_ratios(docs, labels, buckets, smoothing, order)
    kinds = {"doc_id": "long", "text": "string"} | dict.fromkeys(carry)
    types = dict(docs.dtypes)
    rows = pick(docs, **{c: k or types[c] for c, k in kinds.items()})
    held = [F.col(c).alias(f"carried_{c}") for c in carry]
    whole = rows.select("doc_id", text_or_empty().alias("whole"), *held)
    # All of it is one expression, which cuts the text once: a filter on the verdict can move below the
    # projection without repeating any part.
    def verdict(b: Column) -> Column:
        failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEAT_PERCENT * b["n_words"])
        return F.struct(
            *[b[r].alias(r) for r in RULES],
            failed.alias("base_failed"),
            (~failed & (b["score"] >= threshold)).alias("kept"),
            b["score"].alias("score"),
        )

    def judge(words: Column) -> Column:
        base = [v.alias(k) for k, v in base_columns(F.col("whole"), words).items()]
        return _let(F.struct(*base, score(words, ratios, order).alias("score")), verdict)

    carried = [f"carried_{c}" for c in carry]
    judged = whole.select("doc_id", _let(words_of(F.col("whole")), judge).alias("j"), *carried)
    return judged.select(
        "doc_id",
        *[F.col(f"j.{c}").alias(c) for c in (*RULES, "base_failed", "kept", "score")],
        *[F.col(f"carried_{c}").alias(c) for c in carry if c != "doc_id"],
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the score, over all of ``documents``."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
