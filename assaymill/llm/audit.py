"""How five filters act on one another: what each removes, in each of the 120 orders they can be applied in.

A document's failures are five bits. A table, made once, has for each of the 32 cases and each order the step at which
such a document goes; every batch looks its documents up there and counts by part, order, step and label. What
batches count is added up, so nothing but counts is shuffled after the failures are known.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import SPACE, pick, table, text_or_empty, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CASES = 1 << len(FILTERS)
STEPS = len(FILTERS)
#: Labels of a row, as bits: quality=1, toxic=1.
LABELS = 4
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
WIDTH = len(ORDERS) * (STEPS + 1) * LABELS
#: A key with more than a HOT-th of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 10_000
#: Parts that a task counts at a time; with more it hands on what it has and starts anew.
PARTS_HELD = 256


def first_failures() -> np.ndarray:
    """Of each case (bit k: filter k fails) and order the step (0 to 4) of the first filter that fails, or 5."""
    steps = np.full((CASES, len(ORDERS)), STEPS, np.int8)
    for case in range(CASES):
        for o, order in enumerate(ORDERS):
            failing = [s for s, f in enumerate(order) if case >> FILTERS.index(f) & 1]
            steps[case, o] = min(failing, default=STEPS)
    return steps


def text_failures() -> Column:
    """Bits of filters A to D, of a text that isn't null."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 3 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    return reduce(Column.__add__, [f.cast("int") * (1 << k) for k, f in enumerate(fails)])


def looked_up(rows: DataFrame, facts: DataFrame, key: str, name: str, total: int) -> DataFrame:
    """``rows`` (with a ``row`` number) and ``name`` of the row of ``facts`` that has the same key, or null.

    facts has a key once, with the number of its rows as ``met``. Keys that more than a HOT-th of all rows have, fewer
    than HOT, are broadcast; none of the others is larger, so they are joined by shuffling. Rows without a key and
    those of a broadcast key are spread by their number.
    """
    hot = F.col("met") * HOT > total
    few = facts.where(hot).select(key, F.col(name).alias("hot"), F.lit(True).alias("few"))
    rest = facts.where(~hot).select(key, F.lit(0).alias("salt"), F.col(name).alias("rest"))
    spread = F.when(F.col(key).isNull() | F.col("few"), 1 + F.pmod(F.xxhash64("row"), F.lit(1 << 20)).cast("int")).otherwise(0)
    found = rows.join(F.broadcast(few), key, "left").withColumn("salt", spread).join(rest, [key, "salt"], "left")
    return found.select(*rows.columns, F.coalesce("hot", "rest").alias(name))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits, A first) and label (bits: quality, toxic) of every row of ``docs`` (doc_id, text, lang).

    A null lang is part of the empty one, a null text an empty text. E fails where the table has the same text
    under a smaller doc_id; null ids are neither smaller nor larger than others. Of labels that repeat any 1 counts.
    """
    texts = pick(docs, doc_id="long", lang="string", text="string")
    texts = texts.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_or_empty().alias("text"))
    facts = texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_failures().alias("failed"))
    facts = written(facts.withColumn("row", F.monotonically_increasing_id()), "audit-facts")
    total = facts.count()

    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("met")).where("met > 1")
    rows = looked_up(facts, first, "digest", "first", total)

    marks = pick(labels, doc_id="long", quality="long", toxic="long")
    bits = F.max(F.col("quality").eqNullSafe(1).cast("int")) + 2 * F.max(F.col("toxic").eqNullSafe(1).cast("int"))
    marks = marks.groupBy("doc_id").agg(bits.alias("label")).where("label > 0")
    met = facts.groupBy("doc_id").agg(F.count("*").alias("met"))
    rows = looked_up(rows, marks.join(met, "doc_id"), "doc_id", "label", total)

    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return rows.select("part", (F.col("failed") + 16 * again).alias("failed"), F.coalesce("label", F.lit(0)).alias("label"))


def counted(rows: DataFrame) -> DataFrame:
    """part and counts: WIDTH counts by order, step (5: kept) and label, then 128 by case and label.

    A task holds the arrays of PARTS_HELD parts at most; the partial arrays of a part are summed, place by place.
    """
    steps_of = first_failures().astype(np.int64)
    at_order = np.arange(len(ORDERS)) * (STEPS + 1)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        counts = np.zeros((PARTS_HELD, WIDTH + CASES * LABELS), np.int64)

        def held() -> pa.RecordBatch:
            arrays = [pa.array(list(places), pa.string()), pa.array(list(counts[: len(places)]), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "counts"])

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            of_row, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
            failed, label = (batch.column(c).to_numpy().astype(np.int64) for c in ("failed", "label"))
            for start in range(0, len(names), PARTS_HELD):
                some = names[start : start + PARTS_HELD]
                if len(places.keys() | set(some)) > PARTS_HELD:
                    yield held()
                    places.clear()
                    counts[:] = 0
                to = np.array([places.setdefault(n, len(places)) for n in some])
                mine = (of_row >= start) & (of_row < start + len(some))
                place, case, lab = to[of_row[mine] - start], failed[mine], label[mine]
                removed = (place[:, None] * len(ORDERS) * (STEPS + 1) + at_order + steps_of[case]) * LABELS + lab[:, None]
                counts[:, :WIDTH] += np.bincount(removed.ravel(), minlength=PARTS_HELD * WIDTH).reshape(PARTS_HELD, WIDTH)
                cases = (place * CASES + case) * LABELS + lab
                counts[:, WIDTH:] += np.bincount(cases, minlength=PARTS_HELD * CASES * LABELS).reshape(PARTS_HELD, -1)
        if places:
            yield held()

    partial = rows.mapInArrow(count, "part string, counts array<long>")
    added = partial.select("part", F.posexplode("counts").alias("place", "n")).groupBy("part", "place").agg(F.sum("n").alias("n"))
    whole = F.sort_array(F.collect_list(F.struct("place", "n")))
    return added.groupBy("part").agg(F.transform(whole, lambda x: x["n"]).alias("counts"))


def interactions(counts: DataFrame) -> DataFrame:
    """The audit's rows from the counts of each part, 600 a part."""
    kinds = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    letters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    bits = np.arange(CASES)[:, None] >> np.arange(STEPS) & 1

    def table_of(counts: np.ndarray) -> np.ndarray:
        """order x step x measure"""
        gone = counts[:WIDTH].reshape(len(ORDERS), STEPS + 1, LABELS)
        cases = counts[WIDTH:].reshape(CASES, LABELS).sum(1)
        removed = gone[:, :STEPS].sum(2)
        kept = gone.sum((1, 2))[:, None] - removed.cumsum(1)
        fails, only = cases @ bits, cases[1 << np.arange(STEPS)]
        shares = np.bincount(letters.ravel(), removed.ravel(), STEPS).astype(np.int64)
        good, toxic = (gone[:, :STEPS, list(bit)].sum(2) for bit in ((1, 3), (2, 3)))
        return np.stack([kept, removed, fails[letters] - removed, only[letters], good, toxic, shares[letters]], 2)

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(ORDERS) * STEPS
        for batch in batches:
            for part, found in zip(batch.column("part"), batch.column("counts"), strict=True):
                measures = table_of(found.values.to_numpy()).reshape(cells, -1).T
                steps = np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
                columns = [pa.array([part.as_py()] * cells), pa.array(np.repeat(ORDERS, STEPS).tolist()), pa.array(steps)]
                columns += [pa.array(np.ascontiguousarray(m)) for m in measures]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *MEASURES])

    return counts.mapInArrow(told, kinds)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (lang), order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley, of ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, quality, toxic).

    Nulls, ties and labels as in :func:`failures`. Rows that repeat count each time; those of the smallest doc_id of
    a text all stay. A part without failures has zeros; an empty table gives no rows; other columns are ignored.
    """
    return interactions(counted(failures(docs, labels)))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (
    SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id
),
judged AS (
    SELECT row_number() OVER () AS id, t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN t.doc_id > f.first THEN 'E' ELSE '' END AS fails
    FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id
),
groups AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders(o) AS (
    SELECT '' UNION ALL SELECT o || letter FROM orders, letters WHERE length(o) < 5 AND NOT contains(o, letter)
),
cells AS (
    SELECT DISTINCT part, o, step, o[step] AS letter
    FROM (SELECT DISTINCT part FROM groups), orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5
),
rows_ AS (
    SELECT c.part, c.o, c.step, c.letter,
        sum(CASE WHEN translate(fails, o[1:step], '') = fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN contains(fails, letter) AND translate(fails, o[1:step - 1], '') = fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN contains(fails, letter) THEN n ELSE 0 END) AS failing,
        sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN contains(fails, letter) AND translate(fails, o[1:step - 1], '') = fails AND good = 1 THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN contains(fails, letter) AND translate(fails, o[1:step - 1], '') = fails AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
    FROM cells c JOIN groups g ON g.part = c.part GROUP BY ALL
)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, (failing - removed)::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM rows_
"""
