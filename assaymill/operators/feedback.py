"""From a human's edits to correction records, and constraints over them."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.config import REQUIRED_METRICS
from assaymill.functions.text import clean_line, lower_each
from assaymill.sources.shared import stored


def callout_ids(rows: DataFrame) -> DataFrame:
    """rows: target_id, kind, seq. Adds id ``co-<target>-<kind>-NNN``, numbered by kind in the order of seq."""
    place = F.row_number().over(W.partitionBy("target_id", "kind").orderBy("seq"))
    return rows.withColumn("id", F.concat_ws("-", F.lit("co"), "target_id", "kind", F.lpad(place.cast("string"), 3, "0")))


def derive_callouts(citations: DataFrame, findings: DataFrame, wide: DataFrame, exhibits: DataFrame | None = None) -> DataFrame:
    """citations: target_id, metric, page, method, read. exhibits: target_id, metric, page where a missing metric
    is announced. One row a question: target_id, kind, metric, evidence_page, question, id.

    Values read off a chart, by axis or label; a retention above 100; a required metric that is missing.
    """
    no_page = F.lit(None).cast("int").alias("evidence_page")
    axis = F.col("read") == "axis"
    vision = citations.where("method = 'vision'").select(
        "target_id", F.when(axis, "axis_read").otherwise("label_read").alias("kind"), "metric", F.col("page").cast("int").alias("evidence_page"),
        F.concat("metric", F.when(axis, " was read off a chart's geometry: confirm or replace").otherwise(" was read off a printed label")).alias("question"),
    )
    wrong = findings.where("rule_id = 'R5'").select(
        "target_id", F.lit("definition_conflict").alias("kind"), F.lit("grr_pct").alias("metric"), no_page,
        F.lit("gross retention above 100%: net retention under another name?").alias("question"),
    )
    gone = wide.select(
        "target_id", F.explode(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in REQUIRED_METRICS])).alias("metric")
    ).where("metric is not null")
    if exhibits is not None:
        gone = gone.join(exhibits.select("target_id", "metric", F.col("page").cast("int").alias("evidence_page")), ["target_id", "metric"], "left")
    else:
        gone = gone.select("*", no_page)
    shown = F.concat(F.lit(" has an exhibit on page "), F.col("evidence_page").cast("string"), F.lit(" but no value: ask for the series"))
    gone = gone.select(
        "target_id", F.lit("missing_metric").alias("kind"), "metric", "evidence_page",
        F.concat("metric", F.coalesce(shown, F.lit(" is never stated: ask for it first"))).alias("question"),
    )
    rows = vision.unionByName(wrong).unionByName(gone).withColumn("seq", F.struct("metric", "evidence_page"))
    return callout_ids(rows).drop("seq")


def cell_marks(cells: DataFrame, callouts: DataFrame) -> DataFrame:
    """cells: target_id, metric. callouts: target_id, metric, id, seq. Of several call-outs on a metric the last marks the cell."""
    last = callouts.groupBy("target_id", "metric").agg(F.max_by("id", "seq").alias("callout_id"))
    return cells.join(last, ["target_id", "metric"], "left")


def reviewed_callouts(sessions: DataFrame, frozen: DataFrame, current: DataFrame) -> DataFrame:
    """sessions: target_id, session. frozen: target_id, session, id. current: target_id, id. The call-outs of the
    draft that a session reviewed: those frozen with it if there are any, else the target's current ones."""
    kept = frozen.groupBy("target_id", "session").agg(F.collect_set("id").alias("kept"))
    now = current.groupBy("target_id").agg(F.collect_set("id").alias("now"))
    both = sessions.join(kept, ["target_id", "session"], "left").join(now, "target_id", "left")
    return both.select("target_id", "session", F.explode(F.coalesce("kept", "now")).alias("id"), F.col("kept").isNotNull().alias("is_frozen"))


def anchor_above(lines: DataFrame) -> DataFrame:
    """lines: doc_id, line_no, anchor (null on most). Adds above: the nearest anchor at or above the line."""
    order = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("above", F.last("anchor", ignorenulls=True).over(order))


def suggest_reason(kind: Column, before: Column, after: Column) -> Column:
    """What an edit most likely was, by the kind of its call-out: a value read off a chart was wrong; a judgement was
    replaced; a line was taken out or put in. The rest is for triage."""
    gone = F.coalesce(before, F.lit("")) == ""
    empty = F.coalesce(after, F.lit("")) == ""
    return (
        F.when(kind.isin("axis_read", "label_read"), "factual_error")
        .when(kind == "judgement", F.when(empty, "needs_triage").otherwise("judgement_call"))
        .when(gone != empty, "new_information")
        .otherwise("needs_triage")
    )


EDIT = "doc_id string, idx int, callout_id string, blind_spot boolean, before string, after string"
ANCHOR = r"<!--(co-[^>]+)-->"


def diff_lines(draft: str, edited: str) -> Iterator[tuple]:
    """Edits of one document: callout_id, blind_spot, before, after.

    Lines that replace others are paired in order, the longer side with nothing; a run of inserted lines is one
    edit. An edit belongs to the nearest anchor at or above its line in the draft, but what has nothing before
    it was not produced here: it belongs to none and is a blind spot.
    """
    import re

    old, new = draft.splitlines(), edited.splitlines()
    clean = lambda s: " ".join(re.sub(ANCHOR, "", s).split())
    above, anchors = None, []
    for line in old:
        found = re.search(ANCHOR, line)
        above = found[1] if found else above
        anchors.append(above)
    was, now = [clean(x) for x in old], [clean(x) for x in new]

    def edits() -> Iterator[tuple]:
        """Line of the draft, text before and after."""
        for op, a, b, c, d in difflib.SequenceMatcher(None, was, now, autojunk=False).get_opcodes():
            if op == "insert":
                yield None, None, " ".join(now[c:d])
            elif op != "equal":
                yield from ((a + i if a + i < b else None, *pair) for i, pair in enumerate(itertools.zip_longest(was[a:b], now[c:d])))

    for at, before, after in edits():
        if before != after and (before or after):
            anchor = None if before is None else anchors[at]
            yield anchor, anchor is None, before, after


def diff_memos(pairs: DataFrame) -> DataFrame:
    """pairs: doc_id, draft, edited (null: empty). Edits of all documents; rows are diffed on their own."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [
                (doc_id, i, *edit)
                for doc_id, draft, edited in f.itertuples(index=False)
                for i, edit in enumerate(diff_lines(draft or "", edited or ""))
            ]
            yield pd.DataFrame(out, columns=["doc_id", "idx", "callout_id", "blind_spot", "before", "after"])

    rows = pairs.select(F.col("doc_id").cast("string"), "draft", "edited")
    return rows.mapInPandas(work, EDIT)


def attributed_edits(diffs: DataFrame, callouts: DataFrame) -> DataFrame:
    """diffs: as of :func:`diff_memos`. callouts: doc_id, id, kind, metric. Adds the call-out's field and kind, null
    where it isn't known, and the reason that these suggest."""
    known = callouts.select("doc_id", F.col("id").alias("callout_id"), F.col("metric").alias("field"), "kind").dropDuplicates(["doc_id", "callout_id"])
    joined = diffs.join(known, ["doc_id", "callout_id"], "left")
    return joined.withColumn("reason", suggest_reason(F.col("kind"), F.col("before"), F.col("after")))


def corrections(diffs: DataFrame, callouts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Records of a new session of each document: one more than the last."""
    last = sessions.groupBy("doc_id").agg(F.max("session").alias("last"))
    joined = attributed_edits(diffs, callouts).join(last, "doc_id", "left")
    return joined.withColumn("session", F.coalesce("last", F.lit(0)) + 1).drop("last")


def correction_counts(records: DataFrame) -> DataFrame:
    """By document: corrections, blind spots and those that still need triage."""
    return records.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if("blind_spot").alias("blind_spots"), F.count_if(F.col("reason") == "needs_triage").alias("untriaged")
    )


def clean(lines: DataFrame, column: str) -> DataFrame:
    return lines.withColumn(column, clean_line(F.col(column)))


def unanchored(records: DataFrame, callouts: DataFrame) -> DataFrame:
    """Corrections that name a call-out which doesn't exist, and blind spots that name one: should be empty."""
    ids = callouts.select(F.col("id").alias("callout_id")).distinct()
    lost = records.where("callout_id is not null").join(ids, "callout_id", "left_anti")
    odd = records.where("blind_spot and callout_id is not null")
    reason = lambda df, why: df.select("doc_id", "idx", "callout_id", F.lit(why).alias("why"))
    return reason(lost, "no such call-out").unionByName(reason(odd, "a blind spot has no call-out"))


def not_folded_back(records: DataFrame, examples: DataFrame, regressions: DataFrame) -> DataFrame:
    """Judgement calls without an example, factual errors without a regression: should be empty."""
    judged = records.where("reason = 'judgement_call'").join(examples.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    errors = records.where("reason = 'factual_error'").join(regressions.select("doc_id").distinct(), "doc_id", "left_anti")
    pick = lambda df, why: df.select("doc_id", "idx", F.lit(why).alias("why"))
    return pick(judged, "no example").unionByName(pick(errors, "no regression"))


def regressions_held(regressions: DataFrame, callouts: DataFrame) -> DataFrame:
    """regressions: id, target_id, kind, evidence_page, must_contain. held, for each row: a call-out of that target,
    kind and page contains all the strings, whatever their case, character by character; a null page fits any."""
    folded = F.transform("must_contain", lower_each).alias("must_contain")
    r = regressions.select("id", "target_id", "kind", "evidence_page", folded).alias("r")
    c = callouts.select("target_id", "kind", "evidence_page", lower_each(F.col("question")).alias("question")).alias("c")
    fits = (
        (F.col("r.target_id") == F.col("c.target_id"))
        & (F.col("r.kind") == F.col("c.kind"))
        & (F.col("r.evidence_page").isNull() | (F.col("r.evidence_page") == F.col("c.evidence_page")))
        & F.forall("r.must_contain", lambda s: F.contains("c.question", s))
    )
    held, lost = (r.join(c, fits, kind).select("id", F.lit(kind == "left_semi").alias("held")) for kind in ("left_semi", "left_anti"))
    return held.unionByName(lost)


def last_examples(examples: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` examples that were accepted last."""
    return examples.orderBy(F.desc("seq")).limit(k)


#: Words of a run by which long items are found, and the least words of such items.
RUN, LONG = 8, 10
#: Items whose runs are broadcast at most; more are shuffled. Characters of short items that are looked for in one pass.
BROADCAST_ITEMS, PASS_CHARS = 200_000, 1 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _runs(words: Column) -> Column:
    """64-bit hashes of every ``RUN`` words that follow one another."""

    def hashes(w: Column) -> Column:
        firsts = F.slice(w, 1, F.greatest(F.size(w) - (RUN - 1), F.lit(0)))
        return F.transform(firsts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, RUN)]))

    # In a lambda of its own the words are cut once, not for each of their places.
    return F.get(F.transform(F.array(words), hashes), 0)


def cited_items(reports: DataFrame, items: DataFrame) -> DataFrame:
    """Reports that contain a listed item, whatever the case: report_id, item (as listed), for each row of ``reports``.

    reports: report_id, text. items: item; nulls and empty ones are left out, repeated ones count once.
    An item of ``LONG`` words or more is found by a run of whole words inside it: runs of all reports meet
    those of the items in an equi-join, and the report's text decides. Shorter ones are looked for by an
    automaton, one pass over the reports for each ``PASS_CHARS`` characters of them. Rows without a
    report_id are left out.
    """
    listed = items.select("item", F.lower("item").alias("low")).where("item <> ''").distinct()
    listed = listed.withColumn("words", _words(F.col("low")))
    rows = reports.select("report_id", F.lower("text").alias("low")).where("report_id is not null and low is not null")

    # The first and last word may be parts of longer ones in a report; those between stand there as they are.
    long = listed.where(F.size("words") >= LONG).select("item", F.col("low").alias("item_low"), F.get(_runs(F.slice("words", 2, RUN)), 0).alias("run"))
    few = long.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    met = rows.select("report_id", F.explode(F.array_distinct(_runs(_words(F.col("low"))))).alias("run"))
    met = met.join(F.broadcast(long) if few else long, "run").select("report_id", "item", "item_low").distinct()
    found = rows.join(met, "report_id").where(F.contains("low", F.col("item_low"))).select("report_id", "item")

    short = listed.where(F.size("words") < LONG).select("item", "low")
    chars = short.agg(F.sum(F.length("low"))).head()[0] or 0
    blocks = -(-chars // PASS_CHARS)
    for block in range(blocks):
        part = short.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == block)
        found = found.unionByName(_cited_short(rows, [tuple(r) for r in part.collect()]))
    return found


def _cited_short(rows: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """rows: report_id, low. items: (item, in lower case), few enough for one automaton."""
    listed: dict[str, list[str]] = {}
    for item, low in items:
        listed.setdefault(low, []).append(item)
    schema = rows.select("report_id").schema.add("item", "string")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for low, as_listed in listed.items():
            automaton.add_word(low, as_listed)
        automaton.make_automaton()
        for batch in batches:
            at, names = [], []
            for i, text in enumerate(batch.column(1)):
                hits = {id(found): found for _, found in automaton.iter(text.as_py())}
                for item in (x for found in hits.values() for x in found):
                    at.append(i)
                    names.append(item)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(names, pa.string())], names=["report_id", "item"])

    return rows.mapInArrow(look, schema)


#: Ranges of keys whose digests are compared before any row is; those that differ are broadcast.
DIGEST_RANGES = 1 << 16


def ranged(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, name (digest of the text, null for null) and range, by a hash of the key; made once."""
    digest = F.sha2(F.col(text), 256).alias(name)
    return stored(rows.select(key, digest, F.pmod(F.xxhash64(key), F.lit(DIGEST_RANGES)).alias("range")), f"digests-{name}")


def differing(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """range: those in which the two sides aren't the same rows, by count and two digests of all of them."""

    def summed(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(key, name)
        return df.groupBy("range").agg(
            F.count("*").alias(f"{name}_n"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias(f"{name}_x"), F.sum(F.xxhash64(F.lit(2), row).cast("decimal(38,0)")).alias(f"{name}_s")
        )

    left, right = names
    both = summed(a, left).join(summed(b, right), "range", "full_outer")
    return both.where(~reduce(Column.__and__, [F.col(f"{left}_{m}").eqNullSafe(F.col(f"{right}_{m}")) for m in "nxs"])).select("range")


def changed(stored_rows: DataFrame, made: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose stored text isn't what is made now, or that only one side has: should be empty.

    Both sides are summed up by ranges of keys; rows are joined only of ranges that differ, so what is compared row by
    row grows with what has changed.
    """
    a, b = ranged(stored_rows, key, text, "stored"), ranged(made, key, text, "made")
    odd = F.broadcast(differing(a, b, key, ("stored", "made")))  # at most DIGEST_RANGES rows
    a, b = (df.join(odd, "range", "left_semi").drop("range") for df in (a, b))
    return a.join(b, key, "full_outer").where(~F.col("stored").eqNullSafe(F.col("made"))).select(key)


def fired_as_seeded(seeded: DataFrame, findings: DataFrame, rule_of: DataFrame) -> DataFrame:
    """seeded: target_id, defect. rule_of: defect, rule_id. Seeded defects whose rule did not fire: should be empty."""
    expected = seeded.join(F.broadcast(rule_of), "defect")
    return expected.join(findings.select("target_id", "rule_id"), ["target_id", "rule_id"], "left_anti")
