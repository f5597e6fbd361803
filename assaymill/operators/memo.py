"""Memos, briefs and records of whole screening runs: every figure with its page, what is flagged, left out and unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import METRICS, RUNGS
from assaymill.operators.render import metric_display

#: What records of each rung of a cohort have in common with a target.
ALIKE = [" and ".join(n for n, used in zip(("vertical", "size", "retention"), r, strict=True) if used) or "nothing else" for r in RUNGS]
#: Kinds of call-outs that stand at a figure, and those that are questions of their own, in their order.
AT_FIGURES, ASKED = ["axis_read", "label_read"], ["missing_metric", "definition_conflict", "axis_read"]


def rate_headline(rates: DataFrame) -> DataFrame:
    """rates: as of :func:`cohort.base_rates`. target_id, headline: what became of records like a target, and what they have
    in common with it; or why nothing is known."""
    shown = lambda name: F.col(name).cast("string")
    text = F.concat(
        shown("n"), F.lit(" past records alike in "), F.get(F.array(*map(F.lit, ALIKE)), F.col("rung").cast("int")), F.lit(" grew "), shown("median"),
        F.lit("% a year at the median, "), shown("p10"), F.lit("% at the lowest tenth, "), shown("p90"), F.lit("% at the highest; "), shown("shrank_pct"),
        F.lit("% shrank; "), shown("optimistic_pct"), F.lit("% were expected to do better than they did"),
    )
    return rates.select("target_id", F.when(F.col("status") == "matched", text).otherwise(F.concat(F.lit("no base rate: "), "status")).alias("headline"))


def listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows: target_id, line. target_id and ``name``: the lines of each, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"])
    return rows.groupBy("target_id").agg(lines.alias(name))


def source(page: Column, method: Column) -> Column:
    """Where a figure stands: its page and how it was read; null if nobody said."""
    return F.when(page.isNotNull(), F.concat(F.lit(" (page "), page.cast("string"), F.lit(", "), method, F.lit(")")))


def figures(wide: DataFrame, citations: DataFrame, callouts: DataFrame) -> DataFrame:
    """target_id, place, line: each metric that a target states, as shown, with its source and the anchor of what is
    asked about it. citations: target_id, metric, page, method; of several the first page counts."""
    stated = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), metric_display(m, F.col(m)).alias("shown"), F.col(m).isNotNull().alias("known")) for i, m in enumerate(METRICS)])
    rows = wide.select("target_id", F.inline(stated)).where("known")
    cited = citations.groupBy("target_id", "metric").agg(F.min(F.struct("page", "method")).alias("cited"))
    marks = callouts.where(F.col("kind").isin(*AT_FIGURES)).groupBy("target_id", "metric").agg(F.min("id").alias("id"))
    rows = rows.join(cited, ["target_id", "metric"], "left").join(marks, ["target_id", "metric"], "left")
    line = F.concat(
        F.lit("- "), "metric", F.lit(": "), "shown", F.coalesce(source(F.col("cited.page"), F.col("cited.method")), F.lit(" (no source)")),
        F.coalesce(F.concat(F.lit(" <!--"), "id", F.lit("-->")), F.lit("")),
    )
    return rows.select("target_id", "place", line.alias("line"))


def memos(wide: DataFrame, scored: DataFrame, citations: DataFrame, found: DataFrame, callouts: DataFrame, rates: DataFrame, customers: DataFrame) -> DataFrame:
    """target_id, text: a memo for every target of ``wide``.

    scored: as of :func:`fit.fit`. found: target_id, rule_seq, rule_id, severity, page. callouts: target_id, id, kind,
    metric, question. rates, customers: target_id, headline; they stand apart, as they bear on no score. A section
    without a line says so.
    """
    verdict = F.concat(
        F.lit("Score "), F.format_string("%.1f", "score"), F.lit(", "), "tier",
        F.when(F.col("blocked_by") != "", F.concat(F.lit(", blocked by "), "blocked_by")).otherwise(F.lit("")),
    )
    grave = F.col("severity").isin("blocker", "warning")
    line = F.concat(F.lit("- "), "severity", F.lit(" "), "rule_id", F.coalesce(F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")")), F.lit("")))
    rules = found.withColumn("line", line)
    anchored = callouts.withColumn("line", F.concat(F.lit("- "), "question", F.lit(" <!--"), "id", F.lit("-->")))
    plain = callouts.withColumn("line", F.concat(F.lit("- "), "question")).withColumn("turn", F.array_position(F.array(*map(F.lit, ASKED)), F.col("kind"))).where("turn > 0")
    joined = wide.select("target_id").join(scored.select("target_id", verdict.alias("verdict")), "target_id", "left")
    sections = [
        ("Figures", listed(figures(wide, citations, callouts), "figures", "place"), "nothing was recovered"),
        ("Flags", listed(rules.where(grave), "flags", "rule_seq"), "no rule blocks or warns"),
        ("Notes", listed(rules.where(~grave), "notes", "rule_seq"), "none"),
        ("Left out", listed(anchored.where("kind = 'missing_metric'"), "gone", "id"), "nothing that is required"),
        ("Outside the document, for no score", None, ""),
        ("Ask", listed(plain, "asked", "turn", "id"), "nothing is open"),
    ]
    for name, headlines in (("customers", customers), ("rate", rates)):
        joined = joined.join(headlines.select("target_id", F.col("headline").alias(name)), "target_id", "left")
    text = [F.concat(F.lit("# Memo on "), "target_id"), F.coalesce("verdict", F.lit("Not scored"))]
    for heading, lines, nothing in sections:
        if lines is None:
            body = F.concat(F.lit("- customers: "), F.coalesce("customers", F.lit("not researched")), F.lit("\n- base rate: "), F.coalesce("rate", F.lit("none")))
        else:
            joined = joined.join(lines, "target_id", "left")
            name = lines.columns[-1]
            body = F.when(F.size(F.coalesce(name, F.array())) > 0, F.array_join(name, "\n")).otherwise(f"- {nothing}")
        text.append(F.concat(F.lit(f"## {heading}\n"), body))
    return joined.select("target_id", F.concat_ws("\n\n", *text).alias("text"))


def results(wide: DataFrame, scored: DataFrame, citations: DataFrame, found: DataFrame) -> DataFrame:
    """target_id, record: a whole run's result for each target as one JSON object: score, tier, what blocks it, its metrics
    with their sources, to four decimals, findings, and how many metrics were recovered. What is null isn't in it."""
    values = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.col(m).cast("decimal(20,4)").alias("value")) for i, m in enumerate(METRICS)])
    rows = wide.select("target_id", F.inline(values)).where("value is not null")
    cited = citations.groupBy("target_id", "metric").agg(F.min(F.struct("page", "method")).alias("cited"))
    rows = rows.join(cited, ["target_id", "metric"], "left")
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", "metric", "value", "cited.page", "cited.method"))), lambda x: x.dropFields("place"))
    metrics = rows.groupBy("target_id").agg(each.alias("metrics"), F.count("*").alias("recovered"))
    fired = F.transform(F.array_sort(F.collect_list(F.struct("rule_seq", "rule_id", "severity"))), lambda x: x.dropFields("rule_seq"))
    findings = found.groupBy("target_id").agg(fired.alias("findings"))
    joined = wide.select("target_id").join(scored, "target_id", "left").join(metrics, "target_id", "left").join(findings, "target_id", "left")
    record = F.struct("target_id", "score", "tier", "blocked_by", F.coalesce("recovered", F.lit(0)).alias("recovered"), "metrics", "findings")
    return joined.select("target_id", F.to_json(record, {"ignoreNullFields": "true"}).alias("record"))
