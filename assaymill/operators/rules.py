"""Eleven rules over a wide metric row: one projection, one long table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import DEFAULT, REQUIRED_METRICS, Rubric
from assaymill.functions.numbers import percent, ratio

RULES = ["R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8", "R9", "R10a", "R10b", "R11"]
SEVERITY = {
    "R1": "warning", "R2": "blocker", "R3": "blocker", "R4": "warning", "R5": "warning", "R6": "info",
    "R7": "warning", "R8": "blocker", "R9": "info", "R10a": "warning", "R10b": "warning", "R11": "info",
}
SEVERITIES = ["blocker", "warning", "info"]


def conditions(rubric: Rubric) -> dict[str, tuple[Column, Column, Column]]:
    """Of each rule: when it fires, what it saw, what it was held against. A null metric fires none but R11."""
    c = F.col
    drift = F.when(c("arr_usd") == 0, 0.0).otherwise(ratio(F.abs(12 * c("mrr_usd") - c("arr_usd")), c("arr_usd")))
    forty = c("yoy_growth_pct") + percent(c("ebitda_usd"), c("arr_usd"))
    edge = F.when(c("arr_usd") < rubric.arr_min, F.lit(rubric.arr_min)).otherwise(F.lit(rubric.arr_max))
    missing = F.size(F.filter(F.array(*[c(m) for m in REQUIRED_METRICS]), lambda x: x.isNull()))
    number = F.lit
    return {
        "R1": (drift > rubric.mrr_drift, F.when(c("mrr_usd").isNotNull(), drift), number(rubric.mrr_drift)),
        "R2": (~c("arr_usd").between(rubric.arr_min, rubric.arr_max), c("arr_usd"), edge),
        "R3": (c("recurring_pct") < rubric.recurring_floor, c("recurring_pct"), number(rubric.recurring_floor)),
        "R4": (c("grr_pct") < rubric.grr_floor, c("grr_pct"), number(rubric.grr_floor)),
        "R5": (c("grr_pct") > 100, c("grr_pct"), number(100.0)),
        "R6": (c("nrr_pct") < rubric.nrr_target, c("nrr_pct"), number(rubric.nrr_target)),
        "R7": (c("gross_margin_pct") < rubric.margin_floor, c("gross_margin_pct"), number(rubric.margin_floor)),
        "R8": (F.lit(rubric.ebitda_required) & (c("ebitda_usd") <= 0), c("ebitda_usd"), number(0.0)),
        "R9": (forty < rubric.rule_of_40, forty, number(rubric.rule_of_40)),
        "R10a": (c("top1_customer_pct") > rubric.top1_cap, c("top1_customer_pct"), number(rubric.top1_cap)),
        "R10b": (c("top5_customer_pct") > rubric.top5_cap, c("top5_customer_pct"), number(rubric.top5_cap)),
        "R11": (missing > 0, missing.cast("double"), number(0.0)),
    }


def findings(wide: DataFrame, rubric: Rubric = DEFAULT) -> DataFrame:
    """target_id, rule_seq, rule_id, severity, observed, held_against, missing; in the order of the rules."""
    gone = F.array_join(
        F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in REQUIRED_METRICS])), ","
    )
    rows = [
        F.when(
            fires,
            F.struct(
                F.lit(i).alias("rule_seq"),
                F.lit(rule).alias("rule_id"),
                F.lit(SEVERITY[rule]).alias("severity"),
                F.round(saw.cast("double"), 4).alias("observed"),
                against.cast("double").alias("held_against"),
                (gone if rule == "R11" else F.lit("")).alias("missing"),
            ),
        )
        for i, (rule, (fires, saw, against)) in enumerate(conditions(rubric).items(), 1)
    ]
    return wide.select("target_id", F.inline(F.array_compact(F.array(*rows))))


def severity_counts(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Findings of each severity for every target, 0 where there are none."""
    counts = found.groupBy("target_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    joined = targets.select("target_id").join(counts, "target_id", "left")
    return joined.select("target_id", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in SEVERITIES])


def verdicts(wide: DataFrame, rubric: Rubric = DEFAULT) -> DataFrame:
    """Per criterion: meets, breach (of a blocking one), below target, watch, or ``-`` where nothing is stated."""
    c = F.col

    def case(value: Column, ok: Column, otherwise: str) -> Column:
        return F.when(value.isNull(), "-").when(ok, "meets").otherwise(otherwise)

    items = {
        "arr_band": case(c("arr_usd"), c("arr_usd").between(rubric.arr_min, rubric.arr_max), "breach"),
        "recurring": case(c("recurring_pct"), c("recurring_pct") >= rubric.recurring_floor, "breach"),
        "grr": case(c("grr_pct"), c("grr_pct") >= rubric.grr_floor, "below target"),
        "nrr": case(c("nrr_pct"), c("nrr_pct") >= rubric.nrr_target, "below target"),
        "gross_margin": case(c("gross_margin_pct"), c("gross_margin_pct") >= rubric.margin_floor, "below target"),
        "ebitda": case(c("ebitda_usd"), c("ebitda_usd") > 0, "breach" if rubric.ebitda_required else "watch"),
        "top1": case(c("top1_customer_pct"), c("top1_customer_pct") <= rubric.top1_cap, "watch"),
        "top5": case(c("top5_customer_pct"), c("top5_customer_pct") <= rubric.top5_cap, "watch"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("criterion"), v.alias("verdict")) for k, v in items.items()])
    return wide.select("target_id", F.inline(rows))


#: The metric whose citation a finding carries; a finding over several metrics carries that of the first.
METRIC_OF = {
    "R1": "mrr_usd", "R2": "arr_usd", "R3": "recurring_pct", "R4": "grr_pct", "R5": "grr_pct", "R6": "nrr_pct",
    "R7": "gross_margin_pct", "R8": "ebitda_usd", "R9": "yoy_growth_pct", "R10a": "top1_customer_pct", "R10b": "top5_customer_pct",
}


def with_citations(found: DataFrame, citations: DataFrame) -> DataFrame:
    """citations: target_id, metric, page, method. Adds the page and method of the metric a finding is about; null where
    there is none."""
    metric = F.element_at(F.create_map(*[F.lit(x) for pair in METRIC_OF.items() for x in pair]), F.col("rule_id"))
    cited = citations.select("target_id", "metric", "page", "method")
    return found.withColumn("metric", metric).join(cited, ["target_id", "metric"], "left")
