"""Partial-credit components, the weighted score, the tier, and the inbox in order of score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import DEFAULT, Rubric
from assaymill.functions.numbers import band_points, cap_points, floor_points
from assaymill.operators.rules import SEVERITY, conditions


def component_columns(rubric: Rubric) -> list[tuple[str, float, Column]]:
    c = F.col
    return [
        ("arr_band", rubric.arr_weight, band_points(c("arr_usd"), rubric.arr_min, rubric.arr_max, rubric.arr_weight)),
        ("recurring", rubric.recurring_weight, floor_points(c("recurring_pct"), rubric.recurring_floor, rubric.recurring_weight)),
        ("grr", rubric.grr_weight, floor_points(c("grr_pct"), rubric.grr_floor, rubric.grr_weight)),
        ("nrr", rubric.nrr_weight, floor_points(c("nrr_pct"), rubric.nrr_target, rubric.nrr_weight)),
        ("gross_margin", rubric.margin_weight, floor_points(c("gross_margin_pct"), rubric.margin_floor, rubric.margin_weight)),
        ("ebitda", rubric.ebitda_weight, F.when(c("ebitda_usd") > 0, float(rubric.ebitda_weight)).otherwise(0.0)),
        (
            "concentration",
            rubric.concentration_weight,
            cap_points(c("top1_customer_pct"), c("top5_customer_pct"), rubric.top1_cap, rubric.top5_cap, rubric.concentration_weight),
        ),
    ]


def components(wide: DataFrame, rubric: Rubric = DEFAULT) -> DataFrame:
    """target_id, key, weight, earned (two decimals), pct."""
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.lit(float(w)).alias("weight"), e.alias("earned"))
            for k, w, e in component_columns(rubric)
        ]
    )
    exploded = wide.select("target_id", F.inline(rows))
    pct = F.coalesce(F.round(100 * F.try_divide("earned", "weight"), 1), F.lit(0.0))
    return exploded.withColumn("pct", pct)


def fit(wide: DataFrame, rubric: Rubric = DEFAULT) -> DataFrame:
    """target_id, score (one decimal), tier, blocked_by: a blocker passes a target whatever its score.

    Components are rounded before they are summed; tiers compare the score before it is rounded.
    """
    parts = component_columns(rubric)
    total = sum(w for _, w, _ in parts)
    raw = 100.0 * sum((e.cast("decimal(12,2)") for _, _, e in parts), F.lit(0).cast("decimal(12,2)")).cast("double") / total
    # Which rules block is decided in the same row: nothing is joined or read twice.
    fired = [F.when(when, F.lit(rule)) for rule, (when, _, _) in conditions(rubric).items() if SEVERITY[rule] == "blocker"]
    scored = wide.select("target_id", raw.alias("raw"), F.array_join(F.array_compact(F.array(*fired)), ",").alias("blocked_by"))
    tier = (
        F.when(F.col("blocked_by") != "", "pass")
        .when(F.col("raw") >= rubric.tier_1, "tier_1")
        .when(F.col("raw") >= rubric.tier_2, "tier_2")
        .otherwise("pass")
    )
    return scored.select("target_id", F.round("raw", 1).alias("score"), tier.alias("tier"), "blocked_by")


def inbox(scored: DataFrame) -> DataFrame:
    """Targets with the best score first, then by name."""
    return scored.orderBy(F.desc("score"), "target_id")


def text_only(long: DataFrame, carriers: DataFrame) -> DataFrame:
    """The metrics that a text layer alone would give: those that charts carry are null."""
    joined = long.join(F.broadcast(carriers), "metric", "left")
    return joined.withColumn("value", F.when(F.coalesce("carrier", F.lit("")) != "chart", F.col("value"))).drop("carrier")
