"""Texts of results: scorecards, rubric, memos, tables. One column of text per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import METRICS, Rubric
from assaymill.functions.numbers import money_display, plain_number


def metric_display(metric: str, value: Column) -> Column:
    if metric.endswith("_usd"):
        return money_display(value)
    return F.when(value.isNull(), "not stated").otherwise(F.concat(plain_number(value), F.lit("%")))


def rubric_text(rubric: Rubric) -> str:
    """What a rubric asks and what each part weighs."""
    rows = [
        ("ARR within", f"{rubric.arr_min:,.0f} to {rubric.arr_max:,.0f} USD", rubric.arr_weight),
        ("recurring share from", f"{rubric.recurring_floor:g}%", rubric.recurring_weight),
        ("gross retention from", f"{rubric.grr_floor:g}%", rubric.grr_weight),
        ("net retention from", f"{rubric.nrr_target:g}%", rubric.nrr_weight),
        ("gross margin from", f"{rubric.margin_floor:g}%", rubric.margin_weight),
        ("EBITDA", "positive", rubric.ebitda_weight),
        ("largest customer, top five up to", f"{rubric.top1_cap:g}%, {rubric.top5_cap:g}%", rubric.concentration_weight),
    ]
    lines = [f"# {rubric.name}", "", *[f"- {a} {b} (weight {w:g})" for a, b, w in rows]]
    return "\n".join([*lines, "", f"Tier 1 from {rubric.tier_1:g}, tier 2 from {rubric.tier_2:g}."]) + "\n"


def scorecards(wide: DataFrame, scored: DataFrame, verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """target_id, text: score and tier, metrics, verdicts by criterion, findings in the order of the rules."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"- {m}: "), metric_display(m, F.col(m))) for m in METRICS])
    v = verdicts.groupBy("target_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "criterion", "verdict"))).alias("v"))
    f = found.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("rule_seq", "rule_id", "severity"))).alias("f"))
    both = wide.join(scored, "target_id").join(v, "target_id", "left").join(f, "target_id", "left")
    findings = F.transform(F.coalesce("f", F.array().cast("array<struct<rule_seq:int,rule_id:string,severity:string>>")), lambda x: F.concat_ws(" ", F.lit("-"), x["rule_id"], x["severity"]))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), "target_id"), F.concat_ws(" ", F.lit("Score"), plain_number(F.col("score")), "tier"),
        lines, F.array_join(F.transform("v", lambda x: F.concat(F.lit("- "), x)), "\n"), F.array_join(findings, "\n"),
    )
    return both.select("target_id", text.alias("text"))


def memos(cards: DataFrame, callouts: DataFrame) -> DataFrame:
    """Scorecards followed by questions, each with the anchor that edits are traced to."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("id", "question"))), lambda x: F.concat(F.lit("- "), x["question"], F.lit(" <!--"), x["id"], F.lit("-->"))
    )
    asked = callouts.groupBy("target_id").agg(F.array_join(lines, "\n").alias("questions"))
    joined = cards.join(asked, "target_id", "left")
    return joined.select("target_id", F.concat_ws("\n\n", "text", F.concat(F.lit("## Questions\n"), "questions")).alias("text"))


def text_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a table of the rows in the order of their columns. For small results only: reports."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "-|" * len(columns) + "\n"
    return df.select(line.alias("line")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("text"))


#: Characters of a document, and of its narrative, that a prompt holds; items of research in a brief.
PROMPT_CHARS, EXCERPT_CHARS, BRIEF_RESEARCH = 14_000, 2600, 12

#: Blocks of a brief in order: name, heading, what stands there when there is nothing, lines at most (0: all).
BRIEF = [
    ("document", "[A] EXTRACTED FROM THE DOCUMENT", "none available", 0),
    ("base_rate", "[B] BASE RATE FROM PAST ACQUISITIONS", "none available", 0),
    ("customers", "[C] CUSTOMER HEALTH", "not researched", 0),
    ("research", "[D] EXTERNAL RESEARCH", "none available", BRIEF_RESEARCH),
]


def excerpt(text: Column, chars: int) -> Column:
    """The first characters of a text; null: empty."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(chars))


def briefs(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """targets: target_id. lines: target_id, block, seq, line. target_id, text: all that a reasoner may see of a target,
    each block under its origin."""
    held = lines.groupBy("target_id").pivot("block", [b for b, _, _, _ in BRIEF]).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))))
    joined = targets.select("target_id").join(held, "target_id", "left")
    parts = [F.concat(F.lit("TARGET: "), "target_id")]
    for name, heading, empty, most in BRIEF:
        rows = F.transform(F.col(name), lambda x: F.concat(F.lit("  "), x["line"]))
        rows = F.slice(rows, 1, most) if most else rows
        body = F.when(F.coalesce(F.size(name), F.lit(0)) > 0, F.array_join(rows, "\n")).otherwise(f"  {empty}")
        parts.append(F.concat(F.lit(f"\n{heading}\n"), body))
    return joined.select("target_id", F.concat_ws("\n", *parts).alias("text"))
