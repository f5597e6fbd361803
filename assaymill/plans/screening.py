"""Queries over target metrics: rules, fit, tiers, rubric verdicts, missing metrics; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.config import CELLS, METRICS, REQUIRED_METRICS
from assaymill.operators import feedback, fit, metrics, rules
from assaymill.sources.tables import table


def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.target_metrics(*(table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")))


METRICS_SQL = """
per_customer as (
  select o_custkey as custkey,
    sum(case when year(o_orderdate) = 2000 then cast(o_totalprice as decimal(18,2)) end) as r1,
    sum(case when year(o_orderdate) = 1999 then cast(o_totalprice as decimal(18,2)) end) as r0,
    sum(case when year(o_orderdate) = 2000 and month(o_orderdate) = 12 then cast(o_totalprice as decimal(18,2)) end) as m
  from orders where year(o_orderdate) in (1999, 2000) group by 1
), cells as (
  select cast(c_nationkey as varchar) || '-' || c_mktsegment as target_id, c_custkey as custkey, c_name, c_acctbal, r1, r0, m,
    row_number() over (partition by c_nationkey, c_mktsegment order by r1 desc nulls last, c_custkey) as place
  from customer left join per_customer on custkey = c_custkey
), margins as (
  select cast(c_nationkey as varchar) || '-' || c_mktsegment as target_id,
    round(100.0::double * (1.0::double - cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2))) as double)
      / cast(sum(cast(l_extendedprice as decimal(18,2))) as double)), 4) as gross_margin_pct
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  where year(o_orderdate) = 2000 group by 1
), wide as (
  select target_id, cast(sum(r1) as double) as arr_usd, cast(sum(m) as double) as mrr_usd,
    round(100.0::double * (cast(sum(case when r0 > 0 then r1 end) as double) / nullif(cast(sum(r1) as double), 0)), 4) as recurring_pct,
    round(100.0::double * (cast(sum(case when r0 > 0 then least(coalesce(r1, 0), r0) end) as double)
      / nullif(cast(sum(case when r0 > 0 then r0 end) as double), 0)), 4) as grr_pct,
    round(100.0::double * (cast(sum(case when r0 > 0 then coalesce(r1, 0) end) as double)
      / nullif(cast(sum(case when r0 > 0 then r0 end) as double), 0)), 4) as nrr_pct,
    gross_margin_pct, cast(sum(r1) - sum(r0) as double) as ebitda_usd,
    round(100.0::double * (cast(sum(r1) as double) / nullif(cast(sum(r0) as double), 0) - 1.0::double), 4) as yoy_growth_pct,
    round(100.0::double * (cast(max(r1) as double) / nullif(cast(sum(r1) as double), 0)), 4) as top1_customer_pct,
    round(100.0::double * (cast(sum(case when place <= 5 then r1 end) as double) / nullif(cast(sum(r1) as double), 0)), 4) as top5_customer_pct
  from cells left join margins using (target_id) group by target_id, gross_margin_pct
)"""

R = CELLS
_RULES = [
    ("R1", "warning", f"mrr_usd is not null and (case when arr_usd = 0 then 0.0 else abs(12 * mrr_usd - arr_usd) / arr_usd end) > {R.mrr_drift}",
     "abs(12 * mrr_usd - arr_usd) / arr_usd", R.mrr_drift),
    ("R2", "blocker", f"not (arr_usd between {R.arr_min} and {R.arr_max})", "arr_usd",
     f"case when arr_usd < {R.arr_min} then {R.arr_min} else {R.arr_max} end"),
    ("R3", "blocker", f"recurring_pct < {R.recurring_floor}", "recurring_pct", R.recurring_floor),
    ("R4", "warning", f"grr_pct < {R.grr_floor}", "grr_pct", R.grr_floor),
    ("R5", "warning", "grr_pct > 100", "grr_pct", 100.0),
    ("R6", "info", f"nrr_pct < {R.nrr_target}", "nrr_pct", R.nrr_target),
    ("R7", "warning", f"gross_margin_pct < {R.margin_floor}", "gross_margin_pct", R.margin_floor),
    ("R8", "blocker", "ebitda_usd <= 0", "ebitda_usd", 0.0),
    ("R9", "info", f"yoy_growth_pct + 100.0 * (ebitda_usd / nullif(arr_usd, 0)) < {R.rule_of_40}",
     "yoy_growth_pct + 100.0 * (ebitda_usd / nullif(arr_usd, 0))", R.rule_of_40),
    ("R10a", "warning", f"top1_customer_pct > {R.top1_cap}", "top1_customer_pct", R.top1_cap),
    ("R10b", "warning", f"top5_customer_pct > {R.top5_cap}", "top5_customer_pct", R.top5_cap),
]
_GONE = " ".join(f"|| case when {m} is null then ',{m}' else '' end" for m in REQUIRED_METRICS)
FINDINGS_SQL = METRICS_SQL + ", findings as (" + " union all ".join(
    f"select target_id, {i} as rule_seq, '{r}' as rule_id, '{s}' as severity, round(cast({saw} as double), 4) as observed, "
    f"cast({held} as double) as held_against, '' as missing from wide where {when}"
    for i, (r, s, when, saw, held) in enumerate(_RULES, 1)
) + f""" union all
select target_id, 12, 'R11', 'info', cast({" + ".join(f"({m} is null)::int" for m in REQUIRED_METRICS)} as double), 0.0::double, substr('' {_GONE}, 2)
from wide where {" or ".join(f"{m} is null" for m in REQUIRED_METRICS)})"""  # fmt: skip


def _floor_sql(m: str, floor: float, w: float) -> str:
    return f"round(case when {m} is null then 0.0::double when {m} >= {floor} then {w}::double else {w}::double * greatest(0.0::double, {m} / {floor}) end, 2)"


def _half_sql(m: str, cap: float) -> str:
    return f"case when {m} is null then 0.0::double when {m} <= {cap} then 1.0::double else {cap}::double / {m} end"


_BAND = (
    f"round(case when arr_usd is null then 0.0::double when arr_usd between {R.arr_min} and {R.arr_max} then {R.arr_weight}::double "
    f"when arr_usd < {R.arr_min} then {R.arr_weight}::double * greatest(0.0::double, coalesce(arr_usd / {R.arr_min}::double, 0.0)) "
    f"else {R.arr_weight}::double * greatest(0.0::double, coalesce({R.arr_max}::double / arr_usd, 0.0)) end, 2)"
)
_PARTS = [
    ("arr_band", R.arr_weight, _BAND),
    ("recurring", R.recurring_weight, _floor_sql("recurring_pct", R.recurring_floor, R.recurring_weight)),
    ("grr", R.grr_weight, _floor_sql("grr_pct", R.grr_floor, R.grr_weight)),
    ("nrr", R.nrr_weight, _floor_sql("nrr_pct", R.nrr_target, R.nrr_weight)),
    ("gross_margin", R.margin_weight, _floor_sql("gross_margin_pct", R.margin_floor, R.margin_weight)),
    ("ebitda", R.ebitda_weight, f"case when ebitda_usd > 0 then {R.ebitda_weight}::double else 0.0::double end"),
    ("concentration", R.concentration_weight,
     f"round({R.concentration_weight}::double * ({_half_sql('top1_customer_pct', R.top1_cap)} + {_half_sql('top5_customer_pct', R.top5_cap)}) / 2, 2)"),
]
COMPONENTS_SQL = FINDINGS_SQL + ", components as (" + " union all ".join(
    f"select target_id, '{k}' as key, {w}::double as weight, {e} as earned from wide" for k, w, e in _PARTS
) + ")"
FIT_SQL = COMPONENTS_SQL + f""", blocked as (
  select target_id, string_agg(rule_id, ',' order by rule_seq) as blocked_by from findings where severity = 'blocker' group by 1
), raw as (
  select target_id, 100.0::double * cast(sum(cast(earned as decimal(12,2))) as double) / sum(weight) as raw from components group by 1
), fit as (
  select target_id, round(raw, 1) as score,
    case when blocked_by is not null then 'pass' when raw >= {R.tier_1} then 'tier_1' when raw >= {R.tier_2} then 'tier_2' else 'pass' end as tier,
    coalesce(blocked_by, '') as blocked_by
  from raw left join blocked using (target_id)
)"""


def target_metrics(spark, sf_dir):
    return wide_metrics(spark, sf_dir)


def rule_findings(spark, sf_dir):
    return rules.findings(wide_metrics(spark, sf_dir), CELLS)


def severity_counts(spark, sf_dir):
    wide = wide_metrics(spark, sf_dir)
    return rules.severity_counts(rules.findings(wide, CELLS), wide)


def fit_components(spark, sf_dir):
    return fit.components(wide_metrics(spark, sf_dir), CELLS)


def fit_score(spark, sf_dir):
    return fit.inbox(fit.fit(wide_metrics(spark, sf_dir), CELLS))


def rubric_verdicts(spark, sf_dir):
    return rules.verdicts(wide_metrics(spark, sf_dir), CELLS)


def metrics_long_coverage(spark, sf_dir):
    long = metrics.to_long(wide_metrics(spark, sf_dir))
    return long.groupBy("metric").agg(
        F.count("*").alias("targets"), F.count("value").alias("stated"), F.round(100.0 * F.count("value") / F.count("*"), 1).alias("stated_pct")
    )


def metrics_round_trip(spark, sf_dir):
    return metrics.to_wide(metrics.to_long(wide_metrics(spark, sf_dir))).select("target_id", *METRICS)


def missing_metrics_anti(spark, sf_dir):
    """Required metrics that a target does not state; some nations leave retention or revenue out."""
    n = F.split_part("target_id", F.lit("-"), F.lit(1)).cast("int")
    left_out = ((n % 4 == 1) & (F.col("metric") == "grr_pct")) | ((n % 5 == 2) & (F.col("metric") == "arr_usd"))
    long = metrics.to_long(wide_metrics(spark, sf_dir)).withColumn("value", F.when(~left_out, F.col("value")))
    required = spark.createDataFrame([(m,) for m in REQUIRED_METRICS], "metric string")
    wanted = long.select("target_id").distinct().join(F.broadcast(required))
    return wanted.join(long.where("value is not null").select("target_id", "metric"), ["target_id", "metric"], "left_anti")


def callout_ids(spark, sf_dir):
    found = rules.findings(wide_metrics(spark, sf_dir), CELLS)
    return feedback.callout_ids(found.select("target_id", F.col("severity").alias("kind"), F.col("rule_seq").alias("seq"))).select("target_id", "kind", "seq", "id")


def text_only_score(spark, sf_dir):
    """What the score would be without the metrics that charts carry, beside the full score."""
    wide = wide_metrics(spark, sf_dir)
    carriers = spark.createDataFrame([(m, "chart") for m in ("grr_pct", "nrr_pct", "top1_customer_pct", "top5_customer_pct")], "metric string, carrier string")
    less = metrics.to_wide(fit.text_only(metrics.to_long(wide), carriers))
    full = fit.fit(wide, CELLS).select("target_id", F.col("score").alias("full_score"))
    return fit.fit(less, CELLS).select("target_id", F.col("score").alias("text_score")).join(full, "target_id")


_TEXT_TOTAL = " + ".join(
    f"cast({e} as decimal(12,2))" for k, _, e in _PARTS if k in ("arr_band", "recurring", "gross_margin", "ebitda")
)


def set_flags(spark, sf_dir):
    """Targets flagged for retention, for concentration, for both and for the first only."""
    found = rules.findings(wide_metrics(spark, sf_dir), CELLS)
    fired = lambda *ids: F.bool_or(F.col("rule_id").isin(*ids))
    of_target = found.groupBy("target_id").agg(fired("R4", "R6").alias("retention"), fired("R10a", "R10b").alias("concentration"))
    flags = F.when(F.col("retention") & F.col("concentration"), "both").when(F.col("retention"), "retention only").when(F.col("concentration"), "concentration only")
    return of_target.select("target_id", flags.alias("flags")).where("flags is not null")


def blocker_exit(spark, sf_dir):
    """One row: whether any target is blocked, as an exit code would tell."""
    found = rules.findings(wide_metrics(spark, sf_dir), CELLS)
    return found.agg(F.coalesce(F.bool_or(F.col("severity") == "blocker"), F.lit(False)).alias("blocked"))


_UNPIVOT = " union all ".join(f"select target_id, '{m}' as metric, {m} as value from wide" for m in METRICS)
_CASES = [
    ("arr_band", "arr_usd", f"arr_usd between {R.arr_min} and {R.arr_max}", "breach"),
    ("recurring", "recurring_pct", f"recurring_pct >= {R.recurring_floor}", "breach"),
    ("grr", "grr_pct", f"grr_pct >= {R.grr_floor}", "below target"),
    ("nrr", "nrr_pct", f"nrr_pct >= {R.nrr_target}", "below target"),
    ("gross_margin", "gross_margin_pct", f"gross_margin_pct >= {R.margin_floor}", "below target"),
    ("ebitda", "ebitda_usd", "ebitda_usd > 0", "breach"),
    ("top1", "top1_customer_pct", f"top1_customer_pct <= {R.top1_cap}", "watch"),
    ("top5", "top5_customer_pct", f"top5_customer_pct <= {R.top5_cap}", "watch"),
]

QUERIES = {
    f.__name__: f
    for f in (
        target_metrics, rule_findings, severity_counts, fit_components, fit_score, rubric_verdicts, metrics_long_coverage,
        metrics_round_trip, missing_metrics_anti, callout_ids, text_only_score, set_flags, blocker_exit,
    )
}

_ALL = ", ".join(METRICS)
SQL = {
    "target_metrics": f"with {METRICS_SQL} select target_id, {_ALL} from wide",
    "metrics_round_trip": f"with {METRICS_SQL} select target_id, {_ALL} from wide",
    "rule_findings": f"with {FINDINGS_SQL} select * from findings",
    "severity_counts": f"""with {FINDINGS_SQL} select target_id, count(*) filter (severity = 'blocker') as blocker,
        count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'info') as info
        from wide left join findings using (target_id) group by 1""",
    "fit_components": f"""with {COMPONENTS_SQL} select target_id, key, weight, earned,
        coalesce(round(100 * (earned / nullif(weight, 0)), 1), 0.0) as pct from components""",
    "fit_score": f"with {FIT_SQL} select * from fit order by score desc, target_id",
    "rubric_verdicts": f"with {METRICS_SQL} " + " union all ".join(
        f"select target_id, '{k}' as criterion, case when {m} is null then '-' when {ok} then 'meets' else '{bad}' end as verdict from wide"
        for k, m, ok, bad in _CASES
    ),
    "metrics_long_coverage": f"""with {METRICS_SQL}, long as ({_UNPIVOT}) select metric, count(*) as targets, count(value) as stated,
        round(100.0::double * count(value) / count(*), 1) as stated_pct from long group by 1""",
    "missing_metrics_anti": f"""with {METRICS_SQL}, long as ({_UNPIVOT}) select target_id, metric from long
        where (value is null or (cast(split_part(target_id, '-', 1) as int) % 4 = 1 and metric = 'grr_pct') or (cast(split_part(target_id, '-', 1) as int) % 5 = 2 and metric = 'arr_usd')) and metric in ({", ".join(f"'{m}'" for m in REQUIRED_METRICS)})""",
    "callout_ids": f"""with {FINDINGS_SQL} select target_id, severity as kind, rule_seq as seq,
        'co-' || target_id || '-' || severity || '-' || lpad(cast(row_number() over (partition by target_id, severity order by rule_seq) as varchar), 3, '0') as id
        from findings""",
    "text_only_score": f"""with {FIT_SQL} select target_id, round(100.0::double * cast({_TEXT_TOTAL} as double) / {sum(w for _, w, _ in _PARTS)}, 1) as text_score,
        score as full_score from wide join fit using (target_id)""",
    "set_flags": f"""with {FINDINGS_SQL}, a as (select distinct target_id from findings where rule_id in ('R4', 'R6')),
        b as (select distinct target_id from findings where rule_id in ('R10a', 'R10b'))
        select target_id, 'both' as flags from a where target_id in (select target_id from b)
        union all select target_id, 'retention only' from a where target_id not in (select target_id from b)
        union all select target_id, 'concentration only' from b where target_id not in (select target_id from a)""",
    "blocker_exit": f"with {FINDINGS_SQL} select coalesce(bool_or(severity = 'blocker'), false) as blocked from findings",
}
