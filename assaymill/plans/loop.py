"""Queries over charts of many images, labels read twice, and the loop that folds corrections back; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaymill.functions.text import upper_each
from assaymill.operators import chart, feedback
from assaymill.sources.tables import table


def _priorities(spark, sf_dir):
    """Each customer's order priorities: img, p (1 to 5), label, n and the last key of their orders."""
    o = table(spark, sf_dir, "orders")
    p = F.left("o_orderpriority", F.lit(1)).cast("int")
    return o.groupBy(F.col("o_custkey").alias("img"), p.alias("p"), F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def assignment_pairs(spark, sf_dir):
    """Estimates of up to five series of each customer's chart, paired with what was measured; of some one is lacking."""
    rows = _priorities(spark, sf_dir)
    estimates = rows.select("img", "label", (10.0 * F.col("p") + 0.25 * (F.col("n") % 7)).alias("estimate"))
    measured = rows.where("not (img % 5 = 0 and p = 1)").select("img", (10.0 * F.col("p") + 0.25 * (F.col("last") % 9)).alias("value"))
    return chart.assign(estimates, measured)


def label_match(spark, sf_dir):
    """Labels of each customer's chart as measured and as read: whole, in part, with more, or not at all."""
    rows = _priorities(spark, sf_dir)
    p = F.col("p")
    read = F.when(p == 1, "urgent").when(p == 2, "2-high LINE").when((p == 3) & (F.col("img") % 3 == 0), None).when(p == 5, "Low").otherwise(F.col("label"))
    measured = rows.select("img", "label", F.col("n").cast("double").alias("value"))
    seen = rows.select("img", read.alias("label"), (F.col("n") + 0.25 * (F.col("last") % 4)).alias("value")).where("label is not null")
    return chart.match_labels(measured, seen)


def grid_rows(spark, sf_dir):
    """Gridlines of an image for each supplier, whose place follows from its key."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("img"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("y"))
    pixels = rows.select("img", "y", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("x"))
    grey = F.when(((F.col("y") + F.col("img")) % 25 < 2) & ((F.col("x") + F.col("img")) % 10 < 8), 220).otherwise(255)
    return chart.gridlines(pixels.select("img", "y", "x", grey.alias("r"), grey.alias("g"), grey.alias("b"))).select("img", "line", "y")


def chart_measure(spark, sf_dir):
    """A drawn chart for each region: three gridlines and two level lines, one higher in each chart than in the next."""
    places = F.explode(F.sequence(F.lit(0), F.lit(240 * 160 - 1)))
    base = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("img"), places.alias("k"))
    base = base.select("img", F.floor(F.col("k") / 160).cast("int").alias("y"), (F.col("k") % 160).cast("int").alias("x"))
    short = F.col("x").between(75, 139) & (F.abs(F.col("y") - (112 + 4 * F.col("img"))) <= 1)
    level = F.col("x").between(20, 139) & (F.abs(F.col("y") - 200) <= 1)
    grid = F.col("y").isin(20, 120, 220)
    channel = lambda a, b: F.when(short, a).when(level, b).when(grid, 220).otherwise(255).cast("int")
    pixels = base.select("img", "y", "x", channel(200, 30).alias("r"), channel(30, 30).alias("g"), channel(30, 200).alias("b"))
    ticks = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("img"), F.array(F.lit(50.0), F.lit(100.0), F.lit(75.0)).alias("ticks"))
    return chart.measure_charts(pixels, ticks).withColumn("series", F.col("series").cast("long"))


def _records(spark, sf_dir):
    """A correction for each turn: its call-out is one that exists, none, or one that doesn't; its reason follows from its key."""
    c, t = F.col("conv_id"), F.col("turn")
    callout = F.when(t % 3 == 0, F.concat(F.lit("co-"), (c % 50).cast("string"))).when(t % 3 == 2, F.concat(F.lit("co-x"), c.cast("string")))
    reason = F.when((c + t) % 3 == 0, "judgement_call").when((c + t) % 3 == 1, "factual_error").otherwise("needs_triage")
    rows = table(spark, sf_dir, "conversations")
    return rows.select(c.cast("string").alias("doc_id"), t.alias("idx"), callout.alias("callout_id"), ((t % 3 == 1) | (c % 10 == 0)).alias("blind_spot"), reason.alias("reason"), c, t)


def fold_back_violations(spark, sf_dir):
    """Corrections of conversations that name no call-out that exists, or weren't folded back."""
    records = _records(spark, sf_dir)
    callouts = records.select(F.concat(F.lit("co-"), (F.col("conv_id") % 50).cast("string")).alias("id"))
    lost = feedback.unanchored(records, callouts).select("doc_id", "idx", "why")
    examples = records.where("conv_id % 2 = 0").select("doc_id", "idx")
    regressions = records.where("conv_id % 3 = 0").select("doc_id")
    return lost.unionByName(feedback.not_folded_back(records, examples, regressions))


def regression_hold(spark, sf_dir):
    """For each question of a conversation: whether its first words still stand in a turn of its role and page; every third
    conversation has moved by a page, and of every fourth any page will do."""
    t = table(spark, sf_dir, "conversations")
    c, turn = F.col("conv_id"), F.col("turn")
    target = c.cast("string").alias("target_id")
    page = F.when(c % 4 != 0, turn).cast("int")
    wanted = F.array(F.left("text", F.lit(12)), upper_each(F.left("text", F.lit(3))))
    regressions = t.where("role = 'user'").select(F.concat_ws(":", c.cast("string"), turn.cast("string")).alias("id"), target, F.col("role").alias("kind"), page.alias("evidence_page"), wanted.alias("must_contain"))
    callouts = t.select(target, F.col("role").alias("kind"), (turn + F.when(c % 3 == 0, 1).otherwise(0)).cast("int").alias("evidence_page"), F.col("text").alias("question"))
    return feedback.regressions_held(regressions, callouts)


QUERIES = {f.__name__: f for f in (assignment_pairs, label_match, grid_rows, chart_measure, fold_back_violations, regression_hold)}

_PRIORITIES = """g as (select o_custkey as img, cast(left(o_orderpriority, 1) as int) as p, o_orderpriority as label, count(*) as n, max(o_orderkey) as last from orders group by 1, 2, 3)"""
_RECORDS = """r as (select cast(conv_id as varchar) as doc_id, turn as idx, conv_id as c, turn as t, case when turn % 3 = 0 then 'co-' || (conv_id % 50) when turn % 3 = 2 then 'co-x' || conv_id end as callout_id,
  (turn % 3 = 1 or conv_id % 10 = 0) as blind, case (conv_id + turn) % 3 when 0 then 'judgement_call' when 1 then 'factual_error' else 'needs_triage' end as reason from conversations)"""

SQL = {
    "assignment_pairs": f"""with {_PRIORITIES}, odd as (select distinct img from g where img % 5 = 0 and p = 1)
      select img, label, 10.0::double * p + 0.25::double * (n % 7) as estimate, 10.0::double * p + 0.25::double * (last % 9) as value from g where img not in (select img from odd)""",
    "label_match": f"""with {_PRIORITIES}, m as (select img, n, p = 3 and img % 3 = 0 as gone, 0.25::double * (last % 4) as delta from g)
      select img, count(*) as labels, count(*) filter (gone) as unmatched, case when count(*) filter (gone) = 0 then bool_and(delta <= 0.5) end as all_agree, round(max(delta) filter (not gone), 2) as worst from m group by 1""",
    "grid_rows": """with y as (select s_suppkey as img, y, (y + s_suppkey) // 25 as g from supplier, range(100) r(y) where (y + s_suppkey) % 25 < 2)
      select img, row_number() over (partition by img order by g) as line, avg(y) as y from y group by img, g""",
    "chart_measure": "select cast(r_regionkey as bigint) as img, s as series, case s when 1 then 360 else 195 end as pixels, case s when 1 then 55.0::double else 77.0 - r_regionkey end as value from region, range(1, 3) b(s)",
    "fold_back_violations": f"""with {_RECORDS}, ids as (select distinct 'co-' || (c % 50) as id from r)
      select doc_id, idx, 'no such call-out' as why from r where callout_id is not null and callout_id not in (select id from ids)
      union all select doc_id, idx, 'a blind spot has no call-out' from r where blind and callout_id is not null
      union all select doc_id, idx, 'no example' from r where reason = 'judgement_call' and c % 2 <> 0
      union all select doc_id, idx, 'no regression' from r where reason = 'factual_error' and c % 3 <> 0""",
    "regression_hold": """with t as (select *, turn + (conv_id % 3 = 0)::int as page from conversations)
      select u.conv_id || ':' || u.turn as id, exists (select 1 from t where t.conv_id = u.conv_id and t.role = u.role and (u.conv_id % 4 = 0 or t.page = u.turn)
        and contains(lower(t.text), lower(left(u.text, 12))) and contains(lower(t.text), lower(upper(left(u.text, 3))))) as held from conversations u where u.role = 'user'""",
}
