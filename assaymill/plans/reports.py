"""Queries that render whole memos, briefs and results of screening runs; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaymill.config import CELLS, METRICS
from assaymill.operators import fit, memo, render, rules, signal
from assaymill.plans import analytics, ledger
from assaymill.plans.screening import FINDINGS_SQL, FIT_SQL, METRICS_SQL, wide_metrics
from assaymill.sources.shared import stored


def customer_headlines(spark, sf_dir):
    """How many customers of each target are in distress, what hangs on them, and what nobody looked at."""
    return signal.full_headline(signal.customer_details(analytics._roster(spark, sf_dir)))


def base_rate_headlines(spark, sf_dir):
    return memo.rate_headline(analytics.base_rate_cohort(spark, sf_dir))


def memo_texts(spark, sf_dir):
    """A memo for every target: verdict, cited figures, flags, notes, what is left out, context, questions."""
    wide = stored(wide_metrics(spark, sf_dir), "wide")
    _, cites = ledger._cites(spark, sf_dir)
    cites = stored(cites, "citations")
    found = rules.with_citations(rules.findings(wide, CELLS), cites)
    callouts = stored(ledger._callouts(spark, sf_dir), "callouts")
    return memo.memos(wide, fit.fit(wide, CELLS), cites, found, callouts, base_rate_headlines(spark, sf_dir), customer_headlines(spark, sf_dir))


def full_briefs(spark, sf_dir):
    """Briefs with all blocks filled from the tables: rules, base rates and customers; there is no research."""
    wide = stored(wide_metrics(spark, sf_dir), "wide")
    found = rules.findings(wide, CELLS).where("severity in ('blocker', 'warning')")
    document = found.select("target_id", F.lit("document").alias("block"), F.col("rule_seq").alias("seq"), F.concat(F.lit("RULE: "), "rule_id").alias("line"))
    block = lambda df, name: df.select("target_id", F.lit(name).alias("block"), F.lit(1).alias("seq"), F.col("headline").alias("line"))
    rates, customers = base_rate_headlines(spark, sf_dir), customer_headlines(spark, sf_dir)
    return render.briefs(wide, document.unionByName(block(rates, "base_rate")).unionByName(block(customers, "customers")))


def screen_results(spark, sf_dir):
    """Results of the run as stored: one JSON object a target."""
    wide = stored(wide_metrics(spark, sf_dir), "wide")
    _, cites = ledger._cites(spark, sf_dir)
    return memo.results(wide, fit.fit(wide, CELLS), cites, rules.findings(wide, CELLS))


QUERIES = {f.__name__: f for f in (customer_headlines, base_rate_headlines, memo_texts, full_briefs, screen_results)}

_ALIKE = " ".join(f"when {i} then '{a}'" for i, a in enumerate(memo.ALIKE))
_PLACES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(METRICS))
_SHOWN = "case " + " ".join(
    f"when p.metric = '{m}' then " + (ledger._MONEY(m) if m.endswith("_usd") else f"{ledger._PLAIN(m)} || '%'") for m in METRICS
) + " end"
_VALUE = "case " + " ".join(f"when p.metric = '{m}' then {m}::double" for m in METRICS) + " end"
_KNOWN = "case " + " ".join(f"when p.metric = '{m}' then {m} is not null" for m in METRICS) + " end"
_CUSTOMERS = f"""with {METRICS_SQL}, {analytics._ROSTER}, ill as (select target_id, count(*) filter (distress) as n from roster group by 1)
  select target_id, {analytics._SEVERITY} as severity, case when n > 0 then n || ' of ' || researched || ' researched customers are in distress and hold ' || distressed_pct || '% of revenue, ' || largest
    || ' the most of them with ' || top || '%' else 'no distress among ' || researched || ' researched customers with ' || researched_pct || '% of revenue' end
    || '; the roster covers ' || roster_pct || '%, ' || unresearched || ' of it unresearched' as headline from signals join ill using (target_id)"""
_RATES = f"""select target_id, case when status = 'matched' then n || ' past records alike in ' || case rung {_ALIKE} end || ' grew ' || median || '% a year at the median, ' || p10
  || '% at the lowest tenth, ' || p90 || '% at the highest; ' || shrank_pct || '% shrank; ' || optimistic_pct || '% were expected to do better than they did'
  else 'no base rate: ' || status end as headline from ({analytics.SQL["base_rate_cohort"]})"""
_SECTION = lambda heading, lines, nothing: f"chr(10) || chr(10) || '## {heading}' || chr(10) || coalesce({lines}, '- {nothing}')"

SQL = {
    "customer_headlines": _CUSTOMERS,
    "base_rate_headlines": _RATES,
    "memo_texts": f"""with {FIT_SQL}, {ledger._CITES}, called as ({ledger._CALLOUTS} select * from callouts), p(place, metric) as (values {_PLACES}), m_(rule_id, metric) as (values {ledger._METRIC_OF}),
      fig as (select w.target_id, string_agg('- ' || p.metric || ': ' || {_SHOWN} || coalesce(' (page ' || c.page || ', ' || c.method || ')', ' (no source)') || coalesce(' <!--' || a.id || '-->', ''), chr(10) order by p.place) as fig
        from wide w cross join p left join cites c on c.target_id = w.target_id and c.metric = p.metric
        left join called a on a.target_id = w.target_id and a.metric = p.metric and a.kind in ('axis_read', 'label_read') where {_KNOWN} group by 1),
      fl as (select f.target_id, rule_seq, severity in ('blocker', 'warning') as grave, '- ' || severity || ' ' || f.rule_id || coalesce(' (page ' || c.page || ')', '') as line
        from findings f left join m_ using (rule_id) left join cites c on c.target_id = f.target_id and c.metric = m_.metric),
      flags as (select target_id, string_agg(line, chr(10) order by rule_seq) filter (grave) as flags, string_agg(line, chr(10) order by rule_seq) filter (not grave) as notes from fl group by 1),
      qs as (select target_id, string_agg('- ' || question || ' <!--' || id || '-->', chr(10) order by id) filter (kind = 'missing_metric') as gone,
        string_agg('- ' || question, chr(10) order by list_position(['missing_metric', 'definition_conflict', 'axis_read'], kind), id) filter (kind <> 'label_read') as asked from called group by 1),
      cust as ({_CUSTOMERS}), rate as ({_RATES})
      select target_id, '# Memo on ' || target_id || chr(10) || chr(10) || 'Score ' || cast(cast(score as decimal(10,1)) as varchar) || ', ' || tier || case when blocked_by <> '' then ', blocked by ' || blocked_by else '' end
        || {_SECTION("Figures", "fig", "nothing was recovered")} || {_SECTION("Flags", "flags", "no rule blocks or warns")} || {_SECTION("Notes", "notes", "none")}
        || {_SECTION("Left out", "gone", "nothing that is required")} || chr(10) || chr(10) || '## Outside the document, for no score' || chr(10) || '- customers: ' || coalesce(cust.headline, 'not researched')
        || chr(10) || '- base rate: ' || coalesce(rate.headline, 'none') || {_SECTION("Ask", "asked", "nothing is open")} as text
      from wide join fit using (target_id) left join fig using (target_id) left join flags using (target_id) left join qs using (target_id) left join cust using (target_id) left join rate using (target_id)""",
    "full_briefs": f"""with {FINDINGS_SQL}, d as (select target_id, string_agg('  RULE: ' || rule_id, chr(10) order by rule_seq) as d from findings where severity in ('blocker', 'warning') group by 1),
      cust as ({_CUSTOMERS}), rate as ({_RATES})
      select target_id, 'TARGET: ' || target_id || chr(10) || chr(10) || '[A] EXTRACTED FROM THE DOCUMENT' || chr(10) || coalesce(d, '  none available') || chr(10) || chr(10) || '[B] BASE RATE FROM PAST ACQUISITIONS' || chr(10)
        || coalesce('  ' || rate.headline, '  none available') || chr(10) || chr(10) || '[C] CUSTOMER HEALTH' || chr(10) || coalesce('  ' || cust.headline, '  not researched') || chr(10) || chr(10)
        || '[D] EXTERNAL RESEARCH' || chr(10) || '  none available' as text from wide left join d using (target_id) left join rate using (target_id) left join cust using (target_id)""",
    "screen_results": f"""with {FIT_SQL}, {ledger._CITES}, p(place, metric) as (values {_PLACES}),
      m_ as (select w.target_id, count(*) as n, string_agg('{{"metric":"' || p.metric || '","value":' || cast({_VALUE} as decimal(20,4)) || coalesce(',"page":' || c.page || ',"method":"' || c.method || '"', '') || '}}', ',' order by p.place) as ms
        from wide w cross join p left join cites c on c.target_id = w.target_id and c.metric = p.metric where {_KNOWN} group by 1),
      f_ as (select target_id, string_agg('{{"rule_id":"' || rule_id || '","severity":"' || severity || '"}}', ',' order by rule_seq) as fs from findings group by 1)
      select target_id, '{{"target_id":"' || target_id || '","score":' || cast(score as decimal(10,1)) || ',"tier":"' || tier || '","blocked_by":"' || blocked_by || '","recovered":' || coalesce(n, 0)
        || coalesce(',"metrics":[' || ms || ']', '') || coalesce(',"findings":[' || fs || ']', '') || '}}' as record
      from wide join fit using (target_id) left join m_ using (target_id) left join f_ using (target_id)""",
}
