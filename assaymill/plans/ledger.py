"""Queries over records that readers, reviewers and researchers keep, and over what is made of them; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaymill.config import CELLS, METRICS, REQUIRED_METRICS
from assaymill.functions import numbers
from assaymill.functions import text as T
from assaymill.operators import chart, classify, contracts, feedback, fit, metrics, recover, render, rules, screen, series, signal
from assaymill.plans.analytics import SQL as ANALYTICS
from assaymill.plans.analytics import base_rate_cohort, customer_signal, monthly
from assaymill.plans.analytics import _MONTHLY as MONTHLY_SQL
from assaymill.plans.screening import FINDINGS_SQL, FIT_SQL, METRICS_SQL, wide_metrics
from assaymill.plans.screening import SQL as SCREENING
from assaymill.sources import fixtures, parse
from assaymill.sources.shared import stored
from assaymill.sources.tables import table
from assaymill.streaming import incremental

def key():
    return F.col("c_custkey")


def text_of(*parts):
    """One string of columns and literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _customers(spark, sf_dir, *columns):
    return table(spark, sf_dir, "customer").select("c_custkey", *columns)


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name")


# Readers


def page_methods(spark, sf_dir):
    """Pages with amounts, shares, and neither; charts read, measured, or not."""
    c = _customers(spark, sf_dir)
    text = F.when(key() % 4 == 0, text_of("ARR $", key())).when(key() % 4 == 1, text_of("retention ", key(), " %")).when(key() % 4 == 2, F.lit("see the chart \n")).otherwise(F.lit("words only"))
    pages = c.select(key().alias("doc_id"), F.lit(1).alias("page_number"), text.alias("text"))
    charts = pages.where("doc_id % 20 in (2, 6, 10, 3)").select(
        "doc_id", "page_number", (F.col("doc_id") % 20 != 3).alias("has_read"), (F.col("doc_id") % 20 != 6).alias("has_values"),
        F.when(F.col("doc_id") % 20 == 2, text_of("gross: ", F.col("doc_id"), ".0%")).alias("measured"),
    )
    return chart.read_pages(pages, charts).select("doc_id", "text", "method", "unresolved")


def model_reads(spark, sf_dir):
    """Series and ticks of replies: labels with colons, lines that are no reads, ticks that are no numbers."""
    c = _customers(spark, sf_dir)
    reply = text_of("gross: ", key() % 97, ".5%\nNet: retention: ", key() % 31, " \nlow: $5\nnothing: here\nTICKS: 90, 80.5 , x, -5\ntrailing")
    rows = c.select(key().alias("doc_id"), parse.reply_ticks(reply).alias("ticks"), F.explode(parse.reply_pairs(reply)).alias("p"))
    total = F.aggregate("ticks", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.col("p.label").alias("label"), F.col("p.value").alias("value"), F.size("ticks").cast("long").alias("ticks"), total.alias("tick_sum"))


def page_record_faults(spark, sf_dir):
    """Records of suppliers' line items, and why some may not be handed over."""
    kinds, sure = F.array(*map(F.lit, ["prose", "table", "label", "axis", "guess"])), F.array(F.lit("low"), F.lit("high"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("seq"),
        F.get(kinds, (F.col("l_orderkey") % 5).cast("int")).alias("read"), F.get(sure, (F.col("l_linenumber") % 2).cast("int")).alias("confidence"),
    )
    return contracts.broken_page_records(rows).groupBy("doc_id", "why").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def vision_page_union(spark, sf_dir):
    """Pages read by vision, and pages that are cited as such."""
    c = _customers(spark, sf_dir)
    read = c.where(key() % 3 != 0).select(key().alias("doc_id"), F.array((key() % 4).cast("int"), F.lit(7)).alias("pages"))
    cited = c.where(key() % 2 == 0).select(key().alias("doc_id"), F.inline(F.array(
        F.struct((key() % 5).cast("int").alias("page"), F.lit("vision").alias("method")), F.struct(F.lit(99).alias("page"), F.lit("textlayer").alias("method")),
    )))
    return contracts.vision_pages(read, cited).select("doc_id", F.array_join("pages", ",").alias("pages"))


def chart_carried(spark, sf_dir):
    carriers = F.array(*map(F.lit, ["chart", "prose", "table"]))
    truth = _customers(spark, sf_dir, "c_mktsegment", "c_acctbal").select(
        F.col("c_mktsegment").alias("target_id"), text_of("m", key()).alias("metric"), F.col("c_acctbal").alias("value"), F.get(carriers, (key() % 3).cast("int")).alias("carrier")
    )
    return contracts.chart_only(truth).select("target_id", "metric", "value")


def _book(spark, sf_dir):
    """An invented past acquisition for each customer."""
    rows = _customers(spark, sf_dir).select(key().alias("i"))
    return fixtures.records(rows, rows.count())


def carrier_counts(spark, sf_dir):
    """Facts of invented targets by carrier."""
    facts = fixtures.profiles(_book(spark, sf_dir), {"grr_pct": "chart", "top1_customer_pct": "table"})
    return facts.groupBy("carrier").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(20,2)")), 1).cast("double").alias("total"))


def dealbook(spark, sf_dir):
    """Invented past acquisitions."""
    return _book(spark, sf_dir)


def series_ends(spark, sf_dir):
    """Right ends of tracks of coloured pixels."""
    p = F.col("p_partkey")
    track = table(spark, sf_dir, "part").select((p % 3).alias("img"), (p % 5).alias("series"), F.floor(p / 15).alias("x"), (p * 7 % 100).alias("y"))
    return chart.line_ends(track)


def cache_left(spark, sf_dir):
    """Reads that are stored, and reads that are still missing: failures and empty texts aren't stored."""
    e = F.col("event_id")
    reads = table(spark, sf_dir, "events").select("event_id", "event_type", (e % 5 != 0).alias("ok"), F.when(e % 3 == 0, " ").when(e % 7 != 0, text_of("t", e)).alias("text"))
    left = incremental.cache_misses(reads.select("event_id", "event_type"), incremental.successes(reads), "event_id")
    return left.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


# Agents and their files


def front_matter_fields(spark, sf_dir):
    n = _nations(spark, sf_dir)
    page = text_of("---\nname: ", F.col("n_name"), "\nurl: https://example.org/", F.col("n"), "\nempty:\n---\nbody: not a field\n---\n")
    return n.select("n", F.explode(parse.front_matter(page)).alias("key", "value"))


def fenced_lists(spark, sf_dir):
    n = _nations(spark, sf_dir)
    page = text_of("# sources\n```text\na", F.col("n"), ".example.org\n  b.example.net  \n\n```\nand\n```\nlater.example\n```")
    return n.select("n", F.explode(parse.fenced_domains(page)).alias("domain"))


def tools_held(spark, sf_dir):
    """Forbidden tools of agents, and forbidden modules that their files import."""
    n = _nations(spark, sf_dir)
    k = F.col("n")
    tools = F.array(F.lit("read"), F.when(k % 2 == 0, "web").otherwise("grep"), F.when(k % 3 == 0, "shell").otherwise("web"))
    held = contracts.tools_not_allowed(n.select(F.col("n_name").alias("agent"), tools.alias("tools")), ["web", "shell"])
    lines = n.select(F.col("n_name").alias("file"), F.posexplode(F.array(
        F.lit("# import requests"), F.when(k % 2 == 0, "import requests").otherwise("import requests_mock"), F.when(k % 3 == 0, "  from net.http import get").otherwise("from network import get"),
    )).alias("line_no", "text"))
    found = contracts.forbidden_imports(lines, ["requests", "net.http"])
    return held.select("agent", F.col("tool").alias("what")).unionByName(found.select(F.col("file").alias("agent"), F.col("module").alias("what")))


# Claims and signals


def banded_lenses(spark, sf_dir):
    """Research of customers: admissible claims, and lenses with a source that isn't a vendor's."""
    tiers = F.array(*map(F.lit, ["primary", "practitioner", "vendor", "blog"]))
    research = _customers(spark, sf_dir, "c_mktsegment").select(
        F.concat_ws("-", "c_mktsegment", (key() % 10).cast("string")).alias("lens"), F.when(key() % 7 != 0, "found").alias("finding"), F.lit("u").alias("url"),
        F.repeat(F.lit("q"), (key() % 150).cast("int")).alias("quote"), F.when(key() % 11 != 0, "2024-01-01").alias("date"), F.get(tiers, (key() % 4).cast("int")).alias("tier"), F.lit("high").alias("materiality"),
    )
    return classify.banded_lenses(classify.admissible_claims(research))


def researched_roster(spark, sf_dir):
    """Customers with what research found: in distress, well, or not researched."""
    roster = _customers(spark, sf_dir, "c_mktsegment", "c_name").select(F.col("c_mktsegment").alias("target_id"), F.col("c_name").alias("name"), F.lit(1.5).alias("pct_arr"), "c_custkey")
    research = roster.where(key() % 3 == 0).select("target_id", "name", (key() % 2 == 0).alias("distress"))
    found = signal.with_verdicts(roster, research)
    return found.groupBy("target_id", "distress").agg(F.count("*").alias("n"), F.round(F.sum("pct_arr"), 2).alias("pct_arr"))


def headlines(spark, sf_dir):
    """A line for each base rate and each customer signal."""
    rate = contracts.base_rate_headline(base_rate_cohort(spark, sf_dir))
    health = signal.headline(customer_signal(spark, sf_dir)).select("target_id", "headline")
    return rate.withColumn("about", F.lit("base rate")).unionByName(health.withColumn("about", F.lit("customers")))


# Metrics and findings


def stated_conflicts(spark, sf_dir):
    """Stated retention that isn't the derived one."""
    wide = wide_metrics(spark, sf_dir)
    n = F.split_part("target_id", F.lit("-"), F.lit(1)).cast("int")
    derived = wide.select("target_id", F.lit("grr_pct").alias("metric"), F.col("grr_pct").alias("value"))
    stated = wide.select("target_id", F.lit("grr_pct").alias("metric"), F.round(F.col("grr_pct") + (n % 3) * 0.4, 4).alias("value"))
    return metrics.stated_conflicts(stated, derived)


def _cites(spark, sf_dir):
    """Citations of three metrics: by vision for targets of even nations, on a page by the nation."""
    n = F.split_part("target_id", F.lit("-"), F.lit(1)).cast("int")
    wide = wide_metrics(spark, sf_dir)
    rows = F.array(
        F.struct(F.lit("grr_pct").alias("metric"), F.lit("axis").alias("read")), F.struct(F.lit("nrr_pct").alias("metric"), F.lit("label").alias("read")),
        F.struct(F.lit("arr_usd").alias("metric"), F.lit(None).cast("string").alias("read")),
    )
    method = F.when((n % 2 == 0) & (F.col("metric") != "arr_usd"), "vision").otherwise("textlayer")
    return wide, wide.select("target_id", (n % 7 + 1).alias("page"), F.inline(rows)).withColumn("method", method)


def cited_findings(spark, sf_dir):
    wide, cites = _cites(spark, sf_dir)
    found = rules.with_citations(rules.findings(wide, CELLS), cites)
    return found.select("target_id", "rule_id", "metric", F.col("page").cast("long").alias("page"), "method")


def finding_records(spark, sf_dir):
    """Findings as JSON objects."""
    found = rules.findings(wide_metrics(spark, sf_dir), CELLS)
    return found.select(F.to_json(F.struct("target_id", "rule_id", "severity")).alias("record"))


def _callouts(spark, sf_dir):
    wide, cites = _cites(spark, sf_dir)
    n = F.split_part("target_id", F.lit("-"), F.lit(1)).cast("int")
    exhibits = wide.where(n % 3 == 0).select("target_id", F.lit("grr_pct").alias("metric"), F.lit(9).alias("page"))
    # Retention above 100 can't come from these tables: every fifth nation's is raised, every fourth's is left out.
    raised = F.when(n % 4 == 3, None).when(n % 5 == 0, F.col("grr_pct") + 100).otherwise(F.col("grr_pct"))
    wide = wide.withColumn("grr_pct", raised)
    return feedback.derive_callouts(cites, rules.findings(wide, CELLS), wide, exhibits)


def derived_callouts(spark, sf_dir):
    """Questions that follow from citations, findings and missing metrics."""
    return _callouts(spark, sf_dir).withColumn("evidence_page", F.col("evidence_page").cast("long"))


def memo_questions(spark, sf_dir):
    """Memos: a card, and the questions with the anchors that edits are traced to."""
    cards = wide_metrics(spark, sf_dir).select("target_id", text_of("# ", F.col("target_id")).alias("text"))
    return render.memos(cards, _callouts(spark, sf_dir))


def seeded_not_fired(spark, sf_dir):
    """Defects seeded in every target whose rule did not fire."""
    wide = wide_metrics(spark, sf_dir)
    seeded = wide.select("target_id", F.explode(F.array(F.lit("not recurring"), F.lit("loss"))).alias("defect"))
    rule_of = spark.createDataFrame([("not recurring", "R3"), ("loss", "R8")], "defect string, rule_id string")
    return feedback.fired_as_seeded(seeded, rules.findings(wide, CELLS), rule_of).select("target_id", "defect", "rule_id")


def marked_cells(spark, sf_dir):
    """Cells of a memo with the last call-out on their metric."""
    names = F.array(*map(F.lit, ["arr_usd", "grr_pct", "nrr_pct", "ebitda_usd", "mrr_usd"]))
    c = _customers(spark, sf_dir, "c_mktsegment")
    callouts = c.select(F.col("c_mktsegment").alias("target_id"), F.get(names, (key() % 4).cast("int")).alias("metric"), text_of("co-", key()).alias("id"), key().alias("seq"))
    cells = c.select(F.col("c_mktsegment").alias("target_id")).distinct().withColumn("metric", F.explode(names))
    return feedback.cell_marks(cells, callouts)


def frozen_callouts(spark, sf_dir):
    """The call-outs that each session reviewed."""
    n = _nations(spark, sf_dir)
    target = F.col("n_name").alias("target_id")
    sessions = n.select(target, F.explode(F.array(F.lit(1), F.lit(2))).alias("session"))
    frozen = n.where("n % 2 = 0").select(target, F.lit(1).alias("session"), F.explode(F.array(text_of("co-f-", F.col("n")), F.lit("co-f-x"))).alias("id"))
    current = n.where("n % 3 <> 0").select(target, text_of("co-c-", F.col("n")).alias("id"))
    return feedback.reviewed_callouts(sessions, frozen, current).withColumn("session", F.col("session").cast("long"))


def latest_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.struct("ts", "event_id").alias("seq"))
    return feedback.last_examples(rows, 3).select("event_id")


# Pages and values


def _three_pages(spark, sf_dir):
    """Three pages for each customer. The value stands on the third, and on one of the others for two in three."""
    c = _customers(spark, sf_dir)
    pages = c.select(key().alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page_number"))
    shows = (F.col("page_number") == 3) | ((F.col("doc_id") + F.col("page_number")) % 3 == 0)
    value = F.col("doc_id") % 97
    text = F.when(shows, text_of("The gross retention was ", value, "% then.")).otherwise(F.lit("Gross retention is shown elsewhere."))
    values = c.select(key().alias("doc_id"), F.lit("grr_pct").alias("metric"), (key() % 97).cast("double").alias("value"))
    return values, pages.select("doc_id", "page_number", text.alias("text"))


def citation_first_pages(spark, sf_dir):
    values, pages = _three_pages(spark, sf_dir)
    return recover.citation_pages(values, pages).select("doc_id", "metric", F.col("page").cast("long").alias("page"))


def recovered_in_rank(spark, sf_dir):
    """The first page, by rank, that shows a missing metric's value."""
    values, pages = _three_pages(spark, sf_dir)
    rank = ((F.col("page_number") + F.col("doc_id")) % 3 + 1).cast("int")
    routes = pages.select("doc_id", F.lit("grr_pct").alias("metric"), "page_number", rank.alias("rank"))
    return recover.first_recovered(values, routes, pages).select("doc_id", "value", F.col("page").cast("long").alias("page"))


def chart_leaks(spark, sf_dir):
    """Values that only charts should carry, but that a page prints."""
    values, _ = _three_pages(spark, sf_dir)
    pages = values.select("doc_id", F.lit(1).alias("page_number"), F.when(F.col("doc_id") % 4 == 0, text_of("about 1,", (F.col("doc_id") % 97), "% of it")).otherwise(F.lit("nothing printed")).alias("text"))
    return recover.leaks(values, pages).select("doc_id", "metric", "value", F.col("page_number").cast("long").alias("page"))


def review_rates(spark, sf_dir):
    """Coverage of each document's review."""
    verdict = F.when((key() + F.col("m")) % 3 == 0, "agreed").when((key() + F.col("m")) % 3 == 1, "disagreed").otherwise("could_not_check")
    checks = _customers(spark, sf_dir).withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), key() % 5 + 1))).select(key().alias("doc_id"), verdict.alias("verdict"))
    return recover.coverage(checks)


def seeded_error_check(spark, sf_dir):
    """Whole shares on pages, every other one changed before it is asserted, reviewed against the pages."""
    c = _customers(spark, sf_dir)
    names = [("grr_pct", "gross retention"), ("nrr_pct", "net retention"), ("gross_margin_pct", "gross margin")]
    rows = c.select(text_of(key()).alias("target_id"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("word"), (key() * (i + 3) % 89 + 1).cast("double").alias("value"), F.lit(i).alias("page_number")) for i, (m, w) in enumerate(names)])))
    pages = rows.select(F.col("target_id").alias("doc_id"), "page_number", text_of("Our ", F.col("word"), " was ", F.col("value").cast("long"), "%.").alias("text"))
    shown = recover.seeded(rows.select("target_id", "metric", "value"))
    asserted = shown.select(F.col("target_id").alias("doc_id"), F.lit(0).alias("seq"), "metric", F.col("shown").alias("asserted"))
    checks = recover.review(asserted, pages).select(F.col("doc_id").alias("target_id"), "metric", "verdict")
    return recover.reviewer_score(shown.join(checks, ["target_id", "metric"]))


def screened(spark, sf_dir):
    """Targets screened from their pages: required shares printed for even nations, drawn for others, of which vision reads
    those of every third; amounts are never printed. Scores, blockers and what was recovered how."""
    n = F.split_part("doc_id", F.lit("-"), F.lit(1)).cast("int")
    wide = stored(wide_metrics(spark, sf_dir), "wide")
    shares = [("recurring_pct", "recurring"), ("grr_pct", "gross retention"), ("nrr_pct", "net retention")]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("word"), F.round(m, 0).alias("value"), F.lit(i + 1).alias("page_number")) for i, (m, w) in enumerate(shares)])
    values = wide.select(F.col("target_id").alias("doc_id"), F.inline(rows)).where("value is not null")
    candidates = values.select("doc_id", "metric", "value")
    line = text_of("The ", F.col("word"), " share was ", F.col("value").cast("long"), "%.")
    printed = F.when(n % 2 == 0, line).otherwise(F.lit("A chart."))
    every = wide.select(F.col("target_id").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page_number"))
    pages = every.join(values.select("doc_id", "page_number", printed.alias("text")), ["doc_id", "page_number"], "left")
    routes = values.select("doc_id", "metric", "page_number", F.lit(1).alias("rank"))
    reads = values.where(n % 3 == 0).select("doc_id", "page_number", line.alias("text"), (F.col("metric") == "grr_pct").alias("unlabelled"))
    out = screen.screen(candidates, pages, routes, reads, CELLS)
    counts = out["counts"].withColumnRenamed("doc_id", "target_id").select("target_id", "by_text", "by_vision", "recovered")
    read = out["citations"].groupBy(F.col("doc_id").alias("target_id")).agg(F.count_if(F.col("read") == "axis").alias("off_axis"))
    joined = out["scores"].join(counts, "target_id", "left").join(read, "target_id", "left")
    return joined.select("target_id", "score", "tier", "blocked_by", "by_text", "by_vision", "recovered", F.coalesce("off_axis", F.lit(0)).alias("off_axis"))


# Texts


def condition_means(spark, sf_dir):
    """Words that the first documents of a source share with its first English one, by language."""
    docs = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    rows = docs.groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("text"))
    rows = rows.select(F.col("source").alias("target_id"), F.col("lang").alias("condition"), "text")
    return classify.mean_similarity(classify.condition_similarity(rows, "en", []))


def prompt_excerpts(spark, sf_dir):
    """How much of each document a prompt and a brief hold."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(render.excerpt(F.col("text"), render.EXCERPT_CHARS), 256).alias("excerpt"), F.length(render.excerpt(F.col("text"), render.PROMPT_CHARS)).cast("long").alias("prompt_chars"))


def target_briefs(spark, sf_dir):
    """All that a reasoner may see of a target: its rules, its customers, and up to twelve findings of research."""
    wide = wide_metrics(spark, sf_dir)
    n = F.split_part("target_id", F.lit("-"), F.lit(1)).cast("int")
    found = rules.findings(wide, CELLS).where("severity in ('blocker', 'warning')")
    document = found.select("target_id", F.lit("document").alias("block"), F.col("rule_seq").alias("seq"), text_of("RULE: ", F.col("rule_id")).alias("line"))
    health = wide.where(n % 2 == 0).select("target_id", F.lit("customers").alias("block"), F.lit(1).alias("seq"), F.lit("customers hold").alias("line"))
    research = wide.where(n % 3 == 0).select("target_id", F.lit("research").alias("block"), F.explode(F.sequence(F.lit(1), n + 1)).alias("seq"))
    research = research.withColumn("line", text_of("(market) finding ", F.col("seq")))
    return render.briefs(wide, document.unionByName(health).unionByName(research))


def scorecard_texts(spark, sf_dir):
    """Whole scorecards."""
    wide = wide_metrics(spark, sf_dir)
    return render.scorecards(wide, fit.fit(wide, CELLS), rules.verdicts(wide, CELLS), rules.findings(wide, CELLS))


def severity_table(spark, sf_dir):
    """A report: findings by rule, as one text."""
    found = rules.findings(wide_metrics(spark, sf_dir), CELLS).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
    return render.text_table(found, ["rule_id", "severity", "n"])


def plain_numbers(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", numbers.plain_number((key() % 1000) / 8.0).alias("shown"))


def clean_lines(spark, sf_dir):
    line = text_of("  - point ", key(), " <!--co-", key(), "-axis_read-001-->\t and  more <!-- kept --> ")
    return _customers(spark, sf_dir).select("c_custkey", T.clean_line(line).alias("line"))


# Series


def monthly_model(spark, sf_dir):
    """A modelled series for each nation: growth through a base, with a yearly wave."""
    n = _nations(spark, sf_dir)
    points = series.synthetic_monthly(1000.0 + F.col("n"), F.lit(1.01), F.lit(0.1))
    return n.select("n", F.inline(points)).select("n", F.col("t").cast("long").alias("t"), F.round("value", 4).alias("value"))


def concept_quarters(spark, sf_dir):
    """Answers of a registry on two concepts of each nation's company: quarters of the first concept that has enough, once
    each; years, and facts without an accession, are dropped."""
    n = _nations(spark, sf_dir)
    k = F.col("n")
    fact = lambda start, end, accession, value: text_of('{"start":"', start, '","end":"', end, '","val":', value, ',"accn":"', accession, '","fy":2020,"fp":"Q1","form":"10-Q"}')
    quarters = [("2020-01-01", "2020-03-31"), ("2020-04-01", "2020-06-30"), ("2020-01-01", "2020-03-31"), ("2020-01-01", "2020-12-31"), ("2020-07-01", "2020-09-30")]
    rows = [fact(a, b, F.when(k % 3 == i % 3, "").otherwise(text_of("acc-", F.lit(str(i)))) if i == 4 else f"acc-{i}", k * 10 + i) for i, (a, b) in enumerate(quarters)]
    many = F.concat(F.lit('{"units":{"USD":['), F.concat_ws(",", *rows), F.lit(']}}'))
    one = F.concat(F.lit('{"units":{"USD":['), rows[1], F.lit("]}}"))
    answers = n.select(k.alias("entity"), F.inline(F.array(
        F.struct(F.lit(1).alias("tag_priority"), F.when(k % 2 == 0, many).when(k % 5 == 0, F.lit("broken")).otherwise(one).alias("json")),
        F.struct(F.lit(2).alias("tag_priority"), F.when(k % 4 != 3, many).alias("json")),
    )))
    kept = series.first_long_enough(series.quarter_facts(parse.concept_facts(answers).withColumn("entity", F.struct("entity", "tag_priority"))).select("entity.*", "end", "value", "accession"), 2)
    return kept.select("entity", F.col("tag_priority").cast("long").alias("tag_priority"), F.col("end").cast("string").alias("end"), "value", "accession")


def covariate_parts(spark, sf_dir):
    """What the others did, standardised, before the last twelve months and in them."""
    rows = series.covariate_windows(series.cohort_covariates(monthly(spark, sf_dir)), 12)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4).alias(c)
    return rows.select("series_id", F.size("past").cast("long").alias("before"), F.size("future").cast("long").alias("held"), total("past"), F.round(F.get("future", 0), 4).alias("first_held"))


def _points(spark, sf_dir):
    rows = monthly(spark, sf_dir)
    month = F.lpad((F.col("t") % 12 + 1).cast("string"), 2, "0")
    end = F.concat_ws("-", (1995 + F.floor(F.col("t") / 12)).cast("string"), month)
    return rows.select(F.col("series_id").alias("entity"), F.lit("revenue").alias("tag"), end.alias("start"), end.alias("end"), "value", F.concat_ws("/", "series_id", F.col("t").cast("string")).alias("accession"))


def series_provenance(spark, sf_dir):
    found = series.provenance(_points(spark, sf_dir), 12)
    return found.select("entity", "trained_on", "first", "last_trained", "holdout_from", F.array_join(F.transform("filings", lambda x: x["accession"]), ",").alias("filings"))


def stored_revenue(spark, sf_dir):
    found = series.revenue_artifact(_points(spark, sf_dir))
    return found.select("entity", "tag", "quarters", F.sha2(F.array_join(F.transform("points", lambda x: x["accession"]), ","), 256).alias("points"))


QUERIES = {
    f.__name__: f
    for f in (
        page_methods, model_reads, page_record_faults, vision_page_union, chart_carried, carrier_counts, dealbook, series_ends, cache_left,
        front_matter_fields, fenced_lists, tools_held, banded_lenses, researched_roster, headlines, stated_conflicts, cited_findings,
        finding_records, derived_callouts, memo_questions, seeded_not_fired, marked_cells, frozen_callouts, latest_examples,
        citation_first_pages, recovered_in_rank, chart_leaks, review_rates, seeded_error_check, screened, condition_means, prompt_excerpts,
        target_briefs, plain_numbers, clean_lines, monthly_model, series_provenance, stored_revenue, covariate_parts,
        scorecard_texts, severity_table, concept_quarters,
    )
}

_UNIFORM = lambda name: f"(cast('0x' || substr(md5('book-1:' || i || ':{name}'), 1, 8) as bigint) / 4294967296.0::double)"
_BOOK = f"""raw as (select i, ['healthcare', 'logistics', 'education', 'construction', 'finance'][1 + cast(floor({_UNIFORM("vertical")} * 5) as int)] as vertical,
  round(1.5::double + 26.5::double * {_UNIFORM("arr")}, 2) as arr_m, round(76 + 24 * {_UNIFORM("grr")}, 1) as grr, round(65 + 34 * {_UNIFORM("recurring")}, 1) as recurring,
  round(2 + 40 * {_UNIFORM("top1")}, 1) as top1, round(24 * {_UNIFORM("growth")} - 3, 1) as growth, {_UNIFORM("luck")} as luck, {_UNIFORM("hope")} as hope from (select c_custkey as i from customer)),
came as (select *, round(0.4::double * (grr - 88) + 0.2::double * (recurring - 85) - 0.1::double * greatest(0.0, top1 - 15) + 0.1::double * growth + 8 * (luck - 0.5::double) + 4, 2) as outcome from raw),
book as (select 'D' || format('{{:03d}}', cast(i + 1 as bigint)) as deal_id, 2016 + i * 10 // (select count(*) from customer) as acquired, vertical, arr_m * 1e6::double as arr, grr, recurring, top1, growth,
  round(outcome + 6 * hope - 0.5::double + 0.1::double * greatest(0.0, growth), 2) as underwritten, outcome from came)"""
_N = "cast(split_part(target_id, '-', 1) as int)"
_METRIC_OF = ", ".join(f"('{r}', '{m}')" for r, m in rules.METRIC_OF.items())
_CITES = f"""cites as (select target_id, {_N} % 7 + 1 as page, m.metric, m.read, case when {_N} % 2 = 0 and m.metric <> 'arr_usd' then 'vision' else 'textlayer' end as method
  from wide, (values ('grr_pct', 'axis'), ('nrr_pct', 'label'), ('arr_usd', null)) as m(metric, read))"""
_MISSING = " union all ".join(f"select target_id, '{m}' as metric from changed where {m} is null" for m in REQUIRED_METRICS)
_CALLOUTS = f"""with {METRICS_SQL}, {_CITES},
changed as (select * replace (case when {_N} % 4 = 3 then null when {_N} % 5 = 0 then grr_pct + 100 else grr_pct end as grr_pct) from wide),
asked as (
  select target_id, 'axis_read' as kind, metric, page, metric || ' was read off a chart''s geometry: confirm or replace' as question from cites where method = 'vision' and read = 'axis'
  union all select target_id, 'label_read', metric, page, metric || ' was read off a printed label' from cites where method = 'vision' and read = 'label'
  union all select target_id, 'definition_conflict', 'grr_pct', null, 'gross retention above 100%: net retention under another name?' from changed where grr_pct > 100
  union all select target_id, 'missing_metric', metric, case when metric = 'grr_pct' and {_N} % 3 = 0 then 9 end,
    metric || case when metric = 'grr_pct' and {_N} % 3 = 0 then ' has an exhibit on page 9 but no value: ask for the series' else ' is never stated: ask for it first' end from ({_MISSING})),
callouts as (select target_id, kind, metric, cast(page as bigint) as evidence_page, question,
  'co-' || target_id || '-' || kind || '-' || lpad(cast(row_number() over (partition by target_id, kind order by metric) as varchar), 3, '0') as id from asked)"""
_SHOWS = "(p = 3 or (c_custkey + p) % 3 = 0)"
_SCREENED = METRICS_SQL.replace("), wide as (", "), stated as (") + f""", by_vision as (select target_id, {_N} % 2 <> 0 and {_N} % 3 = 0 as seen, {_N} % 2 = 0 as printed from stated),
wide as (select target_id, cast(null as double) as arr_usd, cast(null as double) as mrr_usd, {", ".join(f"case when seen or printed then round({m}, 0) end as {m}" for m in ("recurring_pct", "grr_pct", "nrr_pct"))},
  cast(null as double) as gross_margin_pct, cast(null as double) as ebitda_usd, cast(null as double) as yoy_growth_pct, cast(null as double) as top1_customer_pct, cast(null as double) as top5_customer_pct
  from stated join by_vision using (target_id))""" + FIT_SQL[len(METRICS_SQL):]
_STATED = "((recurring_pct is not null)::int + (grr_pct is not null)::int + (nrr_pct is not null)::int)"
COVARIATE_SQL = ANALYTICS["cohort_covariate"].replace("round(others, 4) as others, round((others", "others, ((others").replace("coalesce(nullif(stddev_pop(others) over (partition by series_id), 0), 1), 4) as z", "coalesce(nullif(stddev_pop(others) over (partition by series_id), 0), 1)) as z")
_POINTS = f"{MONTHLY_SQL}, points as (select series_id as entity, t, (1995 + t // 12) || '-' || lpad(cast(t % 12 + 1 as varchar), 2, '0') as e, series_id || '/' || t as accession from monthly)"

_PLAIN = lambda c: f"case when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) else regexp_replace(cast(cast(round({c}, 4) as decimal(38,4)) as varchar), '\\.?0+$', '') end"
_MONEY = lambda c: (
    f"case when {c} is null then 'not stated' else case when {c} < 0 then '-' else '' end || '$' || case when abs({c}) >= 1e6"
    f" then cast(cast(round(abs({c}) / 1e6, 1) as decimal(20,1)) as varchar) || 'M' else format('{{:,}}', cast(round(abs({c}), 0) as bigint)) end end"
)
_SHOWN = " || chr(10) || ".join(f"'- {m}: ' || " + (_MONEY(m) if m.endswith("_usd") else f"case when {m} is null then 'not stated' else {_PLAIN(m)} || '%' end") for m in METRICS)

SQL = {
    "scorecard_texts": f"""with {FIT_SQL}, v as ({SCREENING["rubric_verdicts"].removeprefix(f"with {METRICS_SQL} ")}),
        vs as (select target_id, string_agg('- ' || criterion || ': ' || verdict, chr(10) order by criterion || ': ' || verdict) as v from v group by 1),
        fs as (select target_id, string_agg('- ' || rule_id || ' ' || severity, chr(10) order by rule_seq) as f from findings group by 1)
        select target_id, '# ' || target_id || chr(10) || 'Score ' || {_PLAIN("score")} || ' ' || tier || chr(10) || {_SHOWN} || chr(10) || v || chr(10) || coalesce(f, '') as text
        from wide join fit using (target_id) join vs using (target_id) left join fs using (target_id)""",
    "severity_table": f"""with {FINDINGS_SQL}, l as (select '| ' || rule_id || ' | ' || severity || ' | ' || count(*) || ' |' as line from findings group by rule_id, severity)
        select '| rule_id | severity | n |' || chr(10) || '|-|-|-|' || chr(10) || string_agg(line, chr(10) order by line) as text from l""",
    "concept_quarters": """with f(i, e) as (values (0, '2020-03-31'), (1, '2020-06-30'), (4, '2020-09-30')),
        t as (select n_nationkey as entity, case when n_nationkey % 2 = 0 then 1 when n_nationkey % 4 <> 3 then 2 end as tag_priority from nation)
        select cast(entity as bigint) as entity, cast(tag_priority as bigint) as tag_priority, e as "end", cast(entity * 10 + i as double) as value, 'acc-' || i as accession
        from t, f where tag_priority is not null and not (i = 4 and entity % 3 = 1)""",
    "covariate_parts": f"""with z as ({COVARIATE_SQL}) select series_id, count(*) filter (t_from_end >= 12) as before, count(*) filter (t_from_end < 12) as held,
        round(sum(z) filter (t_from_end >= 12), 4) as past, round(max(z) filter (t_from_end = 11), 4) as first_held from z group by 1""",
    "page_methods": """select c_custkey as doc_id, case when c_custkey % 20 = 2 then 'see the chart' || chr(10) || chr(10) || 'gross: ' || c_custkey || '.0%'
          else case c_custkey % 4 when 0 then 'ARR $' || c_custkey when 1 then 'retention ' || c_custkey || ' %' when 2 then 'see the chart ' || chr(10) else 'words only' end end as text,
        case when c_custkey % 4 < 2 then 'textlayer' else 'vision' end as method,
        case when c_custkey % 4 < 2 or c_custkey % 20 = 2 then null when c_custkey % 20 = 3 then 'the chart was not read' when c_custkey % 20 = 6 then 'the chart''s geometry did not resolve'
          when c_custkey % 20 = 10 then 'labels and series did not match' else 'no chart on the page' end as unresolved from customer""",
    "model_reads": """select c_custkey as doc_id, 'gross' as label, c_custkey % 97 + 0.5::double as value, 3::bigint as ticks, 165.5::double as tick_sum from customer
        union all select c_custkey, 'Net: retention', cast(c_custkey % 31 as double), 3, 165.5 from customer""",
    "page_record_faults": """with r as (select l_suppkey as doc_id, l_orderkey as seq, l_orderkey % 5 as kind, l_linenumber % 2 as sure, row_number() over (partition by l_suppkey order by l_linenumber, l_orderkey) as place from lineitem),
        w as (select *, case when kind = 4 then 'unknown kind' when kind = 3 and sure = 1 then 'an axis read is never of high confidence' when place > 40 then 'too many records' end as why from r)
        select doc_id, why, count(*) as n, max(seq) as last from w where why is not null group by 1, 2""",
    "vision_page_union": """with p as (select c_custkey as doc_id, c_custkey % 4 as page from customer where c_custkey % 3 <> 0 union select c_custkey, 7 from customer where c_custkey % 3 <> 0
          union select c_custkey, c_custkey % 5 from customer where c_custkey % 2 = 0) select doc_id, string_agg(cast(page as varchar), ',' order by page) as pages from p group by 1""",
    "chart_carried": "select c_mktsegment as target_id, 'm' || c_custkey as metric, c_acctbal as value from customer where c_custkey % 3 = 0",
    "dealbook": f"with {_BOOK} select * from book",
    "carrier_counts": f"""with {_BOOK}, f as (select 'prose' as carrier, arr as v from book union all select 'chart', grr from book union all select 'prose', recurring from book
        union all select 'table', top1 from book union all select 'prose', growth from book) select carrier, count(*) as n, round(cast(sum(cast(v as decimal(20,2))) as double), 1) as total from f group by 1""",
    "series_ends": """with t as (select p_partkey % 3 as img, p_partkey % 5 as series, p_partkey // 15 as x, p_partkey * 7 % 100 as y from part), m as (select img, series, max(x) as "right" from t group by 1, 2)
        select img, series, max("right") as x, (min(y) + max(y)) / 2.0::double as y from t join m using (img, series) where x >= "right" - 3 group by 1, 2""",
    "cache_left": "select event_type, count(*) as n, min(event_id) as first from events where event_id % 5 = 0 or event_id % 3 = 0 or event_id % 7 = 0 group by 1",
    "front_matter_fields": """select cast(n_nationkey as bigint) as n, unnest(['name', 'url', 'empty']) as key, unnest([n_name, 'https://example.org/' || n_nationkey, '']) as value from nation""",
    "fenced_lists": "select cast(n_nationkey as bigint) as n, unnest(['a' || n_nationkey || '.example.org', 'b.example.net']) as domain from nation",
    "tools_held": """select n_name as agent, 'web' as what from nation where n_nationkey % 2 = 0 or n_nationkey % 3 <> 0 union all select n_name, 'shell' from nation where n_nationkey % 3 = 0
        union all select n_name, 'requests' from nation where n_nationkey % 2 = 0 union all select n_name, 'net.http' from nation where n_nationkey % 3 = 0""",
    "banded_lenses": """with c as (select c_mktsegment || '-' || c_custkey % 10 as lens, c_custkey % 4 as tier from customer where c_custkey % 7 <> 0 and c_custkey % 150 between 1 and 125 and c_custkey % 11 <> 0 and c_custkey % 4 < 3)
        select lens, count(*) as claims, count(*) filter (tier <> 2) as independent from c group by 1 having count(*) filter (tier <> 2) > 0""",
    "researched_roster": "select c_mktsegment as target_id, case when c_custkey % 3 = 0 then c_custkey % 2 = 0 end as distress, count(*) as n, round(1.5::double * count(*), 2) as pct_arr from customer group by 1, 2",
    "headlines": f"""with rates as ({ANALYTICS["base_rate_cohort"]}), health as ({ANALYTICS["customer_signal"]})
        select target_id, case when status = 'matched' then n || ' records: median ' || median || '% a year, ' || shrank_pct || '% shrank' else 'no base rate: ' || status end as headline, 'base rate' as about from rates
        union all select target_id, 'customers in distress hold ' || distressed_pct || '% of revenue; ' || researched || ' researched, ' || unresearched || ' not', 'customers' from health""",
    "stated_conflicts": f"with {METRICS_SQL} select target_id, 'grr_pct' as metric, round(grr_pct + 2 * 0.4::double, 4) as stated, grr_pct as derived from wide where {_N} % 3 = 2 and grr_pct is not null",
    "cited_findings": f"""with {FINDINGS_SQL}, {_CITES}, m(rule_id, metric) as (values {_METRIC_OF})
        select f.target_id, f.rule_id, m.metric, cast(c.page as bigint) as page, c.method from findings f left join m using (rule_id) left join cites c on c.target_id = f.target_id and c.metric = m.metric""",
    "finding_records": f"""with {FINDINGS_SQL} select '{{"target_id":"' || target_id || '","rule_id":"' || rule_id || '","severity":"' || severity || '"}}' as record from findings""",
    "derived_callouts": f"{_CALLOUTS} select * from callouts",
    "memo_questions": f"""{_CALLOUTS}, q as (select target_id, string_agg('- ' || question || ' <!--' || id || '-->', chr(10) order by id) as questions from callouts group by 1)
        select target_id, '# ' || target_id || case when questions is null then '' else chr(10) || chr(10) || '## Questions' || chr(10) || questions end as text from wide left join q using (target_id)""",
    "seeded_not_fired": f"""with {FINDINGS_SQL} select target_id, defect, d.rule_id from wide, (values ('not recurring', 'R3'), ('loss', 'R8')) as d(defect, rule_id)
        where not exists (select 1 from findings f where f.target_id = wide.target_id and f.rule_id = d.rule_id)""",
    "marked_cells": """with m(i, metric) as (values (0, 'arr_usd'), (1, 'grr_pct'), (2, 'nrr_pct'), (3, 'ebitda_usd'), (4, 'mrr_usd'))
        select s.c_mktsegment as target_id, m.metric, case when max(c.c_custkey) is not null then 'co-' || max(c.c_custkey) end as callout_id
        from (select distinct c_mktsegment from customer) s cross join m left join customer c on c.c_mktsegment = s.c_mktsegment and c.c_custkey % 4 = m.i group by 1, 2""",
    "frozen_callouts": """select n_name as target_id, 1::bigint as session, unnest(['co-f-' || n_nationkey, 'co-f-x']) as id, true as is_frozen from nation where n_nationkey % 2 = 0
        union all select n_name, s, 'co-c-' || n_nationkey, false from nation, (values (1), (2)) as v(s) where n_nationkey % 3 <> 0 and not (n_nationkey % 2 = 0 and s = 1)""",
    "latest_examples": "select event_id from events where event_type = 'purchase' order by ts desc, event_id desc limit 3",
    "citation_first_pages": f"select c_custkey as doc_id, 'grr_pct' as metric, cast(min(p) as bigint) as page from customer, (values (1), (2), (3)) as v(p) where {_SHOWS} group by 1",
    "recovered_in_rank": f"select c_custkey as doc_id, cast(c_custkey % 97 as double) as value, cast(arg_min(p, (p + c_custkey) % 3) as bigint) as page from customer, (values (1), (2), (3)) as v(p) where {_SHOWS} group by 1, 2",
    "chart_leaks": "select c_custkey as doc_id, 'grr_pct' as metric, cast(c_custkey % 97 as double) as value, 1::bigint as page from customer where c_custkey % 4 = 0",
    "review_rates": """with c as (select c_custkey as doc_id, (c_custkey + m) % 3 as v from (select c_custkey, unnest(range(1, c_custkey % 5 + 2)) as m from customer))
        select doc_id, count(*) as asserted, count(*) filter (v < 2) as checked, count(*) filter (v = 0) as agreed, count(*) filter (v = 1) as disagreed, round(100.0::double * count(*) filter (v < 2) / count(*), 1) as coverage_pct from c group by 1""",
    "seeded_error_check": """with v as (select c_custkey * (i + 3) % 89 + 1 as value, row_number() over (partition by c_custkey order by metric) % 2 = 1 as seeded
          from customer, (values (0, 'grr_pct'), (1, 'nrr_pct'), (2, 'gross_margin_pct')) as m(i, metric)),
        c as (select seeded, contains(value || '%', cast(round(value * case when seeded then 1.35::double else 1.0 end, 0) as bigint) || '%') as agrees from v)
        select count(*) filter (seeded and not agrees) as caught, count(*) filter (seeded and agrees) as missed, 0::bigint as unchecked, 0::bigint as false_flags, count(*) filter (not seeded) as confirmed,
          round(100.0::double * count(*) filter (seeded and not agrees) / nullif(count(*) filter (seeded), 0), 1) as catch_pct from c""",
    "screened": f"""with {_SCREENED}, asked as (select target_id, {_STATED} as n from stated), got as (select target_id, {_STATED} as n, (grr_pct is not null and seen)::bigint as off_axis, printed, seen from wide join by_vision using (target_id))
        select target_id, score, tier, blocked_by, case when a.n > 0 then case when printed then g.n else 0 end end as by_text, case when a.n > 0 then case when seen then g.n else 0 end end as by_vision,
          case when a.n > 0 then g.n || '/' || a.n end as recovered, off_axis from fit join asked a using (target_id) join got g using (target_id)""",
    "condition_means": """with d as (select source, lang, arg_min(text, doc_id) as text from documents where lang is not null and source is not null group by 1, 2),
        w as (select source, lang, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z][a-z]+')) as w from d), b as (select source, w as base from w where lang = 'en'),
        s as (select lang, coalesce(round(len(list_intersect(w, base)) / nullif(len(list_distinct(list_concat(w, base))), 0)::double, 3), 0.0) as s from w join b using (source) where lang <> 'en')
        select lang as condition, count(*) as n, round(avg(s), 3) as similarity from s group by 1""",
    "prompt_excerpts": "select doc_id, sha256(left(coalesce(text, ''), 2600)) as excerpt, cast(least(length(coalesce(text, '')), 14000) as bigint) as prompt_chars from documents",
    "target_briefs": f"""with {FINDINGS_SQL}, d as (select target_id, string_agg('  RULE: ' || rule_id, chr(10) order by rule_seq) as d from findings where severity in ('blocker', 'warning') group by 1),
        r as (select target_id, string_agg('  (market) finding ' || s, chr(10) order by s) as r from (select target_id, unnest(range(1, {_N} + 2)) as s from wide where {_N} % 3 = 0) where s <= 12 group by 1)
        select target_id, 'TARGET: ' || target_id || chr(10) || chr(10) || '[A] EXTRACTED FROM THE DOCUMENT' || chr(10) || coalesce(d, '  none available') || chr(10) || chr(10) || '[B] BASE RATE FROM PAST ACQUISITIONS' || chr(10)
          || '  none available' || chr(10) || chr(10) || '[C] CUSTOMER HEALTH' || chr(10) || case when {_N} % 2 = 0 then '  customers hold' else '  not researched' end || chr(10) || chr(10)
          || '[D] EXTERNAL RESEARCH' || chr(10) || coalesce(r, '  none available') as text from wide left join d using (target_id) left join r using (target_id)""",
    "plain_numbers": "select c_custkey, format('{:g}', (c_custkey % 1000) / 8.0::double) as shown from customer",
    "clean_lines": "select c_custkey, '- point ' || c_custkey || ' and more <!-- kept -->' as line from customer",
    "monthly_model": "select cast(n_nationkey as bigint) as n, t, round((1000.0::double + n_nationkey) * pow(1.01::double, t - 47) * (1 + 0.1::double * sin(2 * 3.141592653589793::double * t / 12)), 4) as value from nation, range(60) r(t)",
    "series_provenance": f"""with {_POINTS}, o as (select *, row_number() over (partition by entity order by t desc) - 1 as back from points)
        select entity, count(*) filter (back >= 12) as trained_on, min(e) as first, max(e) filter (back >= 12) as last_trained, min(e) filter (back < 12) as holdout_from,
          string_agg(accession, ',' order by t) filter (back < 12) as filings from o group by 1 having count(*) filter (back >= 12) >= 12""",
    "stored_revenue": f"with {_POINTS} select entity, 'revenue' as tag, count(*) as quarters, sha256(string_agg(accession, ',' order by t)) as points from points group by 1",
}
