"""Queries over text: surface forms, attribution, reviewer buckets, roster lines, classification; and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.config import METRIC_WORDS, NOVEL_PRESENT, NOVEL_TERMS, RULE_TERMS
from assaymill.functions import text as T
from assaymill.operators import classify, feedback, recover
from assaymill.sources import parse
from assaymill.sources.tables import document_text, table, text_pages

#: Common short words of the invented English prose; a test list.
STOP = ["the", "and", "that", "with", "for", "this", "was", "are"]

def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether composed pages show the values that they state, and others that they don't."""
    pages = composed_pages(spark, sf_dir).select("page_id", T.folded(F.col("text")).alias("hay"))
    c = table(spark, sf_dir, "customer")
    stated = F.round(F.abs("c_acctbal"), 0)
    facts = F.array(
        F.struct(F.lit("arr_usd").alias("metric"), (stated * 1000).alias("value")), F.struct(F.lit("ebitda_usd").alias("metric"), (-1000 * stated - 1).alias("value")),
        F.struct(F.lit("grr_pct").alias("metric"), F.pmod("c_custkey", F.lit(97)).cast("double").alias("value")),
        F.struct(F.lit("yoy_growth_pct").alias("metric"), (F.pmod("c_custkey", F.lit(31)) + 0.5).alias("value")),
        F.struct(F.lit("nrr_pct").alias("metric"), (F.pmod("c_custkey", F.lit(97)) + 100).cast("double").alias("value")),
    )
    rows = c.select(F.col("c_custkey").alias("page_id"), F.inline(facts)).join(pages, "page_id")
    forms = T.surface_forms(F.col("metric"), F.col("value"))
    return rows.select("page_id", "metric", "value", T.present_in(F.col("hay"), forms).alias("present"))


def composed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that state customers' balances and parts' prices in several forms: page_id, text."""
    c = table(spark, sf_dir, "customer")
    units = F.round(F.abs("c_acctbal"), 0).cast("long")
    share = F.pmod("c_custkey", F.lit(97)).cast("string")
    text = F.concat(
        F.lit("Our gross retention was "), share, F.lit(" % in the year.\nGrowth  reached "), F.pmod("c_custkey", F.lit(31)).cast("string"),
        F.lit(".5% while ARR stood at $ "), units.cast("string"), F.lit(" K – or $"), units.cast("string"), F.lit("000.\n\nLargest customer: "),
        F.col("c_name"), F.lit(" $"), units.cast("string"), F.lit("."),
    )
    return c.select(F.col("c_custkey").alias("page_id"), text.alias("text"))


PAGES_SQL = """pages_ as (
  select c_custkey as page_id,
    'Our gross retention was ' || cast(c_custkey % 97 as varchar) || ' % in the year.' || chr(10) || 'Growth  reached ' || cast(c_custkey % 31 as varchar)
    || '.5% while ARR stood at $ ' || cast(cast(round(abs(c_acctbal), 0) as bigint) as varchar) || ' K – or $'
    || cast(cast(round(abs(c_acctbal), 0) as bigint) as varchar) || '000.' || chr(10) || chr(10) || 'Largest customer: ' || c_name || ' $'
    || cast(cast(round(abs(c_acctbal), 0) as bigint) as varchar) || '.' as text
  from customer)"""
_NORM = r"""regexp_replace(regexp_replace(regexp_replace(translate(text, '–—−' || chr(160), '--- '),
  '(\d)\s+([%KM])', '\1\2', 'g'), '\$\s+(\d)', '$\1', 'g'), '\s+', ' ', 'g')"""


def normalise_text(spark, sf_dir):
    return composed_pages(spark, sf_dir).select("page_id", T.normalise(F.col("text")).alias("text"))


def money_tokens(spark, sf_dir):
    """Every amount of every page with its value."""
    rows = composed_pages(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("text", F.lit(T.MONEY), F.lit(0))).alias("token"))
    value = T.amount(F.regexp_extract("token", T.MONEY, 1), F.regexp_extract("token", T.MONEY, 2))
    return rows.select("page_id", "token", value.alias("value"))


def keyword_attribution(spark, sf_dir):
    """How many pages name each metric."""
    pages = composed_pages(spark, sf_dir).select(T.folded(F.col("text")).alias("hay"))
    counts = pages.agg(F.count("*").alias("n"), *[F.count_if(T.names(F.col("hay"), m)).alias(m) for m in METRIC_WORDS])
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("pages"), F.col("n")) for m in METRIC_WORDS]
    return counts.select(F.inline(F.array(*rows)))


def layer_p(spark, sf_dir):
    """Values stated on pages that a text layer kept whole and one that lost every third page: recovered by carrier."""
    pages = composed_pages(spark, sf_dir).withColumnRenamed("page_id", "doc_id").withColumn("page_number", F.lit(1))
    whole = pages.withColumn("backend", F.lit("whole"))
    holed = pages.where("doc_id % 3 <> 0").withColumn("backend", F.lit("holed"))
    truth = pages.select(
        "doc_id", F.lit("grr_pct").alias("metric"), F.pmod("doc_id", F.lit(97)).cast("double").alias("value"),
        F.when(F.col("doc_id") % 2 == 0, "prose").otherwise("table").alias("carrier"), "page_number",
    )
    rows = recover.recoverability(truth, whole.unionByName(holed))
    return recover.graded(rows, "backend", "carrier")


def layer_p_table(spark, sf_dir):
    return recover.by_backend(layer_p(spark, sf_dir), ["whole", "holed", "vision"])


def reviewer_candidates(spark, sf_dir):
    """Numbers near the names of two metrics on composed pages."""
    pages = composed_pages(spark, sf_dir).withColumnRenamed("page_id", "doc_id").withColumn("page_number", F.lit(1))
    metrics = spark.createDataFrame([("grr_pct",), ("arr_usd",)], "metric string")
    return recover.candidates(pages.join(F.broadcast(metrics))).select("doc_id", "metric", "place", "number")


def reviewer_buckets(spark, sf_dir):
    """Asserted retention, right for two documents in three, against their pages."""
    pages = composed_pages(spark, sf_dir).withColumnRenamed("page_id", "doc_id").withColumn("page_number", F.lit(1))
    wrong = F.when(F.col("doc_id") % 3 == 0, 1000).otherwise(0)
    asserted = pages.select("doc_id", F.lit(0).alias("seq"), F.lit("grr_pct").alias("metric"), (F.pmod("doc_id", F.lit(97)) + wrong).cast("double").alias("asserted"))
    checks = recover.review(asserted, pages)
    return checks.groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.col("document_says")[0]).alias("first_number"))


def review_coverage(spark, sf_dir):
    """Coverage by document, settled from text and vision verdicts."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    asserted = docs.select("doc_id", F.posexplode(F.array(F.lit("arr_usd"), F.lit("grr_pct"), F.lit("ebitda_usd"))).alias("seq", "metric")).withColumn("asserted", F.lit(1.0))
    none = F.lit(None).cast("array<double>")
    verdict = F.when(F.col("doc_id") % 4 == 0, "agreed").when(F.col("doc_id") % 4 == 1, "could_not_check").otherwise("disagreed")
    text = asserted.where("metric = 'arr_usd' or (metric = 'grr_pct' and doc_id % 2 = 0)").select("doc_id", "metric", verdict.alias("verdict"), F.lit(1).alias("page"), F.lit("textlayer").alias("method"), none.alias("document_says"))
    vision = asserted.where("metric <> 'ebitda_usd' and doc_id % 3 = 0").select("doc_id", "metric", F.lit("agreed").alias("verdict"), F.lit(2).alias("page"), F.lit("vision").alias("method"), none.alias("document_says"), F.when(F.col("doc_id") % 2 == 0, "axis").otherwise("label").alias("read"))
    settled = recover.settle(asserted, text, vision)
    return settled.groupBy("metric", "verdict", "method").agg(F.count("*").alias("n"), F.sum("page").alias("pages"), F.count("reason").alias("reasons"), F.count_if(F.col("read") == "axis").alias("off_axis"))


def leak_check(spark, sf_dir):
    """Documents that contain a whole benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = feedback.cited_items(docs.select(F.col("doc_id").alias("report_id"), "text"), items.select(F.col("text").alias("item")))
    return found.groupBy("report_id").agg(F.count("*").alias("items"))


def banned_words(spark, sf_dir):
    """Pages that cite one of a few hosts."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("report_id"), F.col("url").alias("text"))
    domains = spark.createDataFrame([("spam-farm.example.org",), ("Cheap-Pills.example.com",), ("casino",)], "item string")
    return feedback.cited_items(pages, domains).withColumnRenamed("item", "domain")


def page_texts(spark, sf_dir):
    """Composed texts cut into pages and put together again."""
    texts = composed_pages(spark, sf_dir)
    pages = text_pages(texts, "page_id", "text")
    return document_text(pages, "page_id").select("page_id", "text", "n_chars", "empty_pages")


def content_word_jaccard(spark, sf_dir):
    """Documents against the first of their language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("target_id"), "text")
    first = docs.groupBy("target_id").agg(F.min("doc_id").alias("first"))
    rows = docs.join(first, "target_id").select("target_id", "text", F.when(F.col("doc_id") == F.col("first"), "base").otherwise(F.col("doc_id").cast("string")).alias("condition"))
    return classify.condition_similarity(rows, "base", STOP)


def keyword_classify(spark, sf_dir):
    """Every turn of every conversation, with a question that its key chooses, for every archetype: bucket and tag."""
    turns = table(spark, sf_dir, "conversations")
    asked = F.get(F.array(*map(F.lit, _QUESTIONS)), ((F.col("conv_id") + F.col("turn")) % len(_QUESTIONS)).cast("int"))
    rows = turns.select("conv_id", "turn", F.concat("text", F.lit(" "), asked).alias("text"), F.explode(F.array(*map(F.lit, NOVEL_PRESENT))).alias("archetype"))
    return classify.classify(rows).select("conv_id", "turn", "archetype", "bucket", "tag")


_QUESTIONS = [
    "What happens if the founder departs?", "Is the ARR definition adjusted?", "Could an AI tool displace this?",
    "They retain available maintenance", "Concentration in one customer", "Is EBITDA negative earnings?", "Gross margin basis?",
    "Legacy Delphi rewrite?", "A creditor of the largest customer is insolvent", "What colour is it?", "Is an LLM enough?",
]


def bucket_rates(spark, sf_dir):
    """Conversation turns by bucket."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("text"), F.lit("clean_gem").alias("archetype"))
    return classify.bucket_rates(classify.classify(turns))


def json_array_parse(spark, sf_dir):
    """Replies that think aloud and then give a JSON array: at most three members of each."""
    events = table(spark, sf_dir, "events")
    reply = F.concat(F.lit("<think>[0]\n</think> so:\n["), *[x for k in range(4) for x in (F.lit('{"k":'), (F.col("event_id") + k).cast("string"), F.lit("}" + ("," if k < 3 else "")))], F.lit("] done"))
    rows = events.select("event_id", F.explode(parse.embedded_array(reply, "array<struct<k:bigint>>", 3)).alias("e"))
    return rows.select("event_id", F.col("e.k").alias("k"))


def event_props(spark, sf_dir):
    """Keys of the events' JSON properties, by type."""
    events = table(spark, sf_dir, "events")
    rows = events.select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return rows.groupBy("event_type", "key").agg(F.count("*").alias("n"))


def asserted_loader(spark, sf_dir):
    """Asserted values of each customer as people write them; a header and words that are no number among them."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.concat
    written = F.array(
        F.struct(F.lit("Metric").alias("metric"), F.lit("value").alias("raw")),
        F.struct(F.lit(" arr_usd ").alias("metric"), text(F.lit(" $"), F.format_number(k * 12_345, 0)).alias("raw")),
        F.struct(F.lit("grr_pct").alias("metric"), text((k % 97).cast("string"), F.lit(".5%")).alias("raw")),
        F.struct(F.lit("ebitda_usd").alias("metric"), text(F.lit("-"), k.cast("string"), F.lit("e2")).alias("raw")),
        F.struct(F.lit("nrr_pct").alias("metric"), F.when(k % 3 == 0, "n/a").when(k % 3 == 1, "").otherwise(F.lit(None)).alias("raw")),
    )
    rows = c.select(k.cast("string").alias("doc_id"), F.posexplode(written).alias("seq", "w")).select("doc_id", "seq", "w.metric", "w.raw")
    return parse.asserted_values(rows, strict=False)


def roster(spark, sf_dir):
    """Customers and shares out of pages of lines: amounts beside names, below them, or without; headers, and names too
    short or too long; and pages that announce no customers."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    beside = F.concat(F.col("c_name"), F.lit("  - $"), (k % 9 + 1).cast("string"), F.lit(".5M"))
    below = F.concat(F.col("c_name"), F.lit("\n$"), (k % 900).cast("string"), F.lit(",000"))
    line = F.when(k % 7 == 0, F.lit("Customer\n$1M")).when(k % 7 == 1, F.lit("Ab $2M")).when(k % 7 == 2, F.lit("$3M\n$4M")).when(k % 7 == 3, F.lit("one of the nine words in a long line $1M"))
    line = line.when(k % 2 == 0, beside).otherwise(below)
    pages = c.select(k.alias("doc_id"), F.inline(F.array(
        F.struct(F.lit(2).alias("page_number"), F.concat(F.when(k % 5 == 0, "Our  customers\n").otherwise("Anchor Customers\n"), line).alias("text")),
        F.struct(F.lit(1).alias("page_number"), F.lit("Elsewhere Ltd $5M").alias("text")),
    )))
    return parse.roster_lines(parse.roster_pages(pages), F.lit(10_000_000.0)).select("doc_id", "name", "pct_arr")


QUERIES = {
    f.__name__: f
    for f in (
        surface_forms, normalise_text, money_tokens, keyword_attribution, layer_p, layer_p_table, reviewer_candidates, reviewer_buckets,
        review_coverage, leak_check, banned_words, page_texts, content_word_jaccard, keyword_classify, bucket_rates, json_array_parse,
        event_props, asserted_loader, roster,
    )
}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_WORDS = ", ".join(f"({_q(m)}, {_q(w)})" for m, ws in METRIC_WORDS.items() for w in ws)


def _hit_sql(terms):
    out = []
    for t in terms:
        out.append(f"regexp_matches(low, '(^|[^a-z0-9_]){t.strip('|')}($|[^a-z0-9_])')" if t.startswith("|") else f"contains(low, {_q(t)})")
    return "(" + " or ".join(out) + ")"


_TAG = (
    "case " + " ".join(f"when {_hit_sql(ts)} then '{n}'" for n, ts in NOVEL_TERMS.items())
    + " " + " ".join(f"when {_hit_sql(ts)} then '{n}'" for n, ts in RULE_TERMS.items()) + " else 'unmapped' end"
)
_PRESENT = ", ".join(f"({_q(a)}, {_q(t)})" for a, ts in NOVEL_PRESENT.items() for t in ts)
_NOVEL = ", ".join(_q(n) for n in NOVEL_TERMS)
_BUCKET = f"""case when tag in ({_NOVEL}) then (case when (archetype, tag) in (select a, t from present) then 'novel-real' else 'noise' end)
  when tag = 'unmapped' then 'noise' else 'redundant' end"""
_CLASSIFY = f"present(a, t) as (values {_PRESENT}), tagged as (select *, {_TAG} as tag from (select *, lower(text) as low from asked))"

SQL = {
    "surface_forms": f"""with u as (select c_custkey as k, round(abs(c_acctbal), 0)::double as v from customer)
      select k as page_id, m as metric, case m when 'arr_usd' then v * 1000 when 'ebitda_usd' then -1000 * v - 1 when 'grr_pct' then (k % 97)::double when 'yoy_growth_pct' then (k % 31) + 0.5::double
        else (k % 97 + 100)::double end as value, m in ('arr_usd', 'grr_pct', 'yoy_growth_pct') as present
      from u, (values ('arr_usd'), ('ebitda_usd'), ('grr_pct'), ('yoy_growth_pct'), ('nrr_pct')) as t(m)""",
    "normalise_text": f"with {PAGES_SQL} select page_id, {_NORM} as text from pages_",
    "money_tokens": rf"""with {PAGES_SQL}, found as (select page_id, unnest(regexp_extract_all(text, '\$\s?(\d+(?:,\d\d\d)*(?:\.\d+)?)\s*([KMBkmb])?')) as token from pages_)
        select page_id, token, cast(regexp_extract(replace(token, ',', ''), '[0-9.]*[0-9]') as double)
          * case when regexp_matches(token, '[kK]$') then 1e3 when regexp_matches(token, '[mM]$') then 1e6 when regexp_matches(token, '[bB]$') then 1e9 else 1.0 end as value from found""",
    "keyword_attribution": f"""with {PAGES_SQL}, words(metric, word) as (values {_WORDS}), norm as (select page_id, lower({_NORM}) as text from pages_),
        hits as (select distinct page_id, metric from norm join words on contains(text, word)), metrics as (select distinct metric from words)
        select metric, count(hits.page_id) as pages, (select count(*) from pages_) as n from metrics left join hits using (metric) group by 1""",
    "layer_p": f"""with {PAGES_SQL}, norm as (select page_id, lower({_NORM}) as text from pages_), backends(backend) as (values ('whole'), ('holed')),
        graded as (select backend, case when page_id % 2 = 0 then 'prose' else 'table' end as carrier,
          case when backend = 'holed' and page_id % 3 = 0 then '' else text end as t, page_id % 97 as v from norm, backends),
        marks as (select backend, carrier, contains(t, v || '%') or contains(t, v || ' %') or contains(t, v || ' percent') or contains(t, v || '.0%') as present,
          contains(t, 'gross retention') or contains(t, 'gross revenue retention') as attributed from graded)
        select backend, carrier, count(*) as n, count(*) filter (present) as present, count(*) filter (attributed) as attributed,
          round(100.0::double * count(*) filter (present and attributed) / count(*), 1) as pct from marks group by 1, 2""",
    "layer_p_table": "with g as (LAYER_P) select carrier, coalesce(cast(max(pct) filter (backend = 'whole') as varchar), 'not run') as whole, coalesce(cast(max(pct) filter (backend = 'holed') as varchar), 'not run') as holed, 'not run' as vision from g group by 1",
    "reviewer_candidates": rf"""with {PAGES_SQL}, norm as (select page_id, {_NORM} as text from pages_),
        grr as (select page_id as doc_id, 'grr_pct' as metric, strpos(lower(text), 'gross retention') - 1 as w, length('gross retention') as wl, text from norm),
        windows as (select doc_id, metric, greatest(0, w - 140) as lo, w, substr(text, greatest(0, w - 140) + 1, least(length(text), w + wl + 140) - greatest(0, w - 140)) as win from grr),
        pct as (select doc_id, metric, lo, w, win, unnest(regexp_extract_all(win, '\d+(?:\.\d+)?\s*%')) as token from windows),
        arr as (select page_id as doc_id, 'arr_usd' as metric, strpos(lower(text), 'arr') - 1 as w, text from norm),
        arrw as (select doc_id, metric, greatest(0, w - 140) as lo, w, substr(text, greatest(0, w - 140) + 1, least(length(text), w + 3 + 140) - greatest(0, w - 140)) as win from arr where w >= 0),
        money as (select doc_id, metric, lo, w, win, unnest(regexp_extract_all(win, '\$\s?\d+(?:,\d\d\d)*(?:\.\d+)?\s*[KMBkmb]?')) as token from arrw),
        nums as (
          select doc_id, metric, cast(regexp_extract(token, '[0-9.]*[0-9]') as double) as number, abs(strpos(win, token) - 1 - (w - lo)) as far from pct
          union all
          select doc_id, metric, floor(cast(regexp_extract(replace(token, ',', ''), '[0-9.]*[0-9]') as double)
            * case when regexp_matches(token, '[kK]$') then 1e3 when regexp_matches(token, '[mM]$') then 1e6 when regexp_matches(token, '[bB]$') then 1e9 else 1.0 end),
            abs(case when strpos(win, token || '.') > 0 then strpos(win, token || '.') else strpos(win, token) end - 1 - (w - lo)) from money),
        near as (select doc_id, metric, number, min(far) as far from nums group by 1, 2, 3)
        select doc_id, metric, place, number from (select *, row_number() over (partition by doc_id, metric order by far, number) as place from near) where place <= 3""",
    "reviewer_buckets": f"""with {PAGES_SQL}, rows_ as (select page_id % 97 as v, page_id % 3 = 0 as wrong from pages_)
        select case when wrong then 'disagreed' else 'agreed' end as verdict, count(*) as n, cast(sum(case when wrong then v end) as double) as first_number from rows_ group by 1""",
    "review_coverage": """with a as (select c_custkey as d, unnest(['arr_usd', 'grr_pct', 'ebitda_usd']) as metric from customer),
        t as (select d, metric, case d % 4 when 0 then 'agreed' when 1 then 'could_not_check' else 'disagreed' end as tv from a where metric = 'arr_usd' or (metric = 'grr_pct' and d % 2 = 0)),
        v as (select d, metric, 'agreed' as vv from a where metric <> 'ebitda_usd' and d % 3 = 0),
        s as (select metric, case when tv <> 'could_not_check' then tv when vv is not null then vv else 'could_not_check' end as verdict,
          case when tv <> 'could_not_check' then 'textlayer' when vv is not null then 'vision' when tv is not null then 'textlayer' end as method, d % 2 = 0 as even
          from a left join t using (d, metric) left join v using (d, metric))
        select metric, verdict, method, count(*) as n, cast(sum(case method when 'textlayer' then 1 when 'vision' then 2 end) as bigint) as pages, count(*) filter (method is null) as reasons,
          count(*) filter (method = 'vision' and even) as off_axis from s group by 1, 2, 3""",
    "leak_check": "select doc_id as report_id, count(*) as items from documents d join (select distinct text from benchmark) b on contains(lower(d.text), lower(b.text)) group by 1",
    "banned_words": "select page_id as report_id, domain from pages, (values ('spam-farm.example.org'), ('Cheap-Pills.example.com'), ('casino')) as v(domain) where contains(lower(url), lower(domain))",
    "page_texts": f"with {PAGES_SQL} select page_id, text, length(text) - 2 as n_chars, 0 as empty_pages from pages_",
    "content_word_jaccard": f"""with d as (select doc_id, concat_ws('/', lang, source) as target_id,
          list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z][a-z]+')), lambda x: not list_contains([{", ".join(map(_q, STOP))}], x)) as w from documents),
        b as (select target_id, arg_min(w, doc_id) as base, min(doc_id) as first from d group by 1)
        select target_id, cast(doc_id as varchar) as condition,
          coalesce(round(len(list_intersect(w, base)) / nullif(len(list_distinct(list_concat(w, base))), 0)::double, 3), 0.0) as similarity
        from d join b using (target_id) where doc_id <> first""",
    "keyword_classify": f"""with asked as (select conv_id, turn, archetype, text || ' ' || ([{", ".join(map(_q, _QUESTIONS))}])[1 + (conv_id + turn) % {len(_QUESTIONS)}] as text
      from conversations, (values {", ".join(f"({_q(a)})" for a in NOVEL_PRESENT)}) as v(archetype)), {_CLASSIFY} select conv_id, turn, archetype, {_BUCKET} as bucket, tag from tagged""",
    "bucket_rates": f"with asked as (select text, 'clean_gem' as archetype from conversations), {_CLASSIFY}, b as (select {_BUCKET} as bucket from tagged) select bucket, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 1) as pct from b group by 1",
    "json_array_parse": "select event_id, event_id + k as k from events, (values (0), (1), (2)) as v(k)",
    "event_props": "select event_type, key, count(*) as n from (select event_type, unnest(json_keys(props)) as key from events) group by 1, 2",
    "asserted_loader": """select cast(c_custkey as varchar) as doc_id, seq, metric, case seq when 1 then c_custkey * 12345.0::double when 2 then (c_custkey % 97) + 0.5::double when 3 then -100.0::double * c_custkey end as asserted
      from customer, (values (1, 'arr_usd'), (2, 'grr_pct'), (3, 'ebitda_usd'), (4, 'nrr_pct')) as v(seq, metric)""",
    "roster": """with r as (select c_custkey as doc_id, case when c_custkey % 7 = 2 then null else c_name end as name,
          case when c_custkey % 2 = 0 then (c_custkey % 9 + 1.5) * 1e6 else (c_custkey % 900) * 1e3 end as value from customer where c_custkey % 5 <> 0 and c_custkey % 7 not in (0, 1, 3)),
        n as (select doc_id, name, value from r where name is not null union all select doc_id, 'Anchor Customers', 3e6 from r where name is null)
        select doc_id, name, round(100 * (value / 1e7::double), 2) as pct_arr from n where 100 * (value / 1e7::double) between 0.05 and 80""",
}
SQL["layer_p_table"] = SQL["layer_p_table"].replace("LAYER_P", SQL["layer_p"])
