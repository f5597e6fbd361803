"""Which stated values a text still shows, on which page, and how a reviewer's numbers hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.config import METRIC_WORDS, NEAR_CHARS
from assaymill.functions.text import MONEY, PERCENT, amount, attributed, folded, named_in, normalise, present_in, surface_forms, value_present


def recoverability(truth: DataFrame, pages: DataFrame) -> DataFrame:
    """truth: doc_id, metric, value, carrier, page_number. pages: backend, doc_id, page_number, text.

    Every truth row under every backend, with present and attributed; a page that is missing is an
    empty text.
    """
    backends = pages.select("backend").distinct()
    wanted = truth.join(F.broadcast(backends))
    joined = wanted.join(pages, ["backend", "doc_id", "page_number"], "left")
    text = F.coalesce("text", F.lit(""))
    return joined.select(
        "backend", "doc_id", "metric", "carrier",
        value_present(text, surface_forms(F.col("metric"), F.col("value"))).alias("present"),
        attributed(text, F.col("metric")).alias("attributed"),
    )


def graded(rows: DataFrame, *keys: str) -> DataFrame:
    """n, present, attributed and the share recovered with both (one decimal), by key."""
    both = F.count_if(F.col("present") & F.col("attributed"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("present").alias("present"),
        F.count_if("attributed").alias("attributed"),
        F.round(100.0 * both / F.count("*"), 1).alias("pct"),
    )


def by_backend(grades: DataFrame, backends: list[str]) -> DataFrame:
    """One row a carrier, one column a backend; a pair that wasn't run says so."""
    wide = grades.groupBy("carrier").pivot("backend", backends).agg(F.first("pct"))
    return wide.select("carrier", *[F.coalesce(F.col(b).cast("string"), F.lit("not run")).alias(b) for b in backends])


def candidates(pages: DataFrame, limit: int = 3, reach: int = NEAR_CHARS) -> DataFrame:
    """Numbers of the right kind near a word that names the metric, nearest first, each once, at most ``limit``. Numbers
    equally near stand in the order of the metric's words, then of the text.

    pages: doc_id, page_number, text, metric. Only tokens that lie whole within ``reach`` characters of
    the word count. Returns doc_id, page_number, metric, place, number. Words and numbers of a page
    meet inside its own row, so nothing is joined.
    """
    hay = pages.withColumn("hay", normalise(F.coalesce("text", F.lit(""))))
    names = F.create_map(*[x for k, v in METRIC_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    hay = hay.select("*", F.posexplode(F.element_at(names, F.col("metric"))).alias("turn", "word"))
    low = F.lower("hay")
    # Text before each occurrence of the word: its length is where the word starts.
    pieces = F.split(low, F.concat(F.lit(r"\Q"), F.col("word"), F.lit(r"\E")), -1)
    starts = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * F.length("word"),
    )
    hits = hay.where(F.contains(low, F.col("word"))).withColumn("at", F.explode(starts))
    left = F.greatest(F.lit(0), F.col("at") - reach)
    window = F.col("hay").substr(left + 1, F.least(F.length("hay"), F.col("at") + F.length("word") + reach) - left)
    hits = hits.select("doc_id", "page_number", "metric", "turn", "at", window.alias("window"), (F.col("at") - left).alias("anchor"))
    percent = F.endswith("metric", F.lit("_pct"))
    tokens = F.when(percent, F.regexp_extract_all("window", F.lit(PERCENT), F.lit(0))).otherwise(
        F.regexp_extract_all("window", F.lit(MONEY), F.lit(0))
    )
    hits = hits.withColumn("token", F.explode(tokens_with_places(F.col("window"), tokens)))
    number = F.when(
        percent, F.regexp_extract("token.text", PERCENT, 1).cast("double")
    ).otherwise(F.floor(amount(F.regexp_extract("token.text", MONEY, 1), F.regexp_extract("token.text", MONEY, 2))).cast("double"))
    rows = hits.select(
        "doc_id", "page_number", "metric", number.alias("number"),
        F.struct(F.abs(F.col("token.at") - F.col("anchor")).alias("far"), "turn", "at", F.col("token.at").alias("token")).alias("far"),
    )
    nearest = rows.groupBy("doc_id", "page_number", "metric", "number").agg(F.min("far").alias("far"))
    order = W.partitionBy("doc_id", "page_number", "metric").orderBy("far")
    return nearest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("far")


def tokens_with_places(text: Column, tokens: Column) -> Column:
    """An array of (text, at) for tokens that occur in this order: at counts characters from 0."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<text:string,at:int>>").alias("out"))

    def step(a: Column, token: Column) -> Column:
        at = F.call_function("locate", token, text, a["end"] + 1) - 1
        return F.struct(
            (at + F.length(token)).alias("end"),
            F.concat(a["out"], F.array(F.struct(token.alias("text"), at.alias("at")))).alias("out"),
        )

    return F.aggregate(tokens, start, step, lambda a: a["out"])


def review(asserted: DataFrame, pages: DataFrame, method: str = "textlayer") -> DataFrame:
    """asserted: doc_id, seq, metric, asserted. pages: doc_id, page_number, text.

    For each metric that a page names: agreed on the first page that names it and shows the value; else
    disagreed on the first page with other numbers near the name; else could_not_check on the first that
    names it. Metrics that no page names give no row.
    """
    pairs = asserted.join(pages, "doc_id").where(attributed(F.coalesce("text", F.lit("")), F.col("metric")))
    pairs = pairs.withColumn(
        "agrees", value_present(F.coalesce("text", F.lit("")), surface_forms(F.col("metric"), F.col("asserted")))
    )
    near = candidates(pairs.select("doc_id", "page_number", "metric", "text").distinct())
    says = near.groupBy("doc_id", "page_number", "metric").agg(
        F.array_sort(F.collect_list(F.struct("place", "number"))).alias("found")
    )
    pairs = pairs.join(says, ["doc_id", "page_number", "metric"], "left")
    agreed = F.min(F.when(F.col("agrees"), F.col("page_number")))
    other = F.min(F.when(F.col("found").isNotNull(), F.struct("page_number", "found")))
    rows = pairs.groupBy("doc_id", "seq", "metric", "asserted").agg(
        agreed.alias("agreed"), other.alias("other"), F.min("page_number").alias("named")
    )
    verdict = F.when(F.col("agreed").isNotNull(), "agreed").when(F.col("other").isNotNull(), "disagreed").otherwise("could_not_check")
    numbers = F.transform("other.found", lambda x: x["number"])
    return rows.select(
        "doc_id", "seq", "metric", "asserted", verdict.alias("verdict"),
        F.coalesce("agreed", "other.page_number", "named").alias("page"),
        F.lit(method).alias("method"),
        F.when(verdict == "disagreed", numbers).alias("document_says"),
    )


def settle(asserted: DataFrame, text: DataFrame, vision: DataFrame) -> DataFrame:
    """Text verdicts first, vision for what they left open, then a text could-not-check, then a reason. ``read``: how
    vision came by its value, label or axis, where its column says so."""
    keys = ["doc_id", "metric"]
    text, vision = (df if "read" in df.columns else df.withColumn("read", F.lit(None).cast("string")) for df in (text, vision))
    firm = F.col("verdict") != "could_not_check"
    ranked = (
        text.withColumn("rank", F.when(firm, 0).otherwise(2))
        .unionByName(vision.withColumn("rank", F.when(firm, 1).otherwise(3)))
    )
    best = ranked.groupBy(*keys).agg(
        F.min_by(F.struct("verdict", "page", "method", "document_says", "read"), "rank").alias("best")
    )
    joined = asserted.join(best, keys, "left")
    none = F.when(F.col("best").isNull(), F.lit("not found in the document"))
    return joined.select(
        *keys, "seq", "asserted", F.coalesce("best.verdict", F.lit("could_not_check")).alias("verdict"),
        F.col("best.page").alias("page"), F.col("best.method").alias("method"),
        F.col("best.document_says").alias("document_says"), F.col("best.read").alias("read"), none.alias("reason"),
    )


def coverage(checks: DataFrame) -> DataFrame:
    """Per document: asserted, checked and the share checked (one decimal)."""
    checked = F.count_if(F.col("verdict") != "could_not_check")
    return checks.groupBy("doc_id").agg(
        F.count("*").alias("asserted"), checked.alias("checked"),
        F.count_if(F.col("verdict") == "agreed").alias("agreed"),
        F.count_if(F.col("verdict") == "disagreed").alias("disagreed"),
        F.round(100.0 * checked / F.count("*"), 1).alias("coverage_pct"),
    )


def seeded(values: DataFrame, factor: float = 1.35) -> DataFrame:
    """Every other metric of a document, in the order of names, times ``factor``: seeded and shown."""
    place = F.row_number().over(W.partitionBy("target_id").orderBy("metric")) - 1
    rows = values.where("value is not null").withColumn("seeded", place % 2 == 0)
    return rows.withColumn("shown", F.when(F.col("seeded"), F.col("value") * factor).otherwise(F.col("value")))


def reviewer_score(checks: DataFrame) -> DataFrame:
    """checks: seeded, verdict. Seeded errors caught, missed and not checkable; sound values flagged and confirmed."""
    c = F.col
    caught = F.count_if(c("seeded") & (c("verdict") == "disagreed"))
    missed = F.count_if(c("seeded") & (c("verdict") == "agreed"))
    return checks.agg(
        caught.alias("caught"), missed.alias("missed"),
        F.count_if(c("seeded") & (c("verdict") == "could_not_check")).alias("unchecked"),
        F.count_if(~c("seeded") & (c("verdict") == "disagreed")).alias("false_flags"),
        F.count_if(~c("seeded") & (c("verdict") == "agreed")).alias("confirmed"),
        F.round(F.try_divide(100.0 * caught, caught + missed), 1).alias("catch_pct"),
    )


def citation_pages(values: DataFrame, pages: DataFrame) -> DataFrame:
    """The first page that shows a value, whether or not it names the metric: doc_id, metric, page."""
    pairs = values.join(pages, "doc_id").where(
        value_present(F.coalesce("text", F.lit("")), surface_forms(F.col("metric"), F.col("value")))
    )
    return pairs.groupBy("doc_id", "metric").agg(F.min("page_number").alias("page"))


#: Rows of routes that one part of a join sorts, about: parts that are measured as compressed can be far larger.
PART_ROWS = 500_000


def first_recovered(missing: DataFrame, routes: DataFrame, pages: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Of a missing metric's routed pages, in the order of rank, the first that names it and shows the value."""
    parts = -(-routes.count() // part_rows)
    if parts > 1:  # as many parts as rows ask for, which Spark leaves as they are
        missing, routes = (df.repartition(parts, "doc_id", "metric") for df in (missing, routes))
        pages = pages.repartition(parts, "doc_id", "page_number")
    pairs = missing.join(routes, ["doc_id", "metric"]).join(pages, ["doc_id", "page_number"])
    hay = folded(F.coalesce("text", F.lit("")))
    shown = named_in(hay, F.col("metric")) & present_in(hay, surface_forms(F.col("metric"), F.col("value")))
    return pairs.where(shown).groupBy("doc_id", "metric", "value").agg(F.min_by("page_number", "rank").alias("page"))


def leaks(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Values that should stand in charts only, but that a text shows as a percent: should be empty."""
    shown = F.concat(F.round("value", 0).cast("long").cast("string"), F.lit("%"))
    pairs = values.join(pages, "doc_id").where(F.contains(F.replace("text", F.lit(","), F.lit("")), shown))
    return pairs.select("doc_id", "metric", "value", "page_number").distinct()
