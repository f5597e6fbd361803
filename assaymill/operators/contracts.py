"""Contracts of what readers and researchers hand over, and measures of how they did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.config import EXHIBIT_HINTS, EXHIBIT_WORDS, MOST_PAGE_RECORDS, READ_KINDS


def exhibit_pages(missing: DataFrame, pages: DataFrame, read: DataFrame) -> DataFrame:
    """missing: doc_id, metric. pages: doc_id, page_number, text. read: doc_id, page_number that vision read.

    The lowest page that announces the metric and was read, or speaks of an exhibit: doc_id, metric, page.
    """
    hints = F.create_map(*[x for m, ps in EXHIBIT_HINTS.items() for x in (F.lit(m), F.lit("(?i)" + "|".join(ps)))])
    seen = pages.join(read.select("doc_id", "page_number").distinct().withColumn("was_read", F.lit(True)), ["doc_id", "page_number"], "left")
    pairs = missing.join(seen, "doc_id").withColumn("hint", F.element_at(hints, F.col("metric"))).where("hint is not null")
    announced = F.regexp_like("text", F.col("hint")) & (F.coalesce("was_read", F.lit(False)) | F.col("text").rlike(f"(?i){EXHIBIT_WORDS}"))
    return pairs.where(announced).groupBy("doc_id", "metric").agg(F.min("page_number").alias("page"))


def ship_label_or_axis(rows: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """rows: img, label_value, axis_value. Both agree: the label is shipped; else the axis, flagged; one alone is shipped."""
    near = F.abs(F.col("label_value") - F.col("axis_value")) <= tolerance
    both = F.col("label_value").isNotNull() & F.col("axis_value").isNotNull()
    read = F.when(both & near, "label").when(F.col("axis_value").isNotNull(), "axis").when(F.col("label_value").isNotNull(), "label")
    value = F.when(read == "label", F.col("label_value")).when(read == "axis", F.col("axis_value"))
    return rows.select("img", read.alias("read"), value.alias("value"), (both & ~near).alias("flagged"))


def broken_page_records(records: DataFrame) -> DataFrame:
    """records: doc_id, page, seq, read, confidence. Those that a page reader may not hand over, and why:
    a kind that isn't known, an axis read of high confidence, more than the most a document may have."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "seq"))
    why = (
        F.when(~F.col("read").isin(READ_KINDS), "unknown kind")
        .when((F.col("read") == "axis") & (F.col("confidence") == "high"), "an axis read is never of high confidence")
        .when(F.col("place") > MOST_PAGE_RECORDS, "too many records")
    )
    return records.withColumn("place", place).select("doc_id", "page", "seq", why.alias("why")).where("why is not null")


def tools_not_allowed(agents: DataFrame, forbidden: list[str]) -> DataFrame:
    """agents: agent, tools (array). Forbidden tools that an agent holds."""
    held = F.array_intersect("tools", F.array(*map(F.lit, forbidden)))
    return agents.select("agent", F.explode(held).alias("tool"))


def forbidden_imports(lines: DataFrame, modules: list[str]) -> DataFrame:
    """lines: file, line_no, text. Lines that import one of the modules, or something of it."""
    names = "|".join(m.replace(".", r"\.") for m in modules)
    module = F.regexp_extract("text", rf"^\s*(?:import|from)\s+({names})(?:[\s.,;]|$)", 1)
    return lines.select("file", "line_no", module.alias("module")).where("module <> ''")


def vision_pages(read: DataFrame, citations: DataFrame) -> DataFrame:
    """read: doc_id, pages (array). citations: doc_id, page, method. All pages that vision had to do with, in order."""
    cited = citations.where("method = 'vision' and page is not null").groupBy("doc_id").agg(F.collect_set("page").alias("cited"))
    none = F.array().cast("array<int>")
    both = read.join(cited, "doc_id", "full_outer")
    return both.select("doc_id", F.array_sort(F.array_union(F.coalesce("pages", none), F.coalesce("cited", none))).alias("pages"))


def chart_only(truth: DataFrame) -> DataFrame:
    """Values that only charts carry."""
    return truth.where("carrier = 'chart'").select("target_id", "metric", "value")


def axis_read_rate(rows: DataFrame, backend_prefix: str) -> DataFrame:
    """rows: backend, carrier, labelled, attributed. Whole percent of unlabelled chart values attributed; null of none."""
    axis = rows.where((F.col("carrier") == "chart") & ~F.col("labelled") & F.startswith("backend", F.lit(backend_prefix)))
    return axis.agg(F.count("*").alias("n"), F.round(100.0 * F.avg(F.col("attributed").cast("int")), 0).alias("pct"))


def chart_split(rows: DataFrame) -> DataFrame:
    """Chart values recovered with and without a printed label, by backend."""
    kind = F.when(F.col("labelled"), "labels").otherwise("axis")
    return rows.where("carrier = 'chart'").groupBy("backend", kind.alias("kind")).agg(
        F.count("*").alias("n"), F.count_if("attributed").alias("attributed")
    )


def reader_seconds(reads: DataFrame) -> DataFrame:
    """reads: backend, seconds. Pages, seconds and seconds a page (one decimal) by backend."""
    return reads.groupBy("backend").agg(
        F.count("*").alias("pages"), F.round(F.sum("seconds"), 1).alias("seconds"),
        F.round(F.sum("seconds") / F.greatest(F.count("*"), F.lit(1)), 1).alias("per_page"),
    )


def cache_key(doc: Column, page: Column, model: Column, dpi: Column, variant: Column | None = None) -> Column:
    """A file name: the document's name and the model's without what file systems dislike, page of two digits."""
    safe = lambda c: F.translate(c, ":/ ", "--_")
    parts = [safe(doc), F.concat(F.when(page < 10, "p0").otherwise("p"), page.cast("string")), safe(model), F.concat(F.lit("dpi"), dpi.cast("string"))]
    return F.concat_ws("__", *parts, *([safe(variant)] if variant is not None else []))


def incomplete_runs(results: DataFrame) -> DataFrame:
    """results: target_id, got, total. Runs that did not get all they should: should be empty."""
    return results.where("got < total")


def base_rate_headline(rates: DataFrame) -> DataFrame:
    """A line for each base rate, or why there is none."""
    text = F.concat(
        F.col("n").cast("string"), F.lit(" records: median "), F.col("median").cast("string"), F.lit("% a year, "),
        F.col("shrank_pct").cast("string"), F.lit("% shrank"),
    )
    return rates.select("target_id", F.when(F.col("status") == "matched", text).otherwise(F.concat(F.lit("no base rate: "), "status")).alias("headline"))
