"""One screening run over any number of targets: pages to metrics, citations, findings, score and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.config import DEFAULT, METRICS, Rubric
from assaymill.functions.text import attributed, surface_forms, value_present
from assaymill.operators import fit, recover, rules
from assaymill.sources.shared import stored


def recovered(candidates: DataFrame, pages: DataFrame, routes: DataFrame, reads: DataFrame) -> DataFrame:
    """candidates: doc_id, metric, value. pages: doc_id, page_number, text (text layer). routes: doc_id, metric,
    page_number, rank (1 the best). reads: doc_id, page_number, text, unlabelled (vision).

    doc_id, metric, value, page, method, read. A value that the whole document shows and a page of it names comes
    from the text layer, cited on the first page that shows it. The others come from the routed pages that vision
    read, the best first; ``read`` says whether off an axis or a label. What neither shows has no row.
    """
    text = F.coalesce("text", F.lit(""))
    pairs = candidates.join(pages, "doc_id")
    shows = value_present(text, surface_forms(F.col("metric"), F.col("value")))
    first = pairs.groupBy("doc_id", "metric", "value").agg(
        F.min(F.when(shows, F.col("page_number"))).alias("page"), F.bool_or(attributed(text, F.col("metric"))).alias("named")
    )
    plain = first.where("page is not null and named").select(
        "doc_id", "metric", "value", "page", F.lit("textlayer").alias("method"), F.lit(None).cast("string").alias("read")
    )
    missing = candidates.join(plain, ["doc_id", "metric"], "left_anti")
    seen = recover.first_recovered(missing, routes, reads)
    kinds = reads.select("doc_id", F.col("page_number").alias("page"), F.when(F.col("unlabelled"), "axis").otherwise("label").alias("read"))
    vision = seen.join(kinds, ["doc_id", "page"]).select("doc_id", "metric", "value", "page", F.lit("vision").alias("method"), "read")
    return plain.unionByName(vision)


def screen(candidates: DataFrame, pages: DataFrame, routes: DataFrame, reads: DataFrame, rubric: Rubric = DEFAULT) -> dict[str, DataFrame]:
    """Inputs as of :func:`recovered`. ``citations``; ``wide``: the metrics that were recovered, null where not, of every
    doc_id of pages, as target_id; ``findings`` with their citations; ``scores``; ``counts``: metrics asked for and
    recovered, by method."""
    cites = stored(recovered(candidates, pages, routes, reads), "citations")
    ids = pages.select(F.col("doc_id").alias("target_id")).distinct()
    got = cites.groupBy(F.col("doc_id").alias("target_id")).pivot("metric", METRICS).agg(F.first("value"))
    wide = stored(ids.join(got, "target_id", "left"), "wide")
    named = cites.withColumnRenamed("doc_id", "target_id")
    asked = candidates.groupBy("doc_id").agg(F.count("*").alias("asked"))
    by = cites.groupBy("doc_id").agg(F.count_if(F.col("method") == "textlayer").alias("by_text"), F.count_if(F.col("method") == "vision").alias("by_vision"))
    counts = asked.join(by, "doc_id", "left").select("doc_id", "asked", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("by_text", "by_vision")])
    return {
        "citations": cites,
        "wide": wide,
        "findings": rules.with_citations(rules.findings(wide, rubric), named),
        "scores": fit.inbox(fit.fit(wide, rubric)),
        "counts": counts.withColumn("recovered", F.concat_ws("/", (F.col("by_text") + F.col("by_vision")).cast("string"), F.col("asked").cast("string"))),
    }


