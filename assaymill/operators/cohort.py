"""Base rates from named past records, on the narrowest cohort that is large enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import LEAST_COHORT, OUT_OF_RANGE, RETENTION_BANDS, RUNGS, SIZE_BANDS
from assaymill.functions.quantiles import grouped_quantiles
from assaymill.sources.shared import stored


def band(value: Column, bands: list[tuple[str, float | None]]) -> Column:
    """The first band whose upper bound is above the value; null for null."""
    out = F.when(value.isNull(), None)
    for name, bound in bands[:-1]:
        out = out.when(value < bound, name)
    return out.otherwise(bands[-1][0])


def base_rates(
    targets: DataFrame,
    book: DataFrame,
    size_bands: list = SIZE_BANDS,
    retention_bands: list = RETENTION_BANDS,
    least: int = LEAST_COHORT,
) -> DataFrame:
    """targets: target_id, vertical, arr, grr. book: deal_id, vertical, arr, grr, underwritten, outcome.

    Rungs go from vertical, size and retention to anything; the first with ``least`` records gives the
    base rate: target_id, status, rung (0 the narrowest), n, p10, median, p90, shrank_pct,
    optimistic_pct, deal_ids. A target without arr or grr, or out of the book's range, or with an empty
    book, has that as its status and nulls.
    """
    # Both are read more than once below, so they are made once.
    targets, book = stored(targets, "targets"), stored(book, "book")
    sized = lambda df: df.withColumns({"size": band(F.col("arr"), size_bands), "retention": band(F.col("grr"), retention_bands)})
    limits = book.agg(F.min("arr").alias("low"), F.max("arr").alias("high"), F.count("*").alias("records"))
    mine = sized(targets).join(F.broadcast(limits))
    outside = (F.col("arr") > OUT_OF_RANGE * F.col("high")) | (F.col("arr") < F.col("low") / OUT_OF_RANGE)
    refusal = (
        F.when(F.col("arr").isNull() | F.col("grr").isNull(), "missing input")
        .when(F.col("records") == 0, "empty book")
        .when(outside, "out of range")
    )
    mine = mine.withColumn("refusal", refusal)
    # Every record and every target once for each rung, with a star for a key that the rung leaves open:
    # one aggregation and one equi-join serve all rungs.
    keys = ["rung", "on_vertical", "on_size", "on_retention"]

    def on_rungs(df: DataFrame) -> DataFrame:
        star = lambda c, used: F.col(c) if used else F.lit("*")
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("rung"), star("vertical", v).alias("on_vertical"), star("size", s).alias("on_size"),
                    star("retention", r).alias("on_retention"),
                )
                for i, (v, s, r) in enumerate(RUNGS)
            ]
        )
        return df.select("*", F.inline(rows)).dropna(subset=keys)

    members = on_rungs(sized(book))
    stats = members.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(100.0 * F.avg((F.col("outcome") < 0).cast("int")), 1).alias("shrank_pct"),
        F.round(100.0 * F.avg((F.col("underwritten") > F.col("outcome")).cast("int")), 1).alias("optimistic_pct"),
    ).where(F.col("n") >= least)
    open_ = mine.where("refusal is null").select("target_id", "vertical", "size", "retention")
    rungs = on_rungs(open_).join(stats, keys)
    best = rungs.groupBy("target_id").agg(F.min_by(F.struct(*keys, "n", "shrank_pct", "optimistic_pct"), "rung").alias("b")).select("target_id", "b.*")
    best = stored(best, "cohorts")
    # Spreads and members of the cohorts that a target came to; the widest is one group of all records.
    chosen = stored(members.join(best.select(*keys).distinct(), keys, "left_semi").select(*keys, "deal_id", "outcome"), "members")
    spread = grouped_quantiles(chosen, keys, "outcome", [0.1, 0.5, 0.9]).select(*keys, F.col("q").alias("p"))
    named = chosen.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("deal_id")), ",").alias("deal_ids"))
    best = best.join(spread, keys, "left").join(named, keys)
    out = mine.select("target_id", "refusal").join(best, "target_id", "left")
    status = F.coalesce("refusal", F.when(F.col("n").isNull(), "thin book"), F.lit("matched"))
    return out.select(
        "target_id", status.alias("status"), "rung", "n", *[F.round(F.get("p", i), 2).alias(k) for i, k in enumerate(("p10", "median", "p90"))],
        "shrank_pct", "optimistic_pct", "deal_ids",
    )


def underwriting_bias(book: DataFrame, *keys: str) -> DataFrame:
    """By key: how far underwritten growth lay above what came, at the tenths and the median, and how often."""
    gaps = book.withColumn("gap", F.col("underwritten") - F.col("outcome")).where("gap is not null")
    often = gaps.groupBy(*keys).agg(F.round(100.0 * F.avg((F.col("gap") > 0).cast("int")), 1).alias("optimistic_pct"))
    spread = grouped_quantiles(gaps, list(keys), "gap", [0.1, 0.5, 0.9]).join(often, list(keys))
    return spread.select(*keys, "n", *[F.round(F.get("q", i), 2).alias(k) for i, k in enumerate(("p10", "median", "p90"))], "optimistic_pct")


def published_bands(values: DataFrame, bands: DataFrame) -> DataFrame:
    """values: target_id, vertical, size, metric, value. bands: metric, vertical, size, low, high, publisher.

    Every band that fits, of every publisher, with inside; a value without one is a row of nulls.
    """
    joined = values.join(bands, ["metric", "vertical", "size"], "left")
    inside = F.col("value").between(F.col("low"), F.col("high"))
    return joined.select("target_id", "metric", "value", "publisher", "low", "high", inside.alias("inside"))
