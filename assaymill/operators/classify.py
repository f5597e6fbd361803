"""Questions by keyword, and texts by the words they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import NOVEL_PRESENT, NOVEL_TERMS, RULE_TERMS
from assaymill.functions.text import content_words, has_term, jaccard


def question_tag(text: Column, archetype: Column) -> Column:
    """A struct of bucket and tag. The first novel tag wins: real where the archetype has it, else noise;
    then the first rule tag is redundant; anything else is noise, unmapped."""
    low = F.lower(text)
    present = F.create_map(*[x for k, v in NOVEL_PRESENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    tag = lambda bucket, name: F.struct(bucket.alias("bucket"), F.lit(name).alias("tag"))
    hit = lambda terms: F.greatest(*[has_term(low, t) for t in terms], F.lit(False))
    parts = []
    for name, terms in NOVEL_TERMS.items():
        real = F.coalesce(F.array_contains(F.element_at(present, archetype), F.lit(name)), F.lit(False))
        parts.append((hit(terms), tag(F.when(real, "novel-real").otherwise("noise"), name)))
    parts += [(hit(terms), tag(F.lit("redundant"), name)) for name, terms in RULE_TERMS.items()]
    out = F.when(*parts[0])
    for part in parts[1:]:
        out = out.when(*part)
    return out.otherwise(tag(F.lit("noise"), "unmapped"))


def classify(rows: DataFrame) -> DataFrame:
    """rows: text, archetype and more. Adds bucket and tag."""
    tagged = rows.withColumn("t", question_tag(F.col("text"), F.col("archetype")))
    return tagged.select(*rows.columns, F.col("t.bucket").alias("bucket"), F.col("t.tag").alias("tag"))


def bucket_rates(rows: DataFrame) -> DataFrame:
    """Rows of each bucket and their share (one decimal)."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).join(F.broadcast(total)).select(
        "bucket", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct")
    )


def condition_similarity(rows: DataFrame, baseline: str, stop: list[str]) -> DataFrame:
    """rows: target_id, condition, text. Jaccard of content words of each condition with the baseline's."""
    words = rows.select("target_id", "condition", content_words(F.col("text"), stop).alias("words"))
    base = words.where(F.col("condition") == baseline).select("target_id", F.col("words").alias("base"))
    both = words.where(F.col("condition") != baseline).join(base, "target_id")
    return both.select("target_id", "condition", jaccard(F.col("words"), F.col("base")).alias("similarity"))


def mean_similarity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 3).alias("similarity"))


def admissible_claims(research: DataFrame) -> DataFrame:
    """Claims with all five fields, a quote of at most 125 characters, a date and a known tier."""
    filled = F.lit(True)
    for f in ("lens", "finding", "url", "quote", "materiality"):
        filled = filled & (F.trim(F.coalesce(f, F.lit(""))) != "")
    return research.where(
        filled & (F.length("quote") <= 125) & F.col("date").isNotNull() & F.col("tier").isin("primary", "practitioner", "vendor")
    )


def banded_lenses(claims: DataFrame) -> DataFrame:
    """Lenses that may carry a band: those with a source that isn't a vendor's."""
    return claims.groupBy("lens").agg(F.count("*").alias("claims"), F.count_if(F.col("tier") != "vendor").alias("independent")).where("independent > 0")
