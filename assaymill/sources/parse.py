"""Parsers of values, rosters, model replies and front matter that come as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.functions.text import MONEY, amount


def asserted_number(raw: Column) -> Column:
    """A number with ``$``, ``,`` and ``%`` taken off; null where that leaves none."""
    bare = F.regexp_replace(F.trim(raw), r"[$,%]", "")
    return F.when(bare.rlike(r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(bare)).cast("double")


def asserted_values(rows: DataFrame, strict: bool = True) -> DataFrame:
    """rows: doc_id, seq, metric, raw. The header row goes; a row without a number is an error.

    With ``strict`` false such a row has a null instead.
    """
    kept = rows.where(~F.lower(F.trim("metric")).isin("metric", "field", "name"))
    number = asserted_number(F.col("raw"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not a number: "), F.col("metric"), F.lit("="), F.coalesce("raw", F.lit(""))))
        number = F.when(number.isNull(), wrong.cast("double")).otherwise(number)
    return kept.select("doc_id", "seq", F.trim("metric").alias("metric"), number.alias("asserted"))


def read_asserted(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """A file of asserted values: ``.json`` (an object), ``.csv`` or ``.tsv`` (two columns)."""
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        pairs = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("seq", "e"))
        rows = pairs.select("seq", F.col("e.key").alias("metric"), F.col("e.value").alias("raw"))
    else:
        lines = spark.read.csv(path, sep="\t" if path.endswith(".tsv") else ",", schema="metric string, raw string")
        rows = lines.withColumn("seq", F.monotonically_increasing_id())
    return asserted_values(rows.withColumn("doc_id", F.lit(doc_id)))


# Column headers that stand where a customer's name would.
ROSTER_HEADERS = ("customer", "annual contract value", "metric", "basis")


def roster_pages(pages: DataFrame) -> DataFrame:
    """pages: doc_id, page_number, text. doc_id, text of the pages that announce anchor customers, one after another."""
    ours = pages.where(F.contains(F.lower("text"), F.lit("anchor customers")))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return ours.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def roster_lines(pages: DataFrame, revenue: Column) -> DataFrame:
    """Customers and their share of revenue, from lines ``Name  $2.1M`` or a name and an amount below it.

    pages: doc_id, text. revenue: the document's, null or 0 gives no rows. A name is what stands before the first
    amount of a line; where nothing does, the line above, if it has no amount. Names of less than three
    characters or more than eight words and column headers are dropped, shares are from 0.05 to 80.
    """
    edges = r"^[ \t|\-–—:]+|[ \t|\-–—:]+$"
    lines = pages.select("doc_id", revenue.alias("revenue"), F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where("line <> ''")
    before = F.lag("line").over(W.partitionBy("doc_id").orderBy("at"))
    lines = lines.withColumn("before", F.coalesce(before, F.lit("")))
    named = lines.where(F.col("line").rlike(MONEY)).select(
        "doc_id",
        "at",
        "revenue",
        amount(F.regexp_extract("line", MONEY, 1), F.regexp_extract("line", MONEY, 2)).alias("value"),
        F.regexp_replace(F.get(F.split("line", MONEY, 2), 0), edges, "").alias("own"),
        F.when(F.col("before").rlike(MONEY), "").otherwise(F.regexp_replace("before", edges, "")).alias("above"),
    )
    name = F.when(F.col("own") != "", F.col("own")).otherwise(F.col("above"))
    share = F.round(100 * F.try_divide("value", "revenue"), 2)
    found = named.select("doc_id", "at", name.alias("name"), share.alias("pct_arr"), (100 * F.try_divide("value", "revenue")).alias("exact"))
    return found.where(
        (F.length("name") >= 3) & ~F.lower("name").isin(*ROSTER_HEADERS) & (F.size(F.split("name", r"\s+")) <= 8) & F.col("exact").between(0.05, 80)
    ).drop("exact")


def reply_pairs(text: Column) -> Column:
    """``label: value`` lines of a reply, the value with or without ``%``, as an array of (label, value)."""
    pattern = r"^(.+?):\s*([0-9]+(?:\.[0-9]+)?)\s*%?\s*$"
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: x.rlike(pattern) & ~F.lower(x).rlike(r"^ticks\s*:"))
    return F.transform(
        lines,
        lambda x: F.struct(F.trim(F.regexp_extract(x, pattern, 1)).alias("label"), F.regexp_extract(x, pattern, 2).cast("double").alias("value")),
    )


def reply_ticks(text: Column) -> Column:
    """The numbers between the commas of the last line that starts with ``ticks:``; what is no number is left out."""
    lines = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)^ticks:"))
    parts = F.split(F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), r"(?i)^ticks:", ""), ",")
    numbers = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.rlike(r"^-?\d+(\.\d+)?$"))
    return F.transform(numbers, lambda x: x.cast("double"))


def embedded_array(text: Column, schema: str, most: int) -> Column:
    """The JSON array inside a reply, after what it thought aloud; at most ``most`` members, null if none."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.slice(F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), schema), 1, most)


def front_matter(text: Column) -> Column:
    """``key: value`` lines between two lines of three hyphens, as a map; an unended block is an error."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, r"\n"), lambda x: F.contains(x, F.lit(":")))
    found = F.map_from_entries(
        F.transform(
            pairs,
            lambda x: F.struct(
                F.trim(F.substring_index(x, ":", 1)).alias("key"),
                F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value"),
            ),
        )
    )
    broken = F.raise_error(F.lit("front matter doesn't end")).cast("map<string,string>")
    return F.when(F.startswith(text, F.lit("---\n")) & (block == ""), broken).otherwise(found)


def fenced_domains(text: Column) -> Column:
    """The lines of the first fenced block."""
    block = F.regexp_extract(text, r"(?s)```[a-z]*\n(.*?)\n```", 1)
    return F.filter(F.transform(F.split(block, r"\n"), lambda x: F.trim(x)), lambda x: x != "")


#: What a registry's answer on one concept of one company holds of each fact.
FACTS = "struct<units: map<string, array<struct<start: string, end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string>>>>"


def concept_facts(answers: DataFrame, unit: str = "USD") -> DataFrame:
    """answers: entity, tag_priority, json (a registry's answer on one concept; null or broken: no facts). The facts in
    the unit, in their order: entity, tag_priority, seq, start, end (dates), value, accession, fy, fp, form, filed."""
    parsed = F.from_json("json", FACTS)
    rows = answers.select("entity", "tag_priority", F.posexplode(F.element_at(parsed["units"], unit)).alias("seq", "f"))
    return rows.select(
        "entity", "tag_priority", "seq", *[F.try_to_date(F.col(f"f.{k}"), "yyyy-MM-dd").alias(k) for k in ("start", "end")], F.col("f.val").alias("value"),
        F.col("f.accn").alias("accession"), *[F.col(f"f.{k}").alias(k) for k in ("fy", "fp", "form", "filed")],
    )
