"""URL filters: host suffixes and path prefixes of each URL against lists of rules.

Each URL is expanded into the pairs of a host suffix and a path prefix that have the shape of some
rule. A pair's sha256 is joined with the rules' on its first eight hexadecimal digits; the whole
digests confirm a match, and of a URL's rules the longest decides. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import pick, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8
#: Rules up to which they are broadcast; more are shuffled by their hash prefix.
BROADCAST_RULES = 200_000

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    path = F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3)"), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    rules: host, path, verdict (block or allow). A rule fits its host and all subdomains of it, if the
    URL's path starts with the rule's. Of those that fit, the longest (host and path together) decides,
    of equally long ones that with the longer host, of the same host and path block. Without one the
    rule is null and the verdict ``default``.

    A null URL, or one without ``://``, has an empty host and path. Rows that repeat are all judged.
    Rules with a null are ignored, and letters A-Z of their hosts count as a-z. An empty table gives
    no rows; without rules ``default`` is every verdict. Other columns are ignored.
    """
    known = pick(rules, host="string", path="string", verdict="string").dropna()
    known = known.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    known = known.distinct().withColumns(
        {
            "labels": F.length("r_host") - F.length(F.replace("r_host", F.lit("."), F.lit(""))) + 1,
            "reach": F.length("r_path"),
            "digest": F.sha2(F.concat("r_host", "r_path"), 256),
        }
    )
    # Labels of a host and characters of a path that rules have: at most one row a rule, mostly few.
    shapes = sorted(known.select("labels", "reach").distinct().collect())
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    known = known.withColumn("prefix", F.left("digest", F.lit(PREFIX_DIGITS))).drop("labels", "reach")

    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pick(pages, page_id="long", url="string").select("page_id", url.alias("url"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
    )
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    pairs = [
        F.when(
            (dots + 1 >= labels) & (F.length("path") >= reach),
            F.sha2(F.concat(F.substring_index("host", ".", -labels), F.left("path", F.lit(reach))), 256),
        )
        for labels, reach in shapes
    ]
    found = F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")
    expanded = rows.withColumn("expression", F.explode_outer(found))
    expanded = expanded.withColumn("prefix", F.left("expression", F.lit(PREFIX_DIGITS)))
    met = expanded.join(F.broadcast(known) if few else known, "prefix", "left")
    fits = F.col("expression") == F.col("digest")
    best = F.max(
        F.when(
            fits,
            F.struct(
                (F.length("r_host") + F.length("r_path")).alias("size"),
                F.length("r_host").alias("host_size"),
                F.col("r_verdict").alias("verdict"),
                F.concat("r_host", "r_path").alias("rule"),
            ),
        )
    )
    judged = met.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``pages``."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP4_SQL = f"""
with parts as (
  select page_id,
         case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), split as (
  select row_number() over () as n, cast(page_id as bigint) as page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(r_host, r_path, r_verdict) as (
  values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), fitting as (
  select s.n, s.page_id, s.host, s.path, r.r_host || r.r_path as rule, r.r_verdict,
         row_number() over (partition by s.n order by length(r.r_host || r.r_path) desc, length(r.r_host) desc, r.r_verdict desc) as place
  from split s left join rules r
    on (s.host = r.r_host or ends_with(s.host, '.' || r.r_host)) and starts_with(s.path, r.r_path)
)
select page_id, host, path, rule, coalesce(r_verdict, '{DEFAULT}') as verdict from fitting where place = 1
"""
