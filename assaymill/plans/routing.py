"""Queries over the text of web pages, and questions routed by words and by vectors; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaymill.operators import cells, route, textindex
from assaymill.sources import html
from assaymill.sources.tables import table

TITLE, LANG = r"(?is)<title\b[^>]*>([^<]*)", r'<html lang="([a-z]*)"'


def page_blocks(spark, sf_dir):
    """Every block of every page."""
    blocks = html.page_blocks(table(spark, sf_dir, "pages"))
    return blocks.select("page_id", "block", "tag", "text", F.length("text").alias("n_chars"))


def page_block_counts(spark, sf_dir):
    """Blocks, empty ones, headings and characters of every page."""
    blocks = html.page_blocks(table(spark, sf_dir, "pages"))
    return blocks.groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("text") == "").alias("empty_blocks"),
        F.count_if(F.col("tag").rlike("^h[1-6]$")).alias("headings"), F.sum(F.length("text")).alias("n_chars"),
    )


def route_items(spark, sf_dir):
    """The three documents nearest to each benchmark item, by their words."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return textindex.route_text(items, docs, 3)


def _titles(spark, sf_dir, k):
    """The titles of pages whose id is divisible by 20, routed over all pages' texts."""
    pages = table(spark, sf_dir, "pages")
    titles = pages.where("page_id % 20 = 0").select(F.col("page_id").alias("query_id"), html.unescaped(F.regexp_extract("html", TITLE, 1)).alias("text"))
    return textindex.route_text(titles, pages.select("page_id", html.page_text(F.col("html")).alias("text")), k)


def route_titles(spark, sf_dir):
    return _titles(spark, sf_dir, 3)


def route_titles_recall(spark, sf_dir):
    """How often a title finds its own page among the first one, two and three, by language."""
    asked = table(spark, sf_dir, "pages").where("page_id % 20 = 0").select(F.col("page_id").alias("query_id"), F.regexp_extract("html", LANG, 1).alias("carrier"))
    own = _titles(spark, sf_dir, 3).where("query_id = page_id").select("query_id", "rank")
    return route.recall(asked.join(own, "query_id", "left"))


def route_titles_saved(spark, sf_dir):
    """Pages that no title selects."""
    return route.pages_saved(_titles(spark, sf_dir, 3), table(spark, sf_dir, "pages").count())


def nearest_vectors(spark, sf_dir):
    """The five nearest of all vectors to each whose id is divisible by 20, itself included."""
    e = table(spark, sf_dir, "embeddings")
    index = cells.CellIndex(e.select(F.col("vec_id").alias("page_id"), "embedding"))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return cells.nearest(asked, index, 5).withColumn("score", F.round("score", 4))


QUERIES = {f.__name__: f for f in (page_blocks, page_block_counts, route_items, route_titles, route_titles_recall, route_titles_saved, nearest_vectors)}

_NAMES = "|".join(html.BLOCKS)
_SP = r"[\x09-\x0D\x20\x{A0}]+"


#: The references that the tables have, the ampersand's last.
_REFERENCES = [("&nbsp;", 160), ("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&#39;", 39), ("&copy;", 169), ("&middot;", 183), ("&amp;", 38)]


def _named_sql(text: str) -> str:
    for name, code in _REFERENCES:
        text = f"replace({text}, '{name}', chr({code}))"
    return text


_BLOCKS = rf"""hidden as (
  select page_id, html, regexp_replace(coalesce(html, ''), '(?is){html.HIDDEN}', ' ', 'g') as t from pages
), tagged as (
  select page_id, html, chr(2) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(?i)<({_NAMES})\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(?:{_NAMES})\b[^>]*>', chr(1) || chr(2), 'g'),
    '(?i)<br\b[^>]*>', ' ', 'g'), '<[/!?A-Za-z][^>]*>', '', 'g') as t from hidden
), cut as (
  select page_id, generate_subscripts(string_split(t, chr(1)), 1) as pos, unnest(string_split(t, chr(1))) as piece from tagged
), read as (
  select page_id, pos, lower(split_part(piece, chr(2), 1)) as tag,
    trim(regexp_replace({_named_sql("split_part(piece, chr(2), 2)")}, '{_SP}', ' ', 'g')) as text from cut
), blocks as (
  select page_id, row_number() over (partition by page_id order by pos) as block, tag, text from read where tag <> '' or text <> ''
  union all select page_id, 1, '', '' from pages where page_id not in (select page_id from read where tag <> '' or text <> '')
)"""


def _routed_sql(questions: str, pages: str, k: int) -> str:
    """questions: query_id, text. pages: page_id, text. Every question against every page that shares a word."""
    words = lambda t, key: f"select {key}, term, 1 + ln(count(*)) as w from (select {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) as term from {t}) group by 1, 2"
    return f"""asked_ as ({words(questions, 'query_id')}), said_ as ({words(pages, 'page_id')}),
lengths_ as (select page_id, sqrt(sum(w * w)) as len from said_ group by 1),
rare_ as (select term, ln(1 + (select count(*) from {pages})::double / count(*)) as idf from said_ group by 1),
q_ as (select query_id, term, a.w * r.idf as q from asked_ a join rare_ r using (term)),
norms_ as (select query_id, sqrt(sum(q * q)) as norm from q_ group by 1),
scores_ as (
  select q.query_id, s.page_id, round(sum(q.q / n.norm * (s.w / l.len)), 6) as score
  from q_ q join norms_ n using (query_id) join said_ s using (term) join lengths_ l using (page_id) group by 1, 2
),
routed_ as (
  select * from (select *, row_number() over (partition by query_id order by score desc, page_id) as rank from scores_) where rank <= {k}
)"""


_ITEMS = _routed_sql("(select item_id as query_id, text from benchmark)", "(select doc_id as page_id, text from documents)", 3)
_TITLES = f"""{_BLOCKS}, titles as (
  select page_id as query_id, {_named_sql("regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)")} as text from pages where page_id % 20 = 0
), texts as (
  select page_id, {_named_sql("regexp_replace(t, chr(1) || '[^' || chr(2) || ']*' || chr(2) || '|^' || chr(2), ' ', 'g')")} as text from tagged
), {_routed_sql("titles", "texts", 3)}"""

SQL = {
    "page_blocks": f"with {_BLOCKS} select page_id, block, tag, text, length(text) as n_chars from blocks",
    "page_block_counts": f"""with {_BLOCKS} select page_id, count(*) as blocks, count(*) filter (text = '') as empty_blocks,
      count(*) filter (regexp_matches(tag, '^h[1-6]$')) as headings, cast(sum(length(text)) as bigint) as n_chars from blocks group by 1""",
    "route_items": f"with {_ITEMS} select * from routed_",
    "route_titles": f"with {_TITLES} select * from routed_",
    "route_titles_recall": f"""with {_TITLES}, own as (
        select p.page_id, regexp_extract(p.html, '<html lang="([a-z]*)"', 1) as carrier, r.rank
        from pages p left join routed_ r on r.query_id = p.page_id and r.page_id = p.page_id where p.page_id % 20 = 0
      ), both_ as (select carrier, rank from own union all select 'all', rank from own)
      select carrier, count(*) as n, {", ".join(f"round(100.0::double * count(*) filter (rank <= {k}) / count(*), 1) as recall_{k}" for k in (1, 2, 3))}
      from both_ group by 1""",
    "route_titles_saved": f"with {_TITLES} " + " union all ".join(
        f"select {k} as k, count(distinct page_id) as selected, round(100.0::double * (1 - count(distinct page_id) / (select count(*) from pages)::double), 1) as saved_pct from routed_ where rank <= {k}"
        for k in (1, 2, 3)
    ),
    "nearest_vectors": """with u as (
        select vec_id, list_transform(embedding, lambda x: x::double / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 1e-12)) as v from embeddings
      ), s as (
        select q.vec_id as query_id, p.vec_id as page_id, round(list_dot_product(q.v, p.v), 6) as score from u q, u p where q.vec_id % 20 = 0
      ) select query_id, page_id, round(score, 4) as score, rank from (
        select *, row_number() over (partition by query_id order by score desc, page_id) as rank from s
      ) where rank <= 5""",
}
