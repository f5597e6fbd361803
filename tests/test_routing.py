import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.operators import cells, textindex
from assaymill.sources import html

# Text of pages


class Blocks(HTMLParser):
    """Blocks of a page, told by the standard library's tokenizer."""

    HIDDEN = ("script", "style", "template", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [["", ""]], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in html.BLOCKS and not self.hidden:
            self.found.append([tag, ""])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden -= 1
            self.handle_data(" ")
        elif tag in html.BLOCKS and not self.hidden:
            self.found.append(["", ""])

    def handle_data(self, data):
        if not self.hidden:
            self.found[-1][1] += data

    def handle_comment(self, data):
        self.handle_data(" ")


def naive_blocks(page):
    told = Blocks()
    told.feed(page or "")
    told.close()
    rows = [(tag, re.sub("[\x09-\x0d\x20\xa0]+", " ", text).strip(" ")) for tag, text in told.found]
    return [r for r in rows if r != ("", "")] or [("", "")]


def blocks_of(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    out = {}
    for r in html.page_blocks(rows).orderBy("page_id", "block").collect():
        assert r.block == len(out.setdefault(r.page_id, [])) + 1
        out[r.page_id].append((r.tag, r.text))
    return [out[i] for i in range(len(pages))]


PAGES = [
    None, "", "  ", "no tags at all", "<p>", "<p></p><p></p>", "<P CLASS='x'>one<br/>two</P>tail<div>in<b>ner</b> <i>x</i></div>",
    "<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- a <p> --><h1>H&#233;&#x1F600;</h1>&lt;p&gt; &amp;lt; &#38;lt;</body></html>",
    "<div><p>a<p>b<ul><li>c<li>d</ul>e</div>", "x<script>var t='</p>';</script>y<noscript>no</noscript>z", "a&nbsp;&nbsp;b\t\n\x0bc",
    "<table><tr><td>1<td>2</tr></table>", "1 < 2 and 3 > 2", "<p>" + "word " * 30_000 + "</p>", "<pre>\x01/\x02x</pre>", "&#0; &#55296; &#9999999; &#65;",
]


def test_blocks_equal_those_of_a_tokenizer(spark, sf_dir):
    real = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages = PAGES[:-2] + real
    for page, got in zip(pages, blocks_of(spark, pages), strict=True):
        assert got == naive_blocks(page)


def test_marks_in_a_page_and_references_to_no_character(spark):
    marks, references = blocks_of(spark, PAGES[-2:])
    assert marks == [("pre", "/ x")]
    assert references == [("", "� � � A")]


def test_whole_text_has_the_words_of_all_blocks(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole = {r.page_id: r.t for r in pages.select("page_id", html.page_text(F.col("html")).alias("t")).collect()}
    blocks = {}
    for r in html.page_blocks(pages).orderBy("page_id", "block").collect():
        blocks.setdefault(r.page_id, []).append(r.text)
    assert {k: v.split() for k, v in whole.items()} == {k: " ".join(v).split() for k, v in blocks.items()}
    assert spark.range(1).select(html.page_text(F.lit(None).cast("string")).alias("t")).first().t is None


# Questions by words


def naive_route(questions, pages, k):
    """Every question against every page."""

    def counts(text):
        return Counter(re.findall(r"[^\W_]+", (text or "").lower()))

    said = [(i, counts(t)) for i, t in pages]
    df = Counter(w for _, c in said for w in c)
    out = {}
    for query, text in questions:
        q = {w: (1 + math.log(n)) * math.log(1 + len(pages) / df[w]) for w, n in counts(text).items() if df[w]}
        norm = math.sqrt(sum(x * x for x in q.values()))
        scores = []
        for i, c in said:
            if set(q) & set(c):
                length = math.sqrt(sum((1 + math.log(n)) ** 2 for n in c.values()))
                scores.append((-round(sum(q[w] / norm * (1 + math.log(c[w])) / length for w in set(q) & set(c)), 6), i))
        out[query] = [(i, -s) for s, i in sorted(scores, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[:k]]
    return {q: rows for q, rows in out.items() if rows}


def routed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.page_id, r.score))
    return out


def invented_pages(rng, n):
    common = ["the", "of", "and", "rate", "growth"]
    rare = ["w%d" % i for i in range(400)]
    return [(i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.choice([3, 20, 200])))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 4])
def test_routes_equal_brute_force(spark, k):
    rng = random.Random(k)
    pages = invented_pages(rng, 900)
    pages += [(1000, None), (1001, ""), (1002, "!!! ..."), (None, "the rate"), (1003, "the rate"), (1004, "the rate"), (1004, "the rate")]
    questions = [(i, " ".join(p[1].split()[:6])) for i, p in enumerate(pages[:25])]
    questions += [(30, "the the rate"), (31, None), (32, ""), (33, "unheardof"), (34, "THE Growth w7"), (35, "w1 w2 w3 w4 w5")]
    asked = spark.createDataFrame(questions, "query_id long, text string")
    rows = spark.createDataFrame(pages, "page_id long, text string").repartition(3)
    index = textindex.build_index(rows, textindex.question_terms(asked), of_range=16)
    want = naive_route(questions, pages, k)
    assert routed(textindex.route_text(asked, rows, k, index)) == want
    assert routed(textindex.route_text(asked, rows, k)) == want
    assert routed(textindex.route_text(asked, rows, k, textindex.build_index(rows))) == want


def test_questions_meet_pages_without_a_join(spark):
    rng = random.Random(8)
    pages = invented_pages(rng, 300) + [(400 + i, "the rate w1") for i in range(40)] + [(None, "the rate w1"), (500, None)]
    questions = [(i, pages[i][1]) for i in range(60)] + [(90, "the rate w1"), (91, None)]
    asked = spark.createDataFrame(questions, "query_id long, text string")
    rows = spark.createDataFrame(pages, "page_id long, text string").repartition(5)
    for k in (1, 3):
        assert routed(textindex.route_passes(asked, rows, k, pass_terms=200)) == naive_route(questions, pages, k)
    plan = textindex.route_text(asked, rows)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_a_better_page_leaves_equal_ones_in_their_order(spark):
    pages = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "a"), (5, "c d")]
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    rows = spark.createDataFrame(pages, "page_id long, text string").coalesce(1)
    assert [i for i, _ in routed(textindex.route_text(asked, rows, 3))[1]] == [4, 1, 2]


def test_bounds_leave_pages_out(spark):
    rng = random.Random(5)
    pages = invented_pages(rng, 2000)
    asked = spark.createDataFrame([(i, pages[i][1]) for i in range(0, 2000, 100)], "query_id long, text string")
    index = textindex.build_index(spark.createDataFrame(pages, "page_id long, text string"), of_range=16)
    plan = textindex.narrowed(asked, index, 1)
    met = plan.asked.where("needed").join(index.postings, ["term", "range"]).count()
    assert met < 0.5 * plan.asked.join(index.postings, ["term", "range"]).count()


def test_no_nested_loop_and_empty_tables(spark):
    empty = spark.createDataFrame([], "query_id long, text string")
    pages = spark.createDataFrame([(1, "the rate")], "page_id long, text string")
    assert textindex.route_text(empty, pages).collect() == []
    asked = spark.createDataFrame([(1, "rate")], "query_id long, text string")
    assert textindex.route_text(asked, pages.limit(0)).collect() == []
    plan = textindex.route_text(asked, pages)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# Vectors


def naive_nearest(queries, pages, k, but_itself=False):
    unit = lambda v: np.array(v, float) / max(np.linalg.norm(np.array(v, float)), 1e-12)
    points = [(i, unit(v)) for i, v in pages if i is not None and v is not None]
    out = {}
    for q, v in queries:
        if q is not None and v is not None:
            scores = sorted((-round(float(unit(v) @ p), 6), i) for i, p in points if not (but_itself and i == q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return {q: rows for q, rows in out.items() if rows}


def clustered(rng, n, dim=8):
    middles = rng.normal(size=(7, dim))
    rows = middles[rng.integers(0, 7, n)] + 0.2 * rng.normal(size=(n, dim))
    rows[: n // 3] = rows[0]  # a third are copies
    return [(i, [round(float(x), 3) for x in r]) for i, r in enumerate(rows)]


KIND = "long, embedding array<float>"


@pytest.mark.parametrize("but_itself", [False, True])
def test_nearest_equal_brute_force(spark, but_itself):
    pages = clustered(np.random.default_rng(3), 1200)
    pages += [(5000, [0.0] * 8), (None, [1.0] * 8), (5001, None), (1199, pages[7][1])]
    queries = [p for p in pages if p[0] is not None and p[0] % 20 == 0] + [(9000, [0.0] * 8), (9001, None), (None, [1.0] * 8)]
    queries = list({q[0]: q for q in queries}.values())
    index = cells.CellIndex(spark.createDataFrame(pages, f"page_id {KIND}"), tile=100)
    got = routed(cells.nearest(spark.createDataFrame(queries, f"query_id {KIND}"), index, 5, but_itself))
    want = naive_nearest(queries, [(i, np.float32(v).tolist() if v else v) for i, v in pages], 5, but_itself)
    assert {q: [round(s, 5) for _, s in r] for q, r in got.items()} == {q: [round(s, 5) for _, s in r] for q, r in want.items()}
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_cells_leave_vectors_out_and_split_large_cells(spark):
    rng = np.random.default_rng(4)
    pages = spark.createDataFrame(clustered(rng, 3000), f"page_id {KIND}")
    index = cells.CellIndex(pages, tile=100)
    assert index.pages.groupBy("cell", "tile").count().agg(F.max("count")).first()[0] < 200
    asked = pages.where("page_id % 20 = 0").withColumnRenamed("page_id", "query_id")
    met = cells.nearest(asked, index, 3)
    n = asked.count()
    assert met.count() == 3 * n
    reach = cells.asked_cells(asked, index).select("query_id", "embedding", F.posexplode("off").alias("cell", "off")).withColumn("reach", F.lit(0.3))
    pairs = cells.compared(reach, index, 1, False).agg(F.sum("met")).first()[0]
    assert pairs < 0.5 * n * 3000


def test_nearest_of_empty_tables_and_one_vector(spark):
    none = spark.createDataFrame([], f"page_id {KIND}")
    one = spark.createDataFrame([(1, [1.0, 0.0])], f"page_id {KIND}")
    asked = one.withColumnRenamed("page_id", "query_id")
    assert cells.nearest(asked, cells.CellIndex(none), 2).collect() == []
    assert [tuple(r) for r in cells.nearest(asked, cells.CellIndex(one), 2).collect()] == [(1, 1, 1.0, 1)]
    assert cells.nearest(asked.limit(0), cells.CellIndex(one), 2).collect() == []
