import json

from pyspark.sql import functions as F

from assaymill.config import METRICS
from assaymill.operators import contracts, feedback, render, rules, screen, series
from assaymill.sources import fixtures
from assaymill.sources.tables import read_records

PAGE = "doc_id string, page_number int, text string"


def test_records_of_json_documents(spark, tmp_path):
    rows = [{"target_id": "T1", "metric": "grr_pct", "value": 81.0, "other": 1}, {"target_id": "T2", "metric": "arr_usd"}]
    (tmp_path / "many.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(rows[0]))
    schema = "target_id string, metric string, value double"
    assert sorted(map(tuple, read_records(spark, str(tmp_path / "many.json"), schema).collect())) == [("T1", "grr_pct", 81.0), ("T2", "arr_usd", None)]
    assert read_records(spark, str(tmp_path / "one.json"), schema).count() == 1


def test_screening_of_text_then_vision_then_nothing(spark):
    pages = [("T", 1, "ARR of $8.4M, gross margin 70%"), ("T", 2, "ARR was $8.4M"), ("T", 3, "a chart"), ("U", 1, "nothing"), ("V", 1, "8.4M only")]
    asked = [("T", "arr_usd", 8.4e6), ("T", "gross_margin_pct", 70.0), ("T", "grr_pct", 91.0), ("T", "nrr_pct", 104.0), ("U", "arr_usd", 1e6)]
    routes = [("T", m, p, r) for m in ("grr_pct", "nrr_pct") for p, r in ((3, 1), (2, 2))]
    reads = [("T", 3, "gross retention 91%", True), ("T", 2, "net retention 104%", False)]
    out = screen.screen(
        spark.createDataFrame(asked, "doc_id string, metric string, value double"), spark.createDataFrame(pages, PAGE),
        spark.createDataFrame(routes, "doc_id string, metric string, page_number int, rank int"),
        spark.createDataFrame(reads, "doc_id string, page_number int, text string, unlabelled boolean"),
    )
    cites = {r.metric: (r.page, r.method, r.read) for r in out["citations"].collect()}
    assert cites == {
        "arr_usd": (1, "textlayer", None), "gross_margin_pct": (1, "textlayer", None), "grr_pct": (3, "vision", "axis"), "nrr_pct": (2, "vision", "label"),
    }
    wide = {r.target_id: r for r in out["wide"].collect()}
    assert set(wide) == {"T", "U", "V"} and wide["T"].grr_pct == 91.0 and all(wide["U"][m] is None for m in METRICS)
    assert {r.doc_id: r.recovered for r in out["counts"].collect()} == {"T": "4/4", "U": "0/1"}
    assert {(r.rule_id, r.page) for r in out["findings"].collect() if r.target_id == "T"} == {("R11", None)}
    assert out["scores"].count() == 3


def test_findings_keep_rules_without_a_citation(spark):
    found = spark.createDataFrame([("T", "R4"), ("T", "R11"), ("U", "R4")], "target_id string, rule_id string")
    cites = spark.createDataFrame([("T", "grr_pct", 7, "vision")], "target_id string, metric string, page int, method string")
    assert {(r.target_id, r.rule_id, r.page) for r in rules.with_citations(found, cites).collect()} == {("T", "R4", 7), ("T", "R11", None), ("U", "R4", None)}


def test_invented_books_are_the_same_each_time(spark):
    book = fixtures.dealbook(spark, 200)
    rows = book.collect()
    assert rows == fixtures.dealbook(spark.newSession(), 200).collect()
    assert len({r.deal_id for r in rows}) == 200 and {r.vertical for r in rows} == set(fixtures.VERTICALS)
    assert sum(r.underwritten > r.outcome for r in rows) > 150
    facts = fixtures.profiles(book.limit(3), {"grr_pct": "chart"})
    assert contracts.chart_only(facts).count() == 3 and facts.count() == 15


def test_series_that_are_too_short_have_no_provenance(spark):
    points = [(e, f"2020-{m:02d}", f"{e}{m}", float(m)) for e, n in (("a", 12), ("b", 5)) for m in range(1, n + 1)]
    rows = series.provenance(spark.createDataFrame(points, "entity string, end string, accession string, value double"), 3, least=6).collect()
    assert [(r.entity, r.trained_on, r.first, r.last_trained, r.holdout_from, [f.accession for f in r.filings]) for r in rows] == [
        ("a", 9, "2020-01", "2020-09", "2020-10", ["a10", "a11", "a12"])
    ]


def test_briefs_without_anything(spark):
    targets = spark.createDataFrame([("T",)], "target_id string")
    lines = spark.createDataFrame([("T", "research", i, f"r{i}") for i in range(20)], "target_id string, block string, seq int, line string")
    text = render.briefs(targets, lines).head().text
    assert text.count("none available") == 2 and "not researched" in text and text.endswith("  r11")
    assert spark.range(1).select(render.excerpt(F.lit(None).cast("string"), 5)).head()[0] == ""


def test_sessions_keep_the_callouts_they_reviewed(spark):
    sessions = spark.createDataFrame([("T", 1), ("T", 2), ("U", 1)], "target_id string, session int")
    frozen = spark.createDataFrame([("T", 1, "old")], "target_id string, session int, id string")
    current = spark.createDataFrame([("T", "new")], "target_id string, id string")
    assert {tuple(r) for r in feedback.reviewed_callouts(sessions, frozen, current).collect()} == {("T", 1, "old", True), ("T", 2, "new", False)}
