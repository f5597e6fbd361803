import pytest
from pyspark.sql import functions as F

from assaymill.config import DEFAULT
from assaymill.operators import contracts, fit, render, rules
from assaymill.sources import sinks
from tests.test_screening import TARGETS, wide


def test_exhibit_page_is_the_lowest_that_was_read_or_speaks_of_one(spark):
    pages = spark.createDataFrame([("d", 2, "Gross  retention by year"), ("d", 3, "gross revenue retention"), ("d", 5, "chart of gross retention"), ("d", 7, "Largest customer")], "doc_id string, page_number int, text string")
    missing = spark.createDataFrame([("d", "grr_pct"), ("d", "top1_customer_pct"), ("d", "arr_usd")], "doc_id string, metric string")
    read = spark.createDataFrame([("d", 3)], "doc_id string, page_number int")
    assert [tuple(r) for r in contracts.exhibit_pages(missing, pages, read).collect()] == [("d", "grr_pct", 3)]


def test_label_or_axis(spark):
    rows = [(1, 81.0, 81.4), (2, 81.0, 90.0), (3, None, 5.0), (4, 5.0, None), (5, None, None)]
    got = {r.img: tuple(r)[1:] for r in contracts.ship_label_or_axis(spark.createDataFrame(rows, "img int, label_value double, axis_value double")).collect()}
    assert got == {1: ("label", 81.0, False), 2: ("axis", 90.0, True), 3: ("axis", 5.0, False), 4: ("label", 5.0, False), 5: (None, None, False)}


def test_page_record_contract(spark):
    rows = [("d", 1, i, "table", "high") for i in range(41)] + [("e", 1, 0, "guess", "low"), ("e", 1, 1, "axis", "high"), ("e", 1, 2, "axis", "low")]
    got = contracts.broken_page_records(spark.createDataFrame(rows, "doc_id string, page int, seq int, read string, confidence string")).collect()
    assert {(r.doc_id, r.seq) for r in got} == {("d", 40), ("e", 0), ("e", 1)}


def test_tools_and_runs(spark):
    agents = spark.createDataFrame([("a", ["read", "write"]), ("b", ["read"])], "agent string, tools array<string>")
    assert [tuple(r) for r in contracts.tools_not_allowed(agents, ["write", "shell"]).collect()] == [("a", "write")]
    runs = spark.createDataFrame([("T1", 10, 10), ("T2", 8, 10)], "target_id string, got int, total int")
    assert [r.target_id for r in contracts.incomplete_runs(runs).collect()] == ["T2"]


def test_read_rates(spark):
    rows = spark.createDataFrame([("p1", "chart", False, True), ("p1", "chart", False, False), ("q", "chart", False, False), ("p1", "table", False, False), ("p1", "chart", True, True)], "backend string, carrier string, labelled boolean, attributed boolean")
    assert tuple(contracts.axis_read_rate(rows, "p").head()) == (2, 50.0)
    assert tuple(contracts.axis_read_rate(rows, "none").head()) == (0, None)
    split = {(r.backend, r.kind): (r.n, r.attributed) for r in contracts.chart_split(rows).collect()}
    assert split == {("p1", "axis"): (2, 1), ("p1", "labels"): (1, 1), ("q", "axis"): (1, 0)}


def test_cache_keys_keep_long_page_numbers(spark):
    rows = spark.createDataFrame([("a b", 7), ("a/b", 120)], "doc string, page int")
    got = [r[0] for r in rows.select(contracts.cache_key(F.col("doc"), F.col("page"), F.lit("m:1"), F.lit(120), F.lit("read 0"))).collect()]
    assert got == ["a_b__p07__m-1__dpi120__read_0", "a-b__p120__m-1__dpi120__read_0"]


def test_headlines(spark):
    rates = spark.createDataFrame([("a", "matched", 29, 6.3, 0.0), ("b", "thin book", None, None, None)], "target_id string, status string, n int, median double, shrank_pct double")
    assert {r.target_id: r.headline for r in contracts.base_rate_headline(rates).collect()} == {"a": "29 records: median 6.3% a year, 0.0% shrank", "b": "no base rate: thin book"}


@pytest.fixture(scope="module")
def cards(spark):
    w = wide(spark, [(t, *map(float, v[0])) for t, v in TARGETS.items()])
    return render.scorecards(w, fit.fit(w), rules.verdicts(w), rules.findings(w))


def test_scorecards_and_memos(spark, cards):
    texts = {r.target_id: r.text for r in cards.collect()}
    assert texts["T03"].startswith("# T03\nScore 92.2 pass\n- arr_usd: $11.2M\n- mrr_usd: $933,333\n- recurring_pct: 58%")
    assert texts["T03"].endswith("- R3 blocker\n- R6 info\n- R7 warning\n- R9 info")
    asked = spark.createDataFrame([("T03", "co-T03-judgement-001", "Why?")], "target_id string, id string, question string")
    memos = {r.target_id: r.text for r in render.memos(cards, asked).collect()}
    assert memos["T03"].endswith("## Questions\n- Why? <!--co-T03-judgement-001-->")
    assert memos["T01"] == texts["T01"]


def test_rubric_and_tables(spark):
    text = render.rubric_text(DEFAULT)
    assert "- gross retention from 85% (weight 20)" in text and "Tier 1 from 75, tier 2 from 55." in text
    rows = spark.createDataFrame([("b", 1.0), ("a", None)], "k string, v double")
    assert render.text_table(rows, ["k", "v"]).head().text == "| k | v |\n|-|-|\n| a | - |\n| b | 1.0 |"


def test_sinks_do_not_write_over_results(spark, cards, tmp_path):
    place = str(tmp_path / "cards")
    sinks.write_texts(cards, place)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_texts(cards, place)
    assert sorted(p.name for p in (tmp_path / "cards").glob("target_id=*")) == [f"target_id=T0{i}" for i in range(1, 6)]
    sinks.write_json(cards, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    assert (sinks.scratch("a/", True), sinks.scratch("a/", False)) == ("a/", "a-scratch")


def test_exit_code(spark):
    found = spark.createDataFrame([("T", "info"), ("U", "blocker")], "target_id string, severity string")
    assert (sinks.exit_code(found), sinks.exit_code(found.limit(1)), sinks.exit_code(found.limit(0))) == (1, 0, 0)
