import json

from pyspark.sql import functions as F

from assaymill.config import METRICS
from assaymill.functions import text as T
from assaymill.operators import memo, signal

WIDE = "target_id string, " + ", ".join(f"{m} double" for m in METRICS)


def wide(spark, **targets):
    return spark.createDataFrame([(t, *[v.get(m) for m in METRICS]) for t, v in targets.items()], WIDE)


def tables(spark):
    w = wide(spark, A={"arr_usd": 8_400_000.0, "grr_pct": 81.5}, B={})
    scored = spark.createDataFrame([("A", 61.25, "tier_2", ""), ("B", 0.0, "pass", "R1,R3")], "target_id string, score double, tier string, blocked_by string")
    cites = spark.createDataFrame([("A", "grr_pct", 7, "vision"), ("A", "grr_pct", 3, "vision")], "target_id string, metric string, page int, method string")
    found = spark.createDataFrame(
        [("A", 4, "R4", "warning", 3), ("A", 2, "R2", "blocker", None), ("A", 9, "R9", "info", None)], "target_id string, rule_seq int, rule_id string, severity string, page int"
    )
    callouts = spark.createDataFrame(
        [("A", "co-1", "axis_read", "grr_pct", "is it so?"), ("A", "co-2", "missing_metric", "nrr_pct", "what of it?"), ("A", "co-0", "label_read", "arr_usd", "a label")],
        "target_id string, id string, kind string, metric string, question string",
    )
    lines = spark.createDataFrame([("A", "a headline")], "target_id string, headline string")
    return w, scored, cites, found, callouts, lines


def test_memo_has_every_section(spark):
    w, scored, cites, found, callouts, lines = tables(spark)
    got = {r.target_id: r.text for r in memo.memos(w, scored, cites, found, callouts, lines, lines).collect()}
    assert got["A"].split("\n\n") == [
        "# Memo on A", "Score 61.3, tier_2",
        "## Figures\n- arr_usd: $8.4M (no source) <!--co-0-->\n- grr_pct: 81.5% (page 3, vision) <!--co-1-->",
        "## Flags\n- blocker R2\n- warning R4 (page 3)", "## Notes\n- info R9", "## Left out\n- what of it? <!--co-2-->",
        "## Outside the document, for no score\n- customers: a headline\n- base rate: a headline", "## Ask\n- what of it?\n- is it so?",
    ]
    assert got["B"].split("\n\n") == [
        "# Memo on B", "Score 0.0, pass, blocked by R1,R3", "## Figures\n- nothing was recovered", "## Flags\n- no rule blocks or warns", "## Notes\n- none",
        "## Left out\n- nothing that is required", "## Outside the document, for no score\n- customers: not researched\n- base rate: none", "## Ask\n- nothing is open",
    ]


def test_results_are_whole_objects(spark):
    w, scored, cites, found, *_ = tables(spark)
    got = {r.target_id: json.loads(r.record) for r in memo.results(w, scored, cites, found).collect()}
    assert got["A"] == {
        "target_id": "A", "score": 61.25, "tier": "tier_2", "blocked_by": "", "recovered": 2,
        "metrics": [{"metric": "arr_usd", "value": 8400000.0}, {"metric": "grr_pct", "value": 81.5, "page": 3, "method": "vision"}],
        "findings": [{"rule_id": "R2", "severity": "blocker"}, {"rule_id": "R4", "severity": "warning"}, {"rule_id": "R9", "severity": "info"}],
    }
    assert got["B"] == {"target_id": "B", "score": 0.0, "tier": "pass", "blocked_by": "R1,R3", "recovered": 0}


def test_customer_headlines(spark):
    rows = [("A", "Big", 30.0, True), ("A", "Mid", 10.0, True), ("A", "Small", 5.0, False), ("A", "Who", 20.0, None), ("B", "One", 40.0, False)]
    roster = spark.createDataFrame(rows, "target_id string, name string, pct_arr double, distress boolean")
    got = {r.target_id: (r.severity, r.headline) for r in signal.full_headline(signal.customer_details(roster)).collect()}
    assert got == {
        "A": ("material", "2 of 3 researched customers are in distress and hold 40.0% of revenue, Big the most of them with 30.0%; the roster covers 65.0%, 1 of it unresearched"),
        "B": ("none", "no distress among 1 researched customers with 40.0% of revenue; the roster covers 40.0%, 0 of it unresearched"),
    }


def test_short_numbers_have_six_significant_digits(spark):
    values = [8_123_456.0, 8_400_000.0, 12_345_678.0, 123_456_789.0, 0.0, -2_400_000.0, 1_000_001.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T._short(F.col("v") / 1e6).alias("s")).collect()
    assert {r.v: r.s for r in rows} == {v: f"{v / 1e6:g}" for v in values}
