import pytest

from assaymill.config import CELLS, DEFAULT, METRICS, Rubric
from assaymill.operators import fit, metrics, rules

# The five published targets, by the order of METRICS, with their score, tier and findings.
TARGETS = {
    "T01": ((8400000, 700000, 91, 94, 108, 78, 1850000, 14, 6, 19), 100.0, "tier_1", "R9"),
    "T02": ((6100000, 508333, 88, 96, 103, 74, 1220000, 9, 34, 71), 94.7, "tier_1", "R9 R10a R10b"),
    "T03": ((11200000, 933333, 58, 89, 97, 52, 1010000, 11, 12, 31), 92.2, "pass", "R3 R6 R7 R9"),
    "T04": ((9600000, 800000, 95, 87, 112, 71, -2400000, 22, 9, 26), 85.0, "pass", "R8 R9"),
    "T05": ((4300000, 358333, 84, 81, 86, 69, 1160000, 2, 11, 28), 97.7, "tier_1", "R4 R6 R9"),
}
TEXT_ONLY = {"T01": 60.0, "T02": 60.0, "T03": 52.5, "T04": 45.0, "T05": 60.0}
CHARTS = ("grr_pct", "nrr_pct", "top1_customer_pct", "top5_customer_pct")


def wide(spark, rows):
    return spark.createDataFrame(rows, "target_id string, " + ", ".join(f"{m} double" for m in METRICS))


@pytest.fixture(scope="module")
def targets(spark):
    return wide(spark, [(t, *map(float, v[0])) for t, v in TARGETS.items()])


def test_published_scores_tiers_and_findings(spark, targets):
    got = {r.target_id: (r.score, r.tier) for r in fit.fit(targets).collect()}
    assert got == {t: v[1:3] for t, v in TARGETS.items()}
    found = rules.findings(targets).orderBy("target_id", "rule_seq").collect()
    assert {t: " ".join(r.rule_id for r in found if r.target_id == t) for t in TARGETS} == {t: v[3] for t, v in TARGETS.items()}


def test_scores_without_charts(spark, targets):
    carriers = spark.createDataFrame([(m, "chart") for m in CHARTS], "metric string, carrier string")
    less = metrics.to_wide(fit.text_only(metrics.to_long(targets), carriers))
    assert {r.target_id: r.score for r in fit.fit(less).collect()} == TEXT_ONLY


def test_inbox_order(targets):
    assert [r.target_id for r in fit.inbox(fit.fit(targets)).collect()] == ["T01", "T05", "T02", "T03", "T04"]


def test_clean_target_is_silent(targets):
    assert rules.findings(targets).where("target_id = 'T01' and severity <> 'info'").count() == 0


def one(spark, **values):
    base = dict(zip(METRICS, TARGETS["T01"][0], strict=True)) | values
    return wide(spark, [("x", *[None if base[m] is None else float(base[m]) for m in METRICS])])


def fired(spark, rubric=DEFAULT, **values):
    return {r.rule_id for r in rules.findings(one(spark, **values), rubric).collect()} - {"R9"}


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ({"arr_usd": 2_000_000, "mrr_usd": None}, set()), ({"arr_usd": 30_000_000, "mrr_usd": None}, set()),
        ({"arr_usd": 1_999_999, "mrr_usd": None}, {"R2"}), ({"arr_usd": 0, "mrr_usd": 5}, {"R2"}),
        ({"arr_usd": 8_000_000, "mrr_usd": 700_000}, set()), ({"arr_usd": 7_999_000, "mrr_usd": 700_000}, {"R1"}),
        ({"recurring_pct": 80}, set()), ({"recurring_pct": 79.9}, {"R3"}), ({"grr_pct": 85}, set()), ({"grr_pct": 100.1}, {"R5"}),
        ({"nrr_pct": 100}, set()), ({"nrr_pct": 99.9}, {"R6"}), ({"gross_margin_pct": 64.9}, {"R7"}), ({"ebitda_usd": 0}, {"R8"}),
        ({"top1_customer_pct": 15, "top5_customer_pct": 35}, set()), ({"top1_customer_pct": 15.1}, {"R10a"}),
        ({"top5_customer_pct": 35.1}, {"R10b"}), ({"grr_pct": None, "ebitda_usd": None}, {"R11"}),
        ({m: None for m in METRICS}, {"R11"}),
    ],
)
def test_rule_edges(spark, values, want):
    assert fired(spark, **values) == want


def test_missing_metrics_are_listed(spark):
    row = rules.findings(one(spark, grr_pct=None, arr_usd=None)).where("rule_id = 'R11'").head()
    assert (row.observed, row.missing) == (2.0, "arr_usd,grr_pct")


def test_ebitda_that_is_not_required_still_scores(spark):
    from dataclasses import replace

    loose = replace(DEFAULT, ebitda_required=False)
    assert fired(spark, loose, ebitda_usd=-1) == set()
    assert fit.fit(one(spark, ebitda_usd=-1), loose).head().score == 85.0


def test_long_and_wide_are_inverse(targets):
    back = metrics.to_wide(metrics.to_long(targets)).select("target_id", *METRICS)
    assert sorted(back.collect()) == sorted(targets.collect())


def test_conflicts_are_listed(spark):
    a = spark.createDataFrame([("t", "grr_pct", 90.0), ("t", "nrr_pct", 100.0)], "target_id string, metric string, value double")
    b = spark.createDataFrame([("t", "grr_pct", 81.0), ("t", "nrr_pct", 100.4)], "target_id string, metric string, value double")
    assert [tuple(r) for r in metrics.stated_conflicts(a, b).collect()] == [("t", "grr_pct", 90.0, 81.0)]


def test_severity_counts_have_zeros(spark, targets):
    rows = {r.target_id: tuple(r)[1:] for r in rules.severity_counts(rules.findings(targets), targets).collect()}
    assert rows["T01"] == (0, 0, 1) and rows["T03"] == (1, 1, 2)


def test_rubric_file(tmp_path):
    import json

    place = tmp_path / "rubric.json"
    place.write_text(json.dumps({
        "profile_name": "p", "arr_band_usd": {"min": 1, "max": 2, "weight": 15}, "recurring_pct_floor": {"value": 80, "weight": 20},
        "grr_pct_floor": {"value": 85, "weight": 20}, "nrr_pct_target": {"value": 100, "weight": 10}, "gross_margin_pct_floor": {"value": 65, "weight": 10},
        "ebitda_positive": {"required": True, "weight": 15}, "rule_of_40_floor": {"value": 40, "weight": 0},
        "concentration_caps": {"top1_pct_max": 15, "top5_pct_max": 35, "weight": 10}, "tiers": {"tier_1_min_score": 75, "tier_2_min_score": 55},
    }))
    rubric = Rubric.read(place)
    assert (rubric.arr_min, rubric.arr_max, rubric.grr_floor) == (1.0, 2.0, 85.0)
    assert set(DEFAULT.blockers) == {r for r, s in rules.SEVERITY.items() if s == "blocker"}
    assert CELLS.margin_floor == 95.0
