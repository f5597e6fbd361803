import pytest
from pyspark.sql import functions as F

from assaymill.functions import numbers
from assaymill.functions import text as T
from assaymill.operators import chart, classify, cohort, feedback, recover, route, signal
from assaymill.sources import parse
from assaymill.sources.tables import document_text, inbox, text_pages

PAGE = "doc_id string, page_number int, text string"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("8.4 M", "8.4M"), ("$ 8.4", "$8.4"), ("a–b—c−d", "a-b-c-d"), ("12 \n %", "12%"), ("a \t b", "a b"), (None, None)],
)
def test_normalise(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.normalise(F.col("t"))).head()[0] == want


def test_money_and_percent_forms(spark):
    row = spark.range(1).select(T.money_forms(F.lit(8400000.0)).alias("m"), T.money_forms(F.lit(-358333.0)).alias("k"), T.percent_forms(F.lit(94.5)).alias("p")).head()
    assert set(row.m) == {"$8,400,000", "$8400000", "$8.4M", "$8.40M", "$8.4 million", "$8400K", "$8,400K"}
    assert {"-$358,333", "-$358333", "-$358K"} == set(row.k)
    assert {"94.5%", "94.5 %", "94.5 percent"} <= set(row.p)


def test_strict_presence_needs_a_whole_number(spark):
    rows = spark.createDataFrame([("grew 12%",), ("just 2% more",)], "t string")
    forms = T.percent_forms(F.lit(2.0))
    assert [tuple(r) for r in rows.select(T.value_present(F.col("t"), forms), T.value_present_strict(F.col("t"), forms)).collect()] == [(True, False), (True, True)]


def test_displays(spark):
    v = spark.createDataFrame([(8400000.0,), (358333.0,), (None,), (-2400000.0,)], "v double")
    assert [r[0] for r in v.select(numbers.money_display(F.col("v"))).collect()] == ["$8.4M", "$358,333", "not stated", "-$2.4M"]
    n = spark.createDataFrame([(94.0,), (94.25,), (12345678.0,)], "v double")
    assert [r[0] for r in n.select(numbers.plain_number(F.col("v"))).collect()] == ["94", "94.25", "12345678"]


def test_reviewer_buckets(spark):
    pages = spark.createDataFrame([("d", 1, "gross retention was 91 %"), ("d", 2, "gross retention 81% and 86%; growth strong"), ("d", 3, "EBITDA of $1.2M"), ("d", 4, None)], PAGE)
    asserted = spark.createDataFrame([("d", 0, "grr_pct", 81.0), ("d", 1, "ebitda_usd", 1300000.0), ("d", 2, "yoy_growth_pct", 5.0), ("d", 3, "nrr_pct", 5.0)], "doc_id string, seq int, metric string, asserted double")
    got = {r.metric: (r.verdict, r.page, r.document_says) for r in recover.review(asserted, pages).collect()}
    assert got["grr_pct"] == ("agreed", 2, None)
    assert got["ebitda_usd"] == ("disagreed", 3, [1200000.0])
    assert got["yoy_growth_pct"] == ("disagreed", 2, [86.0, 81.0])
    assert "nrr_pct" not in got
    settled = recover.settle(asserted, recover.review(asserted, pages), recover.review(asserted, pages.limit(0), "vision"))
    reasons = {r.metric: (r.verdict, r.reason) for r in settled.collect()}
    assert reasons["nrr_pct"] == ("could_not_check", "not found in the document")
    assert recover.coverage(settled).head().coverage_pct == 75.0


def test_candidates_are_nearest_first_distinct_and_few(spark):
    text = "1% 2% 3% gross retention 4% 4% 5% " + "x" * 200 + " 9%"
    rows = recover.candidates(spark.createDataFrame([("d", 1, text, "grr_pct"), ("d", 2, "nothing", "grr_pct")], PAGE + ", metric string")).orderBy("place").collect()
    assert [r.number for r in rows] == [3.0, 2.0, 1.0] or len(rows) == 3


def test_citations_leaks_and_first_recovery(spark):
    pages = spark.createDataFrame([("d", 1, "81% of it"), ("d", 2, "gross retention 81%")], PAGE)
    values = spark.createDataFrame([("d", "grr_pct", 81.0)], "doc_id string, metric string, value double")
    assert recover.citation_pages(values, pages).head().page == 1
    assert recover.leaks(values, pages).count() == 2
    routes = spark.createDataFrame([("d", "grr_pct", 1, 1), ("d", "grr_pct", 2, 2)], "doc_id string, metric string, page_number int, rank int")
    assert recover.first_recovered(values, routes, pages).head().page == 2


def test_asserted_values_reject_what_is_no_number(spark):
    rows = spark.createDataFrame([("d", 0, "metric", "value"), ("d", 1, "arr_usd", "$1,000"), ("d", 2, "x", "n/a")], "doc_id string, seq int, metric string, raw string")
    assert [r.asserted for r in parse.asserted_values(rows.where("seq < 2")).collect()] == [1000.0]
    with pytest.raises(Exception, match="not a number"):
        parse.asserted_values(rows).collect()


def test_asserted_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("metric,value\narr_usd,$8\ngrr_pct,91%\n")
    (tmp_path / "a.tsv").write_text("arr_usd\t8\n")
    (tmp_path / "a.json").write_text('{"arr_usd": 8, "grr_pct": "91%"}')
    got = {k: {r.metric: r.asserted for r in parse.read_asserted(spark, str(tmp_path / f"a.{k}"), "d").collect()} for k in ("csv", "tsv", "json")}
    assert got == {"csv": {"arr_usd": 8.0, "grr_pct": 91.0}, "tsv": {"arr_usd": 8.0}, "json": {"arr_usd": 8.0, "grr_pct": 91.0}}


def test_roster_shapes(spark):
    text = "Anchor customers\nNorthwind Ltd  $2.1M\nFabrikam\n$1,200,000\nTotal $9M\na b c d e f g h i $1M\nNo amount"
    rows = parse.roster_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"), F.lit(10e6)).collect()
    assert [(r.name, r.pct_arr) for r in rows] == [("Northwind Ltd", 21.0), ("Fabrikam", 12.0)]
    assert parse.roster_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"), F.lit(0.0)).count() == 0


def test_model_replies(spark):
    text = "gross: 81.1\nnet: 86\nTicks: 90, 87.5, 75\nprose without"
    row = spark.range(1).select(parse.reply_pairs(F.lit(text)).alias("p"), parse.reply_ticks(F.lit(text)).alias("t")).head()
    assert [tuple(p) for p in row.p] == [("gross", 81.1), ("net", 86.0)] and row.t == [90.0, 87.5, 75.0]
    found = spark.range(1).select(parse.embedded_array(F.lit('<think>[1]</think> ok [{"a":1},{"a":2}] end'), "array<struct<a:int>>", 1).alias("x")).head().x
    assert [r.a for r in found] == [1]


def test_front_matter(spark):
    get = lambda t: spark.range(1).select(parse.front_matter(F.lit(t)).alias("m")).head().m
    assert get("---\nname: a\ntools: x: y\n---\nbody") == {"name": "a", "tools": "x: y"}
    with pytest.raises(Exception, match="doesn't end"):
        get("---\nname: a\nbody")
    assert spark.range(1).select(parse.fenced_domains(F.lit("x\n```\na.com\n b.org\n```\n")).alias("d")).head().d == ["a.com", "b.org"]


def test_pages_and_inbox(spark, tmp_path):
    docs = spark.createDataFrame([("d", "one\n\n\n\nthree"), ("e", None)], "doc_id string, text string")
    pages = text_pages(docs, "doc_id", "text")
    assert [(r.page_number, r.text) for r in pages.where("doc_id = 'd'").orderBy("page_number").collect()] == [(1, "one"), (2, ""), (3, "three")]
    assert {r.doc_id: (r.text, r.empty_pages) for r in document_text(pages, "doc_id").collect()} == {"d": ("one\n\n\n\nthree", 1), "e": ("", 1)}
    for name in ("b.txt", "a.txt", "c.md"):
        (tmp_path / name).write_text(name)
    assert [r.text for r in inbox(spark, str(tmp_path)).collect()] == ["a.txt", "b.txt"]


def test_customer_signals(spark):
    rows = [("T01", "a", 6.0, False), ("T01", "b", 13.0, False), ("T02", "a", 34.0, True), ("T02", "b", 15.0, True), ("T02", "c", 22.0, False), ("T03", "a", 8.0, True), ("T03", "b", 23.0, False),
            ("T04", "a", 10.0, True), ("T05", "a", 9.0, True), ("T05", "b", 6.0, True), ("T06", "x", 50.0, None)]
    got = {r.target_id: r for r in signal.customer_signal(spark.createDataFrame(rows, "target_id string, name string, pct_arr double, distress boolean")).collect()}
    assert {t: r.severity for t, r in got.items()} == {"T01": "none", "T02": "material", "T03": "noted", "T04": "material", "T05": "material", "T06": "none"}
    assert (got["T02"].distressed_pct, got["T02"].researched_pct, got["T02"].largest) == (49.0, 71.0, "a")
    assert (got["T06"].researched, got["T06"].unresearched, got["T06"].researched_pct) == (0, 1, 0.0)


def test_overlap_floor(spark):
    rows = spark.range(25)
    row = signal.overlap_floor(rows, "id", F.col("id") < 21, F.col("id") >= 5).head()
    assert (row.in_a, row.in_b, row.floor) == (21, 20, 16)


DEAL = "deal_id string, vertical string, arr double, grr double, underwritten double, outcome double"


def test_cohort_rungs_and_refusals(spark):
    book = spark.createDataFrame([(f"D{i:02}", "fin" if i < 8 else "med", 5e6 if i < 12 else 15e6, 90.0 if i % 2 else 80.0, 10.0, float(i - 3)) for i in range(20)], DEAL)
    rows = [("same", "fin", 5e6, 90.0), ("null", "fin", None, 90.0), ("huge", "fin", 22.6e6, 90.0), ("edge", "fin", 22.5e6, 90.0), ("none", "xyz", 5e6, 93.0)]
    got = {r.target_id: (r.status, r.rung, r.n) for r in cohort.base_rates(spark.createDataFrame(rows, "target_id string, vertical string, arr double, grr double"), book).collect()}
    assert got["null"] == ("missing input", None, None) and got["huge"][0] == "out of range"
    assert got["edge"][0] == "matched"
    assert got["same"] == ("matched", 2, 10) and got["none"] == ("matched", 3, 12)
    empty = cohort.base_rates(spark.createDataFrame(rows[:1], "target_id string, vertical string, arr double, grr double"), book.limit(0)).head()
    assert empty.status == "empty book"
    thin = cohort.base_rates(spark.createDataFrame(rows[:1], "target_id string, vertical string, arr double, grr double"), book.limit(7)).head()
    assert thin.status == "thin book"


def test_routing(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    p = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [3.0, 0.0])], "page_id int, embedding array<float>")
    rows = route.ranked(route.similarities(q, p)).orderBy("rank").collect()
    assert [(r.page_id, r.score) for r in rows] == [(1, 1.0), (4, 1.0), (2, 0.707107), (3, 0.0)]
    with pytest.raises(ValueError, match="blocks"):
        route.similarities(q.union(q), p, most_queries=1)


def test_routing_of_more_queries_than_a_block(spark):
    pages = spark.createDataFrame([(i, [float(i % 7), float(i % 5 + 1)]) for i in range(30)], "page_id int, embedding array<float>")
    queries = pages.withColumnRenamed("page_id", "query_id")
    got = route.ranked(route.similarities_in_blocks(queries, pages, most_queries=12), 3).collect()
    assert sorted(got) == sorted(route.ranked(route.similarities(queries, pages), 3).collect()) and len(got) == 90


def test_classifier_matches_ai_as_a_word(spark):
    rows = spark.createDataFrame([("Will AI win?", "clean_gem"), ("retain the available", "clean_gem"), ("founder leaves", "clean_gem")], "text string, archetype string")
    assert [(r.bucket, r.tag) for r in classify.classify(rows).collect()] == [("novel-real", "ai_displacement"), ("noise", "unmapped"), ("noise", "founder_dependency")]


def test_jaccard_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.333]


def test_admissible_claims(spark):
    schema = "lens string, finding string, url string, quote string, date string, tier string, materiality string"
    ok = ("m", "f", "u", "q", "2024-01-01", "primary", "high")
    rows = [ok, (*ok[:3], "q" * 126, *ok[4:]), (*ok[:5], "blog", "high"), (*ok[:4], None, *ok[5:]), ("n", *ok[1:5], "vendor", "low")]
    claims = classify.admissible_claims(spark.createDataFrame(rows, schema))
    assert claims.count() == 2
    assert [r.lens for r in classify.banded_lenses(claims).collect()] == ["m"]


def edits(draft, edited):
    return list(feedback.diff_lines("\n".join(draft), "\n".join(edited)))


def test_memo_diff():
    draft = ["# Memo", "ARR 8 <!--co-T1-axis_read-001-->", "line two", "line three"]
    co = "co-T1-axis_read-001"
    assert edits(draft, draft) == []
    assert edits(draft, ["# Memo", "ARR 9 <!--co-T1-axis_read-001-->", "line two", "line three"]) == [(co, False, "ARR 8", "ARR 9")]
    assert edits(draft, draft[:2] + draft[3:]) == [(co, False, "line two", None)]
    assert edits(draft, [*draft, "new", "lines"]) == [(None, True, None, "new lines")]
    assert edits(draft, ["Title", *draft[1:]]) == [(None, True, "# Memo", "Title")]
    assert edits(draft, [*draft[:2], "other", "things", "line three"]) == [(co, False, "line two", "other"), (None, True, None, "things")]
    assert edits(draft, [*draft[:1], "one", "line two", "line three"]) == [(co, False, "ARR 8", "one")]
    assert edits([], ["x"]) == [(None, True, None, "x")] and edits(["x"], []) == [(None, True, "x", None)]


def test_sessions_and_reasons(spark):
    draft = "a 1 <!--co-T1-axis_read-001-->\nb <!--co-T1-judgement-001-->\nc"
    pairs = spark.createDataFrame([("T1", draft, "a 2\nb changed\nc\nd"), ("T2", draft, "a 1\nc")], "doc_id string, draft string, edited string")
    callouts = spark.createDataFrame([(d, f"co-T1-{k}-001", k, m) for d in ("T1", "T2") for k, m in (("axis_read", "grr_pct"), ("judgement", None))], "doc_id string, id string, kind string, metric string")
    sessions = spark.createDataFrame([("T1", 2)], "doc_id string, session int")
    records = feedback.corrections(feedback.diff_memos(pairs), callouts, sessions)
    rows = records.orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.session, r.field, r.kind, r.reason) for r in rows] == [
        ("T1", 3, "grr_pct", "axis_read", "factual_error"), ("T1", 3, None, "judgement", "judgement_call"),
        ("T1", 3, None, None, "new_information"), ("T2", 1, None, "judgement", "needs_triage"),
    ]
    assert sorted(map(tuple, feedback.correction_counts(records).collect())) == [("T1", 3, 1, 0), ("T2", 1, 0, 1)]


def test_callouts(spark):
    cites = spark.createDataFrame([("T", "grr_pct", 7, "vision", "axis"), ("T", "nrr_pct", 7, "vision", "axis"), ("T", "arr_usd", 1, "textlayer", None)], "target_id string, metric string, page int, method string, read string")
    found = spark.createDataFrame([("T", "R5")], "target_id string, rule_id string")
    wide = spark.createDataFrame([("T", 1.0, None, 3.0, 4.0)], "target_id string, arr_usd double, recurring_pct double, grr_pct double, ebitda_usd double")
    ids = sorted(r.id for r in feedback.derive_callouts(cites, found, wide).collect())
    assert ids == ["co-T-axis_read-001", "co-T-axis_read-002", "co-T-definition_conflict-001", "co-T-missing_metric-001"]


def draw(end=20.0, slope=-0.25, width=200, dot=(200, 30, 30)):
    import numpy as np

    rgb = np.full((120, width, 3), 255)
    rgb[[10, 60, 110]] = 220
    right = width - 20
    for x in range(5, right + 1):
        y = end + (x - right) * slope
        for row in range(int(y) - 2, int(y) + 4):
            if abs(row - y) <= 1.5:
                rgb[row, x] = dot
    for x in range(right - 6, right + 7):
        for row in range(int(end) - 7, int(end) + 8):
            if (x - right) ** 2 + (row - end) ** 2 <= 36:
                rgb[row, x] = dot
    return rgb


@pytest.mark.parametrize(("end", "slope"), [(20.0, -0.25), (37.0, 0.1), (70.0, 0.3), (25.5, 0.0)])
def test_charts_are_measured_to_a_tenth(end, slope):
    value = 100 - (end - 10) * 0.5
    [(series, pixels, got)] = chart.measure_image(draw(end, slope), [50.0, 100.0, 75.0])
    assert series == 1 and pixels > 400 and got == pytest.approx(value, abs=0.3)
    assert chart.measure_image(draw(end, slope), [1.0, 2.0]) == []


def test_colours_near_one_another_are_one_series(spark):
    import numpy as np

    rgb = np.full((60, 60, 3), 255)
    for k, colour in enumerate([(200, 30, 30), (180, 40, 40), (30, 30, 200), (30, 200, 30), (200, 30, 200), (30, 200, 200)]):
        rgb[10 + 5 * k, : 50 - 5 * k] = colour
    rgb[50, :5] = (250, 120, 0)
    colours = [tuple(int(x) for x in c) for c in chart.series_colours(rgb)]
    assert colours == [(200, 30, 30), (30, 30, 200), (30, 200, 30), (200, 30, 200)]
    pixels = [(1, y, x, *map(int, rgb[y, x])) for y in range(60) for x in range(60)]
    frame = spark.createDataFrame(pixels, "img int, y int, x int, r int, g int, b int")
    assert [(c.r, c.g, c.b) for c in chart.largest_colours(chart.colour_bins(frame)).orderBy("place").collect()] == colours


def test_many_series_are_paired_in_order(spark):
    e = spark.createDataFrame([(1, f"l{i}", float((i * 7) % 9)) for i in range(9)], "img int, label string, estimate double")
    m = spark.createDataFrame([(1, float(i) + 0.25) for i in range(9)], "img int, value double")
    assert {(r.label, r.value - r.estimate) for r in chart.assign(e, m).collect()} == {(f"l{i}", 0.25) for i in range(9)}


def test_quantiles_equal_numpy(spark):
    import numpy as np

    from assaymill.functions.quantiles import grouped_quantiles

    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=1000), "b": np.array([3.0]), "c": np.array([1.0, 1.0, 1.0, 9.0]), "d": rng.integers(0, 4, 501).astype(float)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("e", None)], "k string, v double")
    for bins in (1, 7, 1024):
        got = {r.k: (r.n, r.q) for r in grouped_quantiles(rows, ["k"], "v", [0.1, 0.5, 0.9], bins).collect()}
        assert set(got) == set(values)
        for k, v in values.items():
            assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, [0.1, 0.5, 0.9]))


def test_items_are_found_whole(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    reports = [(1, f"start {long.upper()} end"), (2, f"xx{long}yy"), (3, long[:-7]), (4, "see HTTP://Casino.example/x"), (5, None), (None, long), (6, f"{long} casino")]
    items = [(long,), ("casino",), ("Casino",), ("",), (None,), ("short one",), (long,)]
    got = feedback.cited_items(spark.createDataFrame(reports, "report_id long, text string"), spark.createDataFrame(items, "item string"))
    assert sorted(map(tuple, got.collect())) == sorted([(1, long), (2, long), (6, long), (4, "casino"), (4, "Casino"), (6, "casino"), (6, "Casino")])


def test_pages_without_numbers_take_the_chart_path(spark):
    pages = spark.createDataFrame([("d", 1, "ARR $8"), ("d", 2, "a chart "), ("d", 3, "another"), ("d", 4, ""), ("d", 5, "x"), ("d", 6, "y")], PAGE)
    charts = [("d", 2, True, True, "[measured]\nseries 1: 81.0"), ("d", 4, False, False, None), ("d", 5, True, False, None), ("d", 6, True, True, None)]
    charts = spark.createDataFrame(charts, "doc_id string, page_number int, has_read boolean, has_values boolean, measured string")
    rows = {r.page_number: (r.method, r.unresolved) for r in chart.read_pages(pages, charts).collect()}
    assert rows == {
        1: ("textlayer", None), 2: ("vision", None), 3: ("vision", "no chart on the page"), 4: ("vision", "the chart was not read"),
        5: ("vision", "the chart's geometry did not resolve"), 6: ("vision", "labels and series did not match"),
    }


def png_of(rgb, filters=(0, 1, 2, 3, 4), colour=2):
    import struct
    import zlib

    import numpy as np

    height, width, channels = rgb.shape
    flat = rgb.astype(int).reshape(height, -1)
    lines = []
    for y in range(height):
        kind = filters[y % len(filters)]
        x, up = flat[y], flat[y - 1] if y else np.zeros_like(flat[0])
        left = np.concatenate([np.zeros(channels, int), x[:-channels]])
        corner = np.concatenate([np.zeros(channels, int), up[:-channels]])
        plane = left + up - corner
        far = np.stack([abs(left - plane), abs(up - plane), abs(corner - plane)])
        nearest = np.choose(far.argmin(0), [left, up, corner])
        guess = [0 * x, left, up, (left + up) // 2, nearest][kind]
        lines.append(bytes([kind]) + ((x - guess) & 255).astype("u1").tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = zlib.compress(b"".join(lines))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data[:99]) + chunk(b"IDAT", data[99:]) + chunk(b"IEND", b"")


def test_png_images_are_decoded_and_measured(spark):
    import numpy as np

    rgb = draw(25.5, 0.0)
    noise = np.random.default_rng(1).integers(0, 256, (40, 30, 4))
    assert (chart.decode_png(png_of(rgb)) == rgb).all()
    assert (chart.decode_png(png_of(noise, colour=6)) == noise[:, :, :3]).all()
    assert (chart.decode_png(png_of(noise[:, :, :1], colour=0)) == noise[:, :, :1]).all()
    images = spark.createDataFrame([(1, png_of(rgb)), (2, b"no image"), (3, png_of(rgb)[:300])], "img long, png binary")
    ticks = spark.createDataFrame([(i, [100.0, 75.0, 50.0]) for i in (1, 2, 3)], "img long, ticks array<double>")
    assert [(r.img, r.value) for r in chart.measure_pngs(images, ticks).collect()] == [(1, chart.measure_image(rgb, [100.0, 75.0, 50.0])[0][2])]
