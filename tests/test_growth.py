"""What grows with the tables: texts are folded once, and no part of a join takes more rows than it may."""

from pyspark.sql import functions as F

from assaymill.functions import text as T
from assaymill.operators import recover
from assaymill.plans import registry


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_text_is_folded_once_and_not_for_each_form(spark):
    rows = spark.createDataFrame([("Up 8 % – $ 1 M", "8%"), ("none", "8%"), (None, "8%"), ("8%", None)], "text string, form string")
    shown = rows.select(T.value_present(F.col("text"), F.array("form")).alias("x"), T.attributed(F.col("text"), F.lit("arr_usd")).alias("y"))
    assert [r.x for r in shown.collect()] == [True, False, None, None]
    for found in (T.value_present(F.col("text"), F.array("form")), T.attributed(F.col("text"), F.col("form"))):
        line = next(x for x in analyzed(rows.select(found.alias("x"))).splitlines() if "exists(" in x)
        assert "text#" not in line.split("exists(", 1)[1]


def test_pages_meet_no_list_of_metrics(spark, sf_dir):
    df = registry.queries()["keyword_attribution"](spark, sf_dir)
    assert "Join" not in analyzed(df)


def test_parts_of_a_join_go_by_rows(spark):
    missing = spark.createDataFrame([(i, "grr_pct", 8.0) for i in range(6)], "doc_id long, metric string, value double")
    routes = spark.createDataFrame([(i, "grr_pct", p, 3 - p) for i in range(6) for p in (1, 2)], "doc_id long, metric string, page_number int, rank int")
    pages = spark.createDataFrame([(i, p, "gross retention 8%" if i != 3 else None) for i in range(6) for p in (1, 2)], "doc_id long, page_number int, text string")
    one = recover.first_recovered(missing, routes, pages)
    many = recover.first_recovered(missing, routes, pages, part_rows=2)
    assert "RepartitionByExpression" in analyzed(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) == [(i, "grr_pct", 8.0, 2) for i in range(6) if i != 3]
