from pyspark.sql import functions as F

from assaymill.operators import feedback


def turns(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text").dropDuplicates(["k"])


def test_equal_sides_have_no_range_to_join(spark, sf_dir):
    rows = turns(spark, sf_dir)
    a, b = feedback.ranged(rows, "k", "text", "stored"), feedback.ranged(rows.repartition(3), "k", "text", "made")
    assert feedback.differing(a, b, "k", ("stored", "made")).collect() == []
    assert feedback.changed(rows, rows, "k", "text").collect() == []


def test_only_ranges_of_changed_rows_are_joined(spark, sf_dir):
    rows = turns(spark, sf_dir).cache()
    keys = sorted(r.k for r in rows.collect())
    altered, gone, new = keys[3], keys[5], "new"
    made = rows.withColumn("text", F.when(F.col("k") == altered, F.lit("other")).otherwise(F.col("text"))).where(F.col("k") != gone)
    made = made.unionByName(spark.createDataFrame([(new, "words")], rows.schema))
    a, b = feedback.ranged(rows, "k", "text", "stored"), feedback.ranged(made, "k", "text", "made")
    assert feedback.differing(a, b, "k", ("stored", "made")).count() == 3
    assert sorted(r.k for r in feedback.changed(rows, made, "k", "text").collect()) == sorted([altered, gone, new])


def test_nulls_and_rows_that_repeat(spark):
    kind = "k string, text string"
    stored = spark.createDataFrame([("a", None), ("b", "x"), ("c", "x"), ("d", "x"), ("d", "x")], kind)
    made = spark.createDataFrame([("a", None), ("b", None), ("c", "y"), ("d", "x")], kind)
    assert sorted(r.k for r in feedback.changed(stored, made, "k", "text").collect()) == ["b", "c"]
    assert feedback.changed(stored.limit(0), made.limit(0), "k", "text").collect() == []
