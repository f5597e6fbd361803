import random

from pyspark.sql import functions as F

from assaymill.operators import asof


def naive_last_known(rows):
    """rows: key, at, value. Sorted by key and at, the last value seen of each key."""
    out, last = [], {}
    for key, at, value in sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1] is not None, r[1] or 0)):
        if value is not None:
            last[key] = value
        out.append((key, at, value, last.get(key)))
    return sorted(out, key=str)


KIND = "key string, at long, value string"


def invented(rng, n):
    """A third of all rows have one key; nine of ten rows have no value."""
    rows = []
    for at in range(n):
        key = rng.choice(["hot", rng.choice("abcdefgh"), rng.choice(["p", "q", None])])
        rows.append((key, at, f"v{at}" if rng.random() < 0.1 else None))
    return rows


def test_last_known_equals_brute_force(spark):
    rows = invented(random.Random(1), 3000) + [("x", None, "first"), ("x", 5, None), ("lonely", 1, None)]
    df = spark.createDataFrame(rows, KIND).repartition(5).withColumn("extra", F.lit(1))
    for parts in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = asof.last_known(df, ["key"], ["at"], "value", "above").select("key", "at", "value", "above").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(map(tuple, got), key=str) == naive_last_known(rows)


def test_a_long_key_is_spread(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("key"), F.col("id").alias("at"), F.when(F.col("id") == 0, "start").alias("value"))
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    dealt = session.createDataFrame(rows.toPandas(), rows.schema)
    out = asof.last_known(dealt, ["key"], ["at"], "value", "above")
    assert out.where("above = 'start'").count() == 20_000
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 10_000


def test_empty_table(spark):
    assert asof.last_known(spark.createDataFrame([], KIND), ["key"], ["at"], "value", "above").collect() == []


def test_join_takes_the_last_row_at_or_before(spark):
    rng = random.Random(4)
    left = [(rng.choice(["hot", "a", None]), rng.randrange(200), str(i)) for i in range(400)]
    right = list({(rng.choice(["hot", "a", "b", None]), rng.randrange(200)): rng.choice([None, "w%d" % i]) for i in range(150)}.items())
    want = sorted(
        ((k, at, note, max(((t, v) for (q, t), v in right if q == k and t <= at and v is not None), default=(0, None))[1]) for k, at, note in left), key=str
    )
    got = asof.asof_join(
        spark.createDataFrame(left, "key string, at long, note string"),
        spark.createDataFrame([(*k, v) for k, v in right], "key string, at long, price string"), ["key"], ["at"], "price", "price",
    )
    assert got.columns == ["key", "at", "note", "price"]
    assert sorted(map(tuple, got.collect()), key=str) == want
