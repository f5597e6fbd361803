import duckdb

from assaymill.functions.text import lower_each, upper_each
from assaymill.plans import registry


def test_held_equals_sql_for_letters_without_a_single_capital(spark, tmp_path):
    texts = ["Erßauen. Lich in der", "ßtra", "ΟΔΟΣ ΟΔΟΣ ΑΒΓ δε", "İstanbul", "ﬁne print", "ŉa", "ᾳ ΐ", "", "plain"]
    rows = [(i, 1, "user", t) for i, t in enumerate(texts, 1)] + [(4, 2, "user", "no"), (4, 2, "user", "no"), (5, 1, "user", None)]
    place = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(place)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{place}/*.parquet'")
    want = con.execute(registry.oracle_sql()["regression_hold"]).fetchall()
    got = [tuple(r) for r in registry.queries()["regression_hold"](spark, str(tmp_path)).select("id", "held").collect()]
    assert sorted(got) == sorted(want)
    assert ("1:1", True) in got


def test_case_of_every_letter_goes_one_for_one(spark):
    letters = [(i, chr(i)) for i in range(1, 0x2000) if not 0x1C80 <= i < 0x1CC0]
    got = spark.createDataFrame(letters, "i int, c string").select("i", lower_each(upper_each("c")).alias("low")).collect()
    want = dict(duckdb.sql("select i, lower(upper(chr(i::int))) from range(1, 8192) t(i)").fetchall())
    assert {r.i: (r.low, want[r.i]) for r in got if r.low != want[r.i]} == {}
