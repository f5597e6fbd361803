import threading

from pyspark.sql import functions as F

from assaymill.streaming import incremental
from assaymill.streaming.committed import CommittedTable


def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")


def test_commits_are_numbered_and_read_in_order(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.read("id long").collect() == [] and table.commits() == []
    assert table.append(spark.range(3), "a") and table.append(spark.range(3, 5), "b")
    assert [(c["version"], c["transaction"]) for c in table.commits()] == [(1, "a"), (2, "b")]
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.id for r in table.read(after=1).collect()) == [3, 4]


def test_a_batch_that_is_replayed_adds_nothing(spark, sf_dir, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    rows = conversations(spark, sf_dir)
    batches = [rows.where(f"conv_id % 3 = {k}") for k in range(3)]
    added = [table.append(batches[k], f"batch-{k}", ["conv_id", "turn"]) for k in (0, 1, 0, 2, 1, 2, 2)]
    assert added == [True, True, False, True, False, False, False]
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
    assert list(table.leftovers()) == []


def test_a_writer_that_dies_leaves_nothing_to_read(spark, sf_dir, tmp_path, monkeypatch):
    table = CommittedTable(spark, str(tmp_path / "t"))
    rows = conversations(spark, sf_dir)
    assert table.append(rows.where("conv_id < 5"), "first")

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(CommittedTable, "_commit", die)
        try:
            table.append(rows, "second")
        except RuntimeError:
            pass
    assert table.read().count() == rows.where("conv_id < 5").count()
    assert len(list(table.leftovers())) == 1
    assert table.append(rows, "second", ["conv_id", "turn"])
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))


def test_two_writers_at_once_lose_nothing_and_store_no_key_twice(spark, tmp_path):
    place = str(tmp_path / "t")
    meet = threading.Barrier(4)
    results = []

    def write(k):
        table = CommittedTable(spark, place)
        rows = spark.range(10 * k, 10 * k + 20).withColumn("by", F.lit(k))  # the upper half is the next one's lower half
        meet.wait()
        results.append(table.append(rows, f"w{k}", ["id"]))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    table = CommittedTable(spark, place)
    assert results == [True] * 4
    assert [c["version"] for c in table.commits()] == [1, 2, 3, 4]
    assert sorted(r.id for r in table.read().collect()) == list(range(50))


def test_one_transaction_of_two_writers_is_committed_once(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "t")
    commit = CommittedTable._commit
    seen = []

    def overtaken(self, version, transaction, folder):
        if not seen:
            seen.append(1)
            assert CommittedTable(spark, place).append(spark.range(3), "same")
        return commit(self, version, transaction, folder)

    monkeypatch.setattr(CommittedTable, "_commit", overtaken)
    table = CommittedTable(spark, place)
    assert not table.append(spark.range(3), "same")
    assert table.read().count() == 3 and list(table.leftovers()) == []


def test_cache_of_a_stream_is_stored_once(spark, sf_dir, tmp_path):
    place, reads = str(tmp_path / "cache"), []
    wanted = conversations(spark, sf_dir)

    def read(misses):
        reads.append(misses.count())
        return misses.withColumn("ok", F.col("turn") != 1)

    for transaction in ("1", "1", "2", None):
        got = incremental.through_cache(spark, wanted, place, ["conv_id", "turn"], read, transaction)
    n, failed = wanted.count(), wanted.where("turn = 1").count()
    assert got.count() == n - failed
    assert reads == [n, failed, failed]
    assert CommittedTable(spark, place).read().count() == n - failed


def test_null_keys_are_keys(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(None, "a"), (1, "b")], "id long, note string")
    assert table.append(rows, keys=["id"]) and table.append(rows, keys=["id"])
    assert table.read().count() == 2


def test_a_session_has_any_number_of_records(spark, tmp_path):
    place = str(tmp_path / "sessions")
    records = spark.createDataFrame([("d", 1, "x"), ("d", 1, "y"), ("d", 1, "y")], "doc_id string, session int, note string")
    for _ in range(2):
        incremental.append_session(records, place)
    assert CommittedTable(spark, place).read().count() == 3
