import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from assaymill.streaming import numbering
from assaymill.streaming.committed import CommittedTable

KIND = "target_id string, submission string"


def submissions(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.col("conv_id").cast("string").alias("target_id"), F.format_string("turn-%03d", "turn").alias("submission"))


def stream(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)


def add(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def stored(spark, place):
    rows = CommittedTable(spark, place).read().collect()
    return {(r.target_id, r.submission): r.session for r in rows}, len(rows)


def numbered_by_hand(batches):
    """Batches in their order, submissions of a target by their keys."""
    out, last = {}, {}
    for batch in batches:
        for target, submission in sorted(set(batch)):
            if (target, submission) not in out:
                last[target] = out[target, submission] = last.get(target, 0) + 1
    return out


def test_two_batches_of_a_target_and_replays(spark, sf_dir, tmp_path):
    folder, place, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = submissions(spark, sf_dir)
    odd, even = rows.where("right(submission, 1) in ('1', '3')"), rows.where("right(submission, 1) in ('0', '2')")
    some = rows.where("target_id < '3'")
    batches = []
    for batch in (odd, even, some, rows):  # the last two come again, in part or whole
        add(batch, folder)
        numbering.store_sessions(stream(spark, folder), place, mark).awaitTermination()
        batches.append([tuple(r) for r in batch.collect()])
    got, n = stored(spark, place)
    assert got == numbered_by_hand(batches) and n == len(got) == rows.distinct().count()
    for target in {t for t, _ in got}:
        numbers = sorted(s for (t, _), s in got.items() if t == target)
        assert numbers == list(range(1, len(numbers) + 1))


def test_a_batch_that_fails_is_numbered_alike_again(spark, sf_dir, tmp_path, monkeypatch):
    folder, place, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = submissions(spark, sf_dir)
    first, second = rows.where("submission < 'turn-002'"), rows.where("submission >= 'turn-002'")
    add(first, folder)
    numbering.store_sessions(stream(spark, folder), place, mark).awaitTermination()
    add(second, folder)
    append = CommittedTable.append

    def dies_after(self, *args, **kwargs):
        append(self, *args, **kwargs)
        raise RuntimeError("lost after the commit, before the batch was marked done")

    with monkeypatch.context() as patch:
        patch.setattr(CommittedTable, "append", dies_after)
        with pytest.raises(StreamingQueryException):
            numbering.store_sessions(stream(spark, folder), place, mark).awaitTermination()
    numbering.store_sessions(stream(spark, folder), place, mark).awaitTermination()
    got, n = stored(spark, place)
    assert n == len(got) and got == numbered_by_hand([[tuple(r) for r in b.collect()] for b in (first, second)])


def test_nulls_and_repeats_in_a_batch(spark, tmp_path):
    folder, place, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    add(spark.createDataFrame([("t", "b"), ("t", "a"), ("t", "b"), (None, "a"), ("t", None), ("u", "z")], KIND), folder)
    numbering.store_sessions(stream(spark, folder), place, mark).awaitTermination()
    assert stored(spark, place) == ({("t", "a"): 1, ("t", "b"): 2, ("u", "z"): 1}, 3)
