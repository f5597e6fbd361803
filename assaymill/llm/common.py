"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at a time, at most: whole texts and sets of shingles are large, and a batch stands
#: in the memory of the executor, of the worker, and once more as its result.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows an Arrow batch to ``BATCH_ROWS``; a session that has less keeps that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast to the given types, and nothing else.

    Columns are found by position, an exact name before one that differs in case, so that extra
    columns whose names clash (``TEXT`` beside ``text``, or two called ``text``) do no harm. A
    column that is missing is null. Every operator reads its rows through here, so this also bounds the batches
    that its Python steps get.
    """
    bound_batches(df.sparkSession)
    exact = {}
    loose = {}
    for i, name in enumerate(df.columns):
        exact.setdefault(name, i)
        loose.setdefault(name.lower(), i)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = []
    for name, kind in kinds.items():
        i = exact.get(name, loose.get(name.lower()))
        value = F.lit(None) if i is None else F.col(f"c{i}")
        out.append(value.cast(kind).alias(name))
    return plain.select(*out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that doesn't name one gets a temporary folder; a cluster must name it.
    """
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="assaymill-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to a folder of their own in the shared one and read again."""
    place = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def rows_of(batch, *names: str) -> Iterator[tuple]:
    """The rows of an Arrow batch, one value at a time, so that long texts aren't all decoded at once."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)
