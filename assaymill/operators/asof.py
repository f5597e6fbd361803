"""As-of joins of keys of any size: what was last known at or before each row.

Rows are dealt by ranges of key and order, so that a long key is spread over many tasks. Each range tells its last
value of each key, what ranges before it knew is carried over, and the rest is looked for within the range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.sources.shared import stored


def same(left: str, right: str, columns: list[str]) -> Column:
    """Whether two rows agree in all columns; null equals null."""
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def last_known(rows: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that isn't null, of the row itself or of one before it in ``order``.

    Null keys are one key; nulls in ``order`` come first. Rows that are equal in key and order aren't parted and may
    see one another's value, so ``order`` should tell rows apart.
    """
    dealt = rows.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "asof")
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    tails = dealt.groupBy(*key, "_range").agg(F.max_by(value, known).alias("_tail"))
    before = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    carried = tails.select(*key, "_range", F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    both = dealt.alias("a").join(carried.alias("b"), same("a", "b", [*key, "_range"])).select("a.*", "b._carried")
    inside = W.partitionBy(*key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried"))
    return both.withColumn(name, found).drop("_range", "_carried")


def asof_join(left: DataFrame, right: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``left`` with ``name``: ``value`` of the last row of ``right`` of its key at or before it; null if there is none.

    Both have the columns of key and order; a row of ``right`` at the very place of one of ``left`` counts for it. Rows of
    ``right`` without a value don't count.
    """
    columns = left.columns
    mine = left.select(*columns, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    theirs = right.where(F.col(value).isNotNull()).select(*key, *order, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    rows = last_known(mine.unionByName(theirs, allowMissingColumns=True), key, [*order, "_side"], "_value", name)
    return rows.where("_side = 1").select(*columns, name)
