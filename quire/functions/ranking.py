"""Exact per-group numbering that never sorts a whole group, or a whole minute of it, in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import work_dir


def ordered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with ``_at``, a number that grows with (keys, order) over the whole table.

    The table is dealt to tasks by ranges of (keys, order), whose bounds come from a sample of the rows. So a
    key or a minute with half of all rows fills as many tasks as its rows need. It is written in that order and
    read back, so that every later use sees the same numbers.
    """
    dealt = [F.asc(c) for c in keys] + list(order)
    ranged = df.repartitionByRange(*dealt).sortWithinPartitions(*dealt)
    path = work_dir(df.sparkSession, "ordered")
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.schema(ranged.withColumn("_at", F.lit(0).cast("bigint")).schema).parquet(path)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str = "row_number",
    newest_first: bool = False,
) -> DataFrame:
    """``row_number() over (partition by keys order by bucket, order)`` for groups of any size.

    ``bucket`` is a function of the ordering (a minute of the timestamp, a block of page numbers; a struct of
    several is fine) that comes before it; with ``newest_first`` it runs downwards. Null keys and buckets count as
    values of their own, so no row is lost. The rows must be told apart by (bucket, order).

    Rows are ordered by ranges, see :func:`ordered_rows`. Where a key starts in each range and how many rows it
    has there is one small row; a running sum of those tells how many rows of the key come before the range.
    """
    keys = list(keys)
    first = F.desc("_bucket") if newest_first else F.asc("_bucket")
    rows = ordered_rows(df.withColumn("_bucket", bucket), keys, [first, *order]).drop("_bucket")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(f"_of_{c}") for c in [*keys, "_range"]],
        (F.col("_start") - F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - 1).alias("_zero"),
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_range"]])
    numbered = rows.join(starts, same).withColumn(out, F.col("_at") - F.col("_zero"))
    return numbered.drop("_at", "_range", "_zero", *[f"_of_{c}" for c in [*keys, "_range"]])


def page_block(page: Column, size: int = 4096) -> Column:
    """Coarse page-number bucket for :func:`number_rows`."""
    return F.floor(page / F.lit(size))


def minute_of(ts: Column) -> Column:
    """Coarse time bucket for :func:`number_rows`."""
    return F.date_trunc("minute", ts)
