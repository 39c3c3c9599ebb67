"""Stored tables in hash buckets, of which an update rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_MANIFEST = "version bigint, batch_id bigint, keys array<string>, buckets int, schema string, bucket int, held_by bigint"


class BucketedTable:
    """One version of a table in ``path``.

    Rows lie in ``data/version=<v>/bucket=<b>``, the bucket by a hash of the key. A manifest says which version
    holds each bucket now; it is kept in two slots written in turn, so that one is always whole. A batch writes
    its buckets into a folder of its own and then the manifest: until that, readers see the version before, and a
    replay writes the same folder again. The bucket count is fixed when the table is made; a bucket should fit a few tasks.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.version, self.batch_id = spark, path, -1, -1
        self.held: dict[int, int] = {}
        try:
            rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/slot=[01]").collect()
        except AnalysisException:
            raise ValueError(f"no table in {path}") from None
        self.version = max(r.version for r in rows)
        rows = [r for r in rows if r.version == self.version]
        self.batch_id, self.keys, self.buckets, self.schema = rows[0].batch_id, rows[0].keys, rows[0].buckets, rows[0].schema
        self.held = {r.bucket: r.held_by for r in rows if r.bucket is not None}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        wanted = sorted(self.held if only is None else set(only) & set(self.held))
        paths = [f"{self.path}/data/version={self.held[b]}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def update(self, changes: DataFrame, batch_id: int, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> BucketedTable:
        """The table after ``apply(old, changes)``, which sees the touched buckets only and returns all their rows.

        ``changes`` carry the key columns. A batch that the table has already changes nothing.
        """
        if batch_id <= self.batch_id:
            return self
        touched = [r[0] for r in changes.select(self.bucket()).distinct().collect()]  # at most the bucket count
        new = apply(self.read(touched), changes)
        held = {b: v for b, v in self.held.items() if b not in touched}
        held |= dict.fromkeys(_write(new, self.path, self.version + 1, self.bucket()), self.version + 1)
        _commit(self.spark, self.path, self.version + 1, batch_id, self.keys, self.buckets, self.schema, held)
        return BucketedTable(self.spark, self.path)


def _write(rows: DataFrame, path: str, version: int, bucket: Column) -> list[int]:
    """Writes rows by bucket, each bucket in the order of one task or more, and tells which buckets have any."""
    place = f"{path}/data/version={version}"
    placed = rows.withColumn("bucket", bucket)
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
    try:
        stored = rows.sparkSession.read.parquet(place)
        return [r[0] for r in stored.select(F.col("bucket").cast("int")).distinct().collect()]
    except AnalysisException:  # no rows, so no files
        return []


def _commit(spark: SparkSession, path: str, version: int, batch_id: int, keys: Sequence[str], buckets: int, schema: str, held: dict[int, int]) -> None:
    head = (version, batch_id, list(keys), buckets, schema)
    rows = [(*head, b, v) for b, v in sorted(held.items())] or [(*head, None, None)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/slot={version % 2}")


def create_table(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> BucketedTable:
    """Stores a table in an empty folder."""
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    held = dict.fromkeys(_write(rows, path, 0, bucket), 0)
    _commit(spark, path, 0, -1, keys, buckets, schema, held)
    return BucketedTable(spark, path)
