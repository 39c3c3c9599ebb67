"""Table access and scratch locations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """More tasks for CPU-heavy row work when a table scan has fewer splits than there are cores.

    Tables of many files have more splits than cores and pass through without a shuffle. Only for
    plain scans: asking a plan with shuffles for its partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def spread_rows(df: DataFrame, rows: int, key: str, each: int = 100_000) -> DataFrame:
    """The rows of ``df``, about ``rows``, dealt by a key to tasks of about ``each`` rows for CPU-heavy row work.

    A task's time then stays the same however large the table is; adaptive execution would join
    the partitions by their bytes, which are few here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // each)), key)


def stream_table(spark: SparkSession, root: str, name: str, **options: object) -> DataFrame:
    """The same table as a file stream. The glob lets it be one file or a folder of part files."""
    schema = table(spark, root, name).schema
    path = f"{root}/{name}.parque[t]"
    return spark.readStream.schema(schema).options(**options).parquet(path)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints.

    On a cluster this lies in the shared folder named by ``spark.checkpoint.dir``;
    a machine-local folder is only ever used in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
