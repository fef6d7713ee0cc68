"""Tables written between the stages of a job.

Stages are cut by Parquet tables in the folder the cluster shares, so a lost executor costs a
re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Scratch:
    """The folders and catalog tables that a job has written between its stages."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Drop the tables and remove the folders. What was read from them is gone then."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.tables.clear()
        self.paths.clear()


_OPEN: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Records what is written inside; the caller releases it when its result is no longer read."""
    own = Scratch(spark)
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield own
    finally:
        _OPEN.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else one below the warehouse; all executors share both."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/pagescout/{name}-{uuid.uuid4().hex}"
    for one in _OPEN.get():
        one.paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once and read it back as a table without lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None, in_place: bool = False) -> DataFrame:
    """Like :func:`materialize`, hash-bucketed by ``key``.

    Repeated joins on ``key`` then read the table in place instead of shuffling it each time. ``in_place`` writes
    without a shuffle: right where each partition has few keys, as every task writes a file for each of its buckets.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"pagescout_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (
        (df if in_place else df.repartition(count, key))
        .write.bucketBy(count, key)
        .sortBy(key)
        .option("path", new_path(spark, name))
        .format("parquet")
        .saveAsTable(table)
    )
    for one in _OPEN.get():
        one.tables.append(table)
    return spark.table(table)
