"""Tables that cut lineage: written once to the folder that driver and executors share, and removed when they are done with."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: shuffle files go as soon as it stands, for it is read from then on, and batches handed to
#: Python are bounded by their bytes, since texts can be long and a worker holds each batch in several forms.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **SMALL_BATCHES}


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-scratch-")


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session, where driver and executors are one process, gets a
    folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return base.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once and read back, and where it lies."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, WHILE_WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once and read back; the table stays."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The tables of one computation. Those that are kept here are removed when the `with` block ends, or earlier by drop;
    a result that outlives the block is written by materialize."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        out, path = written(df, name)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self._paths.pop(id(table))
            remove(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.drop(*(table for table, _ in list(self._paths.values())))


class Chain:
    """Tables each of which is computed from the one before and replaces it."""

    def __init__(self, spark: SparkSession):
        self.spark, self._path = spark, None

    def next(self, df: DataFrame, name: str = "link") -> DataFrame:
        out, path = written(df, name)
        self.drop()
        self._path = path
        return out

    def drop(self) -> None:
        if self._path:
            remove(self.spark, self._path)
            self._path = None
