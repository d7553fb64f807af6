"""Shared-folder tables: cut lineage with written Parquet instead of executor-local state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where that setting is missing and everything runs in this process (tests, a single
    machine) is a temporary folder made and remembered in the session; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="notelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any Hadoop file system; one that isn't there is no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    What follows depends on replicated files only, so a lost executor never recomputes more than
    its own tasks.
    """
    return _written(df, fresh_path(df.sparkSession, label))


class Scratch:
    """Tables that an operator needs only until its result is written.

    As a context manager it removes what is left at the end; ``drop`` removes a table as soon as
    its successor exists. A result that is returned must not read from these tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*self.paths)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """As ``materialize``; the former table of this label goes once the new one is written."""
        path = fresh_path(self.spark, label)
        out = _written(df, path)
        self.drop(label)
        self.paths[label] = path
        return out

    def drop(self, *labels: str) -> None:
        for label in labels:
            if path := self.paths.pop(label, None):
                remove(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
