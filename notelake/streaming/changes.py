"""Structured Streaming: the pending set, debounced upserts, late changes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelake.operators.index import latest
from notelake.storage import remove


class IndexTable:
    """A Parquet table in versions, cut into buckets by a hash of its keys.

    A batch writes the buckets that it touches to a folder of its own and then a manifest (bucket,
    version) of the whole table. The writer's success mark commits a manifest; the greatest
    committed version is the table, so a crash at any point leaves the version before. A batch
    that is replayed writes the same version again, or none if it was committed: a stream over
    the table is exactly-once, and readers see whole versions only. A batch costs as much as the
    buckets that it touches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], *, buckets: int = 64, time: str | None = None):
        """``time``: a row that is older than the stored one of its key doesn't replace it."""
        self.spark, self.path, self.schema, self.keys, self.time = spark, path.rstrip("/"), schema, keys, time
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.bucket: Column = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def version(self) -> int:
        """The greatest committed version, -1 before the first."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return -1
        found = [s.getPath() for s in fs.listStatus(folder)]
        done = [int(p.getName()[1:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=-1)

    def manifest(self, version: int) -> dict[int, int]:
        """Which version of each bucket is the newest; a row a bucket comes to the driver."""
        return {} if version < 0 else {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/manifests/v{version}").collect()}

    def _load(self, buckets: dict[int, int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(buckets.items())])

    def read(self) -> DataFrame:
        return self._load(self.manifest(self.version()))

    def _newer(self, stored: DataFrame, rows: DataFrame) -> DataFrame:
        order = [F.desc("_new")] if self.time is None else [F.desc_nulls_last(self.time), F.desc("_new")]
        both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        return latest(both, self.keys, [*order, *[F.col(c) for c in self.columns]]).drop("_new")

    def _commit(self, data: DataFrame, touched: list[int], manifest: dict[int, int], version: int) -> None:
        data.withColumn("bucket", self.bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
        rows = sorted((manifest | dict.fromkeys(touched, version)).items())
        self.spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/v{version}")

    def merge(self, rows: DataFrame, version: int) -> None:
        """Upserts rows by key; does nothing if the version is committed."""
        last = self.version()
        if version <= last:
            return
        rows = rows.select(*self.columns)
        touched = sorted(r["b"] for r in rows.select(self.bucket.alias("b")).distinct().collect())
        manifest = self.manifest(last)
        stored = self._load({b: manifest[b] for b in touched if b in manifest})
        self._commit(self._newer(stored, rows), touched, manifest, version)

    def vacuum(self) -> None:
        """Removes data that the newest version doesn't use; readers of older versions must be done."""
        last = self.version()
        used = set(self.manifest(last).values())
        jvm = self.spark.sparkContext._jvm
        for part, keep in (("data", used), ("manifests", {last})):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for s in fs.listStatus(folder) if fs.exists(folder) else ():
                if int(s.getPath().getName()[1:]) not in keep:
                    remove(self.spark, s.getPath().toString())


def pending(changes: DataFrame, *, late: timedelta = timedelta(hours=12), time: str = "user_updated_time", key: str = "note_id") -> DataFrame:
    """Changes with repeats of a note at one time dropped, within the watermark for late rows."""
    return changes.withWatermark(time, f"{int(late.total_seconds())} seconds").dropDuplicatesWithinWatermark([key, time])


def apply_changes(changes: DataFrame, index: IndexTable, checkpoint: str, *, process: Callable[[DataFrame], DataFrame] = lambda df: df, time: str = "user_updated_time", late: timedelta | None = None, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Upserts the latest change of each note of each micro-batch; the trigger is the debounce.

    Of changes of one note at one time the one that is first by its columns counts. With ``late``
    the pending set (repeats dropped, that watermark) goes before. ``once`` drains what is there (a
    sweep) and stops. The checkpoint is the retry queue.
    """
    if late is not None:
        changes = pending(changes, late=late, time=time, key=index.keys[0])

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        try:
            if not df.isEmpty():
                index.merge(process(latest(df, index.keys, [F.desc(time), *[F.col(c) for c in index.columns if c in df.columns]])), n)
        finally:
            df.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class UpdateRun:
    """At most one update at a time: a second one is refused, or with ``force`` stops the first."""

    def __init__(self) -> None:
        self.running: StreamingQuery | None = None

    def active(self) -> bool:
        return self.running is not None and self.running.isActive

    def start(self, begin: Callable[[], StreamingQuery], *, force: bool = False) -> StreamingQuery | None:
        if self.active():
            if not force:
                return None
            self.running.stop()
        self.running = begin()
        return self.running
