"""Incremental intake of snapshots with Structured Streaming.

The checkpoint makes intake of files exactly once; each micro-batch is
deduplicated, pivoted and upserted.  The table is a folder per day with a folder
per version in it, and a manifest per batch that names the version of each day; a
batch writes new folders of the days it touches and then its manifest, at once, so
a batch that died anywhere is written again from what was there before it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow import schema
from gaugeflow.functions import parse
from gaugeflow.operators.lookup import keep_one
from gaugeflow.operators.reshape import pivot_last, upsert
from gaugeflow.scratch import materialize

KEY = ["stationId", "timestamp", "parameterNo"]


def snapshot_stream(spark: SparkSession, path: str, kind: str = schema.SNAPSHOT, files_per_trigger: int = 100) -> DataFrame:
    """New snapshot files of a folder, in long form."""
    return spark.readStream.schema(kind).option("header", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "water_data_*.csv").csv(path).withColumn("_file", F.col("_metadata.file_name"))


def latest_readings(batch: DataFrame) -> DataFrame:
    """Of repeated readings the one of the last file."""
    return keep_one(batch, KEY, F.col("_file").desc(), F.col("value").desc_nulls_last())


def wide_batch(batch: DataFrame, parameters: list[str]) -> DataFrame:
    """A row per station and time with a column per parameter."""
    rows = latest_readings(batch.withColumn("_t", parse.mixed_timestamp(F.col("timestamp"))))
    return pivot_last(rows, ["stationId", "timestamp"], parameters, "parameterName", "value", "_file")


def _day() -> Column:
    return F.coalesce(F.date_format(F.col("timestamp").try_cast("timestamp"), "yyyy-MM-dd"), F.lit("none"))


class Versions:
    """Which version of which day is current, in manifests below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def batches(self) -> list[int]:
        """The numbers of the committed batches."""
        folder = self._at("_manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def current(self, before: int | None = None) -> dict[str, int]:
        """Day -> version as of the last batch, or the last one before ``before``."""
        known = [b for b in self.batches() if before is None or b < before]
        if not known:
            return {}
        stream = self._fs.open(self._at(f"_manifests/{known[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, number: int, days: dict[str, int]) -> None:
        """Make ``days`` current: the manifest is written aside and renamed."""
        aside = self._at(f"_manifests/.{number}-{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(days, sort_keys=True).encode()))
        finally:
            stream.close()
        if not self._fs.rename(aside, self._at(f"_manifests/{number}")):
            raise OSError(f"the manifest of batch {number} can't be renamed")

    def read(self, days: dict[str, int]) -> DataFrame | None:
        folders = [f"{self.path}/day={d}/version={v}" for d, v in sorted(days.items())]
        return self.spark.read.parquet(*folders) if folders else None


def upsert_wide(path: str, parameters: list[str]):
    """A function for foreachBatch: the batch's rows replace those of their keys in the table at ``path``.

    Only the days of the batch's rows are read and written.  A batch that is
    committed does nothing when it comes again.
    """

    def run(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, path)
        if number in versions.batches():
            return
        before = versions.current(number)
        new = materialize(wide_batch(batch, parameters).withColumn("day", _day()), "batch")
        touched = [r.day for r in new.select("day").distinct().collect()]
        old = versions.read({d: v for d, v in before.items() if d in touched})
        merged = new if old is None else upsert(old.withColumn("day", _day()), new, ["stationId", "timestamp"])
        stored = merged.withColumn("version", F.lit(number)).repartition("day")
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(path)
        versions.commit(number, before | dict.fromkeys(touched, number))

    return run


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of the last batch; None before the first."""
    versions = Versions(spark, path)
    return versions.read(versions.current())


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete the versions that aren't current, while no batch runs; how many."""
    versions, dropped = Versions(spark, path), 0
    for day, current in versions.current().items():
        for status in versions._fs.listStatus(versions._at(f"day={day}")):
            if status.getPath().getName() != f"version={current}":
                versions._fs.delete(status.getPath(), True)
                dropped += 1
    return dropped


def run_available(stream: DataFrame, path: str, checkpoint: str, parameters: list[str]) -> StreamingQuery:
    """Take in all files that are there and stop."""
    query = stream.writeStream.foreachBatch(upsert_wide(path, parameters)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_means(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Mean by station, parameter and day of a stream with ``ts``; with ``late`` older readings are dropped."""
    rows = stream.withWatermark("ts", late) if late else stream
    return rows.groupBy("stationId", "parameterName", F.window("ts", "1 day")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"))


def first_readings(stream: DataFrame, late: str) -> DataFrame:
    """Without repeats of a key within the watermark; the first reading is kept."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(KEY)
