"""Structured Streaming over the log: live latest commits, member expiry, tails of segment files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.operators import commits as batch_commits
from driftlog.operators import groups
from driftlog.plans import view


def shared(spark: SparkSession) -> str:
    """A fresh folder that executors and driver share; our own only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/') if base else 'file://' + tempfile.mkdtemp(prefix='driftlog-')}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events as a stream of files, their schema taken from the files."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)


def upsert(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream of aggregates in update mode to the end of its input; each batch is one part of the table at out."""
    def write(df: DataFrame, batch: int) -> None:
        # the batch number names the part, so a batch that is run again replaces what it left
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Latest commit per key, kept by a stream over the changelog: the state is one row per key, the greatest seq."""
    home = shared(spark)
    r = view.records(events_stream(spark, path))
    # offsets need the whole log: they come from the log view, the changelog arrives as a stream
    log = view.assign_offsets(view.records(spark.read.parquet(path))).select("seq", "off")
    c = view.commits(r.join(log, "seq"))
    live = c.groupBy("grp", "topic", "part").agg(F.max(F.struct("seq", "off", "metadata")).alias("c"))
    upsert(live, f"{home}/out", f"{home}/checkpoint")
    parts = spark.read.parquet(f"{home}/out").select("grp", "topic", "part", "c.off", "c.metadata", "c.seq")
    return batch_commits.latest(parts)


def expire(spark: SparkSession, path: str, timeout_ms: int) -> DataFrame:
    """Members whose last beat is more than timeout_ms before the newest one of all, from a stream's last beats."""
    home = shared(spark)
    r = view.records(events_stream(spark, path))
    b = r.select(F.concat(F.lit("g"), F.col("key") % 4).alias("grp"), F.concat(F.lit("member-"), F.col("key")).alias("member"), "ts_ms")
    upsert(b.groupBy("grp", "member").agg(F.max("ts_ms").alias("ts_ms")), f"{home}/out", f"{home}/checkpoint")
    last = spark.read.parquet(f"{home}/out")
    return groups.expired(last.select("grp", "member", "ts_ms"), last.agg(F.max("ts_ms")).first()[0] or 0, timeout_ms)
