"""The canonical log view and what derives from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions import schemas as S
from driftlog.plans.prefix import running_sum

TP = ["topic", "part"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp_ntz column, truncated."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) div 1000")


def records(events: DataFrame) -> DataFrame:
    """Records before they have offsets."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("part"),
        epoch_ms("ts").alias("ts_ms"),
        F.col("user_id").alias("key"),
        F.col("props").alias("payload"),
        F.octet_length("props").cast("long").alias("len"),
        "value",
    )


def assign_offsets(df: DataFrame, order: str = "seq", span=None) -> DataFrame:
    """df with off, the first offset of each row: dense and gapless in each (topic, part). A span below 1 counts as 1."""
    return running_sum(df, TP, order, F.lit(1) if span is None else F.greatest(span, F.lit(1)), "off")


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_offsets(records(load(spark, sf_dir, "events")))


def batches(log: DataFrame, size: int = 5) -> DataFrame:
    """Record batches of `size` consecutive offsets: base, span, bytes (header and payloads), append time, first seq."""
    b = F.floor(F.col("off") / size)
    g = log.groupBy(*TP, b.alias("bno"))
    return g.agg(F.min("off").alias("base"), F.count("*").alias("span"), (F.lit(S.BATCH_HEADER) + F.sum("len")).cast("long").alias("bytes"), F.max("ts_ms").alias("ts_ms"), F.min("seq").alias("seq"))


def batch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(log_view(spark, sf_dir))


def commits(log: DataFrame, every: int = 7) -> DataFrame:
    """A changelog of committed offsets: every 7th record commits the offset behind it, for one of four groups."""
    c = log.where(F.col("seq") % every == 0)
    return c.select("seq", F.concat(F.lit("g"), F.col("key") % 4).alias("grp"), *TP, (F.col("off") + 1).alias("off"), F.concat(F.lit("m"), F.col("seq") % 5).alias("metadata"))


def commit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits(log_view(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request metrics: api, result, latency in ms, bytes in and out (none out on an error)."""
    r = records(load(spark, sf_dir, "events"))
    bad = F.col("topic") == "error"
    return r.select("seq", "ts_ms", F.col("topic").alias("api"), F.when(bad, "error").otherwise("ok").alias("result"), F.col("value").alias("ms"), F.col("len").alias("bytes_in"), F.when(bad, F.lit(0)).otherwise(F.col("len") * 2).cast("long").alias("bytes_out"), F.col("key"))
