"""Bounded reads, point and range lookups, fetches. Batches have topic, part, base, span, bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftlog.functions import schemas as S
from driftlog.operators.offsets import earliest_latest
from driftlog.plans.prefix import floor_join, running_sum

TP = ["topic", "part"]


def read_from_offset(batches: DataFrame, requests: DataFrame, at_least_one: bool = False) -> DataFrame:
    """Whole batches for requests (rid, topic, part, start, max_bytes): from the one that holds start, while their bytes
    fit. Lengths are never negative, so the prefix that fits is a filter on the running sum. at_least_one also returns a
    first batch that is too big alone."""
    hit = batches.join(requests, TP).where(F.col("base") + F.col("span") > F.col("start"))
    w = W.partitionBy("rid", *TP).orderBy("base").rowsBetween(W.unboundedPreceding, 0)
    upto = hit.withColumn("upto", F.sum("bytes").over(w))
    fits = F.col("upto") <= F.col("max_bytes")
    return upto.where(fits | (F.col("upto") == F.col("bytes")) if at_least_one else fits)


def batch_containing(batches: DataFrame, probes: DataFrame) -> DataFrame:
    """The batch that holds each probe's offset (topic, part, off), and the offset behind it."""
    found = floor_join(probes.withColumn("at", F.col("off")), batches, TP, "at", "base", F.struct("base", "span"), "b")
    inside = F.col("off") < F.col("b.base") + F.col("b.span")
    return found.where(inside).select(*TP, "off", "b.base", "b.span", (F.col("b.base") + F.col("b.span")).alias("next_off"))


def range_join(batches: DataFrame, records: DataFrame, width: int) -> DataFrame:
    """Every record with its batch. Spans of at most width offsets are dealt into the buckets that they touch, so the
    join is on equal keys and each record meets at most the batches of its bucket."""
    b = batches.select(*TP, "base", "span", F.explode(F.sequence(F.floor(F.col("base") / width), F.floor((F.col("base") + F.col("span") - 1) / width))).alias("_k"))
    r = records.withColumn("_k", F.floor(F.col("off") / width))
    return r.join(b, [*TP, "_k"]).where((F.col("base") <= F.col("off")) & (F.col("off") < F.col("base") + F.col("span"))).drop("_k")


def fetch(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request (rid, topic, part, start, max_bytes): error, high watermark, batches and bytes that fit, first
    base. An unknown partition is error 3, a start before the earliest offset error 1; both have watermark 0 (-1 is
    never used). Reading past the end is no error; past_end tells it."""
    ends = earliest_latest(batches)
    got = read_from_offset(batches, requests).groupBy("rid").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.min("base").alias("first"))
    r = requests.join(ends, TP, "left").join(got, "rid", "left")
    error = F.when(F.col("latest").isNull(), S.UNKNOWN_TOPIC_OR_PARTITION).when(F.col("start") < F.col("earliest"), S.OFFSET_OUT_OF_RANGE).otherwise(S.NONE)
    r = r.withColumn("error", error)
    ok = F.col("error") == S.NONE
    zero = lambda c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return r.select("rid", *TP, "start", "error", zero(F.col("latest")).alias("watermark"), zero(F.col("n")).alias("batches"), zero(F.col("b")).alias("bytes"), F.when(ok, F.col("first")).alias("first_base"), (ok & (F.col("start") >= F.col("latest"))).alias("past_end"))


def torn_prefix(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """What survives of files (topic, part, file_bytes): blobs (topic, part, base, span, bytes) that are complete."""
    size = F.col("bytes") + S.BLOB_HEADER
    end = running_sum(blobs, TP, "base", size, "begins").withColumn("end", F.col("begins") + size).join(files, TP)
    keep = F.col("end") <= F.col("file_bytes")
    n = lambda c: F.coalesce(F.sum(F.when(keep, c)), F.lit(0)).cast("long")
    return end.groupBy(*TP).agg(n(F.lit(1)).alias("blobs"), n(F.col("span")).alias("offsets"), F.coalesce(F.max(F.when(keep, F.col("end"))), F.lit(0)).cast("long").alias("valid_bytes"))
