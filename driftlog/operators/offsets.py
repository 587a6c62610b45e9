"""Earliest and latest offsets, sizes, lookups by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions import schemas as S
from driftlog.plans.prefix import floor_join

TP = ["topic", "part"]
LATEST, EARLIEST = -1, -2


def earliest_latest(batches: DataFrame) -> DataFrame:
    """The first offset of each partition, and one past its last."""
    return batches.groupBy(*TP).agg(F.min("base").alias("earliest"), F.max(F.col("base") + F.col("span")).alias("latest"))


def partition_size(batches: DataFrame) -> DataFrame:
    """Bytes on disk: each blob and its frame."""
    return batches.groupBy(*TP).agg(F.sum(F.col("bytes") + S.BLOB_HEADER).cast("long").alias("bytes"))


def end_offset_total(batches: DataFrame) -> DataFrame:
    return earliest_latest(batches).groupBy("topic").agg(F.sum("latest").cast("long").alias("total"))


def list_offsets(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (rid, topic, part, ts): ts -1 gives the latest offset, -2 the earliest; another time is error -1, an
    unknown partition error 3, both with offset -1. The answer's timestamp is always -1."""
    r = requests.join(earliest_latest(batches), TP, "left")
    known = F.col("latest").isNotNull()
    error = F.when(~known, S.UNKNOWN_TOPIC_OR_PARTITION).when(~F.col("ts").isin(LATEST, EARLIEST), S.UNKNOWN_SERVER_ERROR).otherwise(S.NONE)
    off = F.when(known & (F.col("ts") == LATEST), F.col("latest")).when(known & (F.col("ts") == EARLIEST), F.col("earliest")).otherwise(-1)
    return r.select("rid", *TP, error.alias("error"), F.lit(-1).cast("long").alias("timestamp"), off.cast("long").alias("off"))


def as_of(index: DataFrame, probes: DataFrame, chunk_ms: int = 1 << 26) -> DataFrame:
    """For probes (pid, topic, part, t) the greatest indexed offset (ts_ms, base) whose time is at most t; null if none."""
    return floor_join(probes, index, TP, "t", "ts_ms", F.col("base"), "off", chunk_ms).select("pid", *TP, "t", "off")


def index_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For probes (topic, part, off) the sparse index's entry from which a scan for the offset starts: the last one at or
    before it, with its segment, its offset relative to that, and its byte position; nulls if none is."""
    entry = F.struct("base", "segment_base", "rel", "position")
    found = floor_join(probes.withColumn("at", F.col("off")), index, TP, "at", "base", entry, "entry")
    return found.select(*TP, "off", F.col("entry.segment_base").alias("segment_base"), F.col("entry.rel").alias("rel"), F.col("entry.position").alias("position"))


def reopened(segmented: DataFrame, every: int = S.INDEX_EVERY) -> DataFrame:
    """What a partition goes on with when it is opened again: the next offset, the segment that takes appends, its blobs,
    and how many of these came since the last index entry."""
    g = segmented.groupBy(*TP, "segment_base").agg(F.count("*").alias("n"), F.max(F.col("base") + F.col("span")).alias("next"))
    last = g.groupBy(*TP).agg(F.max(F.struct("segment_base", "next", "n")).alias("s"))
    return last.select(*TP, F.col("s.next").alias("next_off"), F.col("s.segment_base").alias("segment_base"), F.col("s.n").alias("blobs"), (F.col("s.n") % every).alias("since_index"))
