"""Committed offsets: the changelog (seq, grp, topic, part, off, metadata) and its latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftlog.functions import schemas as S
from driftlog.operators.offsets import earliest_latest, partition_size

TP = ["topic", "part"]
KEY = ["grp", *TP]


def latest(changelog: DataFrame) -> DataFrame:
    """The last commit of each key in log order, even if its offset is lower."""
    last = changelog.groupBy(*KEY).agg(F.max_by(F.struct("off", "metadata", "seq"), "seq").alias("c"))
    return last.select(*KEY, "c.off", "c.metadata", "c.seq")


def compact(changelog: DataFrame) -> DataFrame:
    """One record per key, renumbered from 0 in order of the keys. Groups are numbered apart, then shifted by the groups
    before them, so no task sorts all keys."""
    k = latest(changelog)
    n = k.groupBy("grp").agg(F.count("*").alias("_n"))
    # one row per group reaches this window, not one per key
    before = n.select("grp", (F.sum("_n").over(W.orderBy("grp")) - F.col("_n")).alias("_before"))
    inside = k.withColumn("_r", F.row_number().over(W.partitionBy("grp").orderBy(*TP)) - 1)
    return inside.join(before, "grp").select((F.col("_before") + F.col("_r")).cast("long").alias("position"), *KEY, "off", "metadata")


def offset_fetch(state: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (grp, topic, part) with their commit; -1 and null metadata where there is none; never an error."""
    r = requests.join(state.select(*KEY, "off", "metadata"), KEY, "left")
    return r.select(*KEY, F.coalesce("off", F.lit(-1)).cast("long").alias("off"), "metadata", F.lit(S.NONE).alias("error"))


def offset_fetch_wide(state: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (rid, grp, topic, part) where a null topic asks for all of the group's commits; a group without any gives
    no rows for it. Otherwise as offset_fetch."""
    named = requests.where("topic is not null").join(state.select(*KEY, "off", "metadata"), KEY, "left")
    every = requests.where("topic is null").select("rid", "grp").join(state.select(*KEY, "off", "metadata"), "grp")
    both = named.select("rid", *KEY, "off", "metadata").unionByName(every.select("rid", *KEY, "off", "metadata"))
    return both.select("rid", *KEY, F.coalesce("off", F.lit(-1)).cast("long").alias("off"), "metadata", F.lit(S.NONE).alias("error"))


def fetch_all(state: DataFrame) -> DataFrame:
    """Each group's topics with their committed partitions in order."""
    return state.groupBy("grp", "topic").agg(F.sort_array(F.collect_list("part")).alias("parts"))


def groups(changelog: DataFrame) -> DataFrame:
    return changelog.select("grp").distinct()


def lag(state: DataFrame, batches: DataFrame) -> DataFrame:
    """Latest minus committed, as it is, negative too; keys without a partition are left out."""
    return state.join(earliest_latest(batches), TP).select(*KEY, "off", "latest", (F.col("latest") - F.col("off")).alias("lag"))


def size_by_catalog(catalog: DataFrame, batches: DataFrame) -> DataFrame:
    """Sizes of the partitions that the catalog (name, partitions) lists and that exist."""
    listed = catalog_partitions(catalog)
    return listed.join(partition_size(batches), TP)


def catalog_partitions(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("name").alias("topic"), F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("part"))


def flatten(requests: DataFrame) -> DataFrame:
    """Commit requests (grp, topics array<topic, parts array<part, off, metadata>>) as rows; null metadata becomes ''."""
    t = requests.select("grp", F.explode("topics").alias("t")).select("grp", "t.topic", F.explode("t.parts").alias("p"))
    return t.select("grp", "topic", "p.part", "p.off", F.coalesce("p.metadata", F.lit("")).alias("metadata"))
