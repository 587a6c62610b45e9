"""Topics: validation, creation, deletion, metadata. A catalog has name, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions import schemas as S
from driftlog.functions.codec import reserved_name, valid_name
from driftlog.operators.commits import catalog_partitions


def create_topics(catalog: DataFrame, requests: DataFrame, cap: int = 0, internal: bool = False) -> DataFrame:
    """requests (rid, name, partitions) answered in order of rid: error codes 17, 36, 37 or 0.

    A name is checked first, then that it is new (also among earlier requests), then the count, then the room under cap
    (0: none). Which of the requests that pass the row-wise checks fit the cap depends on those before them; requests of
    one call are one array, at most as long as a request frame allows, and are folded in it.
    """
    ok_name = valid_name(F.col("name")) & (F.lit(internal) | ~reserved_name(F.col("name")))
    used = catalog.agg(F.coalesce(F.sum("partitions"), F.lit(0)).cast("long").alias("used"))
    r = requests.join(catalog.select("name", F.lit(True).alias("known")), "name", "left")
    code = F.when(~ok_name, S.INVALID_TOPIC).when(F.col("known"), S.TOPIC_ALREADY_EXISTS).when(~F.col("partitions").between(1, S.MAX_PARTITIONS_PER_TOPIC), S.INVALID_PARTITIONS).otherwise(S.NONE)
    one = r.agg(F.array_sort(F.collect_list(F.struct("rid", "name", "partitions", code.alias("code")))).alias("rs")).join(used)
    start = F.struct(F.col("used").alias("used"), F.array().cast("array<string>").alias("made"), F.array().cast("array<struct<rid:int,name:string,partitions:int,error:int>>").alias("out"))

    def step(a, x):
        again = F.array_contains(a["made"], x["name"]) & ~x["code"].isin(S.INVALID_TOPIC)
        full = (F.lit(cap) > 0) & (a["used"] + x["partitions"] > cap)
        error = F.when(again, S.TOPIC_ALREADY_EXISTS).when(x["code"] != S.NONE, x["code"]).when(full, S.INVALID_PARTITIONS).otherwise(S.NONE)
        made = error == S.NONE
        row = F.struct(x["rid"].cast("int").alias("rid"), x["name"].alias("name"), x["partitions"].cast("int").alias("partitions"), error.alias("error"))
        return F.struct((a["used"] + F.when(made, x["partitions"]).otherwise(0)).cast("long").alias("used"), F.when(made, F.concat(a["made"], F.array(x["name"]))).otherwise(a["made"]).alias("made"), F.concat(a["out"], F.array(row)).alias("out"))

    return one.select(F.inline(F.aggregate("rs", start, step, lambda a: a["out"])))


def delete_topics(catalog: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers to names: error 3 if unknown, the catalog without them)."""
    known = catalog.select("name", F.lit(True).alias("known"))
    answers = names.join(known, "name", "left").select("name", F.when(F.col("known"), S.NONE).otherwise(S.UNKNOWN_TOPIC_OR_PARTITION).alias("error"))
    return answers, catalog.join(names, "name", "left_anti")


def metadata(catalog: DataFrame, names: DataFrame | None = None, node: int = 0) -> DataFrame:
    """name, error, partitions as structs led by the one node; all topics if names is None; error 3 for unknown ones."""
    t = catalog if names is None else names.join(catalog, "name", "left")
    n = F.lit(node)
    part = lambda i: F.struct(i.alias("id"), n.alias("leader"), F.array(n).alias("replicas"), F.array(n).alias("isr"))
    parts = F.when(F.col("partitions").isNull(), F.array().cast(S.T.ArrayType(S.PARTITION))).otherwise(F.transform(F.sequence(F.lit(0), F.col("partitions") - 1), part))
    return t.select("name", F.when(F.col("partitions").isNull(), S.UNKNOWN_TOPIC_OR_PARTITION).otherwise(S.NONE).alias("error"), parts.alias("parts"))


def missing_partitions(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """Partitions of the catalog without storage (topic, part)."""
    return catalog_partitions(catalog).join(stored, ["topic", "part"], "left_anti")


def budget(catalog: DataFrame, without: str | None = None) -> DataFrame:
    return catalog.agg(F.coalesce(F.sum(F.when(F.col("name").eqNullSafe(without), 0).otherwise(F.col("partitions"))), F.lit(0)).cast("long").alias("partitions"))


def duplicates(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
