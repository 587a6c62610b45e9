"""Consumer groups. Members have grp, member, joined (order of joining), protocols array<string>."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftlog.functions import schemas as S
from driftlog.plans.fold import greedy, rounds


def leaders(members: DataFrame) -> DataFrame:
    """The first joiner leads."""
    return members.groupBy("grp").agg(F.min_by("member", "joined").alias("leader"), F.count("*").alias("members"))


def select_protocol(members: DataFrame) -> DataFrame:
    """The protocol that all members know and that comes first in the first joiner's list; none: null and error 23.

    A protocol that all know is one that as many distinct members name as there are: counted before anything is gathered.
    """
    n = members.groupBy("grp").agg(F.countDistinct("member").alias("n"), F.min_by("protocols", "joined").alias("first"))
    named = members.select("grp", "member", F.explode("protocols").alias("protocol")).distinct().groupBy("grp", "protocol").agg(F.count("*").alias("k"))
    common = n.join(named, "grp").where("k = n").groupBy("grp").agg(F.min_by("protocol", F.array_position("first", F.col("protocol"))).alias("protocol"))
    out = n.join(common, "grp", "left")
    return out.select("grp", "protocol", F.when(F.col("protocol").isNull(), S.INCONSISTENT_GROUP_PROTOCOL).otherwise(S.NONE).alias("error"))


def join_results(members: DataFrame, generation: int = 1) -> DataFrame:
    """One answer per member: generation, protocol, leader, and, for the leader alone, the number of members it sees."""
    r = members.join(leaders(members), "grp").join(select_protocol(members), "grp")
    good = F.col("error") == S.NONE
    seen = F.when(good & (F.col("member") == F.col("leader")), F.col("members")).otherwise(0)
    return r.select("grp", "member", "error", F.when(good, generation).otherwise(-1).alias("generation"), F.when(good, F.col("protocol")).alias("protocol"), F.when(good, F.col("leader")).alias("leader"), seen.cast("long").alias("sees"))


def sync(members: DataFrame, sent: DataFrame) -> DataFrame:
    """Each member's part of what its leader sent (grp, assignments array<struct<member, assignment>>), '' if none."""
    a = sent.select("grp", F.inline("assignments"))
    return members.select("grp", "member").join(a, ["grp", "member"], "left").select("grp", "member", F.coalesce("assignment", F.lit("")).alias("assignment"))


def heartbeat(requests: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """requests (rid, grp, member, generation) against groups (grp, generation, state): unknown member 25, then wrong
    generation 22, then not stable 27, else 0."""
    r = requests.join(members.select("grp", "member", F.lit(True).alias("known")), ["grp", "member"], "left")
    r = r.join(groups.select("grp", F.col("generation").alias("now"), "state"), "grp", "left")
    error = F.when(F.col("known").isNull(), S.UNKNOWN_MEMBER_ID).when(F.col("generation") != F.col("now"), S.ILLEGAL_GENERATION).when(F.col("state") != "Stable", S.REBALANCE_IN_PROGRESS).otherwise(S.NONE)
    return r.select("rid", "grp", "member", error.alias("error"))


def sync_results(requests: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """requests (rid, grp, member, generation, assignments array<struct<member, assignment>>, the leader's counts) against
    groups (grp, generation, leader): unknown member 25, then wrong generation 22; a member whose leader sends nothing
    valid waits in vain, 27; else its assignment, '' if the leader has none for it."""
    r = requests.join(members.select("grp", "member", F.lit(True).alias("known")), ["grp", "member"], "left")
    r = r.join(groups.select("grp", F.col("generation").alias("now"), "leader"), "grp", "left")
    r = r.withColumn("early", F.when(F.col("known").isNull(), S.UNKNOWN_MEMBER_ID).when(F.col("generation") != F.col("now"), S.ILLEGAL_GENERATION))
    lead = r.where("early is null and member = leader").groupBy("grp").agg(F.min_by("assignments", "rid").alias("sent"))
    given = lead.select("grp", F.inline("sent")).groupBy("grp", "member").agg(F.first("assignment").alias("assignment"))
    r = r.drop("assignments").join(lead.select("grp", F.lit(True).alias("synced")), "grp", "left").join(given, ["grp", "member"], "left")
    error = F.coalesce("early", F.when(F.col("synced").isNull(), S.REBALANCE_IN_PROGRESS), F.lit(S.NONE))
    return r.select("rid", "grp", "member", error.alias("error"), F.when(error == S.NONE, F.coalesce("assignment", F.lit(""))).alias("assignment"))


def leave(members: DataFrame, leavers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members that stay, groups that a known leaver empties: their members must join again, the generation stays)."""
    gone = members.join(leavers, ["grp", "member"], "left_semi")
    return members.join(leavers, ["grp", "member"], "left_anti"), gone.select("grp", F.lit("Empty").alias("state")).distinct()


def leave_results(requests: DataFrame, members: DataFrame) -> DataFrame:
    """requests (rid, grp, member) in order of rid: 25 for a member that is unknown or has left before."""
    first = W.partitionBy("grp", "member").orderBy("rid")
    r = requests.join(members.select("grp", "member", F.lit(True).alias("known")), ["grp", "member"], "left").withColumn("turn", F.row_number().over(first))
    good = F.col("known").isNotNull() & (F.col("turn") == 1)
    return r.select("rid", "grp", "member", F.when(good, S.NONE).otherwise(S.UNKNOWN_MEMBER_ID).alias("error"))


def joined_members(members: DataFrame) -> DataFrame:
    """What a group's leader is told: one row per member of its group, with the bytes of the picked protocol's metadata
    (here the protocol's name). Groups without a common protocol tell nothing. Nothing is gathered into one row."""
    r = members.join(leaders(members).select("grp", "leader"), "grp").join(select_protocol(members).where(F.col("error") == S.NONE), "grp")
    return r.select("grp", "leader", "member", "protocol")


def expired(beats: DataFrame, now: int, timeout_ms: int) -> DataFrame:
    """Members whose last of beats (grp, member, ts_ms) is more than timeout_ms ago."""
    last = beats.groupBy("grp", "member").agg(F.max("ts_ms").alias("last"))
    return last.where(F.lit(now) - F.col("last") > timeout_ms)


def reap(beats: DataFrame, groups: DataFrame, now: int, timeout_ms: int) -> tuple[DataFrame, DataFrame]:
    """(members that stay, groups (grp, state) afterwards): only Stable groups lose expired members, and one that does is
    Empty, so that those left join again."""
    last = beats.groupBy("grp", "member").agg(F.max("ts_ms").alias("last")).join(groups, "grp")
    late = (F.col("state") == "Stable") & (F.lit(now) - F.col("last") > timeout_ms)
    emptied = last.where(late).select("grp", F.lit("Empty").alias("now")).distinct()
    after = groups.join(emptied, "grp", "left").select("grp", F.coalesce("now", "state").alias("state"))
    return last.where(~late).select("grp", "member", "last"), after


def sessions(beats: DataFrame, timeout_ms: int) -> DataFrame:
    """Runs of a member's beats without a gap of more than timeout_ms: number, first, last, beats."""
    w = W.partitionBy("grp", "member").orderBy("ts_ms", "seq")
    fresh = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) > timeout_ms, F.lit(False)).cast("int")
    s = beats.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w))
    return s.groupBy("grp", "member", "session").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.count("*").alias("beats"))


def rebalance_rounds(joins: DataFrame, delay_ms: int = S.JOIN_DELAY_MS) -> DataFrame:
    """Rounds of joins (grp, member, ts_ms, seq): a round opens with a join and takes all of the next delay_ms. Each
    raises the generation and is led by its first joiner; a member that joins twice in a round counts once."""
    g = greedy(joins.select("grp", "member", "ts_ms", "seq"), ["grp"], ["ts_ms", "seq"], "ts_ms", "seq", "opened", rounds(delay_ms))
    r = g.groupBy("grp", "opened").agg(F.count("*").alias("joins"), F.countDistinct("member").alias("members"), F.min_by("member", "seq").alias("leader"))
    return r.withColumn("generation", F.row_number().over(W.partitionBy("grp").orderBy("opened")).cast("long"))


def member_ids(joins: DataFrame) -> DataFrame:
    """Ids `member-<n>` in order of arrival, over all groups."""
    from driftlog.plans.prefix import running_sum

    n = running_sum(joins.withColumn("_all", F.lit(0)), ["_all"], "seq", F.lit(1), "_n").drop("_all")
    return n.withColumn("member_id", F.concat(F.lit("member-"), F.col("_n") + 1)).drop("_n")


def find_coordinator(keys: DataFrame, node: int = 0, host: str = "localhost", port: int = 9092) -> DataFrame:
    """The one broker coordinates every group."""
    return keys.select("grp", F.lit(S.NONE).alias("error"), F.lit(node).alias("node_id"), F.lit(host).alias("host"), F.lit(port).alias("port"))
