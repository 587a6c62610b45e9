"""Queries over files, frames and bytes: what is written is read back, what is encoded is decoded. Also the states and
errors of groups and versions. Inputs derive from the same events as in driftlog.queries."""

from __future__ import annotations

import struct
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions import codec
from driftlog.functions import requests as R
from driftlog.functions import schemas as S
from driftlog.operators import commits, groups, metrics, offsets, produce, segments
from driftlog.plans import view
from driftlog.queries import EVERY, HOURS6, INDEX, PROBES, SQL, batches, beats, log, members, now, query, segmented, topics, values, wire
from driftlog.sources import files
from driftlog.sources import segments as source


def folder(spark: SparkSession) -> str:
    """A fresh path in the folder that the session names, or, where it names none, as in local runs, of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/') if base else tempfile.mkdtemp(prefix='driftlog-')}/wire-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")


# Segment files


@query(INDEX + " SELECT topic, part, segment_base, base, span, position, (SELECT any_value(bytes) FROM bs WHERE bs.topic = ix.topic AND bs.part = ix.part AND bs.base = ix.base) AS n_bytes FROM (SELECT ix.*, bs.span FROM ix JOIN bs ON bs.topic = ix.topic AND bs.part = ix.part AND bs.base = ix.base) ix")
def segment_round_trip(spark, d):
    """All batches appended as blobs to segment files, and the files read back."""
    source.register(spark)
    s = segmented(spark, d).select("topic", "part", "segment_base", "base", F.col("span").cast("int").alias("span"), F.unhex(F.repeat(F.lit("61"), F.col("bytes").cast("int"))).alias("payload"))
    path = folder(spark)
    s.repartition("topic", "part", "segment_base").sortWithinPartitions("topic", "part", "segment_base", "base").write.format("driftlog").mode("append").save(path)
    back = spark.read.format("driftlog").load(path)
    return back.select("topic", "part", "segment_base", "base", F.col("span").cast("long").alias("span"), "position", F.octet_length("payload").cast("long").alias("n_bytes"))


@query(" SELECT topic, part, segment_base, blobs, offsets, bytes FROM sg")
def segments_discovered(spark, d):
    """Files found by their names, with what they hold."""
    source.register(spark)
    s = segmented(spark, d).select("topic", "part", "segment_base", "base", F.col("span").cast("int").alias("span"), F.unhex(F.repeat(F.lit("61"), F.col("bytes").cast("int"))).alias("payload"))
    path = folder(spark)
    s.repartition("topic", "part", "segment_base").sortWithinPartitions("topic", "part", "segment_base", "base").write.format("driftlog").mode("append").save(path)
    back = spark.read.format("driftlog").load(path).groupBy("topic", "part", "segment_base")
    return back.agg(F.count("*").alias("blobs"), F.sum("span").alias("offsets"), F.sum(F.octet_length("payload").cast("long") + S.BLOB_HEADER).alias("bytes"))


@query(INDEX + f""" SELECT v.topic, v.part, CAST(v.off AS BIGINT) AS off, e.segment_base, e.rel, e.position FROM {values(PROBES, 'topic, part, off')} LEFT JOIN
 (SELECT *, coalesce(lead(base) OVER (PARTITION BY topic, part ORDER BY base), 1000000000000) AS until FROM ix WHERE n % 10 = 0) e ON e.topic = v.topic AND e.part = v.part AND e.base <= v.off AND v.off < until""")
def offset_index_lookup(spark, d):
    return offsets.index_lookup(segments.sparse_index(segmented(spark, d), EVERY), spark.createDataFrame(PROBES, "topic string, part int, off long"))


@query(""" SELECT topic, part, max(base + span) AS next_off, max(segment_base) AS segment_base, arg_max(n, segment_base) AS blobs, arg_max(n, segment_base) % 10 AS since_index
 FROM (SELECT *, count(*) OVER (PARTITION BY topic, part, segment_base) AS n FROM bs) GROUP BY topic, part""")
def reopened_partitions(spark, d):
    return offsets.reopened(segmented(spark, d), EVERY)


# Bytes


@query(""" , g AS (SELECT *, sum(span) OVER (PARTITION BY topic, part ORDER BY seq) - span AS spot FROM b WHERE topic <> 'error' AND seq % 13 <> 0)
 SELECT topic, part, CAST(spot AS BIGINT) AS base_offset, CAST(49 + span AS BIGINT) AS batch_length, 0 AS leader_epoch, 2 AS magic, 0 AS attributes, span - 1 AS last_offset_delta, 1000 + seq % 7 AS first_ts,
 1000 + seq % 7 AS max_ts, -1 AS producer_id, -1 AS producer_epoch, -1 AS base_sequence, span AS record_count, true AS crc_holds FROM g""")
def rewritten_batches(spark, d):
    """The batches that producing writes: all fields of their headers, and whether their CRC holds."""
    empty = spark.createDataFrame([], "topic string, part int, latest long")
    out = produce.produce(wire(spark, d), topics(spark, d).where("name <> 'error'"), empty, 5)[1]
    named = [c for c in codec.header_fields(F.col("payload"))]
    fields = out.select("topic", "part", *named, codec.crc_valid(F.col("payload")).alias("crc_holds")).drop("crc")
    small = {"leader_epoch": "int", "magic": "int", "attributes": "int", "producer_id": "int", "producer_epoch": "int", "base_sequence": "int"}
    return fields.withColumns({k: F.col(k).cast(v) for k, v in small.items()})


@query(" SELECT seq, grp, topic, part, off, metadata FROM c")
def commit_records(spark, d):
    """Every commit encoded as a record and decoded from the log's blobs."""

    @F.pandas_udf("binary")
    def encode(g: pd.Series, t: pd.Series, p: pd.Series, o: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([codec.encode_commit(*x) for x in zip(g, t, p, o, m)])

    c = view.commit_view(spark, d)
    return files.decode_commit_blobs(c.select(F.col("seq").alias("base"), encode("grp", "topic", "part", "off", "metadata").alias("payload")))


@query(" SELECT name, CAST(partitions AS INTEGER) AS partitions FROM cat")
def catalog_file(spark, d):
    """The catalog saved to its file and loaded again."""
    path = folder(spark) + ".json"
    files.save_catalog(topics(spark, d), path)
    return files.load_catalog(spark, path)


def fetch_frame(rid: int, topic: str, part: int, off: int, most: int) -> bytes:
    """A fetch request of one partition, with its length in front."""
    text = lambda s: struct.pack(">h", len(s.encode())) + s.encode()
    body = struct.pack(">hhi", 1, 0, rid) + text(f"c{rid % 3}") + struct.pack(">iii", -1, 500, 1) + struct.pack(">i", 1) + text(topic) + struct.pack(">iiqi", 1, part, off, most)
    return struct.pack(">I", len(body)) + body


def fetch_streams(spark: SparkSession, d: str) -> DataFrame:
    """(stream, data): fetch requests for every record's offset, up to 100 frames a stream, the last one's end missing."""
    r = log(spark, d).select("seq", "topic", "part", "off", "len", (F.col("seq") / 100).cast("long").alias("stream"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = b"".join(fetch_frame(*x) for x in pdf.sort_values("seq")[["seq", "topic", "part", "off", "len"]].itertuples(index=False, name=None))
        return pd.DataFrame([(int(pdf["stream"].iloc[0]), whole + struct.pack(">I", 40) + b"torn")], columns=["stream", "data"])

    return r.groupBy("stream").applyInPandas(build, "stream long, data binary")


@query(" SELECT seq // 100 AS stream, count(*) AS frames, CAST(8 AS BIGINT) AS left_over FROM l GROUP BY seq // 100")
def frames_of_streams(spark, d):
    """Complete frames of each stream, and the bytes of the one that is not complete."""

    def run(parts):
        for pdf in parts:
            found = [(s, *(len(x) for x in R.frames(bytes(b)))) for s, b in zip(pdf["stream"], pdf["data"])]
            yield pd.DataFrame(found, columns=["stream", "frames", "left_over"])

    return fetch_streams(spark, d).mapInPandas(run, "stream long, frames long, left_over long")


@query(" SELECT 'Fetch' AS api, 0 AS version, CAST(seq AS BIGINT) AS correlation, 'c' || (seq % 3) AS client_id, topic, part, off, len AS max_bytes FROM l")
def request_bodies(spark, d):
    """Header and body of every request of the streams."""

    def run(parts):
        for pdf in parts:
            rows = []
            for b in pdf["data"]:
                for frame in R.frames(bytes(b))[0]:
                    q = R.decode_request(frame)
                    for t in q["body"]["topics"]:
                        rows += [(q["api"], q["version"], q["correlation"], q["client_id"], t["topic"], p["part"], p["off"], p["max_bytes"]) for p in t["partitions"]]
            yield pd.DataFrame(rows, columns=["api", "version", "correlation", "client_id", "topic", "part", "off", "max_bytes"])

    return fetch_streams(spark, d).mapInPandas(run, "api string, version int, correlation long, client_id string, topic string, part int, off long, max_bytes long")


VERSIONS = [(1, 0), (2, 1), (3, 3), (4, 0)]


@query()
def version_answers(spark, d):
    return S.version_answers(spark.createDataFrame(VERSIONS, "rid int, version int"))


SQL["version_answers"] = f"SELECT CAST(rid AS INTEGER) AS rid, CAST(version AS INTEGER) AS version, CASE WHEN version > 0 THEN {S.UNSUPPORTED_VERSION} ELSE 0 END AS error, {len(S.APIS)} AS apis FROM " + values(VERSIONS, "rid, version")


# Metrics


@query(" SELECT api, CAST(sum(CAST(round(ms * 1000000) AS DECIMAL(38, 0))) AS DOUBLE) / CAST(1000000000 AS DOUBLE) AS sum_s, count(*) AS n FROM q GROUP BY api")
def latency_totals(spark, d):
    return metrics.histogram_totals(view.requests(spark, d), ["api"])


@query(r""" SELECT 'g{label="' || replace(replace(replace(topic || '\' || part || '"' || chr(10), '\', '\\'), '"', '\"'), chr(10), '\n') || '"} 1' AS raw FROM (SELECT DISTINCT topic, part FROM l0)""")
def label_escapes(spark, d):
    p = view.records(view.load(spark, d, "events")).select("topic", "part").distinct()
    label = F.concat("topic", F.lit("\\"), F.col("part").cast("string"), F.lit('"'), F.lit("\n"))
    return metrics.exposition(p.select(label.alias("label"), F.lit(1).alias("one")), "g", ["label"], "one").withColumnRenamed("value", "raw")


# Groups


def sync_requests(spark: SparkSession, d: str) -> DataFrame:
    """Each member asks once, but the leader of g3; other leaders send assignments for the members with an even key."""
    m, k = members(spark, d), F.col("key")
    lead = groups.leaders(m).select("grp", F.col("leader").alias("member"))
    told = m.where(k % 2 == 0).groupBy("grp").agg(F.collect_list(F.struct("member", F.concat(F.lit("p"), k).alias("assignment"))).alias("assignments"))
    sent = lead.where("grp <> 'g3'").join(told, "grp", "left").select(F.lit(0).cast("long").alias("rid"), "grp", "member", F.lit(1).alias("generation"), "assignments")
    name = F.when(k % 11 == 10, F.concat(F.lit("x-"), "member")).otherwise(F.col("member"))
    nothing = F.lit(None).cast("array<struct<member:string,assignment:string>>")
    rest = m.join(lead, ["grp", "member"], "left_anti").select(F.col("joined").alias("rid"), "grp", name.alias("member"), F.when(k % 9 == 8, 2).otherwise(1).alias("generation"), nothing.alias("assignments"))
    return rest.unionByName(sent)


@query(""" , h AS (SELECT joined AS rid, m.grp, CASE WHEN key % 11 = 10 THEN 'x-' || member ELSE member END AS member, CASE WHEN key % 9 = 8 THEN 2 ELSE 1 END AS generation
 FROM m JOIN lead_ ON m.grp = lead_.grp AND m.member <> leader UNION ALL SELECT 0, grp, leader, 1 FROM lead_ WHERE grp <> 'g3'),
 e AS (SELECT h.*, CASE WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.grp = h.grp AND m.member = h.member) THEN 25 WHEN generation <> 1 THEN 22 WHEN grp = 'g3' THEN 27 ELSE 0 END AS error FROM h)
 SELECT rid, grp, member, error, CASE WHEN error = 0 THEN coalesce((SELECT 'p' || m.key FROM m WHERE m.grp = e.grp AND m.member = e.member AND m.key % 2 = 0), '') END AS assignment FROM e""")
def sync_results(spark, d):
    """Answers to syncing, with the errors of unknown members, wrong generations and a leader that never asks."""
    m = members(spark, d)
    return groups.sync_results(sync_requests(spark, d), m, groups.leaders(m).select("grp", F.lit(1).alias("generation"), "leader"))


@query(""" SELECT joined + turn AS rid, grp, member, CASE WHEN turn = 0 AND key % 10 <> 5 THEN 0 ELSE 25 END AS error
 FROM (SELECT joined, key, grp, CASE WHEN key % 10 = 5 THEN 'x-' || member ELSE member END AS member, unnest([0, 1000000000]) AS turn FROM m WHERE key % 5 = 0)""")
def leave_results(spark, d):
    """Members that leave twice, and strangers."""
    k = F.col("key")
    r = members(spark, d).where(k % 5 == 0).select("joined", "grp", F.when(k % 10 == 5, F.concat(F.lit("x-"), "member")).otherwise(F.col("member")).alias("member"), F.explode(F.array(F.lit(0), F.lit(1_000_000_000))).alias("turn"))
    return groups.leave_results(r.select((F.col("joined") + F.col("turn")).alias("rid"), "grp", "member"), members(spark, d))


STATES = "CASE WHEN grp = 'g1' THEN 'CompletingRebalance' ELSE 'Stable' END"


def states(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).select("grp").distinct().select("grp", F.expr(STATES).alias("state"))


REAP = f""" , s AS (SELECT grp, member, max(ts_ms) AS last, (SELECT max(ts_ms) FROM beat) - max(ts_ms) > {HOURS6} AS old, {STATES} AS state FROM beat GROUP BY grp, member)"""


@query(REAP + " SELECT grp, CASE WHEN bool_or(old AND state = 'Stable') THEN 'Empty' ELSE any_value(state) END AS state FROM s GROUP BY grp")
def groups_after_expiry(spark, d):
    b = beats(spark, d)
    return groups.reap(b, states(spark, d), now(b), HOURS6)[1]


@query(REAP + " SELECT grp, member, last FROM s WHERE NOT (old AND state = 'Stable')")
def members_after_expiry(spark, d):
    b = beats(spark, d)
    return groups.reap(b, states(spark, d), now(b), HOURS6)[0]


@query(" SELECT m.grp, CASE WHEN bool_or(key % 10 = 0) THEN 'Empty' ELSE 'Stable' END AS state FROM m GROUP BY m.grp")
def groups_after_leaving(spark, d):
    m = members(spark, d)
    emptied = groups.leave(m, m.where("key % 10 = 0").select("grp", "member"))[1].withColumnRenamed("state", "now")
    return m.select("grp").distinct().join(emptied, "grp", "left").select("grp", F.coalesce("now", F.lit("Stable")).alias("state"))


@query(" SELECT m.grp, leader, m.member, protocol FROM m JOIN lead_ ON m.grp = lead_.grp JOIN pick ON pick.grp = m.grp WHERE protocol IS NOT NULL")
def members_for_leader(spark, d):
    return groups.joined_members(members(spark, d))


WIDE = [(1, "g0", "click", 0), (2, "g1", "", 0), (3, "g9", "", 0), (4, "g2", "nowhere", 0)]


@query(f""" , w AS (SELECT rid, grp, nullif(topic, '') AS topic, part FROM {values(WIDE, 'rid, grp, topic, part')})
 SELECT rid, w.grp, w.topic, w.part, CAST(coalesce(last.off, -1) AS BIGINT) AS off, metadata, 0 AS error FROM w LEFT JOIN last ON last.grp = w.grp AND last.topic = w.topic AND last.part = w.part WHERE w.topic IS NOT NULL
 UNION ALL SELECT rid, last.grp, last.topic, last.part, last.off, metadata, 0 FROM w JOIN last ON last.grp = w.grp WHERE w.topic IS NULL""")
def offset_fetch_wide(spark, d):
    r = spark.createDataFrame(WIDE, "rid int, grp string, topic string, part int").withColumn("topic", F.when(F.col("topic") != "", F.col("topic")))
    return commits.offset_fetch_wide(commits.latest(view.commit_view(spark, d)), r)
