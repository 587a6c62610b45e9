"""One query per log operator over the driver's tables, and the same in ANSI SQL.

Topics are event types, partitions user_id % 3, records ordered by event_id; batches hold 5 offsets; segments roll at
2,000 bytes, so that small tables have many; commits, members and requests derive from the same events.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions import codec
from driftlog.functions import schemas as S
from driftlog.operators import catalog, commits, groups, metrics, offsets, produce, scan, segments
from driftlog.plans import view

ROLL, EVERY, HOURS6, ROUND_MS = 2000, 10, 6 * 3600 * 1000, 3 * 3600 * 1000
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = "WITH RECURSIVE " + PRELUDE + sql if "FROM" in sql else sql
        return f

    return add


# (name, partitions) of the catalog besides the event types, which have 3 partitions each; ghost has no storage.
EXTRA = [("ghost", 2)]
READS = [(1, "click", 0, 0, 400), (2, "click", 1, 7, 1000), (3, "view", 2, 33, 100), (4, "view", 0, 20, 50), (5, "error", 1, 100000000, 500), (6, "nowhere", 0, 0, 500), (7, "signup", 2, -1, 500), (8, "purchase", 0, 12, 1000000)]
PROBES = [("click", 0, 0), ("click", 1, 4), ("click", 2, 5), ("view", 0, 23), ("error", 1, 57), ("nowhere", 0, 1), ("signup", 0, 100000000)]
LISTS = [(1, "click", 0, -1), (2, "click", 0, -2), (3, "view", 1, 0), (4, "nowhere", 0, -1), (5, "signup", 9, -2), (6, "error", 2, -1)]
NAMES = ["orders", "a.b_c-D", ".", "..", "", "a" * 249, "a" * 250, "sp ace", "orders\n", "é", "x/y", "__internal", "0", "-", "a..b"]
CREATES = [(1, "orders", 3), (2, "click", 1), (3, "bad name", 1), (4, "zero", 0), (5, "many", 1001), (6, "big", 40), (7, "orders", 2), (8, "fits", 5), (9, "__internal", 1), (10, "last", 1), (11, "more", 1)]
CAP = 30


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names})"


PRELUDE = """
l0 AS (SELECT event_id AS seq, event_type AS topic, CAST(user_id % 3 AS INTEGER) AS part, epoch_us(ts) // 1000 AS ts_ms, user_id AS key,
       props AS payload, CAST(octet_length(encode(props)) AS BIGINT) AS len, value FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY seq) - 1 AS off FROM l0),
b AS (SELECT topic, part, min(off) AS base, count(*) AS span, CAST(61 + sum(len) AS BIGINT) AS bytes, max(ts_ms) AS ts_ms, min(seq) AS seq
      FROM l GROUP BY topic, part, off // 5),
o AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY base) AS rn FROM b),
r(topic, part, rn, base, seg, act) AS (
  SELECT topic, part, rn, base, base, bytes + 8 FROM o WHERE rn = 1 UNION ALL
  SELECT o.topic, o.part, o.rn, o.base, CASE WHEN r.act >= 2000 THEN o.base ELSE r.seg END, CASE WHEN r.act >= 2000 THEN 0 ELSE r.act END + o.bytes + 8
  FROM r JOIN o ON o.topic = r.topic AND o.part = r.part AND o.rn = r.rn + 1),
bs AS (SELECT o.*, r.seg AS segment_base FROM o JOIN r ON o.topic = r.topic AND o.part = r.part AND o.rn = r.rn),
sg AS (SELECT topic, part, segment_base, count(*) AS blobs, CAST(sum(span) AS BIGINT) AS offsets, CAST(sum(bytes + 8) AS BIGINT) AS bytes, max(ts_ms) AS mtime
       FROM bs GROUP BY topic, part, segment_base),
ends AS (SELECT topic, part, min(base) AS earliest, max(base + span) AS latest FROM b GROUP BY topic, part),
c AS (SELECT seq, 'g' || (key % 4) AS grp, topic, part, off + 1 AS off, 'm' || (seq % 5) AS metadata FROM l WHERE seq % 7 = 0),
last AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY grp, topic, part ORDER BY seq DESC) = 1),
cat AS (SELECT DISTINCT topic AS name, 3 AS partitions FROM l0 UNION ALL SELECT 'ghost', 2),
catp AS (SELECT name AS topic, CAST(p AS INTEGER) AS part FROM cat, unnest(range(partitions)) AS u(p)),
m AS (SELECT 'g' || (key % 4) AS grp, 'member-' || key AS member, key, min(seq) AS joined FROM l0 GROUP BY key),
pr AS (SELECT grp, member, joined, unnest(CASE WHEN key % 8 = 3 THEN ['roundrobin'] WHEN key % 8 = 7 THEN ['range'] WHEN key % 3 = 0 THEN ['range']
       WHEN key % 3 = 1 THEN ['range', 'roundrobin'] ELSE ['roundrobin', 'range'] END) AS protocol,
       unnest(CASE WHEN key % 8 IN (3, 7) OR key % 3 = 0 THEN [1] ELSE [1, 2] END) AS place FROM m),
lead_ AS (SELECT grp, arg_min(member, joined) AS leader, count(*) AS members FROM m GROUP BY grp),
pick AS (SELECT lead_.grp, (SELECT p.protocol FROM pr p WHERE p.grp = lead_.grp AND p.member = lead_.leader
         AND (SELECT count(DISTINCT member) FROM pr q WHERE q.grp = p.grp AND q.protocol = p.protocol) = lead_.members ORDER BY place LIMIT 1) AS protocol FROM lead_),
beat AS (SELECT 'g' || (key % 4) AS grp, 'member-' || key AS member, ts_ms, seq FROM l0),
q AS (SELECT seq, ts_ms, topic AS api, CASE WHEN topic = 'error' THEN 'error' ELSE 'ok' END AS result, value AS ms, len AS bytes_in,
      CASE WHEN topic = 'error' THEN 0 ELSE len * 2 END AS bytes_out FROM l0)
"""


def log(spark: SparkSession, d: str) -> DataFrame:
    return view.log_view(spark, d)


def batches(spark: SparkSession, d: str) -> DataFrame:
    return view.batch_view(spark, d)


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return segments.assign_segments(batches(spark, d), ROLL)


def topics(spark: SparkSession, d: str) -> DataFrame:
    names = view.load(spark, d, "events").select(F.col("event_type").alias("name")).distinct().withColumn("partitions", F.lit(3))
    return names.unionByName(spark.createDataFrame(EXTRA, "name string, partitions int"))


def members(spark: SparkSession, d: str) -> DataFrame:
    r = view.records(view.load(spark, d, "events"))
    k = F.col("key")
    lists = F.when(k % 8 == 3, F.array(F.lit("roundrobin"))).when((k % 8 == 7) | (k % 3 == 0), F.array(F.lit("range"))).when(k % 3 == 1, F.array(F.lit("range"), F.lit("roundrobin"))).otherwise(F.array(F.lit("roundrobin"), F.lit("range")))
    m = r.groupBy("key").agg(F.min("seq").alias("joined"))
    return m.select(F.concat(F.lit("g"), k % 4).alias("grp"), F.concat(F.lit("member-"), k).alias("member"), "key", "joined", lists.alias("protocols"))


def beats(spark: SparkSession, d: str) -> DataFrame:
    r = view.records(view.load(spark, d, "events"))
    return r.select(F.concat(F.lit("g"), F.col("key") % 4).alias("grp"), F.concat(F.lit("member-"), F.col("key")).alias("member"), "ts_ms", "seq", "topic")


def now(df: DataFrame) -> int:
    return df.agg(F.max("ts_ms")).first()[0] or 0


# Append, offsets, sizes


@query(" SELECT seq, topic, part, off FROM l")
def assign_offsets(spark, d):
    return log(spark, d).select("seq", "topic", "part", "off")


@query(" SELECT seq, topic, part, CAST(sum(s) OVER (PARTITION BY topic, part ORDER BY seq) - s AS BIGINT) AS off FROM (SELECT *, greatest(key % 4, 1) AS s FROM l0)")
def assign_offsets_spans(spark, d):
    r = view.records(view.load(spark, d, "events"))
    return view.assign_offsets(r, "seq", F.col("key") % 4).select("seq", "topic", "part", "off")


@query(" SELECT * FROM ends")
def earliest_latest(spark, d):
    return offsets.earliest_latest(batches(spark, d))


@query(" SELECT topic, CAST(sum(latest) AS BIGINT) AS total FROM ends GROUP BY topic")
def end_offset_total(spark, d):
    return offsets.end_offset_total(batches(spark, d))


@query(" SELECT topic, part, CAST(sum(bytes + 8) AS BIGINT) AS bytes FROM b GROUP BY topic, part")
def partition_size(spark, d):
    return offsets.partition_size(batches(spark, d))


@query(f""" SELECT rid, v.topic, v.part, CASE WHEN latest IS NULL THEN 3 WHEN ts NOT IN (-1, -2) THEN -1 ELSE 0 END AS error, CAST(-1 AS BIGINT) AS "timestamp",
 CAST(CASE WHEN latest IS NULL THEN -1 WHEN ts = -1 THEN latest WHEN ts = -2 THEN earliest ELSE -1 END AS BIGINT) AS off
 FROM {values(LISTS, 'rid, topic, part, ts')} LEFT JOIN ends ON ends.topic = v.topic AND ends.part = v.part""")
def list_offsets(spark, d):
    return offsets.list_offsets(batches(spark, d), spark.createDataFrame(LISTS, "rid int, topic string, part int, ts long"))


# Scans


@query(f""" , u AS (SELECT rid, b.*, sum(bytes) OVER (PARTITION BY rid ORDER BY base) AS upto, max_bytes FROM b
 JOIN {values(READS, 'rid, topic, part, start, max_bytes')} ON b.topic = v.topic AND b.part = v.part AND base + span > start)
 SELECT rid, topic, part, base, span, bytes FROM u WHERE upto <= max_bytes""")
def read_from_offset(spark, d):
    r = spark.createDataFrame(READS, "rid int, topic string, part int, start long, max_bytes long")
    return scan.read_from_offset(batches(spark, d), r).select("rid", "topic", "part", "base", "span", "bytes")


@query(f" SELECT v.topic, v.part, CAST(off AS BIGINT) AS off, base, span, base + span AS next_off FROM {values(PROBES, 'topic, part, off')} JOIN b ON b.topic = v.topic AND b.part = v.part AND base <= off AND off < base + span")
def batch_containing_offset(spark, d):
    return scan.batch_containing(batches(spark, d), spark.createDataFrame(PROBES, "topic string, part int, off long"))


@query(" SELECT l.seq, l.topic, l.part, l.off, b.base, b.span FROM l JOIN b ON l.topic = b.topic AND l.part = b.part AND b.base <= l.off AND l.off < b.base + b.span")
def range_join_offsets(spark, d):
    lg = log(spark, d)
    return scan.range_join(view.batches(lg), lg, 64).select("seq", "topic", "part", "off", "base", "span")


FETCH = f""" , u AS (SELECT rid, b.*, sum(bytes) OVER (PARTITION BY rid ORDER BY base) AS upto, max_bytes FROM b
 JOIN {values(READS, 'rid, topic, part, start, max_bytes')} ON b.topic = v.topic AND b.part = v.part AND base + span > start),
 got AS (SELECT rid, count(*) AS n, sum(bytes) AS nb, min(base) AS f FROM u WHERE upto <= max_bytes GROUP BY rid),
 e AS (SELECT v.*, earliest, latest, n, nb, f, CASE WHEN latest IS NULL THEN 3 WHEN start < earliest THEN 1 ELSE 0 END AS error
 FROM {values(READS, 'rid, topic, part, start, max_bytes')} LEFT JOIN ends ON ends.topic = v.topic AND ends.part = v.part LEFT JOIN got ON got.rid = v.rid)"""


@query(FETCH + """ SELECT rid, topic, part, CAST(start AS BIGINT) AS start, error, CAST(CASE WHEN error = 0 THEN latest ELSE 0 END AS BIGINT) AS watermark,
 CAST(CASE WHEN error = 0 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS batches, CAST(CASE WHEN error = 0 THEN coalesce(nb, 0) ELSE 0 END AS BIGINT) AS bytes,
 CASE WHEN error = 0 THEN f END AS first_base, error = 0 AND start >= latest AS past_end FROM e""")
def fetch_multi(spark, d):
    return scan.fetch(batches(spark, d), spark.createDataFrame(READS, "rid int, topic string, part int, start long, max_bytes long"))


@query(FETCH + " SELECT rid, error FROM e WHERE error = 1")
def fetch_out_of_range(spark, d):
    return fetch_multi(spark, d).where("error = 1").select("rid", "error")


@query(""" , f AS (SELECT topic, part, CAST(sum(bytes + 8) - 30 AS BIGINT) AS size FROM b GROUP BY topic, part),
 e AS (SELECT b.*, size, sum(bytes + 8) OVER (PARTITION BY b.topic, b.part ORDER BY base) AS fin FROM b JOIN f ON b.topic = f.topic AND b.part = f.part)
 SELECT topic, part, count(*) FILTER (fin <= size) AS blobs, CAST(coalesce(sum(span) FILTER (fin <= size), 0) AS BIGINT) AS offsets,
 CAST(coalesce(max(fin) FILTER (fin <= size), 0) AS BIGINT) AS valid_bytes FROM e GROUP BY topic, part""")
def torn_prefix(spark, d):
    b = batches(spark, d)
    files = offsets.partition_size(b).select("topic", "part", (F.col("bytes") - 30).alias("file_bytes"))
    return scan.torn_prefix(b, files)


# Segments, indexes, retention


@query(" SELECT topic, part, base, segment_base FROM bs")
def segment_assignment(spark, d):
    return segmented(spark, d).select("topic", "part", "base", "segment_base")


@query(" SELECT * FROM sg")
def segment_counts(spark, d):
    return segments.segment_counts(segmented(spark, d))


@query(f" SELECT v.topic, v.part, CAST(off AS BIGINT) AS off, max(segment_base) AS segment_base FROM {values(PROBES, 'topic, part, off')} LEFT JOIN sg ON sg.topic = v.topic AND sg.part = v.part AND segment_base <= off GROUP BY v.topic, v.part, off")
def segment_of_offset(spark, d):
    return segments.segment_of(segments.segment_counts(segmented(spark, d)).select("topic", "part", "segment_base"), spark.createDataFrame(PROBES, "topic string, part int, off long"))


INDEX = """ , ix AS (SELECT topic, part, segment_base, base, base - segment_base AS rel, ts_ms, row_number() OVER w - 1 AS n,
 CAST(sum(bytes + 8) OVER w - (bytes + 8) AS BIGINT) AS position FROM bs WINDOW w AS (PARTITION BY topic, part, segment_base ORDER BY base))"""


@query(INDEX + " SELECT topic, part, segment_base, base, rel, position, ts_ms FROM ix WHERE n % 10 = 0")
def sparse_index(spark, d):
    return segments.sparse_index(segmented(spark, d), EVERY)


@query(" SELECT topic, part, base FROM o WHERE rn % 9 = 0")
def flush_points(spark, d):
    return segments.flush_points(batches(spark, d), 9)


@query(INDEX + """ , p AS (SELECT topic, part, t, CAST(row_number() OVER (ORDER BY topic, part, t) AS BIGINT) AS pid FROM
 (SELECT topic, part, unnest([min(ts_ms) - 1, min(ts_ms) + 604800000, max(ts_ms) + 1]) AS t FROM b GROUP BY topic, part))
 SELECT p.topic, p.part, p.t, max(base) AS off FROM p LEFT JOIN ix ON ix.topic = p.topic AND ix.part = p.part AND ix.ts_ms <= p.t AND n % 10 = 0 GROUP BY p.topic, p.part, p.t""")
def offset_asof_timestamp(spark, d):
    s = segmented(spark, d)
    t = s.groupBy("topic", "part").agg(F.array(F.min("ts_ms") - 1, F.min("ts_ms") + 604800000, F.max("ts_ms") + 1).alias("ts"))
    probes = t.select("topic", "part", F.explode("ts").alias("t")).withColumn("pid", F.xxhash64("topic", "part", "t"))
    return offsets.as_of(segments.sparse_index(s, EVERY), probes).select("topic", "part", "t", "off")


KEEP = """ , k AS (SELECT *, CASE WHEN segment_base = max(segment_base) OVER (PARTITION BY topic, part) OR NOT (
 (SELECT max(ts_ms) FROM l0) - mtime > 1209600000 OR sum(bytes) OVER (PARTITION BY topic, part ORDER BY segment_base DESC) > 15000) THEN 1 ELSE 0 END AS keep FROM sg),
 kk AS (SELECT *, max(keep) OVER (PARTITION BY topic, part ORDER BY segment_base) AS kept FROM k)"""


def _kept(spark, d):
    s = segmented(spark, d)
    return segments.retention(segments.segment_counts(s), now(view.records(view.load(spark, d, "events"))), 14 * 24 * 3600 * 1000, 15000)


@query(KEEP + " SELECT topic, part, segment_base, blobs, offsets, bytes, mtime FROM kk WHERE kept = 1")
def retention_survivors(spark, d):
    return _kept(spark, d)


@query(KEEP + " SELECT topic, part, min(segment_base) AS earliest, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes FROM kk WHERE kept = 1 GROUP BY topic, part")
def retention_earliest(spark, d):
    return segments.earliest_after(_kept(spark, d))


# Commits


@query(" SELECT grp, topic, part, off, metadata FROM last")
def latest_commits(spark, d):
    return commits.latest(view.commit_view(spark, d)).select("grp", "topic", "part", "off", "metadata")


@query(" SELECT grp, topic, part, off, metadata, seq FROM last")
def replay_commits(spark, d):
    return commits.latest(view.commit_view(spark, d))


@query(" SELECT row_number() OVER (ORDER BY grp, topic, part) - 1 AS position, grp, topic, part, off, metadata FROM last")
def compacted_log(spark, d):
    return commits.compact(view.commit_view(spark, d))


@query(" SELECT DISTINCT grp FROM c")
def groups_distinct(spark, d):
    return commits.groups(view.commit_view(spark, d))


@query(" SELECT grp, topic, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) AS parts FROM last GROUP BY grp, topic")
def fetch_all_by_topic(spark, d):
    return commits.fetch_all(commits.latest(view.commit_view(spark, d))).withColumn("parts", F.array_join("parts", ","))


WANTED = [("g0", "click", 0), ("g1", "view", 2), ("g9", "click", 0), ("g2", "nowhere", 0), ("g3", "error", 7)]


@query(f" SELECT v.grp, v.topic, v.part, CAST(coalesce(last.off, -1) AS BIGINT) AS off, metadata, 0 AS error FROM {values(WANTED, 'grp, topic, part')} LEFT JOIN last ON last.grp = v.grp AND last.topic = v.topic AND last.part = v.part")
def offset_fetch(spark, d):
    return commits.offset_fetch(commits.latest(view.commit_view(spark, d)), spark.createDataFrame(WANTED, "grp string, topic string, part int"))


@query(" SELECT grp, topic, part, off, CASE WHEN seq % 5 = 0 THEN '' ELSE metadata END AS metadata FROM c")
def offset_commit_flatten(spark, d):
    c = view.commit_view(spark, d).withColumn("metadata", F.when(F.col("seq") % 5 != 0, F.col("metadata")))
    # requests of a bounded size: the commits of a thousand consecutive records
    c = c.withColumn("request", F.floor(F.col("seq") / 1000))
    by_topic = c.groupBy("request", "grp", "topic").agg(F.collect_list(F.struct("part", "off", "metadata")).alias("parts"))
    return commits.flatten(by_topic.groupBy("request", "grp").agg(F.collect_list(F.struct("topic", "parts")).alias("topics")))


@query(" SELECT grp, last.topic, last.part, last.off, latest, latest - last.off AS lag FROM last JOIN ends ON last.topic = ends.topic AND last.part = ends.part")
def consumer_lag(spark, d):
    lg = log(spark, d)
    return commits.lag(commits.latest(view.commits(lg)), view.batches(lg))


@query(" SELECT catp.topic, catp.part, CAST(sum(bytes + 8) AS BIGINT) AS bytes FROM catp JOIN b ON b.topic = catp.topic AND b.part = catp.part GROUP BY catp.topic, catp.part")
def partition_size_by_catalog(spark, d):
    return commits.size_by_catalog(topics(spark, d), batches(spark, d))


# Catalog


@query()
def topic_name_valid(spark, d):
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", codec.valid_name(F.col("name")).alias("valid"))


SQL["topic_name_valid"] = "SELECT name, regexp_full_match(name, '[A-Za-z0-9._-]{1,249}') AND name NOT IN ('.', '..') AS valid FROM " + values([(n,) for n in NAMES], "name")


@query(f""" , rq AS (SELECT *, CASE WHEN NOT regexp_full_match(v.name, '[A-Za-z0-9._-]{{1,249}}') OR v.name LIKE '\\_\\_%' ESCAPE '\\' THEN 17 WHEN cat.name IS NOT NULL THEN 36
 WHEN v.partitions NOT BETWEEN 1 AND 1000 THEN 37 ELSE 0 END AS code, v.name AS n, v.partitions AS p FROM {values(CREATES, 'rid, name, partitions')} LEFT JOIN cat ON cat.name = v.name),
 f(rid, name, partitions, error, used, made) AS (SELECT 0, '', 0, 0, (SELECT CAST(sum(partitions) AS BIGINT) FROM cat), '|' UNION ALL
 SELECT rq.rid, rq.n, rq.p, e, used + CASE WHEN e = 0 THEN rq.p ELSE 0 END, CASE WHEN e = 0 THEN made || rq.n || '|' ELSE made END
 FROM (SELECT f.used, f.made, f.rid AS last, rq.*, CASE WHEN code <> 17 AND contains(made, '|' || rq.n || '|') THEN 36 WHEN code <> 0 THEN code WHEN f.used + rq.p > {CAP} THEN 37 ELSE 0 END AS e
 FROM f JOIN rq ON rq.rid = f.rid + 1) rq)
 SELECT CAST(rid AS INTEGER) AS rid, name, CAST(partitions AS INTEGER) AS partitions, error FROM f WHERE rid > 0""")
def create_topics_validate(spark, d):
    return catalog.create_topics(topics(spark, d), spark.createDataFrame(CREATES, "rid int, name string, partitions int"), CAP)


ASKED = [("click",), ("ghost",), ("unknown",)]


@query(f""" SELECT v.name, CASE WHEN cat.name IS NULL THEN 3 ELSE 0 END AS error, CAST(coalesce(partitions, 0) AS INTEGER) AS n_parts
 FROM {values(ASKED, 'name')} LEFT JOIN cat ON cat.name = v.name""")
def metadata(spark, d):
    return catalog.metadata(topics(spark, d), spark.createDataFrame(ASKED, "name string")).select("name", "error", F.size("parts").alias("n_parts"))


@query(" SELECT CAST(sum(CASE WHEN name <> 'click' THEN partitions ELSE 0 END) AS BIGINT) AS partitions FROM cat")
def partition_budget(spark, d):
    return catalog.budget(topics(spark, d), "click")


@query(" SELECT topic, part FROM catp WHERE NOT EXISTS (SELECT 1 FROM ends WHERE ends.topic = catp.topic AND ends.part = catp.part)")
def missing_partitions(spark, d):
    stored = view.records(view.load(spark, d, "events")).select("topic", "part").distinct()
    return catalog.missing_partitions(topics(spark, d), stored)


@query(f" SELECT v.name, CASE WHEN cat.name IS NULL THEN 3 ELSE 0 END AS error FROM {values(ASKED, 'name')} LEFT JOIN cat ON cat.name = v.name")
def delete_topics(spark, d):
    return catalog.delete_topics(topics(spark, d), spark.createDataFrame(ASKED, "name string"))[0]


@query(" SELECT name, CAST(partitions AS INTEGER) AS partitions FROM cat ORDER BY name")
def catalog_sorted(spark, d):
    return topics(spark, d).orderBy("name")


@query(f" SELECT name, count(*) AS n FROM (SELECT name FROM cat UNION ALL SELECT name FROM {values(ASKED, 'name')}) GROUP BY name HAVING count(*) > 1")
def catalog_duplicates(spark, d):
    return catalog.duplicates(topics(spark, d).select("name").unionByName(spark.createDataFrame(ASKED, "name string")))


# Groups


@query(" SELECT * FROM lead_")
def group_leader(spark, d):
    return groups.leaders(members(spark, d))


@query(" SELECT grp, protocol, CASE WHEN protocol IS NULL THEN 23 ELSE 0 END AS error FROM pick")
def select_protocol(spark, d):
    return groups.select_protocol(members(spark, d))


@query(""" SELECT m.grp, m.member, CASE WHEN protocol IS NULL THEN 23 ELSE 0 END AS error, CASE WHEN protocol IS NULL THEN -1 ELSE 1 END AS generation, protocol,
 CASE WHEN protocol IS NOT NULL THEN leader END AS leader, CAST(CASE WHEN protocol IS NOT NULL AND m.member = leader THEN members ELSE 0 END AS BIGINT) AS sees
 FROM m JOIN lead_ ON m.grp = lead_.grp JOIN pick ON m.grp = pick.grp""")
def join_results(spark, d):
    return groups.join_results(members(spark, d))


@query(""" , k AS (SELECT grp, member, row_number() OVER (PARTITION BY grp ORDER BY joined) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM m),
 a AS (SELECT grp, member, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS assignment FROM k, unnest(range(12)) AS u(p) WHERE p % n = i GROUP BY grp, member)
 SELECT m.grp, m.member, coalesce(assignment, '') AS assignment FROM m LEFT JOIN a ON a.grp = m.grp AND a.member = m.member""")
def sync_assignments(spark, d):
    m = members(spark, d)
    # what each leader sends: partitions 0 to 11 dealt to the members in order of joining
    by_group = m.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("joined", "member"))).alias("ms"))
    deal = lambda x, i: F.struct(x["member"].alias("member"), F.array_join(F.filter(F.sequence(F.lit(0), F.lit(11)), lambda p: p % F.size("ms") == i), ",").alias("assignment"))
    sent = by_group.select("grp", F.filter(F.transform("ms", deal), lambda a: a["assignment"] != "").alias("assignments"))
    return groups.sync(m, sent)


@query(""" , g AS (SELECT grp, 1 AS generation, CASE WHEN grp = 'g3' THEN 'PreparingRebalance' ELSE 'Stable' END AS state FROM lead_),
 h AS (SELECT joined AS rid, grp, CASE WHEN key % 7 = 0 THEN 'x-' || member ELSE member END AS member, CASE WHEN key % 5 = 0 THEN 2 ELSE 1 END AS generation FROM m)
 SELECT rid, h.grp, h.member, CASE WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.grp = h.grp AND m.member = h.member) THEN 25 WHEN h.generation <> g.generation THEN 22
 WHEN state <> 'Stable' THEN 27 ELSE 0 END AS error FROM h JOIN g ON h.grp = g.grp""")
def heartbeat_result(spark, d):
    m = members(spark, d)
    k = F.col("key")
    r = m.select(F.col("joined").alias("rid"), "grp", F.when(k % 7 == 0, F.concat(F.lit("x-"), "member")).otherwise(F.col("member")).alias("member"), F.when(k % 5 == 0, 2).otherwise(1).alias("generation"))
    g = m.select("grp").distinct().select("grp", F.lit(1).alias("generation"), F.when(F.col("grp") == "g3", "PreparingRebalance").otherwise("Stable").alias("state"))
    return groups.heartbeat(r, m, g)


SQL_ERRORS = values(S.GROUP_ERRORS + [("join", "other", -1)], "op, failure, code")


@query()
def error_code_map(spark, d):
    asked = spark.createDataFrame([(o, f) for o, f, _ in S.GROUP_ERRORS] + [("join", "other")], "op string, failure string")
    return asked.join(S.group_errors(spark), ["op", "failure"], "left").select("op", "failure", F.coalesce("code", F.lit(S.UNKNOWN_SERVER_ERROR)).alias("code"))


SQL["error_code_map"] = "SELECT op, failure, CAST(code AS INTEGER) AS code FROM " + SQL_ERRORS


@query(f" SELECT grp, member, max(ts_ms) AS last FROM beat GROUP BY grp, member HAVING (SELECT max(ts_ms) FROM beat) - max(ts_ms) > {HOURS6}")
def expired_members(spark, d):
    b = beats(spark, d)
    return groups.expired(b, now(b), HOURS6)


@query(f""" , g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w > {HOURS6} THEN 1 ELSE 0 END AS fresh FROM beat WINDOW w AS (PARTITION BY grp, member ORDER BY ts_ms, seq)),
 s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY grp, member ORDER BY ts_ms, seq) AS BIGINT) AS session FROM g)
 SELECT grp, member, session, min(ts_ms) AS first, max(ts_ms) AS last, count(*) AS beats FROM s GROUP BY grp, member, session""")
def member_sessions(spark, d):
    return groups.sessions(beats(spark, d), HOURS6)


@query(f""" , j AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts_ms, seq) AS rn FROM (SELECT 'g' || (key % 4) AS grp, 'member-' || key AS member, ts_ms, seq FROM l0 WHERE topic = 'signup')),
 w(grp, rn, opened) AS (SELECT grp, rn, ts_ms FROM j WHERE rn = 1 UNION ALL SELECT j.grp, j.rn, CASE WHEN j.ts_ms >= w.opened + {ROUND_MS} THEN j.ts_ms ELSE w.opened END FROM w JOIN j ON j.grp = w.grp AND j.rn = w.rn + 1),
 x AS (SELECT j.grp, w.opened, count(*) AS joins, count(DISTINCT member) AS members, arg_min(member, seq) AS leader FROM j JOIN w ON j.grp = w.grp AND j.rn = w.rn GROUP BY j.grp, w.opened)
 SELECT *, row_number() OVER (PARTITION BY grp ORDER BY opened) AS generation FROM x""")
def rebalance_rounds(spark, d):
    return groups.rebalance_rounds(beats(spark, d).where("topic = 'signup'"), ROUND_MS)


@query(" SELECT seq, 'member-' || row_number() OVER (ORDER BY seq) AS member_id FROM l0 WHERE topic = 'signup'")
def member_ids(spark, d):
    return groups.member_ids(beats(spark, d).where("topic = 'signup'")).select("seq", "member_id")


@query(" SELECT DISTINCT grp, 0 AS error, 0 AS node_id, 'localhost' AS host, 9092 AS port FROM m")
def find_coordinator(spark, d):
    return groups.find_coordinator(members(spark, d).select("grp").distinct())


@query(" SELECT grp, member FROM m WHERE key % 10 <> 0")
def leave_group(spark, d):
    m = members(spark, d)
    return groups.leave(m, m.where("key % 10 = 0").select("grp", "member"))[0].select("grp", "member")


# Metrics


@query(" SELECT api, result, count(*) AS n FROM q GROUP BY api, result")
def requests_total(spark, d):
    return metrics.requests_total(view.requests(spark, d))


@query(" SELECT 'in' AS direction, CAST(sum(bytes_in) AS BIGINT) AS bytes FROM q UNION ALL SELECT 'out', CAST(sum(bytes_out) AS BIGINT) FROM q")
def bytes_by_direction(spark, d):
    return metrics.bytes_by_direction(view.requests(spark, d))


BOUNDS = "(VALUES " + ", ".join(f"(CAST({b} AS DOUBLE))" for b in S.LATENCY_BOUNDS) + ", (CAST('Infinity' AS DOUBLE))) AS bd(le)"


@query(f" SELECT api, le, CAST(count(*) FILTER (ms / 1000 <= le) AS BIGINT) AS n FROM q, {BOUNDS} GROUP BY api, le")
def latency_histogram(spark, d):
    return metrics.histogram(view.requests(spark, d), ["api"])


@query(""" , s AS (SELECT api, ms, row_number() OVER (PARTITION BY api ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY api) AS n FROM q)
 SELECT api, max(ms) FILTER (i = least(CAST(floor(0.5 * n) AS BIGINT), n - 1)) AS p50, max(ms) FILTER (i = least(CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT), n - 1)) AS p95,
 max(ms) FILTER (i = least(CAST(floor(CAST(0.99 AS DOUBLE) * n) AS BIGINT), n - 1)) AS p99 FROM s GROUP BY api""")
def latency_percentiles(spark, d):
    return metrics.percentiles(view.requests(spark, d), ["api"], "ms")


@query(""" , t AS (SELECT count(*) AS records, CAST(sum(bytes_in) AS BIGINT) AS bytes, CAST(max(ts_ms) - min(ts_ms) AS DOUBLE) / 1000.0 AS seconds FROM q)
 SELECT records, bytes, seconds, records / seconds AS records_per_s, bytes / CAST(1048576 AS DOUBLE) / seconds AS mb_per_s FROM t""")
def throughput_summary(spark, d):
    return metrics.throughput(view.requests(spark, d))


@query(" SELECT api, ts_ms - ts_ms % 60000 AS start_ms, count(*) / CAST(60 AS DOUBLE) AS per_s FROM q GROUP BY api, ts_ms - ts_ms % 60000")
def request_rate(spark, d):
    return metrics.rate(view.requests(spark, d), ["api"])


@query(" SELECT api, ts_ms - ts_ms % 60000 AS start_ms, count(*) / CAST(60 AS DOUBLE) AS per_s FROM q WHERE result = 'error' GROUP BY api, ts_ms - ts_ms % 60000")
def error_rate(spark, d):
    return metrics.rate(view.requests(spark, d).where("result = 'error'"), ["api"])


@query(""" , x AS (SELECT 'in' AS direction, ts_ms, bytes_in AS n FROM q UNION ALL SELECT 'out', ts_ms, bytes_out FROM q)
 SELECT direction, ts_ms - ts_ms % 60000 AS start_ms, CAST(sum(n) AS BIGINT) / CAST(60 AS DOUBLE) AS per_s FROM x GROUP BY direction, ts_ms - ts_ms % 60000""")
def bytes_rate(spark, d):
    return metrics.bytes_rate(view.requests(spark, d))


@query(f""" , h AS (SELECT ts_ms - ts_ms % 300000 AS start_ms, le, CAST(count(*) FILTER (ms / 1000 <= le) AS BIGINT) AS n FROM q, {BOUNDS} GROUP BY ALL),
 hh AS (SELECT *, coalesce(lag(le) OVER w, CAST(0 AS DOUBLE)) AS lo, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY start_ms) AS total FROM h WINDOW w AS (PARTITION BY start_ms ORDER BY le))
 SELECT start_ms, qq AS q, CASE WHEN isinf(le) THEN CAST(10 AS DOUBLE) ELSE lo + (le - lo) * ((qq * total - before) / (n - before)) END AS seconds
 FROM hh, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) AS z(qq) WHERE n >= qq * total AND before < qq * total""")
def histogram_quantile(spark, d):
    return metrics.histogram_quantile(view.requests(spark, d))


@query(" SELECT topic, part, arg_max(value, seq) AS value FROM l0 GROUP BY topic, part")
def gauge_last(spark, d):
    return metrics.gauge_last(view.records(view.load(spark, d, "events")), ["topic", "part"], "value", "seq")


@query(" SELECT topic, CAST(sum(len) AS BIGINT) AS value FROM (SELECT topic, part, arg_max(len, seq) AS len FROM l0 GROUP BY topic, part) GROUP BY topic")
def gauge_over_targets(spark, d):
    r = view.records(view.load(spark, d, "events")).withColumn("broker", F.lit(0))
    both = r.withColumn("target", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return metrics.sum_over_brokers(both, ["topic"], ["broker", "part"], "len", "seq")


@query(""" SELECT 'partition_bytes{topic="' || topic || '",part="' || part || '"} ' || CAST(sum(bytes + 8) AS BIGINT) AS value FROM b GROUP BY topic, part""")
def metrics_text(spark, d):
    return metrics.exposition(offsets.partition_size(batches(spark, d)), "partition_bytes", ["topic", "part"], "bytes")


# Protocol


@query()
def api_key_name(spark, d):
    keys = spark.range(0, 24).select(F.col("id").cast("int").alias("api_key"))
    return keys.join(S.api_table(spark).select("api_key", "name"), "api_key", "left").select("api_key", F.coalesce("name", F.lit("Unknown")).alias("name"))


API_VALUES = values(S.APIS, "api_key, name, min_version, max_version")
SQL["api_key_name"] = f"SELECT CAST(k AS INTEGER) AS api_key, coalesce(name, 'Unknown') AS name FROM unnest(range(24)) AS u(k) LEFT JOIN {API_VALUES} ON api_key = k"


@query()
def supported_apis(spark, d):
    return S.api_table(spark).select("api_key", "min_version", "max_version", F.lit(S.NONE).alias("error"))


SQL["supported_apis"] = f"SELECT CAST(api_key AS INTEGER) AS api_key, CAST(min_version AS INTEGER) AS min_version, CAST(max_version AS INTEGER) AS max_version, 0 AS error FROM {API_VALUES}"


def wire(spark: SparkSession, d: str) -> DataFrame:
    """Producer batches built from the batch view: a header of 61 bytes and the size's payload; every 13th is corrupt."""
    b = batches(spark, d).select("seq", "topic", "part", F.col("span").cast("int").alias("span"))

    @F.pandas_udf("binary")
    def make(n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([codec.build_batch(k, bytes(k), ts=1000 + x % 7)[: 40 if x % 13 == 0 else None] for k, x in zip(n, s)])

    return b.select(F.col("seq").alias("rid"), "topic", "part", "span", make("span", "seq").alias("records"))


@query(""" SELECT seq AS rid, CASE WHEN seq % 13 = 0 THEN 'short' END AS error, CASE WHEN seq % 13 <> 0 THEN CAST(49 + span AS BIGINT) END AS batch_length,
 CASE WHEN seq % 13 <> 0 THEN CAST(2 AS BIGINT) END AS magic, CASE WHEN seq % 13 <> 0 THEN CAST(span - 1 AS BIGINT) END AS last_offset_delta,
 CASE WHEN seq % 13 <> 0 THEN CAST(1000 + seq % 7 AS BIGINT) END AS first_ts, CASE WHEN seq % 13 <> 0 THEN CAST(-1 AS BIGINT) END AS producer_id,
 CASE WHEN seq % 13 <> 0 THEN CAST(span AS BIGINT) END AS record_count, CASE WHEN seq % 13 <> 0 THEN CAST(0 AS BIGINT) END AS base_offset,
 CASE WHEN seq % 13 <> 0 THEN CAST(0 AS BIGINT) END AS leader_epoch, CASE WHEN seq % 13 <> 0 THEN true END AS crc_holds, CASE WHEN seq % 13 <> 0 THEN CAST(0 AS BIGINT) END AS attributes,
 CASE WHEN seq % 13 <> 0 THEN CAST(1000 + seq % 7 AS BIGINT) END AS max_ts, CASE WHEN seq % 13 <> 0 THEN CAST(-1 AS BIGINT) END AS producer_epoch,
 CASE WHEN seq % 13 <> 0 THEN CAST(-1 AS BIGINT) END AS base_sequence FROM b""")
def batch_header_parse(spark, d):
    w = wire(spark, d)
    h = w.select("rid", codec.header_error(F.col("records")).alias("error"), *codec.header_fields(F.col("records")))
    held = w.select("rid", F.when(codec.header_error(F.col("records")).isNull(), codec.crc_valid(F.col("records"))).alias("crc_holds"))
    return h.drop("crc").join(held, "rid")


@query(""" , g AS (SELECT *, CASE WHEN topic = 'error' THEN 3 WHEN seq % 13 = 0 THEN 2 ELSE 0 END AS error FROM b)
 SELECT seq AS rid, topic, part, error, CAST(CASE WHEN error = 0 THEN sum(CASE WHEN error = 0 THEN span ELSE 0 END) OVER (PARTITION BY topic, part ORDER BY seq) - span ELSE -1 END AS BIGINT) AS base,
 CAST(CASE WHEN error = 0 THEN 5 ELSE -1 END AS BIGINT) AS append_ms FROM g""")
def produce_results(spark, d):
    empty = spark.createDataFrame([], "topic string, part int, latest long")
    return produce.produce(wire(spark, d), topics(spark, d).where("name <> 'error'"), empty, 5)[0]


# Streams, run to the end of their input


@query(" SELECT grp, topic, part, off, metadata, seq FROM last")
def stream_latest_commits(spark, d):
    from driftlog.streaming.jobs import replay

    return replay(spark, f"{d}/events.parquet")


@query(f" SELECT grp, member, max(ts_ms) AS last FROM beat GROUP BY grp, member HAVING (SELECT max(ts_ms) FROM beat) - max(ts_ms) > {HOURS6}")
def stream_expired_members(spark, d):
    from driftlog.streaming.jobs import expire

    return expire(spark, f"{d}/events.parquet", HOURS6)


def queries() -> dict:
    from driftlog import queries_wire  # noqa: F401  adds its own

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from driftlog import queries_wire  # noqa: F401  adds its own

    return dict(SQL)
