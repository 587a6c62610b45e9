"""The log's operators on small inputs: spans, rolls, reads, retention, groups, catalog."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlog.functions import codec
from driftlog.functions import schemas as S
from driftlog.operators import catalog, commits, groups, metrics, offsets, produce, scan, segments
from driftlog.plans import view

B = "topic string, part int, base long, span long, bytes long, ts_ms long"


def blobs(spark, sizes, spans=None, ts=None):
    spans = spans or [1] * len(sizes)
    rows = spark.createDataFrame([("t", 0, i, s, n, (ts or range(len(sizes)))[i]) for i, (n, s) in enumerate(zip(sizes, spans))], "topic string, part int, seq long, span long, bytes long, ts_ms long")
    return view.assign_offsets(rows, "seq", F.col("span")).withColumnRenamed("off", "base")


def test_multi_record_spans(spark):
    b = blobs(spark, [13, 14], [5, 3])
    assert [r.base for r in b.orderBy("base").collect()] == [0, 5]
    assert offsets.earliest_latest(b).first()[2:] == (0, 8)
    probes = spark.createDataFrame([("t", 0, o) for o in range(9)], "topic string, part int, off long")
    assert {r.off: r.base for r in scan.batch_containing(b, probes).collect()} == {o: 0 if o < 5 else 5 for o in range(8)}
    assert offsets.partition_size(b).first().bytes == 13 + 14 + 16


def read(spark, b, start, most, **o):
    return sorted(r.base for r in scan.read_from_offset(b, spark.createDataFrame([(1, "t", 0, start, most)], "rid int, topic string, part int, start long, max_bytes long"), **o).collect())


def test_bounded_reads(spark):
    b = blobs(spark, [8] * 10)
    assert read(spark, b, 0, 24) == [0, 1, 2]
    assert read(spark, b, 7, 1000) == [7, 8, 9]
    assert read(spark, b, 99, 1000) == []
    one = blobs(spark, [20])
    assert read(spark, one, 0, 3) == [] and read(spark, one, 0, 3, at_least_one=True) == [0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5)), min_size=1, max_size=25), st.integers(1, 90), st.integers(0, 60))
def test_properties(spark, rows, limit, start):
    """Offsets are dense, segments roll greedily, a read is the longest prefix that fits."""
    sizes, spans = [r[0] for r in rows], [max(1, r[1]) for r in rows]
    b = blobs(spark, sizes, [r[1] for r in rows])
    got = segments.assign_segments(b, limit).orderBy("seq").collect()
    base = seg = active = 0
    for r, n, s in zip(got, sizes, spans):
        if active >= limit:
            seg, active = base, 0
        assert (r.base, r.segment_base) == (base, seg)
        base, active = base + s, active + n + 8
    want, left = [], 50
    for r, n in zip(got, sizes):
        if r.base + max(r.span, 1) > start:
            if n > left:
                break
            left -= n
            want.append(r.base)
    assert read(spark, b.withColumn("span", F.greatest("span", F.lit(1))), start, 50) == want


def test_running_sum_over_chunks(spark):
    from driftlog.plans.prefix import running_sum

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    a = running_sum(df, ["k"], "o", F.col("o"), "s", chunk=17).collect()
    assert all(r.s == sum(x for x in range(r.o) if x % 3 == r.k) for r in a)


def test_index_times_and_retention(spark):
    b = segments.assign_segments(blobs(spark, [8] * 100, ts=[1000 + 10 * i for i in range(100)]), 1 << 20)
    ix = segments.sparse_index(b, 10)
    assert ix.count() == 10
    probes = spark.createDataFrame([(1, "t", 0, 1250), (2, "t", 0, 500)], "pid long, topic string, part int, t long")
    assert {r.pid: r.off for r in offsets.as_of(ix, probes).collect()} == {1: 20, 2: None}
    s = segments.segment_counts(segments.assign_segments(blobs(spark, [8] * 20, ts=[0] * 19 + [10**9]), 40))
    last = s.agg(F.max("segment_base")).first()[0]
    assert [r.segment_base for r in segments.retention(s, 10**9, 7 * 86400000, 0).collect()] == [last]
    assert segments.retention(s, 10**12, 0, 0).count() == s.count()
    half = segments.earliest_after(segments.retention(s, 0, 0, 160)).first()
    assert half.earliest > 0 and half.bytes <= 160
    assert [r.segment_base for r in segments.retention(s, 10**12, 1, 1).collect()] == [last]


def test_commits(spark):
    c = spark.createDataFrame([(1, "a", "o", 0, 5, "x"), (2, "b", "o", 0, 99, ""), (3, "a", "o", 1, 7, ""), (4, "a", "p", 0, 3, ""), (5, "a", "o", 0, 4, "y")], "seq long, grp string, topic string, part int, off long, metadata string")
    now = {(r.grp, r.topic, r.part): r.off for r in commits.latest(c).collect()}
    assert now == {("a", "o", 0): 4, ("b", "o", 0): 99, ("a", "o", 1): 7, ("a", "p", 0): 3}
    assert [(r.position, r.grp, r.topic, r.part) for r in commits.compact(c).orderBy("position").collect()] == [(0, "a", "o", 0), (1, "a", "o", 1), (2, "a", "p", 0), (3, "b", "o", 0)]
    ends = spark.createDataFrame([("o", 0, 0, 3, 5, 0)], B)
    assert {(r.grp): r.lag for r in commits.lag(commits.latest(c), ends).collect()} == {"a": -1, "b": -96}


def test_percentiles(spark):
    r = spark.createDataFrame([("a", float(i)) for i in range(100, 0, -1)] + [("b", 3.0)] * 4, "api string, ms double")
    assert {x.api: (x.p50, x.p95, x.p99) for x in metrics.percentiles(r, ["api"], "ms").collect()} == {"a": (51, 96, 100), "b": (3, 3, 3)}
    empty = spark.createDataFrame([], "api string, ms double, bytes_in long, ts_ms long")
    assert metrics.throughput(empty).first().records_per_s == 0


def test_protocols(spark):
    def pick(*lists):
        m = spark.createDataFrame([("g", f"m{i}", i, p) for i, p in enumerate(lists)], "grp string, member string, joined long, protocols array<string>")
        return tuple(groups.select_protocol(m).first())[1:]

    assert pick(["range"], ["roundrobin"]) == (None, S.INCONSISTENT_GROUP_PROTOCOL)
    assert pick(["range", "roundrobin"], ["roundrobin"]) == ("roundrobin", 0)
    assert pick(["b", "a"], ["a", "b"], ["a", "b", "c"]) == ("b", 0)


VALID = ["orders", "a", "A.b_c-9", "...", "..a", "a" * 249, "-", "_", "0", "orders.v1", "x--y"]
INVALID = ["", ".", "..", "a" * 250, "a b", "a/b", "a\\b", "orders\n", "\norders", "é", "a\x00", "a:b", "../x", "a*", "a?", "日本"]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in VALID + INVALID + [None]], "name string")
    got = {r.name: r.ok for r in df.select("name", codec.valid_name(F.col("name")).alias("ok")).collect()}
    assert all(got[n] for n in VALID) and not any(got[n] for n in [*INVALID, None])


def test_create_and_metadata(spark):
    cat = spark.createDataFrame([("old", 3)], "name string, partitions int")
    ask = spark.createDataFrame([(1, "new", 5), (2, "new", 1), (3, "big", 9), (4, "x", 2), (5, "__x", 1)], "rid int, name string, partitions int")
    assert [r.error for r in catalog.create_topics(cat, ask, 10).orderBy("rid").collect()] == [0, 36, 37, 0, 17]
    m = {r.name: r for r in catalog.metadata(cat, spark.createDataFrame([("old",), ("no",)], "name string"), 7).collect()}
    assert [p.leader for p in m["old"].parts] == [7, 7, 7] and m["no"].parts == [] and m["no"].error == 3


def test_batches_on_the_wire(spark):
    raw = codec.build_batch(3, b"payload")
    bad = raw[:-1] + b"x"
    df = spark.createDataFrame([(1, "t", 0, raw), (2, "t", 0, bad), (3, "t", 0, raw[:50]), (4, "u", 0, raw), (5, "t", 0, raw), (6, "t", 0, raw + raw)], "rid long, topic string, part int, records binary")
    cat = spark.createDataFrame([("t", 1)], "name string, partitions int")
    ends = spark.createDataFrame([("t", 0, 100)], "topic string, part int, latest long")
    answers, out = produce.produce(df, cat, ends, 77)
    assert {r.rid: (r.error, r.base, r.append_ms) for r in answers.collect()} == {1: (0, 100, 77), 5: (0, 103, 77), 2: (2, -1, -1), 3: (2, -1, -1), 4: (3, -1, -1), 6: (2, -1, -1)}
    stored = out.select("base", *codec.header_fields(F.col("payload")), codec.crc_valid(F.col("payload")).alias("ok")).collect()
    assert sorted((r.base, r.base_offset, r.record_count, r.producer_id, r.max_ts, r.ok) for r in stored) == [(100, 100, 3, -1, 1000, True), (103, 103, 3, -1, 1000, True)]
    assert codec.crc32c_bytes(b"123456789") == 0xE3069283


def test_crc_of_signed_fields(spark):
    v = spark.createDataFrame([(-2,), (5,)], "x long")
    assert [r[0] for r in v.select(codec.be_int(codec.to_be(F.col("x"), 4), 0, 4)).collect()] == [-2, 5]
    assert [r[0] for r in v.select(codec.be_int(codec.to_be(F.col("x"), 8), 0, 8)).collect()] == [-2, 5]


def test_leave_and_member_ids(spark):
    m = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "grp string, member string")
    stay, empty = groups.leave(m, spark.createDataFrame([("g", "a"), ("h", "nobody")], "grp string, member string"))
    assert stay.count() == 2 and [r.grp for r in empty.collect()] == ["g"]
    ids = groups.member_ids(spark.createDataFrame([(30,), (10,), (20,)], "seq long"))
    assert {r.seq: r.member_id for r in ids.collect()} == {10: "member-1", 20: "member-2", 30: "member-3"}


@pytest.mark.parametrize("delay, want", [(5, [3, 1]), (100, [4]), (1, [1, 1, 1, 1])])
def test_rounds(spark, delay, want):
    j = spark.createDataFrame([("g", f"m{i}", t, i) for i, t in enumerate([10, 12, 14, 15])], "grp string, member string, ts_ms long, seq long")
    assert [r.joins for r in groups.rebalance_rounds(j, delay).orderBy("generation").collect()] == want


def test_config():
    from driftlog.functions.config import LogConfig, describe

    c = LogConfig.from_text({"retention_bytes": "0", "max_partitions": " 200 "})
    assert (c.max_partitions, c.segment_bytes, describe(c.retention_bytes)) == (200, 16 << 20, "unlimited")
    for bad in ({"max_partitions": "x"}, {"max_partitions": ""}, {"max_partitions": "-1"}, {"nothing": "1"}):
        with pytest.raises(ValueError):
            LogConfig.from_text(bad)
