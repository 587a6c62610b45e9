import json
import os
import random
import struct

import pytest

from driftlog.functions.codec import decode_commits, encode_commit
from driftlog.functions.crc import crc32c_many
from driftlog.functions.requests import LAYOUTS, decode_request, frames
from driftlog.functions.schemas import APIS, MAX_FRAME
from driftlog.sources import files
from driftlog.sources.segments import Tail, register


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("log")
    for topic, part, base, blobs in [("a-b", 0, 0, [(b"x", 2), (b"yy", 3)]), ("a-b", 0, 5, [(b"z", 1)]), ("c", 1, 0, [(b"", 1)])]:
        d = top / f"{topic}-{part}"
        d.mkdir(exist_ok=True)
        (d / f"{base:020d}.log").write_bytes(b"".join(struct.pack(">ii", len(p), s) + p for p, s in blobs))
    with open(top / "c-1" / f"{0:020d}.log", "ab") as f:
        f.write(struct.pack(">ii", 100, 1) + b"torn")
    (top / "c-1" / "notes.txt").write_text("x")
    (top / "c-1" / "1.log").write_text("x")
    return str(top)


def test_read(spark, root):
    register(spark)
    df = spark.read.format("driftlog").load(root)
    got = sorted((r.topic, r.part, r.segment_base, r.base, r.span, r.position, bytes(r.payload)) for r in df.collect())
    assert got == [("a-b", 0, 0, 0, 2, 0, b"x"), ("a-b", 0, 0, 2, 3, 9, b"yy"), ("a-b", 0, 5, 5, 1, 0, b"z"), ("c", 1, 0, 0, 1, 0, b"")]
    one = df.where("topic = 'a-b' and base >= 5")
    assert one.count() == 1 and one.rdd.getNumPartitions() == 1


def test_write_and_tail(spark, root, tmp_path):
    register(spark)
    out = str(tmp_path / "out")
    df = spark.read.format("driftlog").load(root)
    df.select("topic", "part", "segment_base", "base", "span", "payload").repartition("topic", "part").sortWithinPartitions("topic", "part", "base").write.format("driftlog").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["a-b-0", "c-1"]
    cols = ["topic", "part", "base", "span", "payload"]
    assert sorted(map(str, spark.read.format("driftlog").load(out).select(*cols).collect())) == sorted(map(str, df.select(*cols).collect()))
    q = spark.readStream.format("driftlog").load(out).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert spark.table("tail").count() == 4
    finally:
        q.stop()


def test_catalog_file(spark, tmp_path):
    p = str(tmp_path / "topics.json")
    assert files.load_catalog(spark, p).count() == 0
    files.save_catalog(spark.createDataFrame([("b", 2), ("a", 1)], "name string, partitions int"), p)
    assert [t["name"] for t in json.load(open(p))["topics"]] == ["a", "b"]
    assert {r.name: r.partitions for r in files.load_catalog(spark, p).collect()} == {"a": 1, "b": 2}
    good = {"name": "t.1", "partitions": 3}
    for key, value in [("name", "a/b"), ("name", "x" * 250), ("name", ".."), ("partitions", -4), ("partitions", 5000), ("partitions", None), ("partitions", 2.5)]:
        json.dump({"version": 1, "topics": [good, {"name": "u", "partitions": 1} | {key: value}]}, open(p, "w"))
        with pytest.raises(ValueError):
            files.load_catalog(spark, p)
    for whole in ({"version": 1, "topics": [good, good]}, {"topics": [good]}, {"version": 7, "topics": [good]}, "topics"):
        json.dump(whole, open(p, "w"))
        with pytest.raises(ValueError):
            files.load_catalog(spark, p)
    open(p, "w").write("{")
    with pytest.raises(ValueError):
        files.load_catalog(spark, p)


def test_commit_records(spark):
    rows = [("group-a", "orders", 0, 5, "é"), ("g", "t", 1, -1, "")]
    data = b"".join(encode_commit(*r) for r in rows)
    assert decode_commits(data) == rows
    for broken in (data[:-1], b"\x00\x00\x00\x63", b"\x00\x00"):
        with pytest.raises(ValueError):
            decode_commits(broken)
    df = spark.createDataFrame([(7, data)], "base long, payload binary")
    assert [(r.seq, r.grp, r.off) for r in files.decode_commit_blobs(df).orderBy("seq").collect()] == [(7, "group-a", 5), (8, "g", -1)]


def text(s):
    return struct.pack(">h", len(s)) + s.encode()


def head(key, version=0):
    return struct.pack(">hhi", key, version, 9) + text("me")


def test_requests():
    fetch = head(1) + struct.pack(">iii", -1, 500, 1) + struct.pack(">i", 1) + text("t") + struct.pack(">i", 1) + struct.pack(">iqi", 0, 42, 100)
    got = decode_request(fetch)
    assert got["api"] == "Fetch" and got["body"]["topics"][0]["partitions"][0] == {"part": 0, "off": 42, "max_bytes": 100}
    assert decode_request(head(9, 2) + text("g") + struct.pack(">i", -1))["body"]["topics"] is None
    assert decode_request(head(3, 1) + struct.pack(">i", 0))["body"]["topics"] == []
    assert set(LAYOUTS) == {name for _, name, *_ in APIS}


def test_hostile_counts():
    """Counts that are negative, or just above what the bytes behind them can hold."""
    r = random.Random(11)
    arrays = [head(1) + struct.pack(">iii", 0, 0, 0), head(2) + struct.pack(">i", 0), head(8) + text("g"), head(19), head(20), head(14) + text("g") + struct.pack(">i", 1) + text("m")]
    for before in arrays:
        for rest in (b"", bytes(r.randrange(1, 40))):
            for n in (len(rest) + 1, r.randrange(len(rest) + 1, 2**31), *(-r.randrange(1, 2**31) for _ in range(4))):
                with pytest.raises(ValueError):
                    decode_request(before + struct.pack(">i", n) + rest)


def test_frames():
    a, b = struct.pack(">I", 3) + b"abc", struct.pack(">I", 0)
    assert frames(a + b + a[:5]) == ([b"abc", b""], a[:5])
    with pytest.raises(ValueError):
        frames(struct.pack(">I", MAX_FRAME + 1))


def plain_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc_of_many_lengths():
    r = random.Random(3)
    blobs = [r.randbytes(n) for n in [*range(140), 255, 256, 257, 1000, 4096, 4097, 20_000]] + [b"123456789", bytes(300), b"\xff" * 65]
    got = crc32c_many(blobs).tolist()
    assert got == [plain_crc(b) for b in blobs] and got[-3] == 0xE3069283
    assert crc32c_many(blobs, most_bytes=64).tolist() == got and crc32c_many([]).tolist() == []
    big = r.randbytes(3_000_001)
    assert crc32c_many([big, b"x", big[:-1]])[0] == crc32c_many([big])[0]


def blobs_frame(spark, rows):
    return spark.createDataFrame(rows, "topic string, part int, segment_base long, base long, span int, payload binary")


def test_writer_refuses_a_segment_in_two_tasks_and_overwrites(spark, tmp_path):
    register(spark)
    root = str(tmp_path / "w")
    rows = [("t", 0, 0, i, 1, b"%d" % i) for i in range(6)]
    with pytest.raises(Exception, match="several tasks"):
        blobs_frame(spark, rows).repartition(3).write.format("driftlog").mode("append").save(root)
    assert [d for d in os.listdir(root) if os.listdir(os.path.join(root, d))] == []
    blobs_frame(spark, rows).coalesce(1).write.format("driftlog").mode("append").save(root)
    assert spark.read.format("driftlog").load(root).count() == 6
    blobs_frame(spark, [("u", 1, 7, 7, 2, b"new")]).write.format("driftlog").mode("overwrite").save(root)
    assert [(r.topic, r.base, bytes(r.payload)) for r in spark.read.format("driftlog").load(root).collect()] == [("u", 7, b"new")]


def test_tail_reads_only_what_is_new(tmp_path):
    folder = tmp_path / "t-0"
    folder.mkdir()
    blob = lambda b, span=1: struct.pack(">ii", len(b), span) + b
    path = folder / ("0" * 20 + ".log")
    path.write_bytes(blob(b"a", 3) + blob(b"b") + blob(b"torn")[:-1])
    tail = Tail(str(tmp_path))
    one = tail.latestOffset()
    first = [x for p in tail.partitions(tail.initialOffset(), one) for x in tail.read(p)]
    assert [(x[3], x[4], x[5], x[6]) for x in first] == [(0, 3, 0, b"a"), (3, 1, 9, b"b")]
    with open(path, "ab") as f:
        f.write(b"n" + blob(b"c"))
    (folder / f"{5:020d}.log").write_bytes(blob(b"d"))
    two = Tail(str(tmp_path)).latestOffset()  # as after a restart
    more = [x for p in tail.partitions(one, two) for x in tail.read(p)]
    assert [(x[3], x[6]) for x in sorted(more)] == [(4, b"tor" + b"n"), (5, b"c"), (5, b"d")]
    assert tail.partitions(two, tail.latestOffset()) == []
