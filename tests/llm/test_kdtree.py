import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftlog.llm.kdtree import TIE_BITS, kd_shards, kd_tree, leaves, name_ranks


def make(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, "é" * int(r.lognormvariate(4, 1)), r.choice(["en", "de", None]), r.choice(["src%d" % (k % 7) for k in range(9)])) for i in range(n)]
    rows += [(n, None, "en", "a"), (n + 1, "", "de", None), (None, "abc", None, None)]
    rows += [(n + 2 + i, "copy of one text", "en", "src0") for i in range(n // 3)] + [rows[0]] * 5
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def sizes(got):
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    return size


@pytest.mark.parametrize("shards", [24, 5, 1])
def test_near_equal_bytes_and_slots(spark, shards):
    rows, df = make(spark, 3000)
    got = kd_shards(df, shards).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    size, slots = sizes(got), defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(shards))
    mean = sum(size.values()) / shards
    assert max(abs(v - mean) for v in size.values()) < 0.04 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_each_cut_by_brute_force(spark):
    """Axis: the widest; left: the heaviest beginning of the node's rows in key order that its share allows, and the small
    rows that fill what a straddling row leaves."""
    _, df = make(spark, 600)
    at, inner, dims = kd_tree(df, 24, "doc_id", "text", ("lang", "source"))
    rows = at.select("node", "weight", *dims).collect()
    slack = sum(r.weight for r in rows) / 24 / 1000
    leaf, used = leaves(inner), set()
    assert sorted(leaf.values()) == list(range(24)) and {r.node for r in rows} <= set(leaf)

    def under(r, ident):
        n = r.node
        while n > ident:
            n = (n - 1) // 2
        return n == ident

    for n in inner:
        here = [r for r in rows if under(r, n.ident)]
        spread = [max(r[d] >> TIE_BITS for r in here) - min(r[d] >> TIE_BITS for r in here) for d in dims]
        assert n.axis == spread.index(max(spread))
        used.add(n.axis)
        want, left, lack, filling = sum(r.weight for r in here) * (n.mid - n.lo) / (n.hi - n.lo), [], None, False
        by_key = defaultdict(list)
        for r in here:
            by_key[r[dims[n.axis]]].append(r)
        total = 0
        for k in sorted(by_key):
            w = sum(r.weight for r in by_key[k])
            if total + w > want:
                break
            total += w
            left += by_key[k]
        rest = [k for k in sorted(by_key) if k > max((r[dims[n.axis]] for r in left), default=-1)]
        if (gap := want - total) > slack:
            filled = 0
            for k in rest:
                w = sum(r.weight for r in by_key[k] if r.weight <= int(gap / 4))
                if filled + w > gap:
                    break
                filled += w
                left += [r for r in by_key[k] if r.weight <= int(gap / 4)]
        assert Counter(left) == Counter(r for r in here if under(r, 2 * n.ident + 1))
    assert used == {0, 1, 2}


def test_names_are_ranked(spark):
    df = spark.createDataFrame([("https://a",), ("https://b",), (None,), ("https://c",), ("https://b",)], "source string")
    ranked, n = name_ranks(df.repartition(3), "source")
    assert n == 4 and [r.name for r in ranked.orderBy("coord").collect()] == ["", "https://a", "https://b", "https://c"]
    assert [r.coord for r in ranked.orderBy("coord").collect()][::3] == [0, 2**20 - 1]


def test_many_names_are_joined_in_parts(spark, monkeypatch):
    _, df = make(spark, 200)
    plain = sorted(kd_shards(df, 6).collect(), key=str)
    monkeypatch.setattr("driftlog.llm.kdtree.NAMES_AT_ONCE", 0)
    assert sorted(kd_shards(df, 6).collect(), key=str) == plain


def test_same_again(spark):
    _, df = make(spark, 300)
    a, b = (sorted(kd_shards(x, 8).collect(), key=str) for x in (df, df.repartition(7)))
    assert a == b


def test_rows_larger_than_a_shard(spark):
    rows = [(i, "x" * 992) for i in range(400)] + [(1000 + i, "y" * 300_000) for i in range(3)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size = sorted(sizes(got).values())
    assert size[5:] == [300_008] * 3 and size[4] - size[0] <= 1000


def test_small_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert kd_shards(df).count() == 0
    one = spark.createDataFrame([(1, "x" * 100_000)], "doc_id long, text string")
    assert [r.slot for r in kd_shards(one).collect()] == [0]


def test_other_columns_do_not_clash(spark):
    _, df = make(spark, 50)
    more = df.withColumns({c: F.lit(1) for c in ("size", "row", "node", "weight", "n_0", "c_0", "shard", "slot", "name", "coord")})
    assert sorted(kd_shards(more, 4).collect(), key=str) == sorted(kd_shards(df, 4).collect(), key=str)
