"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside blocks, components.

Two fingerprints within the radius r agree on at least k of r + k bit blocks, so comparing only fingerprints that share
the bits of some k blocks loses no link; k grows with the number of distinct fingerprints. Within such a bucket the bit
planes are stored vertically: word w of plane b holds bit b of 64 fingerprints. A query's differing bits are added for
64 fingerprints at once by carry-save adders into bitwise counters, and words in which all 64 have passed the radius
are abandoned after a few planes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.common import HashCache, discard, fresh, frugal, materialize, portions, words
from driftlog.llm.components import connected_components
from driftlog.llm.passages import SHINGLE, THRESHOLD, band_keys, buckets, shingle_sets, verified_links

#: Rows of a bucket that one tile compares with as many others.
TILE = 8192
#: For texts of Jaccard 0.8: 12 bands of 3 minima, and the bits in which their fingerprints may differ.
BANDS, ROWS, WIDE = 12, 3, 24


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the text's word shingles, repeats counted; 0 for a text without words."""
    w = words(text)
    if not w:
        return 0
    norm, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(norm, 42)
    starts = np.concatenate(([0], ends[: len(w) - shingle] + 1)).tolist()
    h, count, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    every = list(zip(starts, ends[shingle - 1 :].tolist()))
    for k in range(0, n, 4096):
        part = np.array([h(norm[a:b], 42) for a, b in every[k : k + 4096]], dtype="<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def add_fingerprint(df: DataFrame, text: str = "text", keep: dict[str, Column] | None = None, shingle: int = 4) -> DataFrame:
    """The columns in keep (name -> long column) and fp, the fingerprint as signed long."""
    keep = keep or {}
    names, n = [*keep, "fp"], len(keep)

    def run(batches):
        for b in batches:
            t = b.column(n)
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in t), np.uint64, len(t))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(fp.view(np.int64))], names)

    cols = [c.cast("long").alias(n) for n, c in keep.items()]
    return df.select(*cols, F.col(text).alias("_text")).mapInArrow(frugal(run), ", ".join(f"{n} long" for n in names))


def exceeds(c: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (bit i of the count in c[i]) is above radius, or that overflowed."""
    gt, eq = over.copy(), ~np.zeros_like(over)
    for i in reversed(range(len(c))):
        if radius >> i & 1:
            eq = eq & c[i]
        else:
            gt |= eq & c[i]
            eq = eq & ~c[i]
    return gt


def add_plane(c: list[np.ndarray], over: np.ndarray, x: np.ndarray, level: int = 0) -> np.ndarray:
    for i in range(level, len(c)):
        c[i], x = c[i] ^ x, c[i] & x
    return over | x


class Sliced:
    """Bit planes of fingerprints that are sorted by bucket; start[i] is the first row of the bucket of row i."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        n = len(fps)
        self.fps, first = fps, np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        size = np.diff(np.append(first, n))
        per = -(-size // 64)
        base = np.cumsum(per) - per
        b = np.repeat(np.arange(len(first)), size)
        rank = np.arange(n) - first[b]
        self.word, self.lane = base[b] + rank // 64, rank % 64
        self.last = (base + per)[b]
        total = int(per.sum())
        padded, valid = np.zeros(total * 64, np.uint64), np.zeros(total * 64, np.uint8)
        at = self.word * 64 + self.lane
        padded[at], valid[at] = fps, 1
        self.row = np.zeros(total * 64, np.int64)
        self.row[at] = np.arange(n)
        pack = lambda bits: np.packbits(bits.reshape(total, 64), axis=1, bitorder="little").view("<u8").ravel()
        self.valid = pack(valid)
        self.planes = [pack((padded >> np.uint64(i)).astype(np.uint8) & 1) for i in range(64)]

    def matches(self, radius: int, slab: int = 1 << 15):
        """Yield (i, j) row arrays of linked pairs with i before j in one bucket."""
        per = self.last - self.word
        ends = np.cumsum(per)
        lo = 0
        while lo < len(per):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + slab, side="right")))
            q = np.repeat(np.arange(lo, hi), per[lo:hi])
            w = self.word[q] + np.arange(len(q)) - np.repeat(ends[lo:hi] - per[lo:hi] - (ends[lo - 1] if lo else 0), per[lo:hi])
            yield self.compare(q, w, radius)
            lo = hi

    def compare(self, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.word[q] == w
        lane = self.lane[q].astype(np.uint64)
        allowed = np.where(own, ~((np.uint64(2) << lane) - np.uint64(1)), ~np.uint64(0)) & self.valid[w]
        depth = radius.bit_length()
        c, over, f = [np.zeros(len(q), np.uint64) for _ in range(depth)], ~allowed, self.fps[q]
        diff = lambda b: self.planes[b][w] ^ (np.uint64(0) - (f >> np.uint64(b) & np.uint64(1)))
        for b in range(0, 64, 3):
            x = diff(b)
            if b < 63:
                y, z = diff(b + 1), diff(b + 2)
                xy = x ^ y
                ones, twos = xy ^ z, (x & y) | (z & xy)
                over = add_plane(c, over, ones)
                over = add_plane(c, over, twos, 1) if depth > 1 else over | twos
            else:
                over = add_plane(c, over, x)
            if b in (21, 30, 42, 54, 63):
                over = exceeds(c, over, radius)
                live = over != ~np.uint64(0)
                if not live.all():
                    q, w, f, over, c = q[live], w[live], f[live], over[live], [x[live] for x in c]
        hit, lanes = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return q[hit], self.row[w[hit] * 64 + lanes]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the labels of each pair a[i], b[i]; label[x] <= x and roots label themselves."""
    while True:
        x, y = label[a], label[b]
        m = x != y
        if not m.any():
            return label
        a, b, x, y = a[m], b[m], x[m], y[m]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def bucket_edges(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each bucket, what links of at most radius bits connect: fewer than rows."""
    if len(fps) < 2:
        return fps[:0], fps[:0]
    s, label = Sliced(fps, bucket), np.arange(len(fps))
    for a, b in s.matches(radius):
        label = join_labels(label, a, b)
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def block_masks(radius: int, n: int) -> list[int]:
    """Masks of all choices of k of radius + k blocks, k chosen for about the least work over n fingerprints."""

    def work(k: int) -> float:
        m = radius + k
        return comb(m, k) * (n * 40 + n * n / 2 ** (64 * k / m) / 2)

    k = min(range(1, 6), key=work)
    m = radius + k
    edge = [64 * i // m for i in range(m + 1)]
    blocks = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(m)]
    return [sum(c) for c in combinations(blocks, k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(src, dst): edges among distinct fingerprints (column fp) whose components are those of all links <= radius.

    A bucket of more than tile fingerprints is dealt out as tiles, each holding two of its chunks, so no task compares
    more than 2 * tile rows of a bucket at once and every pair still meets.
    """
    masks = block_masks(radius, fps.count())
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    big = rows.groupBy("t", "key").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")).where("chunks > 1")
    rows = rows.join(big, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("fp", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))

    def run(batches):
        held_f, held_b, size = [], [], 0

        def flush(cut_all: bool):
            f, b = np.concatenate(held_f), np.concatenate(held_b)
            cut = len(f) if cut_all else int(np.searchsorted(b, b[-1]))
            x, y = bucket_edges(f[:cut], b[:cut], radius)
            return x, y, f[cut:], b[cut:]

        for batch in batches:
            if not batch.num_rows:
                continue
            held_f.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= 8 * tile and held_b[0][0] != held_b[-1][-1]:
                x, y, f, b = flush(False)
                held_f, held_b, size = [f], [b], len(f)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["src", "dst"])
        if held_f:
            x, y, _, _ = flush(True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["src", "dst"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(run), "src long, dst long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per input row: doc_id, text_key (64-bit hash of the text), fp, component_id, keeper.

    component_id is the smallest doc_id reachable over links of at most radius differing bits. keeper marks one
    (doc_id, text_key) of each component: the smallest id, then the smallest text_key. Null and empty texts have
    fingerprint 0 and link like any other; null ids never give a component its name unless it has no other (then it is
    null). Repeated rows come out as often as they came in. Other columns are not looked at.
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = materialize(add_fingerprint(docs, text, {"doc_id": F.col(doc_id), "text_key": key}, shingle), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    fps = materialize(rows.groupBy("fp").agg(F.min(order).alias("first")), "fps")
    comp = connected_components(near_links(fps, radius))
    linked = fps.join(comp.withColumnRenamed("node", "fp"), "fp")
    # aggregated sides are written first: both sides of these joins are then plain shuffles, whose hot keys Spark can split
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = materialize(linked.select("fp", "root").join(least, "root").select("fp", "least"), "named")
    first = materialize(fps.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")), "firsts")
    discard(fps), discard(least), discard(named)
    out = rows.join(first, "fp")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select("doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"), same.alias("keeper"))


def fp_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def set_print(shingles: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes; 0 for the empty set."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(shingles), 1 << 16):
        part = shingles[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(shingles), bitorder="little").view("<u8")[0])


def text_sets(texts: list[str | None], cache: HashCache) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's five-word shingles; a text of fewer words is one shingle, one of none has none."""
    split = [words(t) for t in texts]
    long = [i for i, w in enumerate(split) if len(w) >= SHINGLE]
    sets = [np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64) for w in split]
    for i, x in zip(long, shingle_sets([b" ".join(split[i]) for i in long], cache)[0] if long else []):
        sets[i] = x
    return sets


def with_sets(rows: DataFrame) -> DataFrame:
    """doc_id, rid, own of rows with node (a hash of the shingle set), fp (its SimHash) and keys (its bands)."""

    def run(batches):
        cache = HashCache()
        for b in batches:
            for part in portions(b, 3, 2_000_000):
                sets = text_sets(part.column(3).to_pylist(), cache)
                some = [i for i, x in enumerate(sets) if len(x)]
                keys = np.zeros((len(sets), BANDS), np.int64)
                if some:
                    keys[some] = band_keys([sets[i] for i in some], BANDS, ROWS)
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64).view(np.int64)
                fp = np.array([set_print(x) for x in sets], np.uint64).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(node), pa.array(fp), listed], ["doc_id", "rid", "own", "node", "fp", "keys"])

    return rows.select("doc_id", "rid", "own", "text").mapInArrow(frugal(run), "doc_id long, rid long, own long, node long, fp long, keys array<bigint>")


def meeting(members: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(bucket, node) of members (bucket, node, fp) that have another fp within radius bits in their bucket. A bucket of
    more than tile members is dealt out as tiles of two chunks each, so every pair still meets."""
    big = members.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")).where("chunks > 1")
    m = members.join(big, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    m = m.withColumn("at", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    m = m.withColumn("tile", F.xxhash64("bucket", F.least("at", "other"), F.greatest("at", "other")))

    def run(batches):
        held = None

        def met(x):
            s, hit = Sliced(x[0].view(np.uint64), x[1]), np.zeros(len(x[0]), bool)
            for a, b in s.matches(radius):
                hit[a] = hit[b] = True
            return pa.RecordBatch.from_arrays([pa.array(x[2][hit]), pa.array(x[3][hit])], ["bucket", "node"])

        for b in batches:
            x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = x if held is None else [np.concatenate(c) for c in zip(held, x)]
            cut = int(np.searchsorted(held[1], held[1][-1])) if len(held[1]) >= 4 * tile else 0
            if cut:
                yield met([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield met(held)

    return m.select("fp", "tile", "bucket", "node").repartition("tile").sortWithinPartitions("tile").mapInArrow(frugal(run), "bucket long, node long").distinct()


def drop_near_duplicates(docs: DataFrame, radius: int = WIDE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of near copies left; columns as they came, whatever their names.

    Near copies are texts whose sets of five-word shingles have a Jaccard of at least threshold, and what such links
    reach. Texts that share a band of minima are compared by SimHash in bit slices, and the exact Jaccard decides among
    those within radius bits. At 0.8 a pair shares a band with probability 0.9998 and differs in about 10 bits, with a
    deviation of 3, so the radius of 24 loses next to none; unrelated texts differ in 32.

    The row of the smallest id stays, null ids last, then of the smallest hash of the text; of rows that are equal in both
    any one. Null texts and those without words are one group; a text of fewer than five words links with those of the same
    words only. An empty table gives an empty result.
    """
    own, rid = fresh("own"), fresh("rid")
    # hashes of text, and of id and text: a row's name in joins, which no hot text gathers in one task
    rows = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(rid, F.xxhash64(F.col("doc_id").isNull(), "doc_id", own))
    sets = materialize(with_sets(rows.select("doc_id", F.col(rid).alias("rid"), F.col(own).alias("own"), "text")), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own", "rid")
    nodes = materialize(sets.groupBy("node").agg(F.min(F.struct(first.alias("first"), "fp", "keys")).alias("x")).select("node", "x.*"), "nodes")
    discard(sets)
    members = buckets(nodes).join(nodes.select("node", "fp"), "node")
    met = materialize(meeting(members, radius), "met")
    texts = rows.select(F.col(rid).alias("rid"), F.col(own).alias("own"), F.col("text").alias("body"))
    wanted = materialize(nodes.join(met.select("node").distinct(), "node").select("node", "first.rid", "first.own"), "wanted")
    bodies = materialize(texts.dropDuplicates(["rid", "own"]).join(wanted, ["rid", "own"]).select("node", "body"), "bodies")
    comp = connected_components(verified_links(met, bodies, threshold))
    kept = nodes.join(comp, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    ident, key = fresh("id"), fresh("key")
    kept = materialize(kept.select(F.col("first.rid").alias(ident), F.col("first.own").alias(key)), "kept")
    for t in (nodes, met, wanted, bodies):
        discard(t)
    # repeated rows are one before the shuffle, which the join then shares
    once = rows.dropDuplicates([rid, own])
    return once.join(kept, (F.col(rid) == F.col(ident)) & (F.col(own) == F.col(key)), "left_semi").drop(rid, own)
