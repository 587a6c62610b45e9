"""K-d tree sharding: weighted medians along the widest metadata dimension until leaves hold the target bytes.

Every row gets a coordinate per dimension, scaled to the whole axis: the logarithm of its size, and the rank of each of
its names among the distinct names in byte order. A 48-bit sort key per dimension puts the coordinate above a hash of
the row, so ties split evenly. All rows go through the tree, and all nodes of a level are cut in the same jobs. A cut is
an exact weighted quantile found by radix search: each pass sums weights by (node, next digit of the key), which Spark
pre-aggregates; only these sums, at most shards x 4096 numbers, come to the driver. A node with an odd number of leaves
is cut in that proportion. Rows with their node are written once a level, so plans do not grow with the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftlog.llm.common import discard, fresh, materialize

COORD_BITS, DIGIT_BITS, DIGITS = 20, 12, 4
TIE_BITS = DIGIT_BITS * DIGITS - COORD_BITS
TOP = 2**COORD_BITS - 1
#: A table of names of at most this many rows, of 8 bytes and a name each, is broadcast; a larger one is joined in salted parts.
NAMES_AT_ONCE, SALTS = 100_000, 32


def key(coord: Column, tie: Column) -> Column:
    return F.shiftleft(coord.cast("long"), TIE_BITS).bitwiseOR(tie)


def name_ranks(docs: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(name, coord) of the distinct names, null as empty, and their number. Names are sorted in ranges; a name's rank is
    its place in its range, behind the ranges before."""
    names = docs.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("name")).distinct()
    sorted_ = names.repartitionByRange("name").sortWithinPartitions("name").withColumn("at", F.monotonically_increasing_id())
    t = materialize(sorted_, "kd-names")
    range_, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, before, n = t.groupBy(range_.alias("r")).count().collect(), {}, 0
    for r in sorted(sizes, key=lambda r: r.r):
        before[r.r] = n
        n += r["count"]
    rank = place + (lookup(before, range_) if before else F.lit(0))
    ranked = materialize(t.select("name", (rank * TOP / max(1, n - 1)).cast("long").alias("coord")), "kd-ranks")
    discard(t)
    return ranked, n


def with_coord(rows: DataFrame, ranked: DataFrame, n: int, column: str, out: str) -> DataFrame:
    """rows, column replaced by the coordinate of its name."""
    ranked = ranked.withColumnsRenamed({"name": column, "coord": out})
    if n <= NAMES_AT_ONCE:
        return rows.join(F.broadcast(ranked), column, "left").drop(column)
    salt = fresh("salt")
    parts = ranked.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(parts, [column, salt], "left").drop(column, salt)


def lookup(table: dict, at: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), at)


@dataclass
class Node:
    """Leaves lo to hi - 1. Cut: rows left of `at` on the axis go left, and of the others those with a weight of at most
    `least` that are left of `fill`."""

    ident: int
    lo: int
    hi: int
    axis: int = 0
    at: int = 0
    least: int = -1
    fill: int = 0

    @property
    def mid(self) -> int:
        return (self.lo + self.hi) // 2


def quantile(rows: DataFrame, want: dict[int, float]) -> dict[int, tuple[int, float]]:
    """Node -> (key, weight): the rows below the key weigh the most that is not above want. rows: node, key, weight."""
    prefix, before = dict.fromkeys(want, 0), dict.fromkeys(want, 0)
    rows = rows.where(F.col("node").isin(list(want)))
    for i in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - i)
        here = rows if i == 0 else rows.where(F.shiftright("key", shift + DIGIT_BITS) == lookup(prefix, F.col("node")))
        sums: dict[int, list] = {k: [] for k in want}
        for r in here.groupBy("node", F.shiftright("key", shift).alias("at")).agg(F.sum("weight").alias("w")).collect():
            sums[r.node].append((r["at"], r.w))
        for k, s in sums.items():
            s.sort()
            last = prefix[k] << DIGIT_BITS
            for at, w in s:
                last = at
                if before[k] + w > want[k]:
                    break
                before[k] += w
                last = at + 1
            prefix[k] = last
        done = {k for k, s in sums.items() if not s or prefix[k] > s[-1][0]}  # want covers all that is left: no row above
        for k in done:
            want = {x: v for x, v in want.items() if x != k}
            prefix[k] <<= shift
        if not want:
            break
        rows = rows.where(F.col("node").isin(list(want))) if done else rows
    return {k: (prefix[k], before[k]) for k in before}


def cut_level(rows: DataFrame, nodes: list[Node], dims: list[str], slack: float) -> None:
    """Set the nodes' cuts. A cut that leaves more than slack lacking on the left, because a large row straddles it, lets
    the next rows of at most a quarter of the gap fill it."""
    level = rows.where(F.col("node").isin([n.ident for n in nodes]))
    ends = [f(F.shiftright(d, TIE_BITS)).alias(f"{k}{d}") for d in dims for k, f in (("lo_", F.min), ("hi_", F.max))]
    stats = {r.node: r for r in level.groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()}
    for n in nodes:
        if n.ident in stats:
            r = stats[n.ident]
            n.axis = max(range(len(dims)), key=lambda i: (r["hi_" + dims[i]] - r["lo_" + dims[i]], -i))
    nodes = [n for n in nodes if n.ident in stats]
    if not nodes:
        return
    chosen = F.get(F.array(*dims), lookup({n.ident: n.axis for n in nodes}, F.col("node")))
    level = level.select("node", "weight", chosen.alias("key"))
    want = {n.ident: stats[n.ident].w * (n.mid - n.lo) / (n.hi - n.lo) for n in nodes}
    gap = {}
    for k, (at, w) in quantile(level, dict(want)).items():
        n = next(n for n in nodes if n.ident == k)
        n.at = at
        if want[k] - w > slack:
            gap[k] = want[k] - w
    if gap:
        least = {k: int(g / 4) for k, g in gap.items()}
        at = lookup({n.ident: n.at for n in nodes if n.ident in gap}, F.col("node"))
        more = level.where(F.col("node").isin(list(gap))).where((F.col("key") >= at) & (F.col("weight") <= lookup(least, F.col("node"))))
        for k, (fill, _) in quantile(more, gap).items():
            n = next(n for n in nodes if n.ident == k)
            n.least, n.fill = least[k], fill


def children(nodes: list[Node], dims: list[str]) -> Column:
    """The node of the next level; rows at a leaf stay."""
    cell = {n.ident: F.struct(F.lit(n.axis).alias("axis"), F.lit(n.at).cast("long").alias("at"), F.lit(n.least).cast("long").alias("least"), F.lit(n.fill).cast("long").alias("fill")) for n in nodes}
    cut = F.element_at(F.create_map(*(x for k, v in cell.items() for x in (F.lit(k), v))), F.col("node"))

    def side(c: Column) -> Column:
        k = F.get(F.array(*dims), c["axis"])
        left = (k < c["at"]) | ((F.col("weight") <= c["least"]) & (k < c["fill"]))
        return F.when(c.isNull(), F.col("node")).when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)

    return F.element_at(F.transform(F.array(cut), side), 1)


def most_in_a_row(rows: DataFrame, shards: int) -> tuple[int, float]:
    """Bytes of all rows, and the most of one row that counts as weight: a row that is larger than what the others leave
    to a shard has a shard for itself. At most `shards` rows can be so large."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = [r.size for r in rows.select(F.col("size")).orderBy(F.desc("size")).limit(shards).collect()]
    rest, left = total, shards
    for s in large:
        if left < 2 or s * left <= rest:
            break
        rest, left = rest - s, left - 1
    return total, rest / left


def kd_tree(docs: DataFrame, shards: int, doc_id: str, text: str, meta: tuple[str, ...]) -> tuple[DataFrame, list[Node], list[str]]:
    """Rows with their leaf (node), the inner nodes, and the names of the key columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    crc, size = F.crc32(F.encode(t, "UTF-8")), (F.octet_length(t) + 8).cast("long")
    row = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), t)
    names = [m for m in meta if m in docs.columns]
    cols = [F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"n_{i}") for i, m in enumerate(names)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), row.alias("row"), *cols)
    for i, m in enumerate(names):
        rows = with_coord(rows, *name_ranks(docs, m), f"n_{i}", f"c_{i}")
    rows = materialize(rows, "kd")
    total, most = most_in_a_row(rows, shards)
    lo, hi = rows.agg(F.min("size"), F.max("size")).first()
    wide = F.log2(F.col("size").cast("double")) - F.log2(F.lit(float(lo or 1)))
    span = F.log2(F.lit(float(hi or 2))) - F.log2(F.lit(float(lo or 1)))
    coords = [F.when(span > 0, F.least(F.lit(TOP), (wide / span * TOP).cast("long"))).otherwise(F.lit(0)), *(F.col(f"c_{i}") for i in range(len(names)))]
    dims = [f"d_{i}" for i in range(len(coords))]
    tie = F.xxhash64(F.lit(1), "row").bitwiseAND(F.lit(2**TIE_BITS - 1))
    keyed = rows.select("doc_id", "size", "text_crc32", "row", F.least(F.col("size"), F.lit(int(most) + 1)).alias("weight"), *(key(c, tie).alias(d) for c, d in zip(coords, dims)), F.lit(0).alias("node"))
    at = materialize(keyed, "kd-0")
    discard(rows)
    level, inner = [Node(0, 0, shards)], []
    while level := [n for n in level if n.hi - n.lo > 1]:
        cut_level(at, level, dims, total / shards / 1000)
        inner += level
        below = materialize(at.withColumn("node", children(level, dims)), "kd-level")
        discard(at)
        at = below
        level = [c for n in level for c in (Node(2 * n.ident + 1, n.lo, n.mid), Node(2 * n.ident + 2, n.mid, n.hi))]
    return at, inner, dims


def leaves(inner: list[Node]) -> dict[int, int]:
    """Leaf node -> shard."""
    out = {0: 0} if not inner else {}
    for n in inner:
        for c, lo, hi in ((2 * n.ident + 1, n.lo, n.mid), (2 * n.ident + 2, n.mid, n.hi)):
            if hi - lo == 1:
                out[c] = lo
    return out


def kd_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in its shard).

    The law is `bytes`: shards hold near equal sums of size (UTF-8 bytes of the text, none for null, plus 8). Rows weigh
    their size, but no more than a shard's share, so that one that is larger gets a shard for itself. Where a large row
    straddles a cut, it stays on the right and small rows from there fill the gap. Equal texts share all but their tie
    hash; a group of copies stays together unless a cut runs through it. Repeated rows keep their number. Null metadata
    counts as empty, missing metadata columns are left out, other columns are not looked at. An empty table gives an
    empty result; with fewer rows than shards some shards stay empty.
    """
    at, inner, _ = kd_tree(docs, shards, doc_id, text, meta)
    shard = lookup(leaves(inner), F.col("node"))
    placed = materialize(at.select("doc_id", "size", "text_crc32", "row", shard.alias("shard")), "kd-shards")
    discard(at)
    return number(placed)


def number(placed: DataFrame, per_bin: int = 20_000) -> DataFrame:
    """Slots: rows are numbered inside hash bins of about per_bin rows, behind the rows of the bins before them."""
    bins = max(1, placed.count() // per_bin)
    b = placed.withColumn("bin", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(bins)))
    per = b.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    w = W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    first = per.select("shard", "bin", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    b = b.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bin").orderBy("row", "doc_id")) - 1)
    return b.join(first, ["shard", "bin"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("first") + F.col("rank")).alias("slot"))
