"""Repeated passages: paragraph MinHash banding, exact Jaccard, components, removals.

A paragraph is a line of at least `least` words; its shingles are five words. Equal lines are one node, so copies never
meet as pairs. Each node's MinHash signature is cut into bands, and nodes that share a band meet in a bucket, where exact
Jaccard on the shingle sets decides. Components of the links give the clusters; all but the first occurrence of a cluster
are removals. Any other passage, inside lines or over several, short ones too, is found by anchors: of any WINDOW runs of
PIECE words in a row of a whole text, whatever its lines, the one of least hash is an anchor, so two texts that share
PIECE + WINDOW - 1 words share one. Equal texts are one node. Each text is compared with the first holder of each of its
anchors, and the shared words around the anchor are followed to both sides as far as they go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftlog.llm.common import HashCache, discard, frugal, materialize, mix, ngram_hashes
from driftlog.llm.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: 8 bands of 2 rows: a pair of Jaccard 0.8 shares one with probability 1 - (1 - 0.8^2)^8 > 0.9997; unrelated
#: paragraphs have hardly a shingle in common, so the low threshold costs few false candidates.
BANDS, ROWS = 8, 2
#: Winnowing: any shared run of PIECE + WINDOW - 1 = 50 words has a common anchor.
PIECE, WINDOW = 25, 26
#: Members of a bucket that one tile verifies against as many others.
TILE = 2048
#: A line, or with a null body a text that has anchors; short: some of its words are in lines of fewer than the least words.
UNIT = "doc_id long, row long, start long, end long, n_words long, node long, keys array<bigint>, anchors array<bigint>, places array<bigint>, body string, short boolean"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def anchors(runs: np.ndarray, line: np.ndarray, most: int = 100_000) -> np.ndarray:
    """Indices of the first least run of each WINDOW runs in a row within one text; all runs of a shorter text are one
    window. line: each run's text, ascending."""
    if not len(runs):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(new, len(runs)))
    short = size < WINDOW
    lead = np.minimum.reduceat(runs, new)
    low = np.flatnonzero((runs == np.repeat(lead, size)) & np.repeat(short, size))
    found = [low[np.concatenate(([True], line[low][1:] != line[low][:-1]))] if len(low) else low]
    left = np.repeat(new + size, size) - np.arange(len(runs))
    start = np.flatnonzero(left >= WINDOW)
    if len(start):
        view = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
        for lo in range(0, len(start), most):
            at = start[lo : lo + most]
            found.append(np.unique(at + view[at].argmin(axis=1)))
    return np.unique(np.concatenate(found))


def shingles(h: np.ndarray, off: np.ndarray, wanted) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each wanted run h[off[i]:off[i + 1]] of words (all words as one if they are fewer)."""
    s, at = ngram_hashes(h, off, SHINGLE)
    cut = np.searchsorted(at, off)
    return [np.unique(s[cut[i] : cut[i + 1]]) if cut[i + 1] > cut[i] else mix(h[off[i] : off[i + 1]].sum(keepdims=True)) for i in wanted]


def shingle_sets(bodies: list[bytes], cache: HashCache) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Shingles of each body; words' hashes and offsets."""
    flat, off = [], [0]
    for t in bodies:
        flat.extend(map(cache.__getitem__, t.lower().split()))
        off.append(len(flat))
    h, off = np.array(flat, np.uint64), np.array(off)
    return shingles(h, off, range(len(bodies))), h, off


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes, one line per set: each joins `rows` minima over multiply-mixed copies of the hashes."""
    all_, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            k = b * rows + r + 1
            m = (all_ ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64((k * 0xD1342543DE82EF95 | 1) % 2**64)
            out[:, b] = mix(out[:, b] * np.uint64(31) + np.minimum.reduceat(m ^ (m >> np.uint64(29)), first) + np.uint64(b))
    return out.view(np.int64)


def units(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """Lines as they are written, with band keys, and texts with anchors and their places: node is a 64-bit hash of the
    line or text (of a text that of F.xxhash64), row one of the document's id and text."""

    def run(batches):
        cache = HashCache()
        longs = ["doc_id", "row", "start", "end", "n_words", "node"]
        names = [*longs, "keys", "anchors", "places", "body", "short"]
        listed = lambda x, e: pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x, pa.int64()))
        for b in batches:
            lines: dict[str, list] = {n: [] for n in (*longs, "body")}
            texts: list[tuple] = []
            flat, line_off, text_off, wanted = [], [0], [0], []

            def flush():
                h, off = np.array(flat, np.uint64), np.array(text_off)
                n = len(wanted)
                if n:
                    keys = band_keys(shingles(h, np.array(line_off), wanted))
                    none = pa.nulls(n, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(lines[c], pa.int64()) for c in longs), listed(keys.ravel(), np.arange(n + 1) * BANDS), none, none, pa.array(lines["body"], pa.string()), pa.nulls(n, pa.bool_())], names)
                runs, at = ngram_hashes(h, off, PIECE)
                of = np.searchsorted(off, at, side="right") - 1
                spot = anchors(runs, of)
                ends = np.searchsorted(of[spot], np.arange(len(texts) + 1))
                some = np.flatnonzero(np.diff(ends))
                if len(some):
                    cols = [pa.array([texts[i][k] for i in some.tolist()], pa.int64()) for k in range(len(longs))]
                    ends = np.append(ends[some], ends[-1])
                    yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(some), pa.list_(pa.int64())), listed(runs[spot].view(np.int64), ends), listed((at - off[of])[spot], ends), pa.nulls(len(some), pa.string()), pa.array([texts[i][-1] for i in some.tolist()], pa.bool_())], names)
                for v in (*lines.values(), texts, flat, wanted):
                    v.clear()
                line_off[:], text_off[:] = [0], [0]

            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                row = signed(xxhash.xxh64_intdigest(f"{i}\n{t}".encode("utf-8", "surrogatepass")))
                at, short = 0, False
                for line in t.split("\n"):
                    raw = line.encode("utf-8", "surrogatepass")
                    words = raw.lower().split()
                    if words:
                        flat.extend(map(cache.__getitem__, words))
                        line_off.append(len(flat))
                        if len(words) >= least:
                            wanted.append(len(line_off) - 2)
                            for k, v in zip(lines, (i, row, at, at + len(line), len(words), signed(xxhash.xxh64_intdigest(raw)), line)):
                                lines[k].append(v)
                        else:
                            short = True
                    at += len(line) + 1
                texts.append((i, row, 0, len(t), len(flat) - text_off[-1], signed(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42)), short))
                text_off.append(len(flat))
                if len(flat) >= 150_000:
                    yield from flush()
            if texts:
                yield from flush()

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(frugal(run), UNIT)


def buckets(lines: DataFrame) -> DataFrame:
    """(bucket, node) of band buckets with at least two nodes; buckets of the same nodes are one, named by a hash of their
    nodes. A bucket is summed up before the shuffle and never gathered."""
    keys = materialize(lines.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key")), "keys")
    named = keys.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("all")).where("n > 1")
    named = materialize(named.select("key", F.xxhash64("n", "all").alias("bucket")), "named")
    out = materialize(keys.join(named, "key").select("bucket", "node").distinct(), "buckets")
    discard(keys), discard(named)
    return out


def verified_links(members: DataFrame, bodies: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(src, dst): edges whose components are those of all pairs of a bucket with Jaccard of at least threshold.

    A bucket of more than tile nodes is dealt out as tiles of two of its chunks each. In a tile a node is compared with
    the members of each component until one links: components, not pairs, are asked for.
    """
    big = members.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")).where("chunks > 1")
    m = members.join(big, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    m = m.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    m = m.select("node", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("tile"))
    m = m.join(bodies, "node")

    def link(nodes: list[int], texts: list[str], cache: HashCache):
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts], cache)[0]
        comps: list[list[int]] = []
        for v in range(len(nodes)):
            joined = None
            for c in list(comps):
                for u in c:
                    small, large = sorted((len(sets[u]), len(sets[v])))
                    if small >= threshold * large:
                        both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                        if both >= threshold * (small + large - both):
                            yield nodes[v], nodes[u]
                            if joined is None:
                                joined = c
                                c.append(v)
                            else:
                                joined.extend(c)
                                comps.remove(c)
                            break
            if joined is None:
                comps.append([v])

    def run(batches):
        cache, last, nodes, texts = HashCache(), None, [], []
        for b in batches:
            out = []
            for n, t, x in zip(*(b.column(k).to_pylist() for k in range(3))):
                if t != last:
                    out += link(nodes, texts, cache)
                    last, nodes, texts = t, [], []
                nodes.append(n), texts.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["src", "dst"])
        out = list(link(nodes, texts, cache))
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["src", "dst"])

    return m.select("node", "tile", "body").repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(frugal(run), "src long, dst long")


def with_order(lines: DataFrame) -> DataFrame:
    return lines.withColumn("order", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start"))


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(node, f_node, first, at): at are the places of anchors in a text and in the text that holds them first, whose first
    occurrence is first."""
    spots = with_order(texts).select("node", "order", F.explode(F.arrays_zip("anchors", "places")).alias("s")).select("node", "order", F.col("s.anchors").alias("anchor"), F.col("s.places").alias("place"))
    ends = [f(c).alias(f"{k}_{c}") for c in ("node", "place") for k, f in (("lo", F.min), ("hi", F.max))]
    held = spots.groupBy("anchor").agg(F.min(F.struct("order", "node", "place")).alias("f"), *ends).where("lo_node <> hi_node or lo_place <> hi_place")
    held = materialize(held.select("anchor", F.col("f.node").alias("f_node"), F.col("f.place").alias("f_place"), F.col("f.order").alias("first")), "anchors")
    hits = spots.select("anchor", "node", "place").join(held, "anchor").where("node <> f_node or place <> f_place")
    out = hits.groupBy("node", "f_node").agg(F.min("first").alias("first"), F.collect_set(F.struct("place", "f_place")).alias("at"))
    out = materialize(out, "hits")
    discard(held)
    return out


def common_runs(h: np.ndarray, g: np.ndarray, at: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(a, b, f_a): the longest h[a:b] = g[f_a:f_a + b - a] around each pair of places of at, but for some that lie inside
    another h[a:b] of the list: words that come again and again match at many distances."""
    found: dict[tuple[int, int], int] = {}
    by: dict[int, list[int]] = {}
    for p, q in at:
        by.setdefault(p - q, []).append(p)
    n, m = len(h), len(g)
    for d in sorted(by, key=lambda d: (-len(by[d]), d)):
        lo, hi = max(0, d), min(n, m + d)
        # a run cannot leave a stretch [a, b) if the words before and after differ at this distance
        shut = [(a, b) for a, b in found if a < hi and lo < b and (a <= lo or h[a - 1] != g[a - 1 - d]) and (b >= hi or h[b] != g[b - d])]
        left = [p for p in by[d] if not any(a <= p < b for a, b in shut)]
        if left:
            cut = np.flatnonzero(h[lo:hi] != g[lo - d : hi - d]) + lo
            for p in left:
                k = int(np.searchsorted(cut, p))
                a, b = int(cut[k - 1]) + 1 if k else lo, int(cut[k]) if k < len(cut) else hi
                if b - a >= PIECE:  # else another text's run has the anchor's hash
                    found.setdefault((a, b), a - d)
    return sorted((a, b, f) for (a, b), f in found.items())


def word_spans(t: str) -> np.ndarray:
    """Start and end of each word, in code points."""
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.zeros(len(c) + 2, np.int8)
    word[1:-1] = (c != 0x20) & ((c < 0x09) | (c > 0x0D))
    return np.flatnonzero(np.diff(word)).reshape(-1, 2)


def line_around(t: str, s: int, e: int) -> str | None:
    """The line that holds t[s:e], if one does."""
    if t.find("\n", s, e) >= 0:
        return None
    end = t.find("\n", e)
    return t[t.rfind("\n", 0, s) + 1 : end if end >= 0 else len(t)]


def stretches(hits: DataFrame, bodies: DataFrame, least: int) -> DataFrame:
    """(node, a, s, e, n, f_node, f_a, f_b, f_s, f_e, first): n words from word a on, characters s to e of a text, repeat
    words f_a to f_b, characters f_s to f_e, of the text f_node. Only the longest are left, of equal ones the first; what
    lies within equal lines of at least `least` words is not among them."""
    both = hits.join(bodies, "node").join(bodies.select(F.col("node").alias("f_node"), F.col("body").alias("f_body")), "f_node")
    kinds = "node long, a long, s long, e long, n long, f_node long, f_a long, f_b long, f_s long, f_e long, first struct<none:boolean,doc_id:bigint,row:bigint,start:bigint>"
    names = ["node", "a", "s", "e", "n", "f_node", "f_a", "f_b", "f_s", "f_e"]

    def run(batches):
        cache = HashCache()

        def hashes(t):
            w = t.encode("utf-8", "surrogatepass").lower().split()
            return np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))

        last = g = y = None
        for b in batches:
            out, source = [], []
            node, f_node, body, f_body = (b.column(k).to_pylist() for k in (0, 1, 4, 5))
            at = b.column(3)
            for i in range(b.num_rows):
                if f_node[i] != last:  # a join's rows come by f_node
                    last, g, y = f_node[i], hashes(f_body[i]), None
                h = g if node[i] == last else hashes(body[i])
                pairs = at[i].values
                runs = common_runs(h, g, list(zip(pairs.field(0).to_pylist(), pairs.field(1).to_pylist())))
                if runs:
                    y = word_spans(f_body[i]) if y is None else y
                    x = y if node[i] == last else word_spans(body[i])
                    for a, e, f in runs:
                        here, there = ((int(z[k][0]), int(z[k + e - a - 1][1])) for z, k in ((x, a), (y, f)))
                        line = line_around(body[i], *here)
                        if line is None or line != line_around(f_body[i], *there) or len(line.encode("utf-8", "surrogatepass").split()) < least:
                            out.append((node[i], a, *here, e - a, f_node[i], f, f + e - a, *there))
                            source.append(i)
            cols = [pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, b.column(2).take(pa.array(source, pa.int64()))], [*names, "first"])

    all_ = both.select("node", "f_node", "first", "at", "body", "f_body").mapInArrow(frugal(run), kinds)
    # an anchor at a passage's end may be none in the text that holds the passage first, so it has another first holder
    longer = W.partitionBy("node").orderBy("a", F.desc("n"), "first").rowsBetween(W.unboundedPreceding, -1)
    return all_.withColumn("past", F.max(F.col("a") + F.col("n")).over(longer)).where("past is null or past < a + n").drop("past")


def inner_passages(texts: DataFrame, hits: DataFrame, bodies: DataFrame, least: int) -> DataFrame:
    """Rows of repeated_passages() of kind 1."""
    runs = materialize(stretches(hits, bodies, least), "stretches")
    spans = runs.select("f_node", "f_a", "f_b", "f_s", "f_e", "first").dropDuplicates(["f_node", "f_a", "f_b"])
    before = W.partitionBy("f_node").orderBy("f_a", "f_b").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("f_node").orderBy("f_a", "f_b").rowsBetween(W.unboundedPreceding, 0)
    new = F.coalesce(F.col("f_a") >= F.max("f_b").over(before), F.lit(True))
    spans = spans.withColumn("new", new).withColumn("own", F.max(F.when(F.col("new"), F.col("f_a"))).over(upto))
    spans = materialize(spans.withColumn("cluster", F.xxhash64("f_node", "own")), "spans")
    own = spans.groupBy("f_node", "cluster").agg(F.min("f_a").alias("a"), F.max("f_b").alias("b"), F.min("f_s").alias("s"), F.max("f_e").alias("e"), F.min("first").alias("first"))
    parts = runs.join(spans.select("f_node", "f_a", "f_b", "cluster"), ["f_node", "f_a", "f_b"]).select("node", "s", "e", "n", "cluster", "first", F.lit(False).alias("own"))
    parts = parts.unionByName(own.select(F.col("f_node").alias("node"), "s", "e", (F.col("b") - F.col("a")).alias("n"), "cluster", "first", F.lit(True).alias("own")))
    # equal texts are one node: where some of their lines have no rows, the whole text is a passage
    equal = with_order(texts).where("short").groupBy("node").agg(F.count("*").alias("times"), F.min("order").alias("first"), F.first("end").alias("e"), F.first("n_words").alias("n")).where("times > 1")
    parts = parts.unionByName(equal.select("node", F.lit(0).cast("long").alias("s"), "e", "n", F.xxhash64("node").alias("cluster"), "first", F.lit(True).alias("own")))
    parts = materialize(parts.groupBy("node").agg(F.collect_set(F.struct("s", "e", "n", "cluster", "first", "own")).alias("parts")), "parts")
    discard(runs), discard(spans)
    t = with_order(texts.select("doc_id", "row", "start", "node")).join(parts, "node").select("doc_id", "start", "order", F.explode("parts").alias("p"))
    removed = ~F.col("p.own") | (F.col("order") != F.col("p.first"))
    at = lambda c: (F.col("start") + F.col(c)).cast("long")
    return t.select("doc_id", F.lit(1).alias("kind"), at("p.s").alias("start"), at("p.e").alias("end"), F.col("p.n").alias("n_words"), F.col("p.cluster").alias("cluster"), F.col("p.first.doc_id").alias("first_doc"), removed.alias("removed"))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 20, threshold: float = THRESHOLD) -> DataFrame:
    """One row per occurrence of a paragraph, or of a passage inside or over lines: doc_id, kind (0 line, 1 passage),
    start, end (code points), n_words, cluster (smallest node of its component; of a passage, a hash of where it occurs
    first), first_doc, removed.

    A run of 50 words and more that texts share, however it is cut into lines, holds an anchor, and a run of PIECE words and
    more may. A passage's row goes from an anchor as far to both sides as its words equal those around the anchor's first
    occurrence; stretches that overlap there are one passage. Words beyond, that others share but not that first text, have
    rows of their own if they hold an anchor. What lies within one line of at least `least` words that is equal in both
    texts is left to these lines' rows. Equal texts get a row over the whole text if some of their lines are shorter.

    The occurrence that stays is the one with the smallest (doc_id, row, start), null ids last. Null and empty texts have
    no paragraphs; rows with equal id and text share their verdict; other columns are not looked at; an empty table gives
    an empty result.
    """
    found = materialize(units(docs, doc_id, text, least), "units")
    lines, texts = found.where("body is not null"), found.where("body is null")
    members = buckets(lines)
    bodies = materialize(lines.select("node", "body").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "bodies")
    links = materialize(verified_links(members, bodies, threshold), "links")
    discard(members)
    comp = connected_components(links).withColumnRenamed("root", "cluster")
    n = lines.groupBy("node").agg(F.count("*").alias("n")).join(comp, "node", "left").where("n > 1 or cluster is not null")
    # aggregated sides are written first: both sides of these joins are then plain shuffles, whose hot keys Spark can split
    known = materialize(n.select("node", F.coalesce("cluster", "node").alias("cluster")), "known")
    discard(links)
    t = materialize(with_order(lines.select("doc_id", "row", "start", "end", "n_words", "node")).join(known, "node"), "occurrences")
    first = materialize(t.groupBy("cluster").agg(F.min("order").alias("first")), "first")
    whole = t.join(first, "cluster").select("doc_id", F.lit(0).alias("kind"), "start", "end", "n_words", "cluster", F.col("first.doc_id").alias("first_doc"), (F.col("order") != F.col("first")).alias("removed"))
    discard(bodies), discard(known)
    hits = shared_anchors(texts)
    wanted = materialize(hits.select("node").union(hits.select("f_node")).distinct(), "wanted")
    bodies = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("body"))
    bodies = materialize(bodies.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "bodies")
    inner = inner_passages(texts, hits, bodies, least)
    discard(hits), discard(bodies), discard(wanted)
    return whole.unionByName(inner)
