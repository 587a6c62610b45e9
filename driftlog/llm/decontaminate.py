"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman scores the alignments."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftlog.llm.common import HashCache, discard, fresh, frugal, materialize, mix

WORD = re.compile(r"\w+")
SEED = 4
MATCH, MISMATCH, GAP = 2.0, -1.0, 1.0
#: Most words of items that the driver holds and sends to every executor at once; a larger benchmark is taken in parts.
WORDS_AT_ONCE = 1_000_000
#: A seed is rare if at most RARE items hold it; an item with fewer than FLOOR rare seeds takes its rarest ones besides.
RARE, FLOOR = 16, 8


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and _, in small letters: edits of case and punctuation do not count."""
    return WORD.findall(text.lower()) if text else []


def seeds_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; n may differ from run to run of calls, so it is part of the hash."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mix(out)


def hashes(words: list[str], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def smith_waterman(a: list[str], b: list[str]) -> tuple[float, int]:
    """Best local alignment of a within b: its score, and the end of its stretch in b (exclusive)."""
    both = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([both[w] for w in a]), np.array([both[w] for w in b])
    ramp = GAP * np.arange(len(y) + 1)
    h, best, end = np.zeros(len(y) + 1), 0.0, 0
    for w in x:
        t = np.maximum(h - GAP, 0.0)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where(y == w, MATCH, MISMATCH))
        h = np.maximum.accumulate(t + ramp) - ramp
        k = int(h.argmax())
        if h[k] > best:
            best, end = float(h[k]), k
    return best, end


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Score over the score of an exact copy (0 to 1), and the stretch of the passage that it covers."""
    if not item or not passage:
        return 0.0, 0, 0
    score, end = smith_waterman(item, passage)
    _, back = smith_waterman(item[::-1], passage[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def can_reach(item: list[str], passage: list[str], threshold: float) -> bool:
    """False only if no alignment can score threshold: each match takes a word of the item that the passage has."""
    have = set(passage)
    return sum(w in have for w in item) >= threshold * len(item)


def item_seeds(benchmark: DataFrame, seed: int = SEED, rare: int = RARE, floor: int = FLOOR) -> DataFrame:
    """(item_id, words, size, seeds): the items' words, the length of their seeds (all words of a shorter item), and the
    hashes of the seeds that look for them.

    A seed's frequency is the number of items that hold it, counted on executors. A phrase that many items share, as a
    form of question, would join each document that has it to all of them: an item is looked for by its rare seeds, and by
    its rarest ones, ties included, if it has fewer than floor rare ones.
    """

    def run(batches):
        cache = HashCache()
        for b in batches:
            words = [tokens(t.as_py()) for t in b.column(1)]
            sizes = [min(seed, len(w)) for w in words]
            found = [np.unique(seeds_of(hashes(w, cache), n).view(np.int64)).tolist() if n else [] for w, n in zip(words, sizes)]
            kinds = (pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip((words, sizes, found), kinds))], ["item_id", "words", "size", "seeds"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = materialize(items.mapInArrow(frugal(run), "item_id long, words array<string>, size int, seeds array<bigint>"), "items")
    held = materialize(items.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n")), "seeds")
    one = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    by = W.partitionBy("item").orderBy("n")
    kept = one.select("item", F.explode("seeds").alias("seed")).join(held, "seed").withColumn("rank", F.rank().over(by)).where((F.col("n") <= rare) | (F.col("rank") <= floor))
    kept = kept.groupBy("item").agg(F.collect_list("seed").alias("seeds"))
    out = materialize(one.drop("seeds").join(kept, "item").select("item_id", "words", "size", "seeds"), "items")
    for t in (items, held, one):
        discard(t)
    return out


def find_passages(docs: DataFrame, items: list, doc_id: str, text: str, seed: int, threshold: float) -> DataFrame:
    """Rows (doc_id, item, first, passage): a stretch of a document around seeds that it shares with an item, unless its
    words rule out a score of threshold. items: rows of item_seeds(); item: the place in it."""
    at = np.array([s for r in items for s in r.seeds], np.int64).view(np.uint64)
    owner, length = (np.repeat(np.array(x, np.int64), [len(r.seeds) for r in items]) for x in (range(len(items)), [r["size"] for r in items]))
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    items = [list(r.words) for r in items]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((at, owner, sorted(set(length.tolist())), items))

    def run(batches):
        at, owner, sizes, named = shared.value
        cache = HashCache()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = tokens(t.as_py())
                h = hashes(w, cache)
                hits = []
                for n in sizes:
                    s = seeds_of(h, n)
                    lo = np.searchsorted(at, s)
                    for p in np.flatnonzero(at[np.minimum(lo, len(at) - 1)] == s):
                        k = int(lo[p])
                        while k < len(at) and at[k] == s[p]:
                            hits.append((int(owner[k]), int(p)))
                            k += 1
                hits.sort()
                for j, (o, p) in enumerate(hits):
                    near = hits[j - 1] if j else (-1, 0)
                    wanted = named[o]
                    m = len(wanted)
                    if near[0] != o or p - near[1] > 2 * m + seed:
                        first = p
                    last = p
                    if j + 1 == len(hits) or hits[j + 1][0] != o or hits[j + 1][1] - p > 2 * m + seed:
                        a = max(0, first - m - seed)
                        passage = w[a : last + 2 * m + seed]
                        if can_reach(wanted, passage, threshold):
                            for col, v in zip(out, (i, o, a, " ".join(passage))):
                                col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], ["doc_id", "item", "first", "passage"])

    schema = "doc_id long, item long, first long, passage string"
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(frugal(run), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): items that a document holds in part or whole, maybe edited.

    score is the best Smith-Waterman score over words, as a share of an exact copy's; threshold and more are returned. A
    pair is aligned wherever the document shares one of the item's seeds (see item_seeds), however many documents share
    it too; only stretches with too few of the item's words to reach the threshold are left out. A document without such a
    seed is not compared with the item. The driver takes the benchmark in parts of a fixed number of words, so that what
    it holds and broadcasts is bounded. Null and empty texts and items match nothing; repeated documents give equal rows
    once, as do repeated items; other columns are not looked at; an empty table gives an empty result.
    """
    seeds = item_seeds(benchmark, seed)
    found, part, n = [], [], 0

    def flush():
        if part:
            p = materialize(find_passages(docs, part, doc_id, text, seed, threshold), "passages")
            found.append(materialize(pairs_of(p, part, threshold), "pairs"))
            discard(p)

    for r in seeds.toLocalIterator():
        part.append(r)
        n += len(r.words)
        if n >= WORDS_AT_ONCE:
            flush()
            part, n = [], 0
    flush()
    discard(seeds)
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    best = F.struct("score", (-F.col("first_word")).alias("a"), (-F.col("end_word")).alias("b"))
    out = all_.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    return out.select("doc_id", "item_id", "b.score", (-F.col("b.a")).alias("first_word"), (-F.col("b.b")).alias("end_word"))


def pairs_of(passages: DataFrame, items: list, threshold: float) -> DataFrame:
    """Alignments of passages with their items; a task aligns equal passages once."""
    shared = passages.sparkSession.sparkContext.broadcast([(r.item_id, list(r.words)) for r in items])

    def run(batches):
        known: dict = {}
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, item, first, text in zip(*(c.to_pylist() for c in b.columns)):
                name, words = shared.value[item]
                if (item, text) not in known:
                    known = known if len(known) < 10_000 else {}
                    known[item, text] = align(words, text.split(" "))
                s, a, e = known[item, text]
                if s >= threshold:
                    for col, v in zip(out, (i, name, round(s, 6), first + a, first + e)):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], ["doc_id", "item_id", "score", "first_word", "end_word"])

    spread = passages.repartition(F.xxhash64("doc_id", "item", "first"))
    return spread.mapInArrow(frugal(run), "doc_id long, item_id long, score double, first_word long, end_word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of docs whose id is in no pair of contamination(); a null id is judged by rows with null ids together. Columns
    stay as they came, whatever their names; repeated rows keep their number; an empty table gives an empty result."""
    ident = fresh("id")
    bad = contamination(docs, benchmark, **options).select(F.col("doc_id").alias(ident)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(ident)), "left_anti")
