"""A hierarchical Pitman-Yor bigram model with Gibbs-sampled seating.

Upper restaurants: the most frequent words and the start of a text have one each, all others share one with the words of
their ending. Their dishes are the most frequent words and, for all others, their class (again by the ending). All have one
parent, the root restaurant, whose base is uniform over the dishes. A rare word is then drawn from its class, a Pitman-Yor
process with a diffuse base: there each type sits at one table, and the mass of a new table is that of an unseen word, the
one type beyond the V known ones. This state is bounded by contexts x dishes, whatever the corpus; it is sampled on the driver.

Lower restaurants hold every other pair of words, so each pair of the corpus has a cell of its own: each rarer word is a
context with all words for dishes, over its ending's restaurant; each frequent context has, for each class, one with the
class's words for dishes, over the class. They grow with the corpus and are sampled on executors, each whole in one task.
Their tables are the customers of what lies over them. They are seated twice: over the words' frequencies, for the
customers that they send up, and then over the sampled upper restaurants, for the scores.

Texts stay where they are: a part of a few MB of text asks once for each of its distinct pairs, and keeps, for each text,
the places of its pairs in what it asked. The answers come back in that order, one number a pair, and are added up over the
part's texts. What travels is then at most one pair a token there and one number back, however many texts and tasks there are.

Customers of a dish in a restaurant are exchangeable, so its seating is the histogram of its table sizes. Tables of
more than J customers are pooled: their number and customers are exact, only how often one falls back to J is estimated.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.common import discard, frugal, held_out, materialize, mix, portions

CONTEXTS, DISHES, CLASSES, LISTED = 384, 6144, 64, 200_000
J = 8
UNLISTED = 1 << 63
SPLIT, UPPER = 1 << 40, 1 << 50
LOWER_MOVES = 3
BUCKET = 500_000  # training tokens for each part of the lower restaurants
WORDS = 5_000_000  # training tokens for each part of the words that are not listed
PART = 4_000_000  # bytes of text that ask together
INTERNED = 200_000  # words that a task remembers from part to part
ROWS = 1000  # texts or blocks that go to a worker together
SUMS = 1_000_000  # rows of sums that a task holds
END = b"\n"  # no word: words hold no white space


def word_hash(w: bytes) -> int:
    """63 bits."""
    return xxhash.xxh64_intdigest(w, 42) >> 1


def word_class(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w[-2:], 7) % CLASSES


# Counts


class Tally:
    """Sums by word, given out when many words have gathered."""

    def __init__(self):
        self.n: Counter[bytes] = Counter()

    def add(self, words: list[bytes]) -> None:
        self.n.update(words)

    def batch(self) -> pa.RecordBatch:
        ws = list(self.n)
        h, c = [word_hash(w) for w in ws], [word_class(w) for w in ws]
        out = pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int32()), pa.array(self.n.values(), pa.int64())], ["h", "cls", "c"])
        self.n = Counter()
        return out


def tokens(text: str | None) -> list[bytes]:
    """Words in small letters, then the end."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    w.append(END)
    return w


def word_table(train: DataFrame) -> DataFrame:
    """(h, cls, c) over all tokens of train(text)."""

    def run(batches):
        t = Tally()
        for b in batches:
            for x in b.column(0):
                t.add(tokens(x.as_py()))
                if len(t.n) > 300_000:
                    yield t.batch()
        yield t.batch()

    return train.select("text").mapInArrow(frugal(run), "h long, cls int, c long").groupBy("h", "cls").agg(F.sum("c").alias("c"))


def most_frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most `most`, by count and then hash.

    A histogram of counts on a log scale, some thousand bins however many words there are, tells from which count on the
    words are few enough; only these leave their tasks, so no task merges every task's best.
    """
    bins = table.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).collect()
    wanted, total = F.lit(False), 0
    for b in sorted(bins, key=lambda b: -b.bin):
        if total + b.n > most:
            wanted = wanted | part_of(table, F.col("c").between(b.least, b.most), most - total)
            break
        total += b.n
        wanted = F.col("c") >= b.least
    top = table.where(wanted).select("h", "c").toArrow()
    h, c = top.column("h").to_numpy(), top.column("c").to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


def part_of(table: DataFrame, level: Column, room: int) -> Column:
    """Of the words of a level of counts, those with the least hashes: at most room, and less by no more than one of 4,096
    ranges of hashes."""
    ranges = table.where(level).groupBy(F.shiftright("h", 51).alias("r")).agg(F.count("*").alias("n")).collect()
    end = 0
    for r in sorted(ranges, key=lambda r: r.r):
        room -= r.n
        if room < 0:
            break
        end = r.r + 1
    return level & (F.shiftright("h", 51) < end)


def classes_of(table: DataFrame, h: np.ndarray) -> np.ndarray:
    """The class of each of these words."""
    wanted = table.sparkSession.createDataFrame(pa.table({"h": pa.array(h, pa.int64())}), "h long")
    found = table.join(F.broadcast(wanted), "h", "left_semi").select("h", "cls").toArrow()
    have, k = found.column("h").to_numpy(), found.column("cls").to_numpy().astype(np.int64)
    order = np.argsort(have)
    return k[order][np.searchsorted(have[order], h)]


class Words(dict):
    """Word -> its place in codes (its rank if it is listed, else its hash less 1 << 63) and classes."""

    def __init__(self, listed: dict[int, int]):
        super().__init__()
        self.listed, self.codes, self.classes = listed, array("q"), array("q")

    def __missing__(self, w: bytes) -> int:
        h = word_hash(w)
        self.codes.append(self.listed.get(h, h - UNLISTED))
        self.classes.append(word_class(w))
        i = self[w] = len(self)
        return i

    def forget(self, most: int) -> None:
        """Start anew if there are more words than that."""
        if len(self) > most:
            self.clear()
            self.codes, self.classes = array("q"), array("q")


def pairs_of(texts, words: Words):
    """Of all tokens of texts the distinct pairs (place of the word before, or one beyond all for the start; of the word);
    each token's pair; offsets of the texts."""
    flat: list[bytes] = []
    off = [0]
    for t in texts:
        flat.extend(tokens(t))
        off.append(len(flat))
    off = np.array(off)
    w = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
    start = len(words)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[off[:-1]] = start
    pair, index = np.unique(before * (start + 1) + w, return_inverse=True)
    return pair // (start + 1), pair % (start + 1), index, off


def cells_of(before: np.ndarray, w: np.ndarray, words: Words, contexts: int, dishes: int):
    """g, u, code, k of pairs_of's pairs: u the context's upper restaurant (contexts, classes, the start), the word's code and
    class. g is the pair's lower restaurant: the context's code, or, from SPLIT on, the frequent context and the class; if
    the pair has a cell in an upper restaurant, UPPER + u."""
    code, k = np.array(words.codes, np.int64), np.array(words.classes, np.int64)
    own = np.append(np.where((code >= 0) & (code < contexts), code, contexts + k), contexts + CLASSES)
    u, g, code, k = own[before], np.append(code, 0)[before], code[w], k[w]
    frequent = (u < contexts) | (u == contexts + CLASSES)
    g = np.where(frequent, np.where((code >= 0) & (code < dishes), UPPER + u, SPLIT + u * CLASSES + k), g)
    return g, u, code, k


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the keys starts; equal ones lie together."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


CODEC = "zstd"


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which packs well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def pack(*columns: np.ndarray) -> bytes:
    """Columns' lengths, and all of them compressed."""
    return np.array([len(x) for x in columns], np.int32).tobytes() + pa.compress(b"".join(map(planes, columns)), CODEC, asbytes=True)


def columns_of(block: bytes, *kinds) -> list[np.ndarray]:
    """What pack() was given."""
    head = 4 * len(kinds)
    kinds = [(np.dtype(t), n) for t, n in zip(kinds, np.frombuffer(block[:head], np.int32).tolist())]
    raw = pa.decompress(block[head:], sum(t.itemsize * n for t, n in kinds), CODEC, asbytes=True)
    out, at = [], 0
    for t, n in kinds:
        out.append(np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n).T.copy().view(t).reshape(n))
        at += n * t.itemsize
    return out


def blocks(buckets: int, g: np.ndarray, u: np.ndarray, w: np.ndarray, k: np.ndarray, n: np.ndarray, row: np.ndarray | None = None):
    """(bucket, block) of pairs: all of a lower restaurant are in one bucket. Equal pairs (of a row) are summed up."""
    bucket = bucket_of(g, buckets)
    order = np.lexsort((w, g, bucket) if row is None else (row, w, g, bucket))
    g, u, w, k, n, bucket = (x[order] for x in (g, u, w, k, n, bucket))
    row = None if row is None else row[order]
    new = runs_of(g, w) if row is None else runs_of(g, w, row)
    n = np.add.reduceat(n, new) if len(n) else n
    g, u, w, k, bucket = (x[new] for x in (g, u, w, k, bucket))
    yield from packed(bucket, g, u, w, k, n, None if row is None else row[new])


def packed(bucket: np.ndarray, g: np.ndarray, u: np.ndarray, w: np.ndarray, k: np.ndarray, n: np.ndarray, row: np.ndarray | None = None):
    """(bucket, block) of distinct pairs that lie by bucket and restaurant."""
    ends = [*runs_of(bucket).tolist(), len(g)]
    for lo, hi in zip(ends, ends[1:]):
        x = slice(lo, hi)
        starts = runs_of(g[x])
        rows, at = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if row is None else np.unique(row[x], return_inverse=True)
        yield int(bucket[lo]), pack(g[x][starts], u[x][starts].astype(np.int16), np.diff(np.append(starts, hi - lo)).astype(np.int32), w[x], k[x].astype(np.int8), n[x].astype(np.int32), rows, at.astype(np.int32))


def unpack(block: bytes):
    """g, u, w, k, n of a block's pairs, their rows (none if the block has none)."""
    g, u, runs, w, k, n, rows, i = columns_of(block, np.int64, np.int16, np.int32, np.int64, np.int8, np.int32, np.int64, np.int32)
    return np.repeat(g, runs), np.repeat(u, runs).astype(np.int64), w, k.astype(np.int64), n.astype(np.int64), rows[i]


def bucket_of(g: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(g.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def on_grid(x: np.ndarray, bits: int) -> np.ndarray:
    """x as multiples of 2 ** -bits: their sums are exact, whatever the order."""
    return np.round(x * 2.0**bits) / 2.0**bits


GRID, FINE_GRID = 24, 36  # of scores, which float32 holds up to 1, and of base scores


def batch_of(names: list[str], kinds: list, rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)


ASKED = ["chunk", "bucket", "block"], [pa.int64(), pa.int32(), pa.binary()]


def asked_pairs(docs: DataFrame, shared, contexts: int, dishes: int, buckets: int) -> DataFrame:
    """(chunk, bucket, block) from docs(doc_id, text, held). A chunk is a part of the texts. Where bucket is -1, its record: the
    chunk's pairs are those that it asks for, by bucket, then those with cells in upper restaurants. It has the numbers
    of its pairs that it asks for, places among these of words that are not listed, upper cells of the other pairs; each
    text's pairs in rising order, as differences; offsets of texts, their ids, which are null, and listed words' counts and
    base scores. Else the pairs that it asks for (no class if the word is listed) and how often training texts have them.
    Without a chunk g stands for an upper restaurant of a frequent context and w for its dish, which tasks sum up in a
    matrix of fixed size."""
    width = dishes + CLASSES

    def run(batches):
        listed, log_base = shared.value
        words = Words(listed)
        total = np.zeros((contexts + CLASSES + 1) * width, np.int32)
        for b in batches:
            for part in portions(b, 2, PART):
                chunk, ids, texts, held = (part.column(i) for i in range(4))
                words.forget(INTERNED)
                before, w, index, off = pairs_of(texts.to_pylist(), words)
                g, u, w, k = cells_of(before, w, words, contexts, dishes)
                trained = np.repeat(1.0 - held.to_numpy(zero_copy_only=False), np.diff(off))
                n = np.bincount(index, trained, len(g)).astype(np.int64)
                bucket = bucket_of(g, buckets)
                bucket[g >= UPPER] = buckets
                order = np.lexsort((g, bucket))
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                g, u, w, k, n, bucket = (x[order] for x in (g, u, w, k, n, bucket))
                low = int(np.searchsorted(bucket, buckets))
                frequent = g >= SPLIT
                np.add.at(total, (u * width + np.where(g >= UPPER, w, dishes + k))[frequent], n[frequent].astype(np.int32))
                base = np.zeros(len(w))
                base[w >= 0] = log_base[w[w >= 0]]
                index = place[index]
                known, base = (np.add.reduceat(x[index], off[:-1]) for x in ((w >= 0).astype(np.int64), base))
                index += np.repeat(np.arange(len(ids)) << 32, np.diff(off))
                index.sort()
                index = np.diff(index & 0xFFFFFFFF, prepend=0)
                null = np.array(ids.is_null())
                other = np.flatnonzero(w[:low] < 0)
                record = pack(np.array([low]), other.astype(np.int32), (u * width + w)[low:].astype(np.int32), index.astype(np.int32), off.astype(np.int32), ids.fill_null(0).to_numpy(), null.astype(np.int8), known.astype(np.int32), base)
                k[w >= 0] = 0
                chunk = chunk[0].as_py()
                found = packed(*(x[:low] for x in (bucket, g, u, w, k, n)))
                yield batch_of(*ASKED, [(chunk, -1, record), *((chunk, *x) for x in found)])
        x = np.flatnonzero(total)
        for lo in range(0, len(x), 100_000):
            y = x[lo : lo + 100_000]
            u, w = y // width, y % width
            yield batch_of(*ASKED, [(None, *x) for x in blocks(buckets, UPPER + u, u, w, np.zeros_like(u), total[y].astype(np.int64))])

    docs = docs.select(F.monotonically_increasing_id().alias("chunk"), "doc_id", "text", "held")
    return docs.mapInArrow(frugal(run), "chunk long, bucket int, block binary")


def whole_buckets(batches, by: str = "bucket"):
    """Rows of each bucket as a table; rows are sorted by bucket."""
    kept = []
    for b in batches:
        x = b.column(by).to_numpy()
        ends = [*runs_of(x).tolist(), len(x)]
        for lo, hi in zip(ends, ends[1:]):
            if kept and kept[0].column(by)[0].as_py() != x[lo]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept)


def pairs_in(t: pa.Table) -> list[np.ndarray]:
    """g, u, w, k, n, row of all blocks of a bucket."""
    found = [unpack(x) for x in t.column("block").drop_null().to_pylist()]
    kinds = [np.int64] * 6
    return [np.concatenate([np.zeros(0, y), *x]) for x, y in zip(zip(*found) if found else [()] * 6, kinds)]


def distinct(g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair, by g, and each pair's number among these. The order depends on the set of pairs alone."""
    h = mix(g.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * mix(w.view(np.uint64)))
    order = np.argsort(h)
    new = runs_of(h[order])
    if len(new) != len(runs_of(g[order], w[order])):  # pairs that differ share a hash
        order = np.lexsort((w, g))
        new = runs_of(g[order], w[order])
    first = order[new]
    by = np.argsort(g[first], kind="stable")
    number, index = np.empty_like(by), np.empty_like(order)
    number[by] = np.arange(len(by))
    index[order] = np.repeat(number, np.diff(np.append(new, len(order))))
    return first[by], index


def unlisted_words(w: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words without a rank among w by their part, that part, and each one's places in w as an index of these
    (-1: listed)."""
    at = np.flatnonzero(w < 0)
    words, i = np.unique(w[at], return_inverse=True)
    part = bucket_of(words, parts)
    order = np.argsort(part, kind="stable")
    place, index = np.empty_like(order), np.full(len(w), -1)
    place[order] = np.arange(len(order))
    index[at] = place[i]
    return words[order], part[order], index


TABLES = ["kind", "key", "t", "bucket", "block"], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def lower_tables(asked: DataFrame, start, restaurants: int, dishes: int, parts: int) -> DataFrame:
    """(kind, key, t, bucket, block) from what chunks ask: kind 0, customers of each upper cell; 1, tables of each listed word
    (by rank) in lower restaurants, if it is no dish; 3, lower cells of one and of two customers, all as partial sums. Kind 2:
    of a bucket's words without a rank that lie in part `key` of all such words the hashes, classes, counts and tables."""
    width = dishes + CLASSES

    def run(batches):
        count, top_k, n_all, class_n, mean, d = start.value
        cells, words, ones = np.zeros(restaurants * width, np.int64), np.zeros(len(count), np.int64), np.zeros(3, np.int64)
        for bucket in whole_buckets(batches):
            g, u, w, k, c, _ = pairs_in(bucket)
            first, index = distinct(g, w)
            c = np.bincount(index, c, len(first)).astype(np.int64)
            g, u, w, k = (x[first] for x in (g, u, w, k))
            low = g < UPPER
            listed = low & (w >= 0)
            k[listed] = top_k[w[listed]]
            np.add.at(cells, u[~low] * width + w[~low], c[~low])
            t = np.zeros(len(g), np.int64)
            at = np.flatnonzero(low & (c > 0))
            if len(at):
                t[at] = first_tables(g[at], w[at], k[at], c[at], count, n_all, class_n, mean, d, dishes)
                ones += np.bincount(np.minimum(c[at], 3), minlength=4)[1:]
            rare = ~listed | (w >= dishes)
            at = np.flatnonzero(low & (g < SPLIT))
            np.add.at(cells, u[at] * width + np.where(rare, dishes + k, w)[at], t[at])
            at = np.flatnonzero(listed & rare)
            np.add.at(words, w[at], t[at])
            other, part, index = unlisted_words(w, parts)
            at = np.flatnonzero(index >= 0)
            kind = np.zeros(len(other), np.int8)
            kind[index[at]] = k[at]
            sums = [np.bincount(index[at], x[at], len(other)).astype(np.int64) for x in (c, t)]
            ends = [*runs_of(part).tolist(), len(part)]
            number = bucket.column("bucket")[0].as_py()
            yield batch_of(*TABLES, [(2, int(part[lo]), None, number, pack(*(x[lo:hi] for x in (other, kind, *sums)))) for lo, hi in zip(ends, ends[1:])])
        for kind, x in ((0, cells), (1, words), (3, ones)):
            key = np.flatnonzero(x)
            for lo in range(0, len(key), 100_000):
                y = key[lo : lo + 100_000]
                columns = np.full(len(y), kind), y, x[y], pa.nulls(len(y), pa.int32()), pa.nulls(len(y), pa.binary())
                yield pa.RecordBatch.from_arrays([z if isinstance(z, pa.Array) else pa.array(z, t) for z, t in zip(columns, TABLES[1])], TABLES[0])

    grouped = asked.select("bucket", "block").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return grouped.mapInArrow(frugal(run), "kind int, key long, t long, bucket int, block binary")


def first_tables(g, w, k, c, count, n_all, class_n, mean, d, dishes) -> np.ndarray:
    """Tables of each lower cell, seated over the words' frequencies."""
    rare = (w < 0) | (w >= dishes)
    base = np.where(w >= 0, count[np.maximum(w, 0)] if len(count) else 0, mean[k])
    base = base / np.where(g >= SPLIT, class_n[k], n_all)
    starts = runs_of(g)
    u = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g))))
    seats = Seating(u, c, len(starts), d, 1.0, np.random.default_rng(abs(int(g[0]))))
    seats.begin(base)
    seats.sweep(base, moves=LOWER_MOVES)
    return seats.tables()


def word_totals(sent: DataFrame) -> DataFrame:
    """(bucket, key, block) from kind 2 of lower_tables: back to each bucket, for its words of part `key` and in their order,
    the words' counts and tables over all buckets. Where bucket is -1, partial sums by class: tables, words that have any, that
    have one, that have two."""

    def run(batches):
        stats = np.zeros((4, CLASSES), np.int64)
        names = ["bucket", "key", "block"], [pa.int32(), pa.int64(), pa.binary()]
        for part in whole_buckets(batches, "key"):
            found = [columns_of(x, np.int64, np.int8, np.int64, np.int64) for x in part.column("block").to_pylist()]
            w, k, c, t = map(np.concatenate, zip(*found))
            words, first, i = np.unique(w, return_index=True, return_inverse=True)
            c, t = (np.bincount(i, x, len(words)).astype(np.int64) for x in (c, t))
            for s, x in zip(stats, (t, t > 0, t == 1, t == 2)):
                s += np.bincount(k[first], x, CLASSES).astype(np.int64)
            ends = np.cumsum([0, *(len(x[0]) for x in found)])
            key = part.column("key")[0].as_py()
            yield batch_of(*names, [(b, key, pack(c[i[lo:hi]], t[i[lo:hi]])) for b, lo, hi in zip(part.column("bucket").to_pylist(), ends, ends[1:])])
        yield batch_of(*names, [(-1, 0, stats.tobytes())])

    grouped = sent.select("key", "bucket", "block").repartition(F.col("key")).sortWithinPartitions("key")
    return grouped.mapInArrow(frugal(run), "bucket int, key long, block binary")


def lower_values(g, u, w, k, c, t, m: dict, dishes: int, burn: int = 1, samples: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct pairs by g, with c training customers and the words' t tables: the probability of the dish in the upper
    restaurant, that of the word in its dish, and what the pair's own cell makes of the two, as a factor.

    A pair's probability is own + mass * p over its parent's p: p * (mass + own / p).
    """
    rare = (w < 0) | (w >= dishes)
    inside = np.where(rare, np.where(t > 0, t - m["disc"][k], m["fresh"][k]) / m["norm"][k], 1.0)
    dish = m["prob"][u, np.where(rare, dishes + k, w)]
    p = np.where(g >= SPLIT, 1.0, dish) * inside
    starts = runs_of(g)
    at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g))))
    seen = np.flatnonzero(c)
    own, mass = lower_model(at[seen], c[seen], len(starts), p[seen], m["d"], burn, samples, abs(int(g[0])))
    ratio = mass[at]
    ratio[seen] += own / p[seen]
    return dish, inside, ratio


def answers(asked: DataFrame, model, dishes: int, parts: int, burn: int = 1, samples: int = 2) -> DataFrame:
    """(chunk, bucket, block) for each block of pairs that a chunk asks for: the log10 probabilities of the pairs in their order,
    and the counts of those words that are not listed. asked: also, without a chunk, word_totals' blocks for the bucket."""

    def run(batches):
        m = model.value
        for bucket in whole_buckets(batches):
            alone = bucket.filter(pc.is_null(bucket.column("chunk"))).sort_by("key")
            bucket = bucket.filter(pc.is_valid(bucket.column("chunk")))
            if not len(bucket):
                continue
            found = [unpack(x) for x in bucket.column("block").to_pylist()]
            ends = np.cumsum([0, *(len(x[0]) for x in found)])
            g, u, w, k, n, _ = map(np.concatenate, zip(*found))
            first, index = distinct(g, w)
            n = np.bincount(index, n, len(first)).astype(np.int64)
            g, u, w, k = (x[first] for x in (g, u, w, k))
            k[w >= 0] = m["classes"][w[w >= 0]]
            other, _, place = unlisted_words(w, parts)
            count, tables = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*(columns_of(x, np.int64, np.int64) for x in [pack(*np.zeros((2, 0), np.int64)), *alone.column("block").to_pylist()])))
            if len(count) != len(other):
                raise ValueError(f"bucket has {len(other)} unlisted words and totals of {len(count)}")
            t = np.zeros(len(w), np.int64)
            t[w < 0], t[w >= 0] = tables[place[w < 0]], m["tables"][w[w >= 0]]
            dish, inside, ratio = lower_values(g, u, w, k, n, t, m, dishes, burn, samples)
            value = on_grid(np.log10(dish) + np.log10(inside) + np.log10(ratio), GRID).astype(np.float32)[index]
            place = place[index]
            number, rows = bucket.column("bucket")[0].as_py(), []
            for chunk, lo, hi in zip(bucket.column("chunk").to_pylist(), ends, ends[1:]):
                x = place[lo:hi]
                rows.append((chunk, number, pack(value[lo:hi], count[x[x >= 0]])))
            yield batch_of(*ASKED, rows)

    grouped = asked.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return grouped.mapInArrow(frugal(run), "chunk long, bucket int, block binary")


def text_scores(records: DataFrame, answered: DataFrame, model) -> DataFrame:
    """(doc_id, n, known, base, score) of each text from the chunks' records and the answers that they got."""
    names = ["doc_id", "n", "known", "base", "score"]

    def run(batches):
        log_p, z = model.value
        log_p = log_p.reshape(-1)
        for chunk in whole_buckets(batches, "chunk"):
            record, *found = chunk.column("block").to_pylist()
            low, other, upper, index, off, ids, null, known, base = columns_of(record, np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int8, np.int32, np.float64)
            got, count = (np.concatenate(x) for x in zip((np.zeros(0), np.zeros(0, np.int64)), *(columns_of(x, np.float32, np.int64) for x in found)))
            if len(got) != low[0] or len(count) != len(other):
                raise ValueError(f"a chunk asked for {low[0]} pairs and got {len(got)}")
            index = np.cumsum(index)
            score = np.concatenate([got, log_p[upper].astype(np.float64)])
            more, bases = np.zeros(len(score), np.int64), np.zeros(len(score))
            more[other], bases[other] = count > 0, on_grid(np.log10((count + 0.5) / z), FINE_GRID)
            more, bases, score = (np.add.reduceat(x[index], off[:-1]) for x in (more, bases, score))
            sums = known + more, base + bases, score
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null > 0), pa.array(np.diff(off).astype(np.int64)), *map(pa.array, sums)], names)

    both = records.unionByName(answered).repartition(F.col("chunk")).sortWithinPartitions("chunk", "bucket")
    return both.mapInArrow(frugal(run), "doc_id long, n long, known long, base double, score double")


def score_lower(pairs: DataFrame, model, dishes: int, burn: int = 1, samples: int = 2) -> DataFrame:
    """answers() for pairs that come with their rows, such as single ones; train_and_score does not send these. (row, known,
    base, score) to be summed up by row: what a text's lower pairs add to its upper score. pairs: bucket, and a
    block of pairs of listed words, or one pair of another word: row, g, u, w, k, n, the word's count c and tables t. n:
    times in the row, negative if held out.

    A pair's probability is own + mass * p over its parent's p; the upper score has p already, so log10(mass + own / p) is added.
    """
    names = ["row", "known", "base", "score"]

    def sums_of(batches):
        m = model.value
        for bucket in whole_buckets(batches):
            g, u, w, k, n, row = pairs_in(bucket)
            alone = bucket.filter(pc.is_null(bucket.column("block")))
            one = [alone.column(x).to_numpy() for x in ("g", "u", "w", "k", "n", "row")]
            g, u, w, k, n, row = (np.concatenate([x, y]) for x, y in zip((g, u, w, k, n, row), one))
            count, t = (np.concatenate([np.zeros(len(g) - len(alone), np.int64), alone.column(x).fill_null(0).to_numpy()]) for x in ("c", "t"))
            first, pair = distinct(g, w)
            c = np.bincount(pair, np.maximum(n, 0), len(first)).astype(np.int64)
            g, u, w, k, count, t = (x[first] for x in (g, u, w, k, count, t))
            listed = w >= 0
            t[listed] = m["tables"][w[listed]]
            _, inside, ratio = lower_values(g, u, w, k, c, t, m, dishes, burn, samples)
            add = np.log10(ratio) + np.where(listed, 0.0, np.log10(inside))
            base = np.where(listed, 0.0, np.log10((count + 0.5) / m["z"]))
            known = (~listed & (count > 0)).astype(np.int64)
            n = np.abs(n)
            yield row, *(n * x[pair] for x in (known, base, add))

    def run(batches):
        for row, known, base, add in summed(sums_of(batches)):
            for lo in range(0, len(row), 100_000):
                x = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(row[x]), pa.array(known[x].astype(np.int64)), pa.array(base[x]), pa.array(add[x])], names)

    grouped = pairs.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return grouped.mapInArrow(frugal(run), "row long, known long, base double, score double")


def summed(found, most: int = SUMS):
    """Sums by row of all of found (row, values, ...), each row once while a task's rows are at most half of `most`; of
    more, rows come out as partial sums."""

    def by_row(held):
        row, *values = map(np.concatenate, zip(*held))
        rows, i = np.unique(row, return_inverse=True)
        return rows, *(np.bincount(i, x, len(rows)) for x in values)

    held, size = [], 0
    for x in found:
        held.append(by_row([x]))
        size += len(held[-1][0])
        if size > most:
            held = [by_row(held)]
            size = len(held[0][0])
            if size > most // 2:
                yield held.pop()
                size = 0
    if held:
        yield by_row(held)


def lower_model(u: np.ndarray, c: np.ndarray, restaurants: int, p: np.ndarray, d: float, burn: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's own probability and each restaurant's mass for its parent, averaged over states of the Gibbs sampler."""
    seats = Seating(u, c, restaurants, d, 1.0, np.random.default_rng(seed))
    seats.begin(p)
    own, mass = np.zeros(len(c)), np.zeros(restaurants)
    for s in range(burn + samples):
        seats.sweep(p, moves=LOWER_MOVES)
        if s >= burn:
            x, y = seats.kept()
            own += x
            mass += y
    return own / samples, mass / samples


# Seating


class Seating:
    """Restaurants' seating: dish cells with restaurant u, customers c, tables of size j in n[j - 1], and the larger ones."""

    def __init__(self, u: np.ndarray, c: np.ndarray, restaurants: int, d: float, theta: float, rng: np.random.Generator):
        self.u, self.c, self.r, self.d, self.theta, self.rng = u, c, restaurants, d, theta, rng
        self.n = np.zeros((J, len(c)), np.int32)
        self.big = np.zeros(len(c), np.int32)
        self.total = np.bincount(u, c, restaurants)

    def tables(self) -> np.ndarray:
        return self.n.sum(axis=0) + self.big

    def begin(self, p0: np.ndarray, block: int = 100_000) -> None:
        """Seat all customers anew: one by one while they are few, then in steps of an eighth of those seated."""
        self.n[:], self.big[:] = 0, 0
        seated = np.minimum(self.c, 1)
        self.n[0] = seated
        types = np.bincount(self.u, self.c > 0, self.r)
        new_mass = (self.theta + self.d * types[self.u]) * p0
        every = np.flatnonzero(self.c > 1)
        for lo in range(0, len(every), block):
            self.seat(every[lo : lo + block], seated, new_mass)
            self.fit(every[lo : lo + block])

    def seat(self, live: np.ndarray, seated: np.ndarray, new_mass: np.ndarray) -> None:
        while len(live):
            i, a = seated[live].astype(float), new_mass[live]
            b = np.minimum(np.maximum(1, seated[live] // 8), self.c[live] - seated[live])
            n, t = self.n[:, live], self.n[:, live].sum(axis=0) + self.big[live]
            z = a + i - self.d * t
            one = b == 1
            pick = self.rng.random(len(live)) * z
            flow = np.zeros((J, len(live)), np.int32)
            fresh = np.where(one, pick < a, self.rng.binomial(b, np.clip(a / z, 0, 1)))
            past = a.copy()
            for j in range(J):
                w = n[j] * (j + 1 - self.d)
                flow[j] = np.where(one, (pick >= past) & (pick < past + w), self.rng.binomial(n[j], np.clip(b * (j + 1 - self.d) / z, 0, 1)))
                past += w
            free = b.astype(np.int64) - fresh  # customers that join tables: no more flows than these
            for j in range(J):
                flow[j] = np.minimum(flow[j], free)
                free = free - flow[j]
            none = (free > 0) & (self.big[live] + flow[J - 1] == 0)  # nobody to join: they open tables
            fresh = fresh + np.where(none, free, 0)
            self.n[:, live] += -flow
            self.n[1:, live] += flow[:-1]
            self.big[live] += flow[J - 1]
            self.n[0, live] += fresh.astype(np.int32)
            seated[live] += b
            live = live[seated[live] < self.c[live]]

    def pooled(self, at) -> np.ndarray:
        """Customers at large tables."""
        return self.c[at] - (np.arange(1, J + 1)[:, None] * self.n[:, at]).sum(axis=0)

    def fit(self, at: np.ndarray) -> None:
        """Let the number of large tables agree with their customers: at least J + 1 at each, none without any."""
        over = self.pooled(at)
        big = np.minimum(self.big[at], over // (J + 1))
        lone = (big == 0) & (over > 0)
        small = lone & (over <= J)  # too few for a large table: one table of their size
        np.add.at(self.n, (over[small] - 1, at[small]), 1)
        big[lone & ~small] = 1
        self.big[at] = big

    def choose(self, w: np.ndarray) -> np.ndarray:
        """A line's index per column, in proportion to w."""
        cum = np.cumsum(np.maximum(w, 0), axis=0)
        return (cum < self.rng.random(w.shape[1]) * cum[-1]).sum(axis=0)

    def unseat(self, at: np.ndarray) -> None:
        """A customer of each cell of at, any of them alike, leaves."""
        cols, sizes = np.arange(len(at)), np.arange(1, J + 1)[:, None]
        n, big = self.n[:, at].astype(np.int64), self.big[at].astype(np.int64)
        over = self.c[at] - (sizes * n).sum(axis=0)
        k = self.choose(np.concatenate([sizes * n, over[None, :]]))
        small = k < J
        n[k[small], cols[small]] -= 1
        down = small & (k > 0)
        n[k[down] - 1, cols[down]] += 1
        fall = ~small & (big > 0)
        share = n[J - 1] * (J - self.d) / np.maximum(over, 1)
        fall &= (self.rng.random(len(at)) < share) | (over - 1 < (J + 1) * big)
        over = over - ~small
        size = np.minimum(over, J)  # of the table that is no longer large: J, but for a lone one that had fewer
        lone = np.flatnonzero(fall & (size > 0))
        n[size[lone] - 1, lone] += 1
        big -= fall
        over = over - size * fall
        # a lone large table takes whatever is left with it
        big = np.where(over > 0, np.maximum(big, 1), 0)
        self.n[:, at], self.big[at] = n, big
        self.c[at] -= 1

    def move(self, at: np.ndarray, p0: np.ndarray, open_tables: np.ndarray) -> None:
        """One Gibbs step in each cell of at: a customer leaves and sits down again."""
        t0 = self.n[:, at].sum(axis=0) + self.big[at]
        self.unseat(at)
        cols, sizes, u = np.arange(len(at)), np.arange(1, J + 1)[:, None], self.u[at]
        n, big = self.n[:, at].astype(np.int64), self.big[at].astype(np.int64)
        over = self.c[at] - (sizes * n).sum(axis=0)
        w = np.concatenate([((self.theta + self.d * (open_tables[u] - t0 + n.sum(axis=0) + big)) * p0[at])[None, :], n * (sizes - self.d), (over - self.d * big)[None, :]])
        k = self.choose(w)
        fresh, join = k == 0, (k > 0) & (k <= J)
        n[0, fresh] += 1
        j = k[join] - 1
        n[j, cols[join]] -= 1
        up = j + 1 < J
        n[j[up] + 1, cols[join][up]] += 1
        big[cols[join][~up]] += 1
        open_tables += np.bincount(u, n.sum(axis=0) + big - t0, self.r)
        self.n[:, at], self.big[at] = n, big
        self.c[at] += 1

    def change(self, c: np.ndarray, p0: np.ndarray) -> None:
        """Customers of each cell become c: those too many leave, new ones sit down beside the others."""
        while len(at := np.flatnonzero(self.c > c)):
            self.unseat(at)
        seated = self.c.copy()
        more = np.flatnonzero(c > seated)
        alone = more[seated[more] == 0]
        self.n[0, alone] += 1
        seated[alone] = 1
        self.c = c.copy()
        self.total = np.bincount(self.u, self.c, self.r)
        new_mass = (self.theta + self.d * np.bincount(self.u, self.c > 0, self.r)[self.u]) * p0
        self.seat(more[seated[more] < c[more]], seated, new_mass)
        self.fit(more)

    def sweep(self, p0: np.ndarray, moves: int = 6, block: int = 100_000) -> None:
        """Gibbs steps: each customer's share of them, at most `moves` in a cell. Cells of one customer cannot change."""
        open_tables = np.bincount(self.u, self.tables(), self.r)
        for m in range(moves):
            live = np.flatnonzero(self.c > max(1, m))
            for lo in range(0, len(live), block):
                self.move(live[lo : lo + block], p0, open_tables)

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's own probability, and each restaurant's mass for its parent."""
        t = self.tables()
        z = self.theta + self.total
        return (self.c - self.d * t) / z[self.u], (self.theta + self.d * np.bincount(self.u, t, self.r)) / z


def discount(c: np.ndarray) -> float:
    return discount_of(int((c == 1).sum()), int((c == 2).sum()))


def discount_of(one: float, two: float) -> float:
    return float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.9))


def sample_model(cell: np.ndarray, c: np.ndarray, restaurants: int, width: int, burn: int = 4, samples: int = 6, seed: int = 1) -> np.ndarray:
    """Predictive probabilities, restaurants x dishes, averaged over `samples` states of the Gibbs sampler. The parent's
    seating goes on from state to state: its customers are the tables of the context restaurants, and come and go with
    them."""
    rng = np.random.default_rng(seed)
    order = np.argsort(cell)
    cell, c = cell[order].astype(np.int64), c[order].astype(np.int64)
    u, w = cell // width, cell % width
    seats = Seating(u, c, restaurants, discount(c), 1.0, rng)
    base = np.full(width, 1.0 / width)
    p_root = base
    mean = np.zeros((restaurants, width))
    if len(c):
        p_root = np.bincount(w, c, width) + 1.0
        p_root /= p_root.sum()
        seats.begin(p_root[w])
    first = np.bincount(w, seats.tables(), width).astype(np.int64)
    root = Seating(np.zeros(width, np.int64), first, 1, discount(first), 1.0, rng)
    root.begin(base)
    for s in range(burn + samples):
        if len(c):
            seats.sweep(p_root[w])
        root.change(np.bincount(w, seats.tables(), width).astype(np.int64), base)
        root.sweep(base)
        own, mass = root.kept()
        p_root = own + mass[0] / width
        if s >= burn:
            own, mass = seats.kept()
            mean += mass[:, None] * p_root[None, :]
            mean[u, w] += own
    return mean / samples


# Scores


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 5, contexts: int = CONTEXTS, dishes: int = DISHES, listed: int = LISTED) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id) mod 5 is 1 are held out; all others' whole texts are counted. A null text is empty: its one
    token is the end. A null id counts as the empty text in the hash and stays null. Equal rows get equal scores; an
    empty table gives an empty result. Counts of the `listed` most frequent words, a fixed number, are broadcast; others
    are summed up over buckets and sent back to them. Every pair of words has a cell: in an upper restaurant, on the driver, if both are
    frequent, else in a lower one, in a task.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    d = d.withColumn("held", held_out(F.col("doc_id"), mod))
    train = d.where(~F.col("held"))
    table = materialize(word_table(train), "words")
    n_all, v_all, one, two = table.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("c"), F.lit(1), (F.col("c") == 1).cast("int"), (F.col("c") == 2).cast("int")))).first()
    top_h, top_c = most_frequent(table, listed)
    top_k = classes_of(table, top_h)
    z = n_all + 0.5 * (v_all + 1)
    shared = spark.sparkContext.broadcast(({h: i for i, h in enumerate(top_h.tolist())}, on_grid(np.log10((top_c + 0.5) / z), FINE_GRID)))
    width, restaurants = dishes + CLASSES, contexts + CLASSES + 1
    class_n, class_v = np.zeros((2, CLASSES))
    for r in table.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        class_n[r.cls], class_v[r.cls] = r.n, r.v
    mean = (class_n - np.bincount(top_k, top_c, CLASSES)) / np.maximum(class_v - np.bincount(top_k, minlength=CLASSES), 1)
    class_n -= np.bincount(top_k[:dishes], top_c[:dishes], CLASSES)
    start = spark.sparkContext.broadcast((top_c, top_k, n_all, class_n, mean, discount_of(one, two)))
    buckets, parts = n_all // BUCKET + 1, n_all // WORDS + 1
    discard(table)
    asked = materialize(asked_pairs(d, shared, contexts, dishes, buckets), "lm", ROWS)
    requests = asked.where("bucket >= 0")
    sent = materialize(lower_tables(requests, start, restaurants, dishes, parts), "tables", ROWS)
    sums = materialize(sent.where("kind <> 2").groupBy("kind", "key").agg(F.sum("t").alias("t")), "sums")
    cells = sums.where("kind = 0").select("key", "t").toArrow()
    prob = sample_model(cells.column("key").to_numpy(), cells.column("t").to_numpy(), restaurants, width)
    by_rank = sums.where("kind = 1").select("key", "t").toArrow()
    top_t = np.zeros(len(top_h), np.int64)
    top_t[by_rank.column("key").to_numpy()] = by_rank.column("t").to_numpy()
    ones = {r.key: r.t for r in sums.where("kind = 3").collect()}
    # a rare word has as many customers in its class as it has tables in lower restaurants
    totals = materialize(word_totals(sent.where("kind = 2")), "unlisted")
    discard(sent), discard(sums)
    n, v, once, twice = np.zeros((4, CLASSES))
    for r in totals.where("bucket = -1").select("block").collect():
        for x, y in zip((n, v, once, twice), np.frombuffer(r.block, np.int64).reshape(4, CLASSES)):
            x += y
    t = top_t[dishes:]
    for x, y in ((n, t), (v, t > 0), (once, t == 1), (twice, t == 2)):
        x += np.bincount(top_k[dishes:], y, CLASSES)
    disc = np.array([discount_of(x, y) if z else 0.5 for x, y, z in zip(once, twice, v)])
    norm, fresh = 1.0 + n, 1.0 + disc * v
    prob = np.maximum(prob, 1e-300)
    upper = spark.sparkContext.broadcast((on_grid(np.log10(prob), GRID).astype(np.float32), z))
    lower = spark.sparkContext.broadcast({"prob": prob, "tables": top_t, "classes": top_k, "disc": disc, "norm": norm, "fresh": fresh, "z": z, "d": discount_of(ones.get(0, 0), ones.get(1, 0))})
    requests = requests.where("chunk is not null").unionByName(totals.where("bucket >= 0"), allowMissingColumns=True)
    answered = materialize(answers(requests, lower, dishes, parts), "answers", ROWS)
    discard(totals)
    scores = text_scores(asked.where("bucket = -1"), answered, upper)
    return scores.select("doc_id", held_out(F.col("doc_id"), mod).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
