"""SentencePiece segmentations sampled without replacement, and decoding.

A text's lattice holds all ways to spell it in pieces of a given model; a segmentation's probability is the product of
its pieces' probabilities, normalised. No piece runs across the end of a word, so the lattice is a chain of word
lattices, built once per distinct word in a task; backward sums over a word give each edge its probability given that
the path reaches its start.

Gumbel top-k: the text's root gets a Gumbel variate, the maximum over all its segmentations' perturbed log
probabilities. Going down the lattice, the edge taken keeps the maximum, and the mass of the edges not taken becomes a
node of the queue, with a Gumbel truncated at that maximum. A-star takes the node with the greatest variate, which is
exact as a bound, and completes it: so the k samples are the k segmentations of greatest perturbed log probability.
The next variate in the queue is the threshold that inclusion probabilities are taken against.
"""

from __future__ import annotations

import heapq
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.common import frugal, mix, portions

META = "▁"
UNIT = re.compile(f" *[^ {META}]+|{META}| +")
#: Rank shift of the Zipf-Mandelbrot law that turns a piece's rank into its probability.
SHIFT = 2.7


def load_model(path: str) -> tuple[list[str], list[int]]:
    """(pieces, kind of each): 0 normal, 1 byte, 2 control. Read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in n], [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) else 0 for i in n]


EMPTY = np.uint64(2**64 - 1)
#: -log of the smallest exponential variate that a 53-bit uniform number gives, rounded up.
REACH = 38.0
SPREAD = np.uint64(0x9E3779B97F4A7C15)
STRIDE = np.uint64(0xD1342543DE82EF95)
FIRST = 1024  # edges of a text that get their variates at once


class Vocabulary:
    """Pieces with their log probabilities, as a trie in one open hash table from (node, character) to node."""

    def __init__(self, pieces: list[str], kinds: list[int]):
        normal = [i for i, k in enumerate(kinds) if k == 0]
        self.ids = {pieces[i]: i for i in normal}
        p = 1.0 / (np.arange(len(normal)) + SHIFT)
        self.prob = dict(zip((pieces[i] for i in normal), (p / p.sum()).tolist()))
        self.log_prob = np.zeros(len(pieces))
        self.log_prob[normal] = np.log(p / p.sum())
        byte = [i for i, k in enumerate(kinds) if k == 1]
        self.byte_id = {int(pieces[i][3:5], 16): i for i in byte}
        self.raw = [bytes([int(x[3:5], 16)]) if k == 1 else b"" if k == 2 else x.replace(META, " ").encode() for x, k in zip(pieces, kinds)]
        child: dict[int, int] = {}
        ends = [-1]
        for i in normal:
            node = 0
            for c in pieces[i]:
                at = node << 21 | ord(c)
                node = child.setdefault(at, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.root = np.full(0x110000, -1, np.int64)
        for at, v in child.items():
            if at >> 21 == 0:
                self.root[at] = v
        self.bits = max(8, (4 * len(child)).bit_length())
        self.at, self.child = np.full(1 << self.bits, EMPTY), np.zeros(1 << self.bits, np.int64)
        slot = (np.array(list(child), np.uint64) * SPREAD >> np.uint64(64 - self.bits)).tolist()
        for (k, v), x in zip(child.items(), slot):
            while self.at[x] != EMPTY:
                x = (x + 1) % len(self.at)
            self.at[x], self.child[x] = k, v

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Each node's child by a character, -1 if there is none."""
        want = (node.astype(np.uint64) << np.uint64(21)) | code
        slot = (want * SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(node), -1)
        open_ = np.arange(len(node))
        while len(open_):
            k = self.at[slot[open_]]
            hit = k == want[open_]
            out[open_[hit]] = self.child[slot[open_[hit]]]
            open_ = open_[~hit & (k != EMPTY)]
            slot[open_] = (slot[open_] + 1) % len(self.at)
        return out

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Text of each run ids[off[i]:off[i + 1]], without the leading space that encoding adds."""
        pieces = pa.array(self.raw, pa.binary()).take(pa.array(ids))
        return [x[1:] for x in pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pieces), b"").to_pylist()]


class Column:
    """A growing array."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1 << 16, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n // 2 + 2 * len(more), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class Lattices:
    """Word lattices as flat arrays. Edges of a node follow each other, longest piece first; a word's last node has none.

    q: an edge's probability given its node; cum: the running sum of q in a node, 2 at its last edge; to: the node it
    leads to; piece: its id, or -1 - number in spelled for a character spelled in bytes.
    """

    def __init__(self, vocab: Vocabulary, limit: int = 200_000):
        self.vocab, self.limit = vocab, limit
        self.spelled: list[list[int]] = []
        self.spell: dict[int, int] = {}
        self._first, self._size, self._q, self._cum, self._to, self._piece = (Column(k) for k in (np.int32, np.int32, np.float64, np.float64, np.int32, np.int32))
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        for c in (self._first, self._size, self._q, self._cum, self._to, self._piece):
            c.n = 0
        self.view()

    def view(self) -> None:
        self.first, self.size, self.q, self.cum, self.to, self.piece = (c.room[: c.n] for c in (self._first, self._size, self._q, self._cum, self._to, self._piece))

    def rest(self, e: np.ndarray) -> np.ndarray:
        """Probability of the other edges of each edge's node; just 0 only if there are none."""
        return 1.0 - self.q[e]

    def byte_piece(self, code: int) -> int:
        if code not in self.spell:
            self.spell[code] = len(self.spelled)
            self.spelled.append([self.vocab.byte_id[b] for b in chr(code).encode("utf-8", "surrogatepass")])
        return -1 - self.spell[code]

    def add(self, units: list[str]) -> None:
        v, size = self.vocab, np.fromiter(map(len, units), np.int64, len(units))
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.repeat(np.cumsum(size), size)
        literal = code == ord(META)
        seen = np.where(code == 32, ord(META), code).astype(np.uint64)
        found: list[tuple] = []
        pos = np.flatnonzero(~literal)
        node, k = np.zeros(len(pos), np.int64), 0
        bare = np.ones(len(code), bool)
        while len(pos):
            node = v.step(node, seen[pos + k]) if k else v.root[seen[pos].astype(np.int64)]
            ok = node >= 0
            pos, node = pos[ok], node[ok]
            k += 1
            hit = v.ends[node] >= 0
            found.append((pos[hit], k, v.ends[node[hit]], None))
            if k == 1:
                bare[pos[hit]] = False
            more = pos + k < end[pos]
            pos, node = pos[more], node[more]
        at = np.flatnonzero(bare)
        kinds, which = np.unique(code[at], return_inverse=True)
        found.append((at, 1, np.array([self.byte_piece(c) for c in kinds.tolist()], np.int64)[which] if len(at) else at, -13.8))
        count = np.zeros(len(code), np.int64)
        for p, *_ in found:
            count[p] += 1  # a position occurs once in each
        # edges lie in order of their start's distance from the word's end, so each distance is one stretch of them
        left = end - np.arange(len(code))
        order = np.argsort(left.astype(np.uint16) if size.max() < 1 << 16 else left, kind="stable")
        per = count[order]
        lead = np.cumsum(per) - per
        first = np.empty_like(lead)
        first[order] = lead
        n, word = int(count.sum()), np.repeat(np.arange(len(units)), size)
        to, piece, lp, at = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n), first.copy()
        for p, k, i, lone in reversed(found):
            e = at[p]
            at[p] += 1
            to[e], piece[e], lp[e] = p + k + word[p], i, v.log_prob[i] if lone is None else lone
        back = np.zeros(len(code) + len(units))  # by node: log of the sum over ways to the word's end, 0 there
        node = order + word[order]
        left = np.bincount(size)  # words by length: positions at distance d are as many as words of length d or more
        bounds = np.concatenate([[0], np.cumsum(np.cumsum(left[::-1])[::-1][1:])])
        q = np.zeros(n)
        for a, b in zip(bounds, bounds[1:]):
            x, y = lead[a], lead[b - 1] + per[b - 1]
            w = lp[x:y] + back[to[x:y]]
            m = np.maximum.reduceat(w, lead[a:b] - x)
            w = np.exp(w - np.repeat(m, per[a:b]))
            t = np.add.reduceat(w, lead[a:b] - x)
            back[node[a:b]] = m + np.log(t)
            q[x:y] = w / np.repeat(t, per[a:b])
        q = np.where(np.repeat(per == 1, per), 1.0, np.clip(q, 1e-300, 1 - 2**-53))
        cum = np.cumsum(q)
        cum -= np.repeat((cum - q)[lead], per)
        cum[lead + per - 1] = 2.0
        base, edge = self._first.n, self._q.n
        by_node, sizes = np.zeros(len(back), np.int64), np.zeros(len(back), np.int32)
        by_node[node], sizes[node] = lead + edge, per
        for c, x in ((self._first, by_node), (self._size, sizes), (self._q, q), (self._cum, cum), (self._to, base + to), (self._piece, piece)):
            c.extend(x)
        self.start.update(zip(units, (base + np.cumsum(size) - size + np.arange(len(units))).tolist()))
        self.view()

    def starts(self, units: list[str]) -> np.ndarray:
        if len(self.start) > self.limit:
            self.clear()
        out = np.fromiter(map(self.start.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            self.add(list(dict.fromkeys(new)))
            out[missing] = np.fromiter(map(self.start.__getitem__, new), np.int64, len(new))
        return out

    def walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One random path from each node to its word's end: edges, and offsets by path. seed: one number per path."""
        steps, who = [], []
        live, cur, t = np.arange(len(node)), node, 0
        while True:
            more = self.size[cur] > 0
            live, cur = live[more], cur[more]
            if not len(live):
                break
            u = uniform(seed[live] + np.uint64(t * 0x632BE59BD9B4E019 % 2**64))
            e = self.first[cur]
            late = np.flatnonzero(self.cum[e] <= u)
            while len(late):
                e[late] += 1
                late = late[self.cum[e[late]] <= u[late]]
            steps.append(e), who.append(live)
            cur = self.to[e]
            t += 1
        off = np.zeros(len(node) + 1, np.int64)
        for w in who:
            off[1:][w] += 1
        off = np.cumsum(off)
        out = np.zeros(off[-1], np.int64)
        for t, (e, w) in enumerate(zip(steps, who)):
            out[off[w] + t] = e
        return out, off


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit numbers."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def mix_one(h: int) -> int:
    """mix() of one number."""
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 33)


def within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of the runs of these sizes."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def spread(bases: list[int], size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each place of each run, from the run's base."""
    return np.repeat(np.array(bases, np.uint64), size) + place.astype(np.uint64) * STRIDE


def truncated(loc: np.ndarray, top, u: np.ndarray) -> np.ndarray:
    """Gumbel variates at loc, each given that it is below top."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(loc), -np.inf, loc - np.log(np.exp(np.minimum(loc - top, 700.0)) - np.log(u)))


class Text:
    """The search for one text: its words' start nodes, its queue, its samples so far."""

    def __init__(self, nodes: np.ndarray, key: int):
        self.nodes, self.key, self.queue, self.count = nodes, int(key), [], 0
        self.samples: list[tuple[np.ndarray, float]] = []

    def base(self, tag: int) -> int:
        return (self.key + tag * 0x9E3779B97F4A7C15) % 2**64

    def number(self, tag: int) -> float:
        """In (0, 1)."""
        return ((mix_one(mix_one(self.base(tag))) >> 11) + 0.5) * 2.0**-53

    def begin(self) -> tuple[np.ndarray, int]:
        """What is to walk, and the tag of its random numbers."""
        self.pending = (float(-np.log(-np.log(self.number(1)))), np.zeros(0, np.int64), 0.0)
        return self.nodes, 2

    def resume(self, lat: Lattices) -> tuple[np.ndarray, int] | None:
        """Take the best node of the queue, choose among its edges; what is left to walk, or None if the queue is empty."""
        if not self.queue:
            return None
        top, _, path, t, ex = heapq.heappop(self.queue)
        top, tag = -top, 16 + 4 * len(self.samples)
        node = self.node_of(lat, path, t)
        first = int(lat.first[node])
        free = [e for e in range(first, first + int(lat.size[node])) if e not in ex]
        w = np.cumsum(lat.q[free])
        e = free[min(int(np.searchsorted(w, self.number(tag) * w[-1], side="right")), len(free) - 1)]
        before = float(np.log(lat.q[path[:t]]).sum())
        left = lat.q[free].sum() - lat.q[e] if len(free) > 1 else 0.0
        if left > 0:
            loc = before + np.log(left)
            g = loc - np.log(np.exp(min(loc - top, 700.0)) - np.log(self.number(tag + 1)))
            self.push(g, np.append(path[:t], e), t, (*ex, e))
        head = np.append(path[:t], e)
        self.pending = (top, head, before + float(np.log(lat.q[e])))
        word = self.word_of(lat, head)
        nodes = np.concatenate([[lat.to[e]], self.nodes[word + 1 :]]).astype(np.int64)
        return nodes, tag + 2

    def push(self, g: float, path: np.ndarray, t: int, ex: tuple) -> None:
        if np.isfinite(g):
            self.count += 1
            heapq.heappush(self.queue, (-g, self.count, path, t, ex))

    def node_of(self, lat: Lattices, path: np.ndarray, t: int) -> int:
        """The node at which the path's edge t starts: the end of the one before, or the start of the next word."""
        if t == 0:
            return int(self.nodes[0])
        end = lat.to[path[t - 1]]
        if lat.size[end]:
            return int(end)
        return int(self.nodes[self.word_of(lat, path[:t]) + 1])

    def word_of(self, lat: Lattices, path: np.ndarray) -> int:
        """Number of the word in which the path's last edge lies."""
        end = lat.to[path]
        return int((lat.size[end] == 0).sum()) - int(lat.size[end[-1]] == 0)

    def finish(self, lat: Lattices, tail: np.ndarray, log_q: np.ndarray, g: np.ndarray, keep: int) -> None:
        """Complete the pending node by the walked edges, and queue the best keep nodes that they passed by. g: the variates
        of the first ones."""
        top, head, phi = self.pending
        path = np.concatenate([head, tail])
        if len(tail):
            while True:
                n = len(g)
                best = np.argpartition(-g, keep)[:keep] if n > keep else np.arange(n)
                # a variate is at most REACH above its location, and locations only fall: none further on can be better
                if n == len(tail) or (n > keep and phi + log_q[:n].sum() + REACH < g[best].min()):
                    break
                g = variates(lat, [self], tail, log_q, np.array([0, len(tail)]), 8 * n)
            for t in sorted(best.tolist()):
                self.push(float(g[t]), path, len(head) + t, (int(tail[t]),))
            phi += float(log_q.sum())
        self.samples.append((path, phi))


def variates(lat: Lattices, texts: list[Text], edges: np.ndarray, log_q: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For the first edges of each text, at most `most`, the variates of the nodes that they passed by. Text i has
    edges[ends[i]:ends[i + 1]]."""
    size = np.minimum(np.diff(ends), most)
    place = within(size)
    before = np.zeros(len(place))
    for a, n, x in zip(ends.tolist(), size.tolist(), (np.cumsum(size) - size).tolist()):
        if n > 1:
            np.cumsum(log_q[a : a + n - 1], out=before[x + 1 : x + n])
    phi, top = (np.repeat([t.pending[i] for t in texts], size) for i in (2, 0))
    with np.errstate(divide="ignore"):
        loc = phi + before + np.log(lat.rest(edges[np.repeat(ends[:-1], size) + place]))
    return truncated(loc, top, uniform(spread([t.base(19 + 4 * len(t.samples)) for t in texts], size, place)))


def search(lat: Lattices, words: list[list[str]], keys: list[int], k: int) -> list[Text]:
    """k samples of each text; all texts' walks of a round run together, and so do the variates along them."""
    flat = lat.starts([u for w in words for u in w])
    off = np.cumsum([0, *map(len, words)])
    texts = [Text(flat[off[i] : off[i + 1]], key) for i, key in enumerate(keys)]
    for r in range(k):
        todo = [(t, *w) for t in texts if (w := t.begin() if r == 0 else t.resume(lat)) is not None]
        if not todo:
            break
        size = np.array([len(nodes) for _, nodes, _ in todo])
        seeds = mix(spread([t.base(tag) for t, _, tag in todo], size, within(size)))
        edges, at = lat.walk(np.concatenate([nodes for _, nodes, _ in todo]), seeds)
        ends = at[np.concatenate([[0], np.cumsum(size)])]
        log_q = np.log(lat.q[edges])
        g = variates(lat, [t for t, *_ in todo], edges, log_q, ends, FIRST)
        upto = np.cumsum([0, *np.minimum(np.diff(ends), FIRST).tolist()]).tolist()
        for (t, *_), a, b, x, y in zip(todo, ends[:-1].tolist(), ends[1:].tolist(), upto, upto[1:]):
            t.finish(lat, edges[a:b], log_q[a:b], g[x:y], k + 1)  # k - 1 more pops and the threshold need no others
    return texts


def piece_runs(lat: Lattices, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all paths, and where each path's start."""
    ends = np.cumsum([0, *map(len, paths)])
    if not ends[-1]:
        return np.zeros(0, np.int32), ends
    path = np.concatenate(paths)
    odd = np.flatnonzero(lat.piece[path] < 0)
    more = np.array([len(lat.spelled[x]) - 1 for x in (-1 - lat.piece[path[odd]]).tolist()], np.int64)
    return piece_ids(lat, path), ends + np.concatenate([[0], np.cumsum(more)])[np.searchsorted(odd, ends)]


def piece_ids(lat: Lattices, path: np.ndarray) -> np.ndarray:
    ids = lat.piece[path]
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids.astype(np.int32)
    spelled = [lat.spelled[x] for x in (-1 - ids[odd]).tolist()]
    size = np.ones(len(ids), np.int64)
    size[odd] = [len(x) for x in spelled]
    out = np.repeat(ids, size).astype(np.int32)
    end = np.cumsum(size)[odd]
    at = np.repeat(end, size[odd]) - np.concatenate([np.arange(n, 0, -1) for n in size[odd].tolist()])
    out[at] = [b for x in spelled for b in x]
    return out


_KEPT: dict[int, Lattices] = {}


def kept_lattices(pieces: list[str], kinds: list[int], reuse: bool) -> Lattices:
    """One model's lattices, kept by a worker for its next task if reuse is asked for; else its trie alone, and few lattices
    at a time."""
    model = xxhash.xxh64_intdigest("\n".join(pieces).encode() + bytes(kinds))
    if model not in _KEPT:
        _KEPT.clear()
        _KEPT[model] = Lattices(Vocabulary(pieces, kinds))
    return _KEPT[model] if reuse else Lattices(_KEPT[model].vocab, 25_000)


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, reuse: bool = True) -> DataFrame:
    """Up to k rows per row of docs, fewer if the text has fewer segmentations: doc_id, sample (0 is the greatest
    variate), n_pieces, log_prob, log_inclusion, ids_hash (XXH64 of the ids as int32, signed), round_trip (decoding the
    ids gives the text back) and, if with_ids, ids.

    Random numbers depend on the doc_id (a null one counts as empty text) and the position only: equal rows get equal
    samples wherever they lie. Null and empty texts have one segmentation, of no pieces. Characters outside the
    vocabulary, and a literal U+2581, are spelled in bytes. Whole texts are read, whatever their length. Other columns are
    not looked at; an empty table gives an empty result.

    With reuse a Python worker keeps its lattices, some 100 MB, for its next task, which saves building them anew; without,
    it takes shorter runs of texts, holds the lattices of 25,000 words and a run's at most, and none when a task has ended,
    which leaves the memory to other stages of one session. The result is the same.

    The model is a merge list: its scores are ranks and no probabilities, and it is not trained here. A piece's probability
    is taken from its rank by a Zipf-Mandelbrot law.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_model(model))
    names = ["doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids_hash", "round_trip"] + ["ids"] * with_ids

    def run(batches):
        lat = kept_lattices(*shared.value, reuse)
        for b in batches:
            for part in portions(b, 1, 600_000 if reuse else 150_000):
                yield sampled(lat, part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])

    def sampled(lat, doc_ids, texts):
        words = [UNIT.findall(" " + t) if t else [] for t in texts]
        keys = [xxhash.xxh64_intdigest(b"" if i is None else str(i).encode(), 5) for i in doc_ids]
        rows = {n: [] for n in names}
        paths, source = [], []
        for i, t, s in zip(doc_ids, texts, search(lat, words, keys, k)):
            kappa = -s.queue[0][0] if s.queue else -np.inf
            for n, (path, phi) in enumerate(s.samples):
                paths.append(path), source.append(t)
                rows["doc_id"].append(i), rows["sample"].append(n), rows["log_prob"].append(phi)
                with np.errstate(divide="ignore", over="ignore"):
                    x = phi - kappa
                    rows["log_inclusion"].append(float(x if x < -30 else np.log(-np.expm1(-np.exp(x)))))
        ids, off = piece_runs(lat, paths)
        rows["n_pieces"] = np.diff(off)
        raw = memoryview(ids).cast("B")
        rows["ids_hash"] = [xxhash.xxh64_intdigest(raw[4 * x : 4 * y]) - (1 << 63) for x, y in zip(off.tolist(), off[1:].tolist())]
        rows["round_trip"] = [x == t.encode("utf-8", "surrogatepass") for x, t in zip(lat.vocab.decode(ids, off), source)]
        arrays = [pa.array(rows[n], y) for n, y in zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()))]
        if with_ids:
            arrays.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)))
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, sample int, n_pieces long, log_prob double, log_inclusion double, ids_hash long, round_trip boolean"
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(frugal(run), schema + ", ids array<int>" * with_ids)
