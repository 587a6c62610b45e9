import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from driftlog.llm.hpylm import CLASSES, J, SPLIT, UNLISTED, Seating, blocks, lower_model, most_frequent, sample_model, score_lower, train_and_score, unpack, whole_buckets


def partitions(n, most=None):
    if n == 0:
        yield ()
    for k in range(min(n, most or n), 0, -1):
        for rest in partitions(n - k, k):
            yield (k, *rest)


def exact_tables(c, d, theta, p0):
    """Distribution of the number of tables of c customers who all eat one dish."""
    w = Counter()
    for sizes in partitions(c):
        ways = math.factorial(c)
        for s, m in Counter(sizes).items():
            ways //= math.factorial(s) ** m * math.factorial(m)
        x = ways * math.prod(theta + d * i for i in range(len(sizes))) * p0 ** len(sizes)
        w[len(sizes)] += x * math.prod(math.prod(k - d for k in range(1, s)) for s in sizes)
    z = sum(w.values())
    return {k: v / z for k, v in w.items()}


@pytest.mark.parametrize("c", [2, 5, 7])
def test_seating_against_enumeration(c):
    n, d, theta, p0 = 20000, 0.5, 1.0, 0.3
    s = Seating(np.arange(n), np.full(n, c), n, d, theta, np.random.default_rng(c))
    base = np.full(n, p0)
    s.begin(base)
    for _ in range(6):
        s.sweep(base)
    assert ((np.arange(1, J + 1)[:, None] * s.n).sum(axis=0) + s.pooled(np.arange(n)) == c).all()
    got = Counter(s.tables().tolist())
    for t, p in exact_tables(c, d, theta, p0).items():
        assert abs(got[t] / n - p) < 5 * math.sqrt(p / n) + 2e-3


def test_many_customers_stay_consistent():
    s = Seating(np.zeros(5, np.int64), np.array([1, 9, 50, 5000, 200000]), 1, 0.6, 1.0, np.random.default_rng(0))
    p0 = np.full(5, 0.2)
    s.begin(p0)
    for _ in range(20):
        s.sweep(p0)
        over = s.pooled(np.arange(5))
        assert (s.n >= 0).all() and (s.big >= 0).all() and (over >= 0).all()
        assert ((over > 0) == (s.big > 0)).all() and (s.tables() <= s.c).all()


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    cell = np.unique(r.integers(0, 20 * 50, 300))
    p = sample_model(cell, r.geometric(0.1, len(cell)), 20, 50)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
    assert np.allclose(sample_model(np.zeros(0, np.int32), np.zeros(0, np.int64), 3, 4), 0.25)


def toy(n=400, seed=2):
    r = random.Random(seed)
    chains = [[f"{p}{i}" for i in range(60)] for p in ("aa", "Bb", "çc")]
    rows = []
    for i in range(n):
        vocab = r.choice(chains)
        k, out = r.randrange(60), []
        for _ in range(r.choice([0, 5, 80])):
            k = (k + r.choice([1, 1, 1, 7])) % 60
            out.append(vocab[k] if r.random() < 0.97 else "x%d" % r.randrange(10**6))
        rows.append((i, " ".join(out)))
    return rows + [(9000, None), (9001, ""), (None, "aa1 aa2"), (3, rows[3][1]), (9002, "z " * 30000)]


def test_against_plain_counts(spark):
    rows = toy()
    df = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, score string")
    got = train_and_score(df, contexts=20, dishes=40, listed=60).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tok(t)), sum(w in c for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 5)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)  # both are negative


@pytest.mark.parametrize("most", [0, 3, 50, 1000])
def test_most_frequent(spark, most):
    rows = [(h, 0, c) for h, c in enumerate([900, 1, 1, 40, 39, 7, 7, 7, *[2] * 200])]
    h, c = most_frequent(spark.createDataFrame(rows, "h long, cls int, c long"), most)
    want = sorted(((c, h) for h, _, c in rows), key=lambda x: (-x[0], x[1]))
    assert list(zip(c, h)) == want[: len(h)] and len(h) <= most
    assert len(h) == {0: 0, 3: 3, 50: 6, 1000: 208}[most]


def test_empty(spark):
    assert train_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_customers_come_and_go():
    r = np.random.default_rng(5)
    c = r.integers(0, 60, 40)
    s = Seating(np.zeros(40, np.int64), c.copy(), 1, 0.5, 1.0, r)
    p = np.full(40, 1 / 40)
    s.begin(p)
    for _ in range(12):
        want = np.maximum(0, c + r.integers(-30, 30, 40))
        s.change(want, p)
        s.sweep(p)
        assert (s.c == want).all() and s.total[0] == want.sum()
        small = (np.arange(1, J + 1)[:, None] * s.n).sum(axis=0)
        assert (s.n >= 0).all() and (small <= want).all() and ((s.big > 0) == (small < want)).all()
        assert ((want - small) >= s.big).all()
        assert ((s.tables() > 0) == (want > 0)).all()
        own, mass = s.kept()
        assert abs(own.sum() + mass[0] - 1) < 1e-9


def test_most_frequent_with_ties(spark):
    rows = [(h << 48, 0, c) for h, c in [*((k, 1000 - k) for k in range(50)), *((1000 + 31 * k, 7) for k in range(900))]]
    t = spark.createDataFrame(rows, "h long, cls int, c long")
    for most in (30, 50, 500, 2000):
        h, c = most_frequent(t, most)
        want = sorted(((-c, h) for h, _, c in rows))[:most]
        got = list(zip((-c).tolist(), h.tolist()))
        assert got == want[: len(got)] and len(want) - len(got) <= 8


def test_rare_pairs_have_cells(spark):
    """Words past every limit, of one class and equally frequent: only a cell of their own tells pairs apart."""
    n = 12
    train = [(i, " ".join(f"w{i % n}zz v{i % n}zz" for _ in range(3))) for i in range(400)]
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 5 == 1][: 2 * n]
    seen = [(held[j], f"w{j}zz v{j}zz") for j in range(n)]
    unseen = [(held[n + j], f"w{j}zz v{(j + 1) % n}zz") for j in range(n)]
    df = spark.createDataFrame(train + seen + unseen, "doc_id long, text string")
    for listed in (2, 10, 100):
        got = {r.doc_id: r.score for r in train_and_score(df, contexts=1, dishes=1, listed=listed).collect()}
        # v follows w always: a ninth of the class's probability, or less, goes to any other
        assert min(got[i] for i, _ in seen) > max(got[i] for i, _ in unseen) + 0.9


def test_lower_restaurants_sum_to_one(spark):
    """One held-out occurrence of each word in each lower restaurant: the probabilities sum up to one."""
    dishes, contexts, r = 3, 2, np.random.default_rng(3)
    width, k = dishes + CLASSES, 5
    count = np.array([90, 70, 50, 8, 7, 6, 0, 0])  # ranks 0-2 dishes, 3-5 listed; two unlisted words, the last one unseen
    code = [0, 1, 2, 3, 4, 5, 11 - UNLISTED, 12 - UNLISTED]
    tables, other = np.array([0, 0, 0, 4, 3, 2]), {6: 2, 7: 0}
    prob = r.dirichlet(np.ones(width), contexts + CLASSES + 1)
    prob[:, dishes:] = 0
    prob[:, dishes + k] = 1 - prob[:, :dishes].sum(axis=1)
    disc, v, n = np.full(CLASSES, 0.4), 4, 11
    norm, fresh = np.full(CLASSES, 1.0 + n), np.full(CLASSES, 1 + 0.4 * v)
    m = {"prob": prob, "tables": tables, "disc": disc, "norm": norm, "fresh": fresh, "z": 300.0, "d": 0.6}
    rows, row, upper = [], 0, {}
    # a rare context with every word, an unseen context, a frequent context's class with the class's words
    for g, u, words, seen in ((4, contexts + k, range(8), True), (5, contexts + k, range(8), False), (SPLIT + 1 * CLASSES + k, 1, range(3, 8), True)):
        for w in words:
            dish = w if w < dishes else dishes + k
            extra = (int(count[w]) or None, other[w] or None) if w >= 6 else (None, None)
            if seen and w in (1, 3, 4, 6):
                rows.append((-1 - row, g, code[w], u * width + dish, int(r.integers(1, 30)), *extra))
            rows.append((row, g, code[w], u * width + dish, -1, *extra))
            t = tables[w] if w < 6 else other[w]
            inside = 1 if w < dishes else (t - 0.4 if t else fresh[0]) / norm[0]
            upper[row] = g, (inside if w < 6 else 1) * (1 if g >= SPLIT else prob[u, dish])
            row += 1

    class Shared:
        value = m

    listed = [x for x in rows if x[2] >= 0]
    column = lambda i: np.array([x[i] for x in listed])
    cell = column(3)
    packed = blocks(1, column(1), cell // width, column(2), np.maximum(cell % width - dishes, 0), column(4), column(0))
    others = [(b, None, row, g, cell // width, w, cell % width - dishes, n, c, t) for b, (row, g, w, cell, n, c, t) in ((0, x) for x in rows if x[2] < 0)]
    df = spark.createDataFrame([(b, bytearray(x), *[None] * 8) for b, x in packed] + others, "bucket int, block binary, row long, g long, u long, w long, k long, n long, c long, t long")
    total = Counter()
    for x in score_lower(df, Shared, dishes).collect():
        if x.row >= 0:
            total[upper[x.row][0]] += upper[x.row][1] * 10**x.score
    assert all(abs(p - 1) < 1e-9 for p in total.values()) and len(total) == 3


@pytest.mark.parametrize("c", [2, 5])
def test_lower_model_against_enumeration(c):
    """One cell in each restaurant: the mean of own against the exact distribution of tables."""
    n, d, p0 = 30000, 0.6, 0.2
    own, mass = lower_model(np.arange(n), np.full(n, c), n, np.full(n, p0), d, 10, 2, 1)
    mean = sum(t * p for t, p in exact_tables(c, d, 1.0, p0).items())
    assert abs(own.mean() - (c - d * mean) / (1 + c)) < 3e-3 and np.allclose(own + mass, 1)


def test_blocks():
    r = np.random.default_rng(0)
    n = 4000
    g, w = r.choice([-(1 << 63) + 5, -7, 3, 9, 400, SPLIT + 77], n), r.choice([-9, 0, 5, 199_999, -(1 << 62)], n)
    u, k, times, row = g % 400, w % CLASSES, r.choice([-2, -1, 40_000], n), r.integers(-(1 << 63), 1 << 63, 300)[r.integers(0, 300, n)]
    for rows in (row, None):
        want, seen = Counter(), {}
        for x in zip(g.tolist(), u.tolist(), w.tolist(), k.tolist(), times.tolist(), row.tolist() if rows is not None else [0] * n):
            want[(*x[:4], x[5])] += x[4]
        got = Counter()
        for bucket, b in blocks(4, g, u, w, k, times, rows):
            *pair, c, back = unpack(b)
            for x in zip(*(y.tolist() for y in pair), back.tolist() if rows is not None else [0] * len(c), c.tolist()):
                assert x[:-1] not in got and seen.setdefault(x[0], bucket) == bucket
                got[x[:-1]] = x[-1]
        assert got == want
    assert not list(blocks(4, *(np.zeros(0, np.int64) for _ in range(5))))


def test_whole_buckets():
    import pyarrow as pa

    x = np.repeat(np.arange(40), np.random.default_rng(0).integers(1, 90, 40)).astype(np.int32)
    for size in (1, 7, 1000, 10**6):
        parts = [t.column("bucket").to_numpy() for t in whole_buckets(iter(pa.table({"bucket": x}).to_batches(max_chunksize=size)))]
        assert (np.concatenate(parts) == x).all() and [p[0] for p in parts] == list(range(40)) and all((p == p[0]).all() for p in parts)
    assert not list(whole_buckets(iter(())))


def test_a_task_gives_one_row_of_sums_for_each_text():
    from driftlog.llm.hpylm import summed

    rng = np.random.default_rng(3)
    found = [(rng.integers(0, 200, 500), rng.integers(0, 3, 500), rng.random(500)) for _ in range(40)]
    for most, limit in ((10_000, 200), (1000, 200), (300, 200 * 40)):
        got = [np.concatenate(x) for x in zip(*summed(iter(found), most))]
        assert len(got[0]) <= limit
        for k in (1, 2):
            assert np.allclose(np.bincount(got[0], got[k], 200), sum(np.bincount(x[0], x[k], 200) for x in found))
    assert not list(summed(iter([])))


def test_a_part_asks_once_for_each_pair(spark):
    """However many texts a part has, a bucket gets one row of it; the part's record leads from its texts to what it asks."""
    from pyspark.sql import functions as F

    from driftlog.llm.hpylm import UPPER, asked_pairs, columns_of, word_class, word_hash

    contexts, dishes, buckets = 20, 40, 5
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    rows = toy(300)
    top = [w for w, _ in Counter(w for _, t in rows for w in tok(t)).most_common(60)]
    rank = {word_hash(w): i for i, w in enumerate(top)}

    class Shared:
        value = rank, np.full(60, -1.0)

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held", F.col("doc_id") % 5 == 1)
    asked = asked_pairs(df.withColumn("held", F.coalesce("held", F.lit(False))), Shared, contexts, dishes, buckets).collect()
    records = [r for r in asked if r.bucket == -1]
    assert len(records) <= 3 and len([r for r in asked if r.chunk is not None]) <= len(records) * (1 + buckets)
    code = lambda w: rank.get(word_hash(w), word_hash(w) - UNLISTED)
    want, got, trained = Counter(), Counter(), 0
    for i, t in rows:
        before = None
        for w in tok(t):
            c, b = code(w), None if before is None else code(before)
            if before is None or 0 <= b < contexts:
                u = contexts + CLASSES if before is None else b
                g = UPPER + u if 0 <= c < dishes else SPLIT + u * CLASSES + word_class(w)
            else:
                g = b
            want[i, g, c] += 1
            trained += g < UPPER and (i is None or i % 5 != 1)
            before = w
    for r in records:
        found = sorted((x.bucket, bytes(x.block)) for x in asked if x.chunk == r.chunk and x.bucket >= 0)
        g, _, w, _, n, _ = (np.concatenate(x).tolist() for x in zip(*(unpack(b) for _, b in found)))
        low, other, upper, index, off, ids, null, known, base = columns_of(bytes(r.block), np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int8, np.int32, np.float64)
        assert low[0] == len(g) == len(set(zip(g, w))) and [i for i, x in enumerate(w) if x < 0] == other.tolist()
        trained -= sum(n)
        pairs = [*zip(g, w), *((UPPER + x // (dishes + CLASSES), x % (dishes + CLASSES)) for x in upper.tolist())]
        at = np.cumsum(index)
        for i, lo, hi, no, k, s in zip(ids.tolist(), off, off[1:], null, known, base):
            got.update((None if no else i, *pairs[x]) for x in at[lo:hi].tolist())
            assert s == -k == -sum(pairs[x][1] >= 0 for x in at[lo:hi].tolist())
    assert got == want and trained == 0
