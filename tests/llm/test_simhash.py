import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftlog.llm.simhash import bucket_edges, drop_near_duplicates, fingerprint, simhash_groups


def brute_fp(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    ids, fps = [r[0] for r in rows], [brute_fp(r[1]) for r in rows]
    lab = list(range(len(rows)))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                lab[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in out.items()}
    return [(ids[i], fps[i], least[find(i)]) for i in range(len(rows))]


def brute_shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_kept(rows, least=0.8):
    """Names (id, text) of the first row of each component of texts with Jaccard of at least `least` on five words."""
    sets = [brute_shingles(t) for _, t in rows]
    lab = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                lab = [lab[j] if x == lab[i] else x for x in lab] if lab[i] != lab[j] else lab
    out = {}
    for x, r in zip(lab, rows):
        out.setdefault(x, []).append(r)
    return {min(v, key=lambda r: (r[0] is None, r[0] or 0)) for v in out.values()}


def corpus(n=160, seed=3):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(n):
        if i % 4 and rows and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 40, 200])))))
    return rows + [(1000, None), (1001, ""), (None, "w1 w2 w3"), (5, rows[5][1]), (1002, "A\x0bb\tC\n d")]


def test_fingerprint():
    for _, t in corpus():
        assert fingerprint(t) == brute_fp(t)


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_slices_against_popcount(radius):
    g = np.random.default_rng(radius)
    base = g.integers(0, 2**63, 7, dtype=np.uint64)
    fps = base[g.integers(0, 7, 500)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << g.integers(0, 64, 500).astype(np.uint64))
    fps = np.concatenate([fps, g.integers(0, 2**63, 100, dtype=np.uint64)])
    bucket = np.sort(g.integers(0, 5, len(fps)))
    a, b = bucket_edges(fps, bucket, radius)
    assert all((int(x) ^ int(y)).bit_count() >= 0 for x, y in zip(a, b))
    label = np.arange(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if bucket[i] == bucket[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius and label[i] != label[j]:
                label[label == label[i]] = label[j]
    assert len(a) == len(fps) - len(set(label.tolist()))


@pytest.mark.parametrize("tile", [8192, 16])
def test_groups(spark, tile, monkeypatch):
    import driftlog.llm.simhash as s

    monkeypatch.setattr(s.near_links, "__defaults__", (4, tile))
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, fp string, text_key double")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_groups(df).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


def test_empty(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dropping_keeps_columns_that_clash(spark):
    rows = [(i, "one text that is the same for all of them") for i in range(5)] + [(9, None), (8, ""), (None, "another text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_id", "_key", "_text_key", "fp", "root", "first", "a.b")})
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["0", "8", "None"]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def edited(seed):
    """Texts of 20 to 400 words and copies with edits around Jaccard 0.8, chains of copies, and short ones."""
    r = random.Random(seed)
    vocab = ["v%d" % i for i in range(2000)]
    rows = [(i, " ".join(r.choices(vocab, k=r.choice([20, 50, 100, 400])))) for i in range(40)]
    for i in range(40, 160):
        w = r.choice(rows)[1].split()
        for _ in range(r.randrange(0, 1 + max(2, len(w) // 40))):
            at = r.randrange(len(w))
            w[at : at + r.randrange(2)] = [r.choice(vocab)]
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, " \t "), (203, "a b"), (204, "b a"), (205, "A\nb"), (None, rows[3][1]), (7, rows[3][1].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed):
    rows = edited(seed)
    want = brute_kept(rows)
    assert len(want) < len(rows) - 60
    got = drop_near_duplicates(spark.createDataFrame(rows + rows[:9] + 80 * rows[12:13], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in want)


def test_tiles_of_a_large_bucket_lose_no_meeting(spark):
    from driftlog.llm.simhash import meeting

    g = np.random.default_rng(5)
    base = g.integers(0, 2**62, 60)
    fps = [*base.tolist(), *(int(x) ^ 5 for x in base[:20])]
    rows = [(b, i, x) for b in (1, 2) for i, x in enumerate(fps) if b == 1 or i < 60]
    want = {(b, i) for b, i, x in rows if any(b == c and i != j and (x ^ y).bit_count() <= 3 for c, j, y in rows)}
    df = spark.createDataFrame(rows, "bucket long, node long, fp long")
    for tile in (8, 8192):
        got = [tuple(r) for r in meeting(df, 3, tile).collect()]
        assert len(got) == len(want) and set(got) == want
