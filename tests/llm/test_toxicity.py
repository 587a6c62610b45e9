import itertools
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from driftlog.llm.toxicity import Batch, Field, fit_field, observed, score, sums, suspects, train


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    for _ in range(30):
        f = Field([b"a", b"b"], r.normal(size=2), float(r.normal()), np.log(r.dirichlet([1, 1], 2)))
        n = int(r.integers(1, 9))
        at = np.sort(r.choice(n, size=int(r.integers(1, n + 1)), replace=False))
        word = r.integers(0, 2, len(at))
        unary = np.full(n, f.plain)
        unary[at] = f.weights[word]
        z, hit = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            s = sum(unary[i] for i in range(n) if path[i]) + sum(f.trans[a, b] for a, b in zip((0, *path), path))
            z += np.exp(s)
            hit += np.exp(s) * np.array(path)
        assert np.allclose(f.marginals(at, word, n), hit[at] / z)


def test_held_out_accuracy(spark):
    r = random.Random(4)
    clean, bad = ["w%d" % i for i in range(300)], ["nasty", "vile", "rotten"]
    docs, labels = [], []
    for i in range(900):
        y = int(r.random() < 0.2)
        w = r.choices(clean, k=r.choice([20, 200])) + (r.choices(bad, k=4) if y else r.choices(bad, k=1) * (r.random() < 0.03))
        r.shuffle(w)
        docs.append((i, " ".join(w), "en"))
        if i % 5:
            labels.append((i, y, 1))
    docs += [(None, "vile rotten nasty", "en"), (5000, None, "en"), (5001, "", "en"), docs[3], (5002, "x " * 50000 + "nasty vile. Rotten!", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (7, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    out = score(d, *train(d, lab)).collect()
    assert len(out) == len(docs)
    got = {x.doc_id: x for x in out}
    truth = dict((i, y) for i, y, _ in labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == truth[i] for i in held) > 0.95 * len(held)
    assert got[None].predicted == 1 and got[5000].predicted == 0 and got[5001].score == got[5000].score
    assert [s.first for s in got[5002].spans][0] == 50000


def test_suspects_at_any_share_and_number(spark):
    rows = [(b"bad%d" % i, 200, 210) for i in range(600)] + [(b"plain", 100, 200), (b"clean", 10, 200), (b"rare", 3, 3)]
    c = spark.createDataFrame(rows, "word binary, toxic_docs long, docs long")
    for n_toxic in (300, 500, 700):  # of 1,000
        assert set(suspects(c, n_toxic, 1000)) == {w for w, _, _ in rows[:600]}


def test_half_of_the_labels_toxic(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choices(["w%d" % k for k in range(100)], k=30) + ["vile"] * (i % 2))) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = score(d, *train(d, spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int"))).collect()
    assert all(x.predicted == x.doc_id % 2 for x in out)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert score(d, *train(d, lab)).count() == 0


def brute_sums(field, sample):
    """Log Z and expected toxic tokens by all labellings."""
    log_z, got = 0.0, np.zeros(len(field.words))
    for at, k, n, _ in sample:
        word, total, hot = dict(zip(at.tolist(), k.tolist())), 0.0, np.zeros(len(field.words))
        for ys in itertools.product([0, 1], repeat=n):
            v, last = 0.0, 0
            for i, y in enumerate(ys):
                v += field.trans[last, y] + y * (field.weights[word[i]] if i in word else field.plain)
                last = y
            total += math.exp(v)
            for i, j in word.items():
                hot[j] += ys[i] * math.exp(v)
        log_z += math.log(total)
        got += hot / total
    return log_z, got


def small_sample():
    r = np.random.default_rng(2)
    out = []
    for _ in range(25):
        n = int(r.integers(0, 9))
        at = np.flatnonzero(r.random(n) < 0.4)
        out.append((at, r.integers(0, 3, len(at)), n, int(r.random() < 0.5)))
    return out


def test_sums_against_all_labellings():
    field = Field([b"a", b"b", b"c"], np.array([0.7, -0.4, 1.9]), -0.8, np.array([[0.0, -0.6], [0.3, 0.5]]))
    for got, want in zip(sums(field, Batch(small_sample()), marginals=True), brute_sums(field, small_sample())):
        assert np.allclose(got, want)


def test_fit_raises_the_likelihood():
    sample = small_sample()
    seen, hot, pairs = observed(3, sample)

    def likelihood(f):
        return (hot * f.weights).sum() + (pairs * f.trans).sum() - brute_sums(f, sample)[0]

    start, done = fit_field([b"a", b"b", b"c"], sample, rounds=0), fit_field([b"a", b"b", b"c"], sample, rounds=200)
    assert likelihood(done) > likelihood(start) + 1
    # at the maximum, up to the penalty, expected counts are the observed ones
    assert np.abs(brute_sums(done, sample)[1] - hot).max() < 0.1
    assert not np.allclose(start.trans, done.trans) and start.plain != done.plain


def test_without_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    field, curve = train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, None), (2, "")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "spans", "predicted")})
    assert len({r.score for r in score(rows, field, curve).collect()}) == 1 and score(rows, field, curve).count() == 4
    assert score(df, field, curve).count() == 0
