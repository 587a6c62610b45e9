import random

from pyspark.sql import functions as F

from driftlog.llm import decontaminate
from driftlog.llm.decontaminate import MATCH, align, contamination, drop_contaminated, item_seeds, smith_waterman, tokens


def brute_sw(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(max(r) for r in h)


def test_alignment():
    r = random.Random(0)
    for _ in range(50):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(1, 15))] for _ in range(2))
        assert smith_waterman(a, b)[0] == brute_sw(a, b)
        s, x, y = align(a, b)
        assert brute_sw(a, b[x:y]) == s * MATCH * len(a)


def world():
    r = random.Random(2)
    vocab = ["v%d" % i for i in range(400)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, text(40)) for i in range(12)] + [(50, None), (51, ""), (52, "only two")]
    docs = [(i, text(r.choice([0, 5, 60, 900]))) for i in range(120)]
    for k in range(12):
        w = items[k][1].split()
        edited = [x if r.random() < 0.88 else r.choice(vocab) for x in w]
        docs.append((1000 + k, f"{text(30)}. {' '.join(w).upper()}! {text(50)}"))
        docs.append((2000 + k, f"{text(300)} {', '.join(edited)} {text(20)}"))
    docs += [(3000, None), (3001, ""), (None, items[0][1]), (1000, docs[120][1]), (3002, "well only two here"), (3003, text(20000) + " " + items[3][1])]
    return items, docs


def test_against_brute_force(spark):
    items, docs = world()
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contamination(d, b).collect()}
    want = {}
    for i, t in docs:
        if i != 3003:
            for k, it in items:
                a, w = tokens(it), tokens(t)
                if a and w and (s := brute_sw(a, w) / (2 * len(a))) >= 0.5:
                    want[i, k] = round(s, 6)
    want[3003, 3] = 1.0
    assert got == want
    assert {(1000 + k, k) for k in range(12)} | {(2000 + k, k) for k in range(12)} <= set(got)
    left = {r.doc_id for r in drop_contaminated(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_copies_of_one_seed_are_all_found(spark):
    r = random.Random(5)
    text = lambda n: " ".join("u%d" % r.randrange(10**6) for _ in range(n))
    b = spark.createDataFrame([(1, "four words as item"), (2, "a b c d e f g h i j k l")], "item_id long, text string")
    # 12 words of which 10 stay, with one run of four: 20 - 2 of 24
    whole = [(i, f"{text(9)} four words as item {text(9)}") for i in range(1000)]
    edited = [(1000 + i, f"{text(9)} a b c x e f g h y j k l {text(9)}") for i in range(1000)]
    phrase = [(2000 + i, f"{text(9)} e f g h {text(9)}") for i in range(1000)]
    got = {(x.doc_id, x.item_id): x.score for x in contamination(spark.createDataFrame(whole + edited + phrase, "doc_id long, text string"), b).collect()}
    assert got == {(i, 1): 1.0 for i, _ in whole} | {(i, 2): 0.75 for i, _ in edited}


def test_empty(spark):
    items, docs = world()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).count() == 0


def test_seeds_are_rare_ones(spark):
    items = [(i, "which of the following is true about " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(30)]
    items += [(100 + i, f"which of the following is true a{i}") for i in range(3)] + [(7, items[7][1])]
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = {r.item_id: r for r in item_seeds(b, rare=16, floor=2).collect()}
    assert len(got) == 33
    # 27 words have 24 seeds, of which 30 items share the first four; "the following is true" and "of the following is" are shared by 33
    assert all(len(got[i].seeds) == 20 for i in range(30))
    assert all(len(got[100 + i].seeds) == 4 for i in range(3))  # one of its own, the rest tie
    docs = spark.createDataFrame([(1, "x y " + items[3][1]), (2, "which of the following is true about nothing")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contamination(docs, b).collect() if r.item_id < 100] == [(1, 3)]


def test_benchmark_in_parts_and_clashing_columns(spark, monkeypatch):
    items, docs = world()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(contamination(d, b).collect(), key=str)
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 50)
    assert sorted(contamination(d, b).collect(), key=str) == whole
    more = d.withColumns({c: F.lit(1) for c in ("_id", "item", "item_id", "first", "score", "a b")})
    kept = drop_contaminated(more, b)
    assert kept.columns == more.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in drop_contaminated(d, b).collect())
