import random

import numpy as np
import pytest

import driftlog.llm.passages as P
from driftlog.llm.passages import repeated_passages


def world(seed=5):
    r = random.Random(seed)
    vocab = ["v%d" % i for i in range(900)]
    line = lambda n: " ".join(r.choices(vocab, k=n))
    shared = [line(70) for _ in range(6)]
    docs = []
    for i in range(90):
        ls = [line(r.choice([3, 25, 60])) for _ in range(r.randrange(0, 5))]
        if i % 3 == 0:
            w = shared[i % 6].split()
            if i % 2:
                w[r.randrange(70)] = "edit%d" % i
            ls.insert(r.randrange(len(ls) + 1), " ".join(w).upper() if i % 4 == 0 else " ".join(w))
        docs.append((i, "\n".join(ls)))
    inside = line(60)
    docs += [(200, f"{line(30)} {inside} {line(9)}"), (201, f"{line(12)} {inside} {line(40)}")]
    return docs + [(300, None), (301, ""), (None, docs[0][1]), (7, docs[7][1]), (302, line(20000))]


def brute_lines(docs):
    occ = []
    for i, t in docs:
        at = 0
        for ln in (t or "").split("\n"):
            w = ln.encode().lower().split()
            if len(w) >= 20:
                occ.append((i, at, at + len(ln), tuple(w)))
            at += len(ln) + 1
    nodes = sorted({o[3] for o in occ})
    sets = [{w[k : k + 5] for k in range(len(w) - 4)} for w in nodes]
    lab = list(range(len(nodes)))
    for a in range(len(nodes)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and lab[a] != lab[b]:
                old, new = lab[a], lab[b]
                lab = [new if x == old else x for x in lab]
    cluster = {w: lab[k] for k, w in enumerate(nodes)}
    by = {}
    for o in occ:
        by.setdefault(cluster[o[3]], []).append(o[:3])
    return sorted((sorted(v, key=str) for v in by.values() if len(v) > 1), key=str)


@pytest.mark.parametrize("tile", [2048, 3])
def test_lines_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(P.verified_links, "__defaults__", (tile,))
    docs = world()
    df = spark.createDataFrame([(*d, 0, 1) for d in docs], "doc_id long, text string, node int, key int")
    got = repeated_passages(df).collect()
    by = {}
    for g in got:
        if g.kind == 0:
            by.setdefault(g.cluster, []).append((g.doc_id, g.start, g.end))
    assert sorted((sorted(v, key=str) for v in by.values()), key=str) == brute_lines(docs)
    for c in {g.cluster for g in got}:
        assert len({(g.doc_id, g.start, g.end) for g in got if g.cluster == c and not g.removed}) == 1  # equal rows share it
    pieces = [g for g in got if g.kind == 1 and g.doc_id in (200, 201)]
    assert {g.doc_id for g in pieces} == {200, 201}
    text = dict(docs)
    for g in got:
        assert len(text[g.doc_id][g.start : g.end].split()) == g.n_words


def test_passages_inside_lines_are_whole(spark):
    r = random.Random(8)
    vocab = ["v%d" % i for i in range(5000)]
    line = lambda n: " ".join(r.choices(vocab, k=n))
    other = lambda n: " ".join("w%d" % r.randrange(10**9) for _ in range(n))
    docs, want = [], {}
    for k in range(60):
        inside = line(r.choice([51, 55, 60, 80]))
        for i in (2 * k, 2 * k + 1):
            before, after = other(r.randrange(90)), other(r.randrange(90))
            docs.append((i, f"{before}  {inside}\t{after}"))
            want[i] = (len(before) + 2, len(before) + 2 + len(inside), 2 * k, i % 2 == 1)
    docs.append((1000, "z " * 300))
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).where("kind = 1 and doc_id < 1000").collect()
    assert {g.doc_id: (g.start, g.end, g.first_doc, g.removed) for g in got} == want and len(got) == len(want)


def test_empty(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_against_brute_force():
    r = np.random.default_rng(4)
    size = r.integers(1, 120, 50)
    line, runs = np.repeat(np.arange(50), size), r.integers(0, 60, size.sum()).astype(np.uint64)
    want, at = set(), 0
    for n in size.tolist():
        part = runs[at : at + n].tolist()
        for k in range(max(1, n - P.WINDOW + 1)):
            w = part[k : k + P.WINDOW]
            want.add(at + k + w.index(min(w)))
        at += n
    assert P.anchors(runs, line, most=700).tolist() == sorted(want)


def test_three_lines_share_more_or_less(spark):
    """The last two share 90 words, the first of all only the 30 in their middle."""
    r = random.Random(1)
    other = lambda n: " ".join("w%d" % r.randrange(10**9) for _ in range(n))
    a, b, c = other(30), other(30), other(30)
    docs = [(1, f"{other(20)} {b} {other(20)}"), (2, f"{other(25)} {a} {b} {c} {other(9)}"), (3, f"{other(3)} {a} {b} {c} {other(40)}")]
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).where("kind = 1 and removed").collect()
    words = set()
    text = dict(docs)
    for g in got:
        if g.doc_id == 3:
            words |= set(text[3][g.start : g.end].split())
    assert words == set(f"{a} {b} {c}".split())


def test_very_common_line_and_passage(spark):
    r = random.Random(2)
    other = lambda n: " ".join("w%d" % r.randrange(10**9) for _ in range(n))
    line, inside = other(40), other(60)
    docs = [(i, f"{line}\n{other(5)}\n{other(20)} {inside} {other(20)}") for i in range(400)]
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((g.doc_id, g.kind, g.removed, g.n_words) for g in got) == sorted((i, k, i > 0, n) for i in range(400) for k, n in ((0, 40), (1, 60)))


def test_passages_over_short_lines(spark):
    """Passages of 51 words and more, cut into lines of few words at other places in each text."""
    r = random.Random(6)
    other = lambda n: ["w%d" % r.randrange(10**9) for _ in range(n)]
    docs, want = [], {}
    for k in range(30):
        inside = other(r.choice([51, 60, 90]))
        for i in (2 * k, 2 * k + 1):
            joined = inside[0] + "".join(("\n" if r.random() < 0.25 else " ") + w for w in inside[1:])
            before, after = " ".join(other(r.randrange(1, 15))), " ".join(other(r.randrange(1, 15)))
            docs.append((i, f"{before}\n{joined}\n{after}"))
            want[i] = (len(before) + 1, len(before) + 1 + len(joined), len(inside), 2 * k, i % 2 == 1)
    poem = "\n".join(" ".join(other(9)) for _ in range(8))
    docs += [(100, poem), (101, poem)]
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).where("kind = 1").collect()
    want |= {i: (0, len(poem), 72, 100, i > 100) for i in (100, 101)}
    assert {g.doc_id: (g.start, g.end, g.n_words, g.first_doc, g.removed) for g in got} == want and len(got) == len(want)


def test_equal_lines_are_left_to_their_rows(spark):
    r = random.Random(7)
    other = lambda n: " ".join("w%d" % r.randrange(10**9) for _ in range(n))
    line = other(80)
    docs = [(i, f"{other(4)}\n{line}\n{other(30)}") for i in range(5)]
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((g.doc_id, g.kind, g.n_words, g.removed) for g in got) == [(i, 0, 80, i > 0) for i in range(5)]


def test_common_runs_against_brute_force():
    r = np.random.default_rng(3)
    block = r.integers(0, 9, 30).astype(np.uint64)
    for _ in range(30):
        h, g = (np.concatenate([r.integers(0, 9, r.integers(40)), *[block] * r.integers(2, 6), r.integers(0, 9, r.integers(40))]).astype(np.uint64) for _ in range(2))
        at = [(p, q) for p in range(len(h) - P.PIECE + 1) for q in range(len(g) - P.PIECE + 1) if (h[p : p + P.PIECE] == g[q : q + P.PIECE]).all()]
        whole = set()
        for p, q in at:
            a, b = p, p
            while a and q - p + a and h[a - 1] == g[a - 1 + q - p]:
                a -= 1
            while b < len(h) and b + q - p < len(g) and h[b] == g[b + q - p]:
                b += 1
            whole.add((a, b))
        longest = lambda x: {s for s in x if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in x)}
        got = P.common_runs(h, g, at)
        assert longest({(a, b) for a, b, _ in got}) == longest(whole)
        assert all((h[a:b] == g[f : f + b - a]).all() for a, b, f in got)
