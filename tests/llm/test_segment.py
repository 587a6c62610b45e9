import math
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from driftlog.llm import segment
from driftlog.llm.queries import PIECE_MODEL
from driftlog.llm.segment import UNIT, Lattices, Vocabulary, kept_lattices, load_model, piece_ids, sample_segmentations, search

TINY = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "▁ab", "aa"] + [f"<0x{i:02X}>" for i in range(256)]
KINDS = [2] + [0] * 8 + [1] * 256


def every(vocab, s):
    if not s:
        return [((), 1.0)]
    return [((vocab.ids[s[:j]], *t), vocab.prob[s[:j]] * p) for j in range(1, len(s) + 1) if s[:j] in vocab.ids for t, p in every(vocab, s[j:])]


def test_distribution_against_enumeration():
    vocab = Vocabulary(TINY, KINDS)
    lat, text, n = Lattices(vocab), "ab aab", 12000
    all_ = every(vocab, "▁ab▁aab")
    z = sum(p for _, p in all_)
    prob = {ids: p / z for ids, p in all_}
    words = UNIT.findall(" " + text)
    got = search(lat, [words] * n, [k * 7919 for k in range(n)], 3)
    pairs = Counter()
    for t in got:
        ids = [tuple(piece_ids(lat, p).tolist()) for p, _ in t.samples]
        assert len(set(ids)) == 3
        for i, (_, phi) in zip(ids, t.samples):
            assert math.isclose(math.exp(phi), prob[i], rel_tol=1e-9)
        pairs[ids[0], ids[1]] += 1
    for a, b in permutations(prob, 2):  # sampling without replacement, in order
        want = prob[a] * prob[b] / (1 - prob[a])
        assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n) + 1e-3
    # Horvitz-Thompson sums with inclusion probabilities average to 1
    total = [sum(math.exp(phi) / -math.expm1(-math.exp(phi + t.queue[0][0])) for _, phi in t.samples) for t in got if t.queue]
    assert abs(np.mean(total) - 1) < 0.02


def test_all_segmentations_in_order_of_their_variates():
    vocab = Vocabulary(TINY, KINDS)
    lat = Lattices(vocab)
    (t,) = search(lat, [UNIT.findall(" abab")], [5], 100)
    assert sorted(tuple(piece_ids(lat, p).tolist()) for p, _ in t.samples) == sorted(i for i, _ in every(vocab, "▁abab"))
    assert not t.queue and math.isclose(sum(math.exp(p) for _, p in t.samples), 1)


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " ", "  x ", "a\tb\nc", "▁ literal ▁▁x", "Größe 東京 😀 é", "x" * 3000, "The quick brown fox. " * 3000, "a", "\x00\x7f"]
    return list(enumerate(texts)) + [(None, "some text"), (4, "a\tb\nc")]


def test_round_trip_and_seeds(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, sample int")
    got = sample_segmentations(df, PIECE_MODEL, 3).collect()
    assert all(r.round_trip for r in got)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        if "▁" not in text and "\x00" not in text:
            assert sp.decode(list(r.ids)) == text
        assert r.log_inclusion <= 0 and r.log_prob <= 0
    n = Counter(r.doc_id for r in got)
    assert n[0] == n[1] == 1 and n[4] == 4 and n[8] == 3
    again = sample_segmentations(df.repartition(5), PIECE_MODEL, 3, with_ids=False).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.ids_hash, r.log_inclusion)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sample_segmentations(df.limit(0), PIECE_MODEL).count() == 0


def test_speed_unit():
    vocab = Vocabulary(*load_model(PIECE_MODEL))
    lat = Lattices(vocab)
    (t,) = search(lat, [UNIT.findall(" " + "word and another word " * 500)], [1], 2)
    assert len(t.samples) == 2


def test_few_lattices_without_reuse(spark, rows):
    model = load_model(PIECE_MODEL)
    lat = kept_lattices(*model, reuse=False)
    for lo in range(0, 60_000, 10_000):
        lat.starts([f" w{i}" for i in range(lo, lo + 10_000)])
        assert len(lat.start) <= 35_000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (Counter(str(r) for r in sample_segmentations(df, PIECE_MODEL, 3, reuse=x).collect()) for x in (True, False))
    assert a == b


def test_texts_of_a_run_are_searched_together(monkeypatch):
    vocab, calls = Vocabulary(TINY, KINDS), []
    monkeypatch.setattr(segment, "uniform", lambda x, f=segment.uniform: calls.append(len(x)) or f(x))
    texts = ["ab aab" * (1 + i % 7) + " ba" * (i % 5) for i in range(200)] + ["ab ba " * 3000, "", "b"]
    words = [UNIT.findall(" " + t) if t else [] for t in texts]
    together = search(Lattices(vocab), words, list(range(len(texts))), 3)
    assert len(calls) < 200  # steps of the longest word and rounds, not some for each text
    lat = Lattices(vocab)
    for i in (0, 6, 40, 199, 200, 201, 202):
        (alone,) = search(lat, [words[i]], [i], 3)
        assert [phi for _, phi in alone.samples] == [phi for _, phi in together[i].samples]
        assert [q[0] for q in alone.queue] == [q[0] for q in together[i].queue]
