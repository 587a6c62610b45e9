import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from driftlog.llm import common
from driftlog.llm.decontaminate import tokens
from tests.llm.test_decontaminate import brute_sw
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_simhash import brute_kept


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    vocab = ["word%d" % i for i in range(500)]
    vocab = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in vocab]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, text(40)) for i in range(4)]
    docs = [(i, text(r.choice([10, 60, 120]))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + ("" if i % 2 else " x")) for i in range(12)]
    docs += [(200 + i, f"{text(70)} {items[i][1]} {text(20)}") for i in range(4)]
    docs += [(300, text(60) + " mail a.b@example.com or +1 (523) 555-1055 now"), (301, "# $ % " * 40), (302, None), (303, ""), (None, text(70)), (304, "same words again " * 40)]
    docs.append(docs[0])
    spark.createDataFrame([(*d, "en", "s", len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [d for d in docs if brute_quality(d[1])[-1]]
    second = sorted(brute_kept(kept), key=str)
    third = [d for d in second if not any(brute_sw(tokens(t), tokens(d[1])) >= len(tokens(t)) for _, t in items)]
    assert {g.doc_id for g in got} == {d[0] for d in third}
    assert all(g.round_trip for g in got)
    names = ["email", "ip", "card", "phone"]
    import sentencepiece

    from driftlog.llm.queries import PIECE_MODEL

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for i, t in third:
        out, at = "", 0
        for a, k, b in brute_pii(t):
            if a >= at:
                out += t[at:a] + f"<{names[k]}>"
                at = b
        want = out + t[at:]
        assert {sp.decode(list(g.ids)) for g in got if g.doc_id == i} == {want}
    assert {len(s) for s in corpus_pipeline.STAGES} == {2} and len(corpus_pipeline.STAGES) == 5


def test_empty_table_and_clashing_columns(spark, tmp_path):
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(400)]
    docs = [(i, " ".join(r.choices(vocab, k=80))) for i in range(6)] + [(6, None), (7, ""), (None, " ".join(r.choices(vocab, k=80)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df = df.withColumns({c: F.lit(c) for c in ("lang", "_id", "_key", "_all", "_words", "n_words", "kept", "fp", "row", "base", "item", "first")})
    spark.createDataFrame([(1, "one item of seven words in all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, left in ((df, 7), (df.limit(0), 0)):
        at = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == df.columns
        assert at.count() == left
        assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).select("doc_id").distinct().count() == left


def test_workers_hold_a_part_of_a_batch_and_give_memory_back(monkeypatch):
    texts = [None, "", "a" * 10, "é" * 10, "b" * 90, "", "c", None]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["i", "text"])
    got = [p.column(1).to_pylist() for p in common.portions(b, 1, 32)]
    assert sum(got, []) == texts and len(got) == 3
    assert all(sum(len((t or "").encode()) for t in p) <= 32 or len([t for t in p if t]) == 1 for p in got)
    assert not list(common.portions(b.slice(0, 0), 1, 32))
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    assert list(common.frugal(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and done == [1]


def test_every_worker_of_the_pipeline_is_frugal(spark, tmp_path, monkeypatch):
    seen = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, g=frame.mapInArrow, **k: seen.append(f.__name__) or g(self, f, *a, **k))
    spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one item of seven words in all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus_pipeline.run(spark, str(tmp_path))
    assert seen and set(seen) == {"tidy"}
