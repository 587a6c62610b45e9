import random
import re

from pyspark.sql import functions as F

from driftlog.llm.quality import keep_good, quality_report


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(tri) if tri.count(x) > 1 for j in (i, i + 1, i + 2)}
    ls = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = len(ls) - len(set(ls))
    chars, sym = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
    up, dig, n = len(re.findall("[A-Z]", t)), len(re.findall("[0-9]", t)), len(w)
    failed = n < 50 or 100 * len(hit) > 50 * n
    bad = failed or 10 * sym > n or 10 * up > 3 * chars or 2 * dig > chars or chars < 2 * n or chars > 20 * n or (dup >= 2 and 10 * dup > 3 * len(ls))
    return n, chars, sym, dup, len(hit), failed, not bad


def texts():
    r = random.Random(1)
    out = [None, "", " \n\t", "a b c a b c", "x" * 5000, "é ñ\x0bß\r\nz", "\n\n a \n a \n", "a b c d"]
    for _ in range(60):
        vocab = ["w%d" % i for i in range(r.choice([3, 40, 4000]))] + ["Äb", "|", "C#", "DEF"]
        out.append("".join(r.choice(vocab) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(r.choice([5, 60, 300]))))
    out.append("\n".join(["same line of words"] * 20 + ["other %d line" % i for i in range(20)]))
    return out + ["many words here %d " % i * 3000 for i in range(1)]


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (3, "a b c a b c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, x int")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_report(df).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sorted(r.doc_id for r in keep_good(df).collect()) == sorted(i for i, t in rows if brute(t)[-1])
    assert keep_good(df).columns == df.columns


def test_empty(spark):
    assert quality_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns_and_empty_table(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    df = plain.withColumns({c: F.lit("x") for c in ("n_words", "_words", "kept", "words", "a.b")})
    report = {r.doc_id: (r.n_words, r.kept) for r in quality_report(df).collect()}
    assert report == {r.doc_id: (r.n_words, r.kept) for r in quality_report(plain).collect()}
    assert quality_report(df).columns == ["doc_id", "text", "_words", "words", "a.b", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    good = keep_good(df)
    assert good.columns == df.columns and {r.doc_id for r in good.collect()} == {i for i, (_, k) in report.items() if k}
    assert keep_good(df.limit(0)).count() == 0 == quality_report(df.limit(0)).count()
