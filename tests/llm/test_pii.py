import hashlib
import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from driftlog.llm.pii import KINDS, digest, redact, with_spans

RX = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(d):
    return sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    ok = [
        lambda m: True,
        lambda m: all(int(p) <= 255 for p in m.split(".")),
        lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, rx in enumerate(RX) for m in re.finditer(rx, text or "") if ok[k](m[0]))


TEXTS = [
    None,
    "",
    "é😀 a@b.c_d@e.f x@y a.b@c-d.e.f. @ a@@b.c",
    "ip 8.196.197.208 1.2.3.4.5.6.7.8 300.1.1.1 0255.0.0.001 99999999999999999999.1.1.1 1.2.3",
    "card 4465758382889437 4465 7583 8288 9437 4465-7583-8288-9437x 4465758382889438 49927398716",
    "+1 (523) 555-1055 équ +49.30.1234567- ++1 2 +123 +1234567890123456",
    "a@b.c 1.2.3.4 +1 (523) 555-1055 4465758382889437 4465758382889437",
    "9" * 20000 + " " + "a" * 20000 + " " + "a.b" * 3000 + "@x.y",
    "😀" * 50 + " me.12@mail8.example.com, then",
]


def show(s):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s)


def test_base_against_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, "x@y.z"), (6, TEXTS[6])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, base string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in digest(with_spans(df)).collect()}
    want = set()
    for i, t in rows:
        b = brute(t)
        want.add((i, *(sum(k == j for _, k, _ in b) for j in range(4)), hashlib.sha256(show(b).encode()).hexdigest()))
    assert got == want
    assert digest(with_spans(df)).count() == len(rows)


def test_bootstrap_and_redaction(spark):
    rows = [(i, f"please mail me at user{i}@example.com soon") for i in range(12)]
    rows += [(100, "please mail me at someone42(at)example soon"), (101, "see chapter 123456 of it"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in digest(with_spans(df)).collect()}
    assert got[0] == "email:18:35" and got[100] == "email:18:27" and got[101] == ""
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert out[3] == "please mail me at <email> soon" and out[101] == rows[-2][1] and out[102] is None


def test_empty(spark):
    assert digest(with_spans(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


IDENT = re.compile(r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*[0-9])[A-Za-z0-9@._%+-]{6,}")
SPACE = re.compile("[\x20\x09-\x0D]+")


def lefts(text, found):
    """The two words before each of found (start, end), given all matches of the kind: earlier ones count as #."""
    out, tail, at = {}, "", 0
    for a, b in found:
        words = [w for w in SPACE.split(tail + text[at:a] + "#") if w][-3:]
        tail, at = " ".join(words), b
        left = [w for w in SPACE.split(tail[:-1]) if w][-2:]
        out[a, b] = re.sub("[0-9]+", "0", " ".join(left).lower())
    return out


def brute_added(rows, confidence=0.8, support=5):
    hits = []
    for n, t in enumerate(rows):
        base = brute(t)
        for k, rx in enumerate(RX):
            at = lefts(t, [m.span() for m in re.finditer(rx, t)])
            hits += [(n, a, k, b, t[a:b].lower(), at[a, b]) for a, j, b in base if j == k]
        spots = [m.span() for m in IDENT.finditer(t)]
        at = lefts(t, spots)
        hits += [(n, a, 4, b, t[a:b].lower(), at[a, b]) for a, b in spots if not any(a < y and x < b for x, _, y in base)]
    hits = [h for h in hits if h[5]]
    of, score = defaultdict(set), {(h[4], h[2]): 1.0 for h in hits if h[2] < 4}
    for h in hits:
        of[h[5]].add(h[4])
    seeds, good = dict(score), {}
    for _ in range(50):
        good = {}
        for p, xs in of.items():
            for k in range(4):
                mass = sum(score.get((x, k), 0) for x in xs)
                if mass >= support and mass / (len(xs) + 1) >= confidence:
                    good[p, k] = mass / (len(xs) + 1)
        left = defaultdict(lambda: 1.0)
        for (p, k), c in good.items():
            for x in of[p]:
                left[x, k] *= 1 - min(c, 0.999)
        score = dict(seeds)
        for key, v in left.items():
            score[key] = max(score.get(key, 0), 1 - v)
    best = {}
    for (p, k), c in sorted(good.items(), key=lambda x: (x[1], -x[0][1])):
        best[p] = k
    return sorted((n, a, best[p], b) for n, a, k, b, x, p in hits if k == 4 and p in best)


def test_added_spans_against_brute_force(spark):
    r, rows = random.Random(3), []
    for i in range(240):
        mail, ip = f"user{i}@example.com", f"10.0.{i}.7"
        rows.append(r.choice([f"Write to me at {mail} or to {ip}, twice", f"host is up: {ip} and me at {mail}", f"reach  my\taccount: {mail}"]))
    rows += [f"write to me at hidden{i}(at)x and later my account: hidden{i}(at)x" for i in range(8)]
    rows += ["his secret name: hidden1(at)x", "chapter one: abc12345 abc12346", "me at zzz99999, up: zzz99999 , up: yyy88888"]
    got = digest(with_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))).collect()
    added = brute_added(rows)
    assert added
    want = {n: show(sorted(brute(t) + [(a, k, b) for m, a, k, b in added if m == n])) for n, t in enumerate(rows)}
    assert {x.doc_id: x.spans for x in got} == want


def test_very_many_matches(spark):
    text = " ".join(f"mail me at u{i}@example.com or id{i:06d}" for i in range(50_000))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    began = time.time()
    out = {x.doc_id: x.text for x in redact(df).collect()}
    assert time.time() - began < 90
    assert out[2] is None and out[1].count("<email>") >= 50_000 and "@" not in out[1]


def test_redaction_of_overlaps_blocks_and_clashing_columns(spark):
    rows = [(i, TEXTS[i]) for i in range(len(TEXTS))] + [(50, "x" * 4090 + " a@b.cc " + "é" * 9000 + " 1.2.3.4"), (50, "x" * 4090 + " a@b.cc " + "é" * 9000 + " 1.2.3.4"), (None, "t@u.v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_key", "_all", "_id", "text_key", "row", "base", "all", "start", "kind", "a b.c")})
    out = redact(df)
    assert out.columns == df.columns and out.count() == len(rows)

    def plain(t):
        done, at = "", 0
        for a, k, b in brute(t):
            if a >= at:
                done += t[at:a] + f"<{KINDS[k]}>"
            at = max(at, b)
        return t if t is None else done + t[at:]

    assert sorted((str(x.doc_id), x.text or "") for x in out.collect()) == sorted((str(i), plain(t) or "") for i, t in rows)
    assert redact(df.limit(0)).count() == 0
