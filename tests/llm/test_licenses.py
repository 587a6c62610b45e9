import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from driftlog.llm.licenses import ORACLE, TEMPLATES, gate, scan_licenses, template_table


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def pairs(w):
    return {" ".join(p) for p in zip(w, w[1:])}


def brute(text, known, threshold=0.8):
    w, found = words(text), []
    for i in range(len(w) - 1):
        for t in known:
            if (j := t.anchors.get(f"{w[i]} {w[i + 1]}")) is not None:
                a, e = max(0, i - j), min(len(w), i - j + len(t.words))
                g = pairs(w[a:e])
                d = round(2 * len(g & set(t.pairs)) / (len(g) + len(t.pairs)), 9)
                if d >= threshold:
                    found.append((-d, t.rank, a, e))
    best = {}
    for x in found:
        if not any(y < x and y[2] < x[3] and x[2] < y[3] for y in found):
            k = known[x[1]].license
            best[k] = min(best.get(k, (0,)), (x[0], x[2], x[1], " ".join(w[x[2] : x[3]])))
    return {(k, -v[0], v[3]) for k, v in best.items()}


def wrapped(text, n=72):
    lines, at = [], ""
    for w in text.split():
        if len(at) + len(w) > n:
            lines, at = [*lines, "# " + at], ""
        at += w + " "
    return "\n".join([*lines, "# " + at])


OTHER = " ".join("word%d" % (i * 7919 % 1000) for i in range(60))
EDITED = " ".join(w for i, w in enumerate(TEMPLATES["MIT"][2].split()) if i % 17)
TEXTS = [
    None,
    "",
    "nothing here",
    "Some words. Released under the MIT License. More words, more.",
    "x\nLicensed under CC BY-NC 4.0.\ny\nLicensed under the apache license -- version 2.0",
    "This work is licenced under the GNU General Public License, version 3.\n" * 3,
    "the License of the license is a license",
    "word " * 30000 + "\nAll rights reserved.",
    "license",
    "Odd words.\nThis work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY 4.0! And. Licensed under CC BY-SA 4.0.",
    "-" * 3000 + " Released under the MIT License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    *(f"{OTHER}\n{wrapped(t)}\n{OTHER}" for ts in TEMPLATES.values() for t in ts),
    f"{OTHER} {EDITED} {OTHER}",
]


def test_against_brute_force_and_sql(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[3]), (3, TEXTS[3])]
    df = spark.createDataFrame([(*r, "z", "y") for r in rows], "doc_id long, text string, license string, row string")
    got = sorted(((r.doc_id, r.license, r.dice, r.unit) for r in scan_licenses(df).collect()), key=str)
    known = template_table(TEMPLATES, 0.8)
    assert got == sorted(((i, *b) for i, t in rows for b in brute(t, known)), key=str)
    of = {i: {r[1] for r in got if r[0] == i} for i in range(len(TEXTS))}
    assert of[3] == {"MIT"} == of[11] and of[4] == {"CC-BY-NC-4.0", "Apache-2.0"} and of[12] == {"CC-BY-NC-4.0"} and of[10] == {"CC-BY-4.0", "CC-BY-SA-4.0"}
    names = [k for k, ts in TEMPLATES.items() for _ in ts]
    assert [of[13 + i] for i in range(len(names))] == [{k} for k in names] and of[len(TEXTS) - 1] == {"MIT"}
    assert scan_licenses(df.limit(0)).count() == 0
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert sorted(((None if pd.isna(r[0]) else int(r[0]), *r[1:]) for r in duckdb.sql(ORACLE).fetchall()), key=str) == got


def test_any_template(spark):
    df = spark.createDataFrame([(1, "You may copy and share this work freely.")], "doc_id long, text string")
    assert [r.license for r in scan_licenses(df, templates={"X": ["You may copy and share this work freely."]}).collect()] == ["X"]


def test_gate_loses_nothing():
    r = random.Random(3)
    known = template_table(TEMPLATES, 0.8)
    rx = re.compile(gate(known).replace("(?iu)", "(?i)").replace("\\p{L}\\p{N}", "\\w"))
    for t in known:
        for _ in range(20):
            w = [x for x in t.words if r.random() > 0.08]
            g = pairs(w)
            if g and 2 * len(g & set(t.pairs)) >= 0.8 * (len(g) + len(t.pairs)):
                assert rx.search(" / ".join(w).title())


def test_very_many_notices(spark):
    text = "\n".join(f"Released under the MIT License. w{i} Licensed under CC BY-NC 4.0." for i in range(20_000))
    got = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r.license for r in got} == {"MIT", "CC-BY-NC-4.0"} and all(r.dice == 1 for r in got)


def test_sums_of_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, TEXTS[3])], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("t", "u", "g", "found", "block", "start", "_t", "dice")})
    assert [r.license for r in scan_licenses(df).collect()] == ["MIT"]
