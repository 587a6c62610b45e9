"""Quality rules as a short-circuit cascade, on built-in functions alone.

Each rule is a Boolean column that is true where it rejects. On a sample, every rule's rejections are counted and its
time is taken; rules then run in order of rejections per second, so most rejected rows meet a cheap rule first and the
dear ones are not evaluated for them. The order changes only the time: a row is kept if no rule rejects it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.common import SPACE_RE, discard, fresh, materialize

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def split_words(text: str) -> Column:
    t = F.btrim(whole(text), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE))


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are told apart by a 64-bit hash."""

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(p, start, step, lambda a: a["n"])

    def twice(s: Column) -> Column:
        both = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, both), lambda x: x["i"]))

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(pairs, lambda s: let(twice(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(w, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(windows(w), of)))


def lines_with_words(text: str) -> Column:
    return F.filter(F.split(whole(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def base_columns(words: Column, text: str) -> dict[str, Column]:
    dup = let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(whole(text), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def rules(text: str = "text", c: dict[str, Column] | None = None) -> dict[str, Column]:
    """Rule name -> rejects. c: the base columns, if they are at hand."""
    c = c or base_columns(split_words(text), text)
    upper = F.regexp_count(whole(text), F.lit("[A-Z]"))
    digits = F.regexp_count(whole(text), F.lit("[0-9]"))
    lines = let(lines_with_words(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return {
        "too_short": c["n_words"] < 50,
        "symbols": 10 * c["n_symbols"] > c["n_words"],
        "shouting": 10 * upper > 3 * c["word_chars"],
        "digits": 2 * digits > c["word_chars"],
        "word_length": (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"]),
        "dup_lines": let(lines, lambda x: (x["d"] >= 2) & (10 * x["d"] > 3 * x["n"])),
        "repeats": 100 * c["n_repeat_words"] > 50 * c["n_words"],
    }


def cascade_order(docs: DataFrame, named: dict[str, Column], sample_rows: int = 2000, seed: int = 7) -> list[str]:
    """Rule names by rejections per second on about sample_rows sampled rows; as given for an empty table."""
    n = docs.count()
    if not n:
        return list(named)
    used = {c for c in docs.columns if c == "text"} or set(docs.columns)
    sample = materialize(docs.sample(min(1.0, sample_rows / n), seed).select(*used), "rules")
    rejects = sample.agg(*(F.sum(F.coalesce(r, F.lit(False)).cast("int")).alias(k) for k, r in named.items())).first()

    def seconds(r: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.sum(r.cast("int"))).collect()
        return time.perf_counter() - began

    idle = seconds(F.lit(True))
    rate = {k: (rejects[k] or 0) / max(seconds(r) - idle, 1e-3) for k, r in named.items()}
    discard(sample)
    return sorted(named, key=lambda k: -rate[k])


def cascade(named: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in order that rejects the row, else null; later rules are not evaluated."""
    out = F.when(F.coalesce(named[order[0]], F.lit(False)), F.lit(order[0]))
    for k in order[1:]:
        out = out.when(F.coalesce(named[k], F.lit(False)), F.lit(k))
    return out


def quality_report(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """docs' columns plus the base columns, base_failed and kept; these take the place of columns of docs of their names.

    A null text has no words and fails as too short, as does an empty one. Rows are judged one by one, so repeated rows,
    null ids and an empty table need nothing special. Texts of any length are read whole.
    """
    order = cascade_order(docs, rules(text), sample_rows)
    words, whole_text = fresh("words"), fresh("text")
    c = base_columns(F.col(words), whole_text)
    added = [*c, "base_failed", "kept"]
    d = docs.withColumns({whole_text: F.col(text), words: split_words(text)})
    d = d.select(*(F.col(f"`{x}`") for x in docs.columns if x not in added), whole_text, *(v.alias(k) for k, v in c.items()))
    named = rules(whole_text, {k: F.col(k) for k in c})
    failed = named["too_short"] | named["repeats"]
    return d.withColumn("base_failed", failed).withColumn("kept", cascade(named, order).isNull()).drop(whole_text)


def verdict(text: str, order: list[str]) -> Column:
    """cascade() over the rules, the text split into words once for all of them."""

    def of(w: Column) -> Column:
        sizes = F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"))
        return let(sizes, lambda s: cascade(rules(text, base_columns(w, text) | {"n_words": s["n"], "word_chars": s["chars"]}), order))

    return let(split_words(text), of)


def keep_good(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns, whatever their names.

    Null and empty texts are rejected as too short. Rows are judged one by one: repeated rows, ties and null ids need
    nothing special; an empty table gives an empty result.
    """
    return docs.where(verdict(text, cascade_order(docs, rules(text), sample_rows)).isNull())


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM tri WHERE z IS NOT NULL) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
         len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[0-9]')) AS n_digits
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_upper > 3 * word_chars
            OR 2 * n_digits > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
FROM b
"""
