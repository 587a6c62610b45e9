"""Personal data: fixed patterns as seeds, then bootstrapped contexts, on built-in functions alone.

The fixed kinds give the base spans. Their instances seed a graph whose other side is lexical patterns: the two words just
before an instance, an earlier match counting as one. Spark scores patterns by the share of their instances that are
known, and instances by the patterns that hold them, in rounds until nothing changes; identifiers that no fixed pattern
finds are added where a pattern of high confidence precedes them. Offsets are code points: text between matches (split)
and the matches themselves (extract) alternate, so lengths add up to positions. Arrays are folded in chunks, as each step
of a fold copies what it has gathered: the time is linear in a text's matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftlog.llm.common import SPACE_RE, discard, materialize
from driftlog.llm.quality import SPACES, let, whole

KINDS = ["email", "ip", "card", "phone"]
#: Java forms, equal to the plain ones: possessive where no backtracking can help, and starts only where a leftmost match can.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What an unseen identifier may look like: at least 6 characters, one a digit.
IDENT = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*+[0-9])[A-Za-z0-9@._%+-]{6,}+"
SPAN = "struct<start:int,kind:int,end:int,inst:string,left:string>"
CHUNK = 256


def fold(items: Column, state: Column, kind: str, step, chunk: int = CHUNK) -> Column:
    """All that step(state, item), a struct of the next state s and an array out, gives out, in order. kind: type of out's
    elements."""
    none = F.array().cast(f"array<{kind}>")

    def part(a: Column, c: Column) -> Column:
        inner = F.aggregate(
            F.slice(items, c * chunk + 1, F.lit(chunk)),
            F.struct(a["s"].alias("s"), none.alias("out")),
            lambda b, x: let(step(b["s"], x), lambda r: F.struct(r["s"].alias("s"), F.concat(b["out"], r["out"]).alias("out"))),
        )
        return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / chunk).cast("int"))
    return F.when(F.size(items) == 0, none).otherwise(F.aggregate(parts, start, part, lambda a: F.flatten(a["out"])))


def last_words(text: Column, n: int) -> Column:
    return let(F.split(F.btrim(text, F.lit(SPACES)), SPACE_RE), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), F.lit(n)), " "))


def spans(text: Column, pattern: str, kind: int, gate: Column, valid=None) -> Column:
    """Array of matches of pattern in order, those that fail valid dropped; empty where gate is false. left: the last two
    words before the match in small letters, digits as 0, earlier matches as #."""
    rx = F.lit(pattern)
    none = F.array().cast(f"array<{SPAN}>")

    def step(a: Column, z: Column) -> Column:
        start = a["pos"] + F.length(z["p"])
        tail = last_words(F.concat(a["tail"], z["p"], F.lit("#")), 3)
        now = F.struct(start.alias("start"), (start + F.coalesce(F.length(z["m"]), F.lit(0))).alias("end"), tail.alias("tail"))

        def put(v: Column) -> Column:
            left = last_words(F.substring(v["tail"], F.lit(1), F.length(v["tail"]) - 1), 2)
            one = F.struct(v["start"].alias("start"), F.lit(kind).alias("kind"), v["end"].alias("end"), z["m"].alias("inst"), F.regexp_replace(F.lower(left), "[0-9]+", "0").alias("left"))
            keep = z["m"].isNotNull() if valid is None else z["m"].isNotNull() & valid(z["m"])
            return F.struct(F.struct(v["end"].alias("pos"), v["tail"].alias("tail")).alias("s"), F.when(keep, F.array(one).cast(f"array<{SPAN}>")).otherwise(none).alias("out"))

        return let(now, put)

    def walk(parts: Column) -> Column:
        return let(F.arrays_zip(parts["p"].alias("p"), parts["m"].alias("m")), lambda z: fold(z, F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail")), SPAN, step))

    parts = F.struct(F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(gate, let(parts, walk)).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    at = lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when((F.length(d) - i) % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + at(i) - F.when(at(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def ip_parts(m: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by start and then kind."""
    card = lambda m: F.length(digits(m)).between(12, 19) & luhn(digits(m))
    kinds = [
        spans(text, EMAIL, 0, F.contains(text, F.lit("@"))),
        spans(text, IP, 1, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), ip_parts),
        spans(text, CARD, 2, F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), card),
        spans(text, PHONE, 3, F.rlike(text, F.lit(r"\+[0-9]")), lambda m: F.length(digits(m)).between(9, 15)),
    ]
    return F.array_sort(F.concat(*kinds))


def find_spans(docs: DataFrame, text: str, **kept: Column) -> DataFrame:
    """row (a number), the columns in kept, base, and cand: what may be an identifier."""
    rows = docs.select(*(c.alias(k) for k, c in kept.items()), whole(text).alias("_t"))
    cand = spans(F.col("_t"), IDENT, 4, F.rlike("_t", F.lit("[0-9]")))
    return rows.select(F.monotonically_increasing_id().alias("row"), *kept, base_spans(F.col("_t")).alias("base"), cand.alias("cand"))


def all_hits(found: DataFrame) -> DataFrame:
    """(row, start, kind, end, inst, left) of base spans and of the candidates (kind 4) that no base span overlaps."""

    def rows(of: DataFrame, what: Column) -> DataFrame:
        return of.select("row", F.explode(what).alias("s")).select("row", "s.*")

    mixed = (F.size("base") > 0) & (F.size("cand") > 0)
    near = rows(found.where(mixed), F.concat("base", "cand"))
    is_base = F.col("kind") < 4
    # base spans come first among equal starts; the texts' own matches are a window's rows
    before = W.partitionBy("row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("_past", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("_next", F.min(F.when(is_base, F.col("start"))).over(after))
    covered = (F.col("_past") > F.col("start")) | (F.col("_next") < F.col("end"))
    near = near.where(is_base | ~F.coalesce(covered, F.lit(False))).drop("_past", "_next")
    return near.unionByName(rows(found.where(~mixed), F.concat("base", "cand")))


def bootstrap(found: DataFrame, confidence: float = 0.8, support: int = 5, still: float = 1e-3) -> DataFrame:
    """(row, start, kind, end) of spans to add to those in found (of find_spans).

    An instance's score for a kind starts at 1 for seeds. A pattern's confidence for a kind is the sum of its distinct
    instances' scores over their number plus 1; patterns count from that confidence and support on. An instance that is
    no seed gets 1 minus the product of (1 - confidence) over its patterns. Scores only rise, so rounds end: when no
    pattern is new and confidences rise by less than `still` on average. A span takes its pattern's best kind, ties the
    first. Sums are pre-aggregated before each shuffle.
    """
    hits = all_hits(found).where("left <> ''").withColumn("inst", F.lower("inst")).withColumnRenamed("left", "pattern")
    hits = materialize(hits, "pii-hits")
    pairs = materialize(hits.select("pattern", "inst").distinct(), "pii-pairs")
    total = pairs.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = hits.where("kind < 4").select("inst", "kind").distinct().withColumn("score", F.lit(1.0))
    score, last, scratch = materialize(seeds, "pii-scores"), (-1, 0.0), []
    scratch.append(score)
    while True:
        mass = pairs.join(score, "inst").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        good = mass.where(F.col("mass") >= support).join(total, "pattern").withColumn("conf", F.col("mass") / (F.col("total") + 1))
        good = materialize(good.where(F.col("conf") >= confidence).select("pattern", "kind", "conf"), "pii-patterns")
        scratch.append(good)
        n, conf = good.agg(F.count("*"), F.coalesce(F.sum("conf"), F.lit(0.0))).first()
        if n == last[0] and conf - last[1] <= still * n:
            break
        last = (n, conf)
        new = pairs.join(good, "pattern").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("score"))
        score = materialize(seeds.unionByName(new).groupBy("inst", "kind").agg(F.max("score").alias("score")), "pii-scores")
        scratch.append(score)
    best = good.groupBy("pattern").agg(F.max(F.struct("conf", (-F.col("kind")).alias("order"))).alias("b")).select("pattern", (-F.col("b.order")).alias("as_kind"))
    best = materialize(best, "pii-best")
    out = materialize(hits.where("kind = 4").join(best, "pattern").select("row", "start", F.col("as_kind").cast("int").alias("kind"), "end"), "pii-added")
    for t in (*scratch, hits, pairs, best):
        discard(t)
    return out


def all_spans(found: DataFrame, *columns: str, **options) -> DataFrame:
    """columns of found, base, and all: base and added spans. Rows without candidates meet no join."""
    added = bootstrap(found, **options).groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    held = found.select("row", *columns, plain("base").alias("base"), (F.size("cand") > 0).alias("more"))
    alone = held.where("not more").select(*columns, "base", F.col("base").alias("all"))
    both = held.where("more").join(added, "row", "left").select(*columns, "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array()))).alias("all"))
    return alone.unionByName(both)


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, base and all: arrays of struct(start, kind, end), by start and then kind; one row per row.

    A null text counts as empty, and an empty one has no spans. Equal rows get equal spans; a null id is kept. Texts of any
    length and any number of matches take time in proportion. Other columns are not looked at. An empty table gives an
    empty result.
    """
    found = materialize(find_spans(docs, text, doc_id=F.col(doc_id)), "pii")
    return all_spans(found, "doc_id", **options)


def as_text(s: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")


def digest(spanned: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spanned.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("all")).alias("spans"))


def replaced(text: Column, marked: Column, block: int = 4096) -> Column:
    """text with each span of marked (sorted) as its kind in angle brackets; what overlaps an earlier span joins it. Pieces
    are taken from blocks of the text, as a position in a string is found by counting from its start."""

    def step(a: Column, s: Column) -> Column:
        one = F.array(F.struct(a.alias("a"), s["start"].alias("b"), s["kind"].alias("kind")))
        none = F.array().cast("array<struct<a:int,b:int,kind:int>>")
        return F.struct(F.greatest(a, s["end"]).alias("s"), F.when(s["start"] >= a, one).otherwise(none).alias("out"))

    def piece(blocks: Column, x: Column) -> Column:
        def part(i: Column) -> Column:
            lo = F.greatest(x["a"] - i * block, F.lit(0))
            return F.substring(F.get(blocks, i), lo + 1, F.least(x["b"] - i * block, F.lit(block)) - lo)

        at = F.sequence(F.floor(x["a"] / block).cast("int"), F.floor((x["b"] - 1) / block).cast("int"))
        mark = F.when(x["kind"] < 0, "").otherwise(F.concat(F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit(">")))
        return F.concat(F.when(x["b"] > x["a"], F.array_join(F.transform(at, part), "")).otherwise(""), mark)

    end = F.struct(F.length(text).alias("start"), F.lit(-1).alias("kind"), F.length(text).alias("end"))
    pieces = let(F.concat(marked, F.array(end)), lambda m: fold(m, F.lit(0), "struct<a:int,b:int,kind:int>", step))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0))
    return let(F.struct(blocks.alias("b"), pieces.alias("p")), lambda v: F.array_join(F.transform(v["p"], lambda x: piece(v["b"], x)), ""))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    All rows and columns come back, whatever the columns' names; null and empty texts stay as they are; repeated rows are
    treated alike and keep their number; an empty table gives an empty result. Rows are written once with their spans; only
    those with a candidate are joined with what the bootstrap adds.
    """
    found = materialize(find_spans(docs, "text", doc=F.struct(*(F.col(f"`{c}`") for c in docs.columns))), "pii")
    d, doc = all_spans(found, "doc", **options), F.col("doc")
    text = F.when(F.size("all") > 0, replaced(doc.getField("text"), F.col("all"))).otherwise(doc.getField("text"))
    return d.select(*(text.alias("text") if c == "text" else doc.getField(c).alias(c) for c in docs.columns))
