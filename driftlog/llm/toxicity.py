"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Labels mark documents, so token labels are derived: a word, or a beginning of words, is a suspect if it occurs in far more toxic training
documents than its share of others explains, and a suspect's tokens in toxic documents are labelled toxic. The field has
two states; a token's features are its word, if it is a suspect, and otherwise the same bias for all, so long runs of
plain tokens act as powers of one 2 x 2 matrix: forward and backward sums only visit suspects, exactly. Weights, bias and
transitions are fitted together by gradient steps on the likelihood. Marginals of suspects give the offending spans, and
three sums of them give the document's score by a logistic curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.common import held_out, materialize

TRIM = b".,;:!?\"'()[]{}*&%$#|<>-"


def norm_words(text: str | None) -> list[bytes]:
    return [w.strip(TRIM) for w in text.encode("utf-8", "surrogatepass").lower().split()] if text else []


#: Bytes of the word beginnings that are features besides whole words; a beginning is written with a star.
PREFIXES = (9, 7, 6, 5)


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings, the most specific first."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


class Lookup(dict):
    """Word -> its most specific suspect feature, or None; remembers a bounded number of words."""

    def __init__(self, index: dict[bytes, int], limit: int = 200_000):
        super().__init__()
        self.index, self.limit = index, limit

    def __missing__(self, word: bytes) -> int | None:
        k = next((self.index[f] for f in features(word) if f in self.index), None)
        if len(self) < self.limit:
            self[word] = k
        return k


def word_counts(train: DataFrame) -> DataFrame:
    """word (or beginning), toxic_docs, docs over the texts of train (text, toxic): tasks sum up before the shuffle."""

    def run(batches):
        total: dict[bytes, list[int]] = {}

        def out():
            k = list(total)
            n = np.array([total[w] for w in k], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["word", "toxic_docs", "docs"])

        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                for w in {f for w in set(norm_words(t.as_py())) for f in features(w)}:
                    n = total.setdefault(w, [0, 0])
                    n[0] += y
                    n[1] += 1
            if len(total) > 200_000:
                yield out()
                total = {}
        yield out()

    parts = train.select("text", "toxic").mapInArrow(run, "word binary, toxic_docs long, docs long")
    return parts.groupBy("word").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("docs").alias("docs")).where(F.length("word") > 0)


def suspects(counts: DataFrame, n_toxic: int, n_docs: int) -> list[bytes]:
    """All words whose odds of a toxic document are over three times those of all documents, significantly (G statistic);
    odds, unlike shares, can exceed any multiple whatever the toxic share."""
    if not n_toxic or n_toxic == n_docs:
        return []
    p = n_toxic / n_docs
    a, n = F.col("toxic_docs").cast("double"), F.col("docs").cast("double")
    g = 2 * (a * F.log(a / (n * p)) + F.when(n > a, (n - a) * F.log((n - a) / (n * (1 - p)))).otherwise(0.0))
    top = counts.where((F.col("docs") >= 5) & (a * (1 - p) > 3 * p * (n - a))).withColumn("g", g).where("g > 15").orderBy(F.desc("g"), "word")
    return [bytes(r.word) for r in top.collect()]


class Field:
    """weights: per suspect the log odds of the toxic state; plain: that of all other tokens; trans: 2 x 2 log weights."""

    def __init__(self, words: list[bytes], weights: np.ndarray, plain: float, trans: np.ndarray):
        self.words, self.weights, self.plain, self.trans = words, weights, plain, trans
        self.index = {w: i for i, w in enumerate(words)}
        self.step = np.exp(trans)
        m = self.step * np.exp([0.0, plain])
        self.val, self.vec = np.linalg.eig(m)
        self.inv = np.linalg.inv(self.vec)

    def power(self, k: int) -> np.ndarray:
        """(transition, then a plain token) k times, scaled to a greatest entry of about 1."""
        m = (self.vec * (self.val / self.val.max()) ** k) @ self.inv
        return np.maximum(m.real, 0.0)

    def marginals(self, at: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """P(toxic) of the tokens at positions `at`, suspects `word`, in a text of n tokens."""
        k = len(at)
        gap = np.diff(np.concatenate([[-1], at, [n]])) - 1
        unary = np.stack([np.ones(k), np.exp(self.weights[word])], axis=1)
        f, fs = np.array([1.0, 0.0]), np.zeros((k, 2))  # a text starts behind a clean state
        for i in range(k):
            f = f @ self.power(int(gap[i])) @ self.step * unary[i]
            f /= f.sum()
            fs[i] = f
        b = self.power(int(gap[k])) @ np.ones(2)
        out = np.zeros(k)
        for i in range(k - 1, -1, -1):
            b /= b.sum()
            both = fs[i] * b
            out[i] = both[1] / both.sum()
            b = self.power(int(gap[i])) @ (self.step @ (unary[i] * b))
        return out


def find(text: str | None, look: Lookup) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of suspects among the words, which suspects, number of words."""
    w = norm_words(text)
    got = [(i, k) for i, k in enumerate(map(look.__getitem__, w)) if k is not None]
    return np.array([i for i, _ in got], np.int64), np.array([k for _, k in got], np.int64), len(w)


class Batch:
    """Compressed texts (positions, suspects, length, toxic), most suspects first, so that the texts that have a t-th
    suspect are the first rows."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray, int, int]]):
        sample = sorted(sample, key=lambda s: -len(s[0]))
        self.n = np.array([s[2] for s in sample], float)
        count = np.array([len(s[0]) for s in sample], np.int64)
        self.rows = [int((count > t).sum()) for t in range(int(count.max(initial=0)))]
        self.word = [np.array([s[1][t] for s in sample[:m]], np.int64) for t, m in enumerate(self.rows)]
        at = [np.array([s[0][t] for s in sample[:m]], float) for t, m in enumerate(self.rows)]
        before = [np.full(m, -1.0) if t == 0 else at[t - 1][:m] for t, m in enumerate(self.rows)]
        self.gap = [a - b - 1 for a, b in zip(at, before)]
        last = np.array([s[0][-1] if len(s[0]) else -1 for s in sample], float)
        self.rest = self.n - last - 1


def powers(field: Field, k: np.ndarray) -> np.ndarray:
    m = np.einsum("ij,nj,jk->nik", field.vec, (field.val / field.val.max())[None, :] ** k[:, None], field.inv)
    return np.maximum(m.real, 0.0)


def sums(field: Field, batch: Batch, marginals: bool = False) -> tuple[float, np.ndarray]:
    """Sum of log Z over the texts; expected toxic tokens of each suspect (if asked for)."""
    f, log_z, high = np.tile([1.0, 0.0], (len(batch.n), 1)), 0.0, float(np.log(field.val.max().real))
    steps, got = [], np.zeros(len(field.words))
    for m, k, gap in zip(batch.rows, batch.word, batch.gap):
        unary = np.stack([np.ones(m), np.exp(field.weights[k])], axis=1)
        g = np.einsum("ni,nij->nj", f[:m], powers(field, gap)) @ field.step * unary
        z = g.sum(axis=1)
        f[:m] = g / z[:, None]
        log_z += float(np.log(z).sum() + high * gap.sum())
        if marginals:
            steps.append((f[:m].copy(), unary))
    end = powers(field, batch.rest)
    log_z += float(np.log(np.einsum("ni,nij->n", f, end)).sum() + high * batch.rest.sum())
    if marginals:
        b = end.sum(axis=2)
        for t in range(len(batch.rows) - 1, -1, -1):
            m, (fs, unary) = batch.rows[t], steps[t]
            both = fs * b[:m]
            np.add.at(got, batch.word[t], both[:, 1] / both.sum(axis=1))
            up = np.einsum("nij,nj->ni", powers(field, batch.gap[t]), (unary * b[:m]) @ field.step.T)
            b[:m] = up / up.sum(axis=1, keepdims=True)
    return log_z, got


def observed(words: int, sample: list[tuple[np.ndarray, np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each suspect is seen, and toxic; transitions, the one from the clean state before a text included."""
    seen, hot, pairs = np.zeros(words), np.zeros(words), np.zeros((2, 2))
    for at, k, m, y in sample:
        np.add.at(seen, k, 1)
        np.add.at(hot, k, y)
        t = np.zeros(m + 1, np.int64)
        t[at + 1] = y
        np.add.at(pairs, (t[:-1], t[1:]), 1.0)
    return seen, hot, pairs


def fit_field(words: list[bytes], sample: list[tuple[np.ndarray, np.ndarray, int, int]], rounds: int = 60, l2: float = 0.01, step: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps over compressed texts (positions, suspects, length, toxic).

    A suspect's gradient is its observed less its expected toxic tokens, from forward and backward sums. For the bias of
    plain tokens and the transitions, of which the one that stays clean is 0, log Z is differentiated by differences. All
    start from observed shares, and a small penalty draws them there. An empty sample gives the start.
    """
    seen, hot, pairs = observed(len(words), sample)
    n = sum(s[2] for s in sample)
    share = np.log((pairs + 1) / (pairs + 1).sum(axis=1, keepdims=True))
    odds = np.log((pairs[0, 1] + 1) / (pairs[0, 0] + 1))
    w0 = np.log((hot + 0.5) / (seen - hot + 0.5)) - odds
    x0 = np.array([np.log(0.5 / max(n, 1)) - odds, *(share.ravel()[1:] - share[0, 0])])
    make = lambda w, x: Field(words, w, float(x[0]), np.array([[0.0, x[1]], [x[2], x[3]]]))
    w, x, batch, counted = w0.copy(), x0.copy(), Batch(sample), np.array([0.0, pairs[0, 1], pairs[1, 0], pairs[1, 1]])
    fast_w, fast_x = np.full(len(w), 1e-6), np.full(4, 1e-6)
    for _ in range(rounds if len(words) else 0):
        _, got = sums(make(w, x), batch, marginals=True)
        grad_w = hot - got - l2 * (w - w0)
        slope = [(sums(make(w, x + d), batch)[0] - sums(make(w, x - d), batch)[0]) / (2 * step) for d in step * np.eye(4)]
        grad_x = counted - np.array(slope) - l2 * (x - x0)
        fast_w, fast_x = fast_w + grad_w**2, fast_x + grad_x**2
        w, x = w + 0.5 * grad_w / np.sqrt(fast_w), x + 0.1 * grad_x / np.sqrt(fast_x)
    return make(w, x)


def evidence(field: Field, at: np.ndarray, word: np.ndarray, n: int) -> tuple[list[float], np.ndarray]:
    """What the score is made of: expected toxic tokens, that no token is clean, their density."""
    if not len(at):
        return [0.0, 0.0, 0.0], np.zeros(0)
    p = field.marginals(at, word, n)
    return [float(np.log1p(p.sum())), float(p.max()), float(p.sum() / np.sqrt(n))], p


def fit_curve(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression with an intercept, by Newton steps."""
    a, b = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(b)) * (l2 * len(x) + 1e-9)
        d = np.linalg.solve(h, a.T @ (y - p) - l2 * len(x) * b * np.r_[0, np.ones(len(b) - 1)])
        b = b + d
        if abs(d).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, stat_rows: int = 20_000, field_rows: int = 4000, seed: int = 11) -> tuple[Field, np.ndarray]:
    """Word statistics over a sample of about stat_rows labelled training rows, the field and the curve over about
    field_rows of these, of which only suspects' positions reach the driver; both bounds hold whatever the input's size.
    Training rows are those whose crc32(doc_id) mod 3 is not 1.

    Rows without a label or an id teach nothing; of a repeated label the toxic one counts; repeated documents count as
    often as they come. Ties among suspects are broken by the word. Without training rows, as with an empty table, every
    text has the same score. Null and empty texts have no words; other columns are not looked at."""
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.where(~held_out(F.col("doc_id"), mod))
    labelled = y.count()
    share = min(1.0, stat_rows / max(labelled, 1))
    y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about stat_rows ids of 8 bytes: a size that does not grow with the input
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    rows = materialize(rows, "toxic-train")
    n, n_toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    words = suspects(word_counts(rows), n_toxic or 0, n)
    index = {w: i for i, w in enumerate(words)}

    def run(batches):
        look = Lookup(index)
        for b in batches:
            got = [find(t.as_py(), look) for t in b.column(0)]
            at, k, m = pa.array([g[0].tolist() for g in got], pa.list_(pa.int64())), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got])
            yield pa.RecordBatch.from_arrays([b.column(2), at, k, pa.array(m, pa.int64()), b.column(1)], ["doc_id", "at", "k", "n", "toxic"])

    part = rows.sample(min(1.0, field_rows / n), seed) if n else rows
    got = part.select("text", "toxic", "doc_id").mapInArrow(run, "doc_id long, at array<bigint>, k array<bigint>, n long, toxic int").collect()
    got.sort(key=lambda r: (r.doc_id, r.n))
    sample = [(np.array(r["at"], np.int64), np.array(r["k"], np.int64), r["n"], r["toxic"]) for r in got]
    field = fit_field(words, sample)
    if not sample:
        return field, np.array([0.0, 0, 0, 0])
    x = np.array([evidence(field, *s[:3])[0] for s in sample])
    return field, fit_curve(x, np.array([s[3] for s in sample], float))


def score(docs: DataFrame, field: Field, curve: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted and spans (first word, end word, marginal) of runs of tokens that are likelier toxic.

    Null and empty texts get the curve's value without evidence. Rows are scored one by one: repeated rows alike, null ids
    kept, texts of any length whole. Other columns are not looked at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field, curve))

    def run(batches):
        field, curve = shared.value
        look = Lookup(field.index)
        for b in batches:
            scores, spans = [], []
            for t in b.column(1):
                at, k, n = find(t.as_py(), look)
                x, p = evidence(field, at, k, n)
                scores.append(float(1 / (1 + np.exp(-np.clip(curve[0] + curve[1:] @ x, -30, 30)))))
                runs: list[list] = []
                for i, q in zip(at.tolist(), p.tolist()):
                    if q >= 0.5:
                        if runs and runs[-1][1] == i:
                            runs[-1][1:] = [i + 1, max(runs[-1][2], q)]
                        else:
                            runs.append([i, i + 1, q])
                spans.append([dict(zip(("first", "end", "marginal"), r)) for r in runs])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    schema = "doc_id long, score double, predicted int, spans array<struct<first:bigint,end:bigint,marginal:double>>"
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, schema)
