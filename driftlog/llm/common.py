"""Shared pieces: scratch tables in the cluster's shared folder, word splitting, token hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java form of the white space that separates words.
SPACE_RE = "[\\x20\\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a local session, whose executors share the driver's
    disk, gets one of its own; any other session is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftlog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") + "/driftlog"


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"


#: Setting by which Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Settings of how many rows a scan holds and a Python worker gets at a time.
AT_A_TIME = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and no executor holds it. Nothing
    reads the query's shuffle files once its table stands, so they go. rows: as many go through a task at a time."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | ({x: str(rows) for x in AT_A_TIME} if rows else {})
    before = {x: spark.conf.get(x, None) for x in settings}
    try:
        for x, y in settings.items():
            spark.conf.set(x, y)
        df.write.parquet(path)
    finally:
        for x, y in before.items():
            spark.conf.unset(x) if y is None else spark.conf.set(x, y)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftlog_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    path = getattr(df, "_driftlog_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod, is 1; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % mod == 1


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then the words between runs of \\x20 and \\x09-\\x0D; bytes.split() splits on just these."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class HashCache(dict):
    """Word -> XXH64 as unsigned int, remembering a bounded number of words."""

    def __init__(self, seed: int = 42, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) < self.limit:
            self[word] = h
        return h


def portions(b: pa.RecordBatch, column: int, most_bytes: int):
    """b in parts whose texts have about most_bytes bytes together; a longer text stands alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = done = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, done + most_bytes, side="right")))
        yield b.slice(lo, hi - lo)
        lo, done = hi, int(size[hi - 1])


def give_back() -> None:
    """Return free memory to the system; where the C library cannot, what Arrow holds at least."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run):
    """run, for mapInArrow, after which a worker that waits for its next task holds no free memory of this one."""

    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


def hash_words(cache: HashCache, texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and offsets: text i has hashes[off[i]:off[i + 1]]."""
    flat: list[bytes] = []
    off = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        flat.extend(words(t))
        off[i + 1] = len(flat)
    return np.fromiter(map(cache.__getitem__, flat), np.uint64, len(flat)), off


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer on uint64."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words that lies within one text, and the position of its first word in h."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    ok = np.ones(len(out), bool)
    for e in off[1:-1]:
        ok[max(0, e - n + 1) : e] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at
