"""Request metrics: counters, histograms, rates, quantiles. Requests have api, result, ms, bytes_in, bytes_out, ts_ms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftlog.functions import schemas as S

MINUTE = 60_000


def requests_total(r: DataFrame) -> DataFrame:
    return r.groupBy("api", "result").agg(F.count("*").alias("n"))


def bytes_by_direction(r: DataFrame) -> DataFrame:
    s = r.agg(F.sum("bytes_in").alias("i"), F.sum("bytes_out").alias("o"))
    return s.select(F.expr("stack(2, 'in', i, 'out', o)").alias("direction", "bytes")).select("direction", F.col("bytes").cast("long"))


def histogram(r: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts per bound (+Inf last) by keys: one pass, one conditional sum per bound."""
    bounds = [*S.LATENCY_BOUNDS, float("inf")]
    sums = [F.sum((F.col("ms") / 1000 <= b).cast("long")).alias(f"_b{i}") for i, b in enumerate(bounds)]
    h = r.groupBy(*keys).agg(*sums)
    cells = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)))
    return h.select(*keys, F.inline(cells))


def histogram_totals(r: DataFrame, keys: list[str]) -> DataFrame:
    """What goes with a histogram: the sum of seconds, exact to the nanosecond, and the count."""
    ns = F.sum(F.round(F.col("ms") * 1_000_000).cast("decimal(38,0)"))
    return r.groupBy(*keys).agg((ns.cast("double") / 1e9).alias("sum_s"), F.count("*").alias("n"))


def gauge_last(samples: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.max_by(value, order).alias("value"))


def sum_over_brokers(samples: DataFrame, keys: list[str], series: list[str], value: str, order: str) -> DataFrame:
    """Sum of a gauge's last values by keys. Targets that reach the same broker scrape the same series, so a series
    (broker and labels) counts once, whatever number of targets delivered it."""
    last = samples.groupBy(*dict.fromkeys([*keys, *series])).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(*keys).agg(F.sum("_v").alias("value"))


def percentiles(r: DataFrame, keys: list[str], value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """sorted[min(int(p * n), n - 1)] by keys. A histogram of some thousand bins tells in which bin each rank lies; only
    that bin's distinct values are put in order, so no task sorts a key's values."""
    bin_ = F.floor(F.signum(value) * F.log2(F.abs(F.col(value)) + 1) * 256)
    d = r.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_b", bin_)
    bins = d.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    w = W.partitionBy(*keys)
    bins = bins.withColumn("_past", F.sum("_n").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).withColumn("_all", F.sum("_n").over(w))
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), F.least(F.floor(p * F.col("_all")), F.col("_all") - 1).alias("rank")) for i, p in enumerate(ps)))
    wanted = bins.select(*keys, "_b", "_n", "_past", F.explode(ranks).alias("_p")).where("_p.rank >= _past and _p.rank < _past + _n")
    wanted = wanted.select(*keys, "_b", F.col("_p.i").alias("_i"), (F.col("_p.rank") - F.col("_past")).alias("_rank"))
    inside = d.join(wanted, [*keys, "_b"])
    upto = F.sum("_c").over(W.partitionBy(*keys, "_i").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    hit = inside.withColumn("_upto", upto).where(F.col("_upto") > F.col("_rank"))
    return hit.groupBy(*keys).agg(*(F.min(F.when(F.col("_i") == i, F.col(value))).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)))


def throughput(r: DataFrame) -> DataFrame:
    """Totals over the time between the first and the last request; 0 per second if there is none."""
    s = r.agg(F.count("*").alias("records"), F.coalesce(F.sum("bytes_in"), F.lit(0)).cast("long").alias("bytes"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000.0).alias("seconds"))
    per = lambda x: F.when(F.col("seconds") > 0, x / F.col("seconds")).otherwise(0.0)
    return s.select("records", "bytes", "seconds", per(F.col("records")).alias("records_per_s"), per(F.col("bytes") / (1024.0 * 1024.0)).alias("mb_per_s"))


def rate(r: DataFrame, keys: list[str], window_ms: int = MINUTE, value=None) -> DataFrame:
    """Exact rate per second in windows of fixed length, from the requests themselves."""
    start = F.col("ts_ms") - F.col("ts_ms") % window_ms
    total = F.count("*") if value is None else F.sum(value)
    return r.groupBy(*keys, start.alias("start_ms")).agg((total / (window_ms / 1000.0)).alias("per_s"))


def bytes_rate(r: DataFrame, window_ms: int = MINUTE) -> DataFrame:
    long = r.select("ts_ms", F.expr("stack(2, 'in', bytes_in, 'out', bytes_out)").alias("direction", "bytes"))
    return rate(long, ["direction"], window_ms, F.col("bytes"))


def histogram_quantile(r: DataFrame, window_ms: int = 5 * MINUTE, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles read off the cumulative buckets of each window, linear inside a bucket; the last bound for +Inf."""
    h = histogram(r.withColumn("start_ms", F.col("ts_ms") - F.col("ts_ms") % window_ms), ["start_ms"])
    w = W.partitionBy("start_ms").orderBy("le")
    h = h.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0)))
    h = h.withColumn("total", F.max("n").over(W.partitionBy("start_ms"))).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    rank = F.col("q") * F.col("total")
    h = h.where((F.col("n") >= rank) & (F.col("before") < rank))
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * ((rank - F.col("before")) / (F.col("n") - F.col("before")))
    value = F.when(F.col("le") == float("inf"), F.lit(S.LATENCY_BOUNDS[-1])).otherwise(inside)
    return h.select("start_ms", "q", value.alias("seconds"))


def exposition(samples: DataFrame, name: str, labels: list[str], value: str = "value") -> DataFrame:
    """Lines of the text format: name{label="value",...} value; a label's backslashes, quotes and line ends are escaped."""
    plain = lambda k: F.replace(F.replace(F.replace(F.col(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), plain(k), F.lit('"')) for k in labels))
    return samples.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("value"))
