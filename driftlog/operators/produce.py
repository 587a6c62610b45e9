"""Appending record batches as producers send them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions import schemas as S
from driftlog.functions.codec import be_int, crc_valid, header_error, rewrite
from driftlog.operators.commits import catalog_partitions
from driftlog.plans.view import TP, assign_offsets


def produce(requests: DataFrame, catalog: DataFrame, ends: DataFrame, now_ms: int, check_crc: bool = True) -> tuple[DataFrame, DataFrame]:
    """requests (rid, topic, part, records) appended in order of rid behind ends (topic, part, latest).

    Returns (answers: rid, topic, part, error, base, append_ms; batches to write: topic, part, base, span, payload with
    its base offset and CRC renewed). Errors: 3 for a partition that the catalog lacks, 2 for a broken header, or, unless
    check_crc is off, a CRC or length that does not hold. A failed request uses no offset.
    """
    listed = catalog_partitions(catalog).withColumn("known", F.lit(True))
    r = requests.join(listed, TP, "left")
    whole = be_int(F.col("records"), 8, 4) + 12 == F.octet_length("records")
    bad = header_error(F.col("records")).isNotNull()
    sound = whole & crc_valid(F.col("records")) if check_crc else F.lit(True)
    error = F.when(F.col("known").isNull(), S.UNKNOWN_TOPIC_OR_PARTITION).when(bad, S.CORRUPT_MESSAGE).when(~sound, S.CORRUPT_MESSAGE).otherwise(S.NONE)
    r = r.withColumn("error", error).withColumn("span", F.greatest(be_int(F.col("records"), 57, 4), F.lit(1)))
    good = assign_offsets(r.where(F.col("error") == S.NONE), "rid", F.col("span")).join(ends, TP, "left")
    good = good.withColumn("base", F.col("off") + F.coalesce("latest", F.lit(0)))
    none = F.lit(-1).cast("long")
    answers = good.select("rid", *TP, "error", "base", F.lit(now_ms).cast("long").alias("append_ms")).unionByName(
        r.where(F.col("error") != S.NONE).select("rid", *TP, "error", none.alias("base"), none.alias("append_ms"))
    )
    return answers, good.select(*TP, "base", "span", rewrite(F.col("records"), F.col("base"), check_crc).alias("payload"))
