"""Types, codes and limits of the log's protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Error codes of the wire protocol.
UNKNOWN_SERVER_ERROR = -1
NONE = 0
OFFSET_OUT_OF_RANGE = 1
CORRUPT_MESSAGE = 2
UNKNOWN_TOPIC_OR_PARTITION = 3
INVALID_TOPIC = 17
ILLEGAL_GENERATION = 22
INCONSISTENT_GROUP_PROTOCOL = 23
UNKNOWN_MEMBER_ID = 25
REBALANCE_IN_PROGRESS = 27
UNSUPPORTED_VERSION = 35
TOPIC_ALREADY_EXISTS = 36
INVALID_PARTITIONS = 37

# Fixed values: (api key, name, least and greatest version).
APIS = [
    (0, "Produce", 3, 3),
    (1, "Fetch", 0, 0),
    (2, "ListOffsets", 1, 1),
    (3, "Metadata", 1, 1),
    (8, "OffsetCommit", 0, 0),
    (9, "OffsetFetch", 2, 2),
    (10, "FindCoordinator", 0, 0),
    (11, "JoinGroup", 0, 0),
    (12, "Heartbeat", 0, 0),
    (13, "LeaveGroup", 0, 0),
    (14, "SyncGroup", 0, 0),
    (18, "ApiVersions", 0, 0),
    (19, "CreateTopics", 0, 0),
    (20, "DeleteTopics", 0, 0),
]

# What a group operation's failure becomes on the wire, by operation.
GROUP_ERRORS = [
    ("heartbeat", "unknown member", UNKNOWN_MEMBER_ID),
    ("heartbeat", "illegal generation", ILLEGAL_GENERATION),
    ("heartbeat", "rebalance in progress", REBALANCE_IN_PROGRESS),
    ("join", "inconsistent protocol", INCONSISTENT_GROUP_PROTOCOL),
    ("sync", "unknown member", UNKNOWN_MEMBER_ID),
    ("sync", "illegal generation", ILLEGAL_GENERATION),
    ("sync", "sync timed out", REBALANCE_IN_PROGRESS),
]

# Sizes and limits.
BLOB_HEADER = 8
BATCH_HEADER = 61
SEGMENT_BYTES = 16 << 20
INDEX_EVERY = 100
MAX_PARTITIONS_PER_TOPIC = 1000
MAX_NAME = 249
MAX_FRAME = 100 << 20
FLUSH_EVERY = 1000
RETENTION_MS = 7 * 24 * 3600 * 1000
JOIN_DELAY_MS = 3000

# Latency bounds in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

BLOB = T.StructType([T.StructField("base", T.LongType()), T.StructField("span", T.IntegerType()), T.StructField("position", T.LongType()), T.StructField("payload", T.BinaryType())])
COMMIT = T.StructType([T.StructField("grp", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("off", T.LongType()), T.StructField("metadata", T.StringType())])
BROKER = T.StructType([T.StructField("node_id", T.IntegerType()), T.StructField("host", T.StringType()), T.StructField("port", T.IntegerType())])
PARTITION = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("leader", T.IntegerType()), T.StructField("replicas", T.ArrayType(T.IntegerType())), T.StructField("isr", T.ArrayType(T.IntegerType()))])


def api_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(APIS, "api_key int, name string, min_version int, max_version int")


def group_errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUP_ERRORS, "op string, failure string, code int")


def version_answers(requests: DataFrame) -> DataFrame:
    """requests (rid, version) for the API table: a version above 0 is error 35, so that the client asks again with 0;
    the table's entries go with every answer."""
    return requests.select("rid", "version", F.when(F.col("version") > 0, UNSUPPORTED_VERSION).otherwise(NONE).alias("error"), F.lit(len(APIS)).alias("apis"))
