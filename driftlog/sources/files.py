"""Catalog files and streams of commit records."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

from driftlog.functions import schemas as S
from driftlog.functions.codec import decode_commits

VERSION = 1
NAME = re.compile(r"[A-Za-z0-9._-]{1,%d}" % S.MAX_NAME)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The topics (name, partitions) of a catalog file; none if there is no file; any fault in it is an error.

    A catalog is one small JSON file of the driver: its size is bounded by the partition cap.
    """
    if not os.path.exists(path):
        return spark.createDataFrame([], "name string, partitions int")
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict) or data.get("version") != VERSION:
        raise ValueError(f"catalog {path}: version {data.get('version') if isinstance(data, dict) else None}, not {VERSION}")
    seen: set[str] = set()
    for t in data.get("topics") or []:
        name, n = t.get("name", ""), t.get("partitions", 0)
        if not NAME.fullmatch(name) or name in (".", ".."):
            raise ValueError(f"catalog {path}: bad topic name {name!r:.60}")
        if not isinstance(n, int) or not 1 <= n <= S.MAX_PARTITIONS_PER_TOPIC:
            raise ValueError(f"catalog {path}: {name} has {n} partitions")
        if name in seen:
            raise ValueError(f"catalog {path}: {name} is listed twice")
        seen.add(name)
    return spark.createDataFrame([(t["name"], t["partitions"]) for t in data.get("topics") or []], "name string, partitions int")


def save_catalog(catalog: DataFrame, path: str) -> None:
    """Replace the catalog file at once: topics by name, synced beside it, then renamed over it."""
    rows = sorted((r.name, r.partitions) for r in catalog.select("name", "partitions").collect())
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump({"version": VERSION, "topics": [{"name": n, "partitions": p} for n, p in rows]}, f, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    folder = os.open(os.path.dirname(os.path.abspath(path)), os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def decode_commit_blobs(blobs: DataFrame) -> DataFrame:
    """Commits of blobs (base, payload) of a commit log, seq counting from each blob's base; a broken record fails."""

    def run(batches):
        for pdf in batches:
            rows = [(b + i, *c) for b, p in zip(pdf["base"], pdf["payload"]) for i, c in enumerate(decode_commits(bytes(p)))]
            yield pdf.__class__(rows, columns=["seq", "grp", "topic", "part", "off", "metadata"])

    return blobs.select("base", "payload").mapInPandas(run, "seq long, grp string, topic string, part int, off long, metadata string")
