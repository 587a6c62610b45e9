"""Request frames and bodies, one layout per API, decoded to nested Python values for mapInPandas and UDFs."""

from __future__ import annotations

import struct

from driftlog.functions.codec import Reader
from driftlog.functions.schemas import APIS, MAX_FRAME

#: Layouts: a field is (name, kind); kinds are the codec's: b h i q (integers), s (string), n (nullable string),
#: y (bytes), S (strings), and [layout] or ?[layout] for an array (nullable) of such structs.
PARTITION_OFFSET = [("part", "i"), ("off", "q"), ("max_bytes", "i")]
LAYOUTS: dict[str, list] = {
    "Produce": [("transactional_id", "n"), ("acks", "h"), ("timeout_ms", "i"), ("topics", [("topic", "s"), ("partitions", [("part", "i"), ("records", "y")])])],
    "Fetch": [("replica_id", "i"), ("max_wait_ms", "i"), ("min_bytes", "i"), ("topics", [("topic", "s"), ("partitions", PARTITION_OFFSET)])],
    "ListOffsets": [("replica_id", "i"), ("topics", [("topic", "s"), ("partitions", [("part", "i"), ("ts", "q")])])],
    "Metadata": [("topics", "N")],
    "OffsetCommit": [("grp", "s"), ("topics", [("topic", "s"), ("partitions", [("part", "i"), ("off", "q"), ("metadata", "n")])])],
    "OffsetFetch": [("grp", "s"), ("topics", ("?", [("topic", "s"), ("partitions", [("part", "i")])]))],
    "FindCoordinator": [("key", "s")],
    "JoinGroup": [("grp", "s"), ("session_timeout_ms", "i"), ("member", "s"), ("protocol_type", "s"), ("protocols", [("name", "s"), ("metadata", "y")])],
    "Heartbeat": [("grp", "s"), ("generation", "i"), ("member", "s")],
    "LeaveGroup": [("grp", "s"), ("member", "s")],
    "SyncGroup": [("grp", "s"), ("generation", "i"), ("member", "s"), ("assignments", [("member", "s"), ("assignment", "y")])],
    "ApiVersions": [],
    "CreateTopics": [("topics", [("topic", "s"), ("partitions", "i"), ("replication", "h"), ("assignments", [("part", "i"), ("replicas", [("id", "i")])]), ("configs", [("name", "s"), ("value", "n")])]), ("timeout_ms", "i")],
    "DeleteTopics": [("topics", "S"), ("timeout_ms", "i")],
}
LEAST = {"b": 1, "h": 2, "i": 4, "q": 8, "s": 2, "n": 2, "y": 4, "S": 4, "N": 4}
NAMES = {key: name for key, name, *_ in APIS}


def least(layout) -> int:
    """Bytes that a struct of this layout takes at least."""
    return max(1, sum(LEAST[k] if isinstance(k, str) else 4 for _, k in layout))


def read(r: Reader, layout: list) -> dict:
    out = {}
    for name, kind in layout:
        if isinstance(kind, str):
            out[name] = r.text(kind == "n") if kind in "sn" else r.blob() if kind == "y" else r.texts(kind == "N") if kind in "SN" else r.number(kind)
        else:
            nullable, inner = (True, kind[1]) if isinstance(kind, tuple) else (False, kind)
            n = r.count(least(inner), nullable)
            out[name] = None if n is None else [read(r, inner) for _ in range(n)]
    return out


def decode_request(frame: bytes) -> dict:
    """api_key, api, version, correlation, client_id and the body's fields of a frame without its length."""
    r = Reader(frame)
    key, version, correlation, client = r.number("h"), r.number("h"), r.number("i"), r.text(True)
    api = NAMES.get(key, "Unknown")
    body = read(r, LAYOUTS[api]) if api in LAYOUTS else {}
    return {"api_key": key, "api": api, "version": version, "correlation": correlation, "client_id": client, "body": body}


def frames(data: bytes) -> tuple[list[bytes], bytes]:
    """Complete frames of a stream and what is left; a frame of more than 100 MiB is an error."""
    out, at = [], 0
    while at + 4 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        if n > MAX_FRAME:
            raise ValueError(f"frame of {n} bytes")
        if at + 4 + n > len(data):
            break
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out, data[at:]
