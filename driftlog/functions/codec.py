"""Binary fields, the record-batch header, CRC-32C, topic names."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from driftlog.functions import schemas as S
from driftlog.functions.crc import crc32c_many

# Field, first byte, bytes, in the 61-byte header of a record batch, big-endian.
HEADER = [
    ("base_offset", 0, 8),
    ("batch_length", 8, 4),
    ("leader_epoch", 12, 4),
    ("magic", 16, 1),
    ("crc", 17, 4),
    ("attributes", 21, 2),
    ("last_offset_delta", 23, 4),
    ("first_ts", 27, 8),
    ("max_ts", 35, 8),
    ("producer_id", 43, 8),
    ("producer_epoch", 51, 2),
    ("base_sequence", 53, 4),
    ("record_count", 57, 4),
]
MAGIC = 2
CRC_FROM = 21


def be_int(b: Column, at: int, size: int, signed: bool = True) -> Column:
    """Big-endian integer of size bytes at a byte position, as long."""
    n = F.conv(F.hex(F.substring(b, at + 1, size)), 16, -10).cast("long")
    return n - F.when(n >= 1 << (8 * size - 1), F.lit(1 << 8 * size)).otherwise(F.lit(0)) if signed and size < 8 else n


def to_be(x: Column, size: int) -> Column:
    """Long as size big-endian bytes, the inverse of be_int."""
    return F.unhex(F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * size)))


def header_error(b: Column) -> Column:
    """Why b has no valid record-batch header, or null."""
    magic = be_int(b, 16, 1)
    return F.when(b.isNull() | (F.octet_length(b) < S.BATCH_HEADER), "short").when(magic != MAGIC, "magic")


def header_fields(b: Column) -> list[Column]:
    """The 13 fields; null where the header is invalid."""
    ok = header_error(b).isNull()
    return [F.when(ok, be_int(b, at, n, name != "crc")).alias(name) for name, at, n in HEADER]


def crc32c_bytes(data: bytes) -> int:
    return int(crc32c_many([data])[0])


@F.pandas_udf(LongType())
def crc32c(b: pd.Series) -> pd.Series:
    """CRC-32C of each value, unsigned; Spark's own crc32 has another polynomial. Null stays null."""
    known = b.notna()
    out = pd.Series(np.zeros(len(b)), index=b.index).astype("Int64")
    out[known] = crc32c_many([bytes(x) for x in b[known]]).astype(np.int64)
    return out.where(known)


def rewrite(b: Column, base: Column, checked: bool = False) -> Column:
    """b with its base offset replaced and its CRC-32C renewed. The CRC is over bytes 21 and on, which do not change, so
    one that has been checked holds on."""
    if checked:
        return F.concat(to_be(base, 8), F.substring(b, 9, 1 << 30))
    tail = F.substring(b, CRC_FROM + 1, 1 << 30)
    return F.concat(to_be(base, 8), F.substring(b, 9, 9), to_be(crc32c(tail), 4), tail)


def crc_valid(b: Column) -> Column:
    return be_int(b, 17, 4, False) == crc32c(F.substring(b, CRC_FROM + 1, 1 << 30))


def build_batch(n: int, payload: bytes = b"", base: int = 0, ts: int = 1000) -> bytes:
    """A record batch of n records with the given payload, as a producer sends it."""
    tail = struct.pack(">hiqqqhii", 0, n - 1, ts, ts, -1, -1, -1, n) + payload
    return struct.pack(">qiibI", base, len(tail) + 9, 0, MAGIC, crc32c_bytes(tail)) + tail


def encode_commit(grp: str, topic: str, part: int, off: int, metadata: str) -> bytes:
    """A commit as a length-prefixed record; strings have a 16-bit length."""
    text = lambda s: struct.pack(">h", len(s.encode())) + s.encode()
    body = text(grp) + text(topic) + struct.pack(">iq", part, off) + text(metadata)
    return struct.pack(">I", len(body)) + body


class Reader:
    """Big-endian fields of a buffer; a field that does not fit is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"need {n} bytes at {self.at}, have {len(self.data) - self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.take(struct.calcsize(">" + kind)))[0]

    def text(self, nullable: bool = False) -> str | None:
        n = self.number("h")
        if n == -1 and nullable:
            return None
        return self.take(n).decode("utf-8")

    def blob(self) -> bytes | None:
        n = self.number("i")
        return None if n == -1 else self.take(n)

    def count(self, least: int, nullable: bool = False) -> int | None:
        """Length of an array whose elements take at least `least` bytes each."""
        n = self.number("i")
        if n == -1 and nullable:
            return None
        if n < 0 or n * least > len(self.data) - self.at:
            raise ValueError(f"array of {n} elements does not fit")
        return n

    def texts(self, nullable: bool = False) -> list[str] | None:
        n = self.count(2, nullable)
        return None if n is None else [self.text() for _ in range(n)]


def decode_commits(data: bytes) -> list[tuple[str, str, int, int, str]]:
    """All commits of a concatenated stream; a broken record is an error."""
    r, out = Reader(data), []
    while r.at < len(data):
        b = Reader(r.take(r.number("I")))
        out.append((b.text(), b.text(), b.number("i"), b.number("q"), b.text()))
    return out


def valid_name(name: Column) -> Column:
    """1 to 249 of A-Z a-z 0-9 . _ -, other than . and .. ; \\z, since $ would allow a newline behind."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]{1,%d}\z" % S.MAX_NAME) & ~name.isin(".", ".."), F.lit(False))


def reserved_name(name: Column) -> Column:
    """Internal names, which clients may not create."""
    return name.startswith("__")
