"""Rows that carry packed arrays to numbered shards, and the steps to gather them there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "shard bigint, blob binary"
MOST_SHARDS = 16


def rows(shards, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])


def gathered(batches):
    """All blobs of one shard after the other, from rows sorted by shard."""
    current, held = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard != current and held:
                yield current, held
                held = []
            current = shard
            held.append(blob.as_py())
    if held:
        yield current, held


def to_shards(df: DataFrame, shards: int) -> DataFrame:
    """Brings the rows of each shard together, sorted, shards dealt out to tasks by their number. There are
    as many tasks as the session shuffles to, or more, so that none gets over ``MOST_SHARDS`` of them."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(shards, wanted), -(-shards // MOST_SHARDS))
    number = F.pmod(F.col("shard").cast("bigint"), F.lit(parts)).cast("int")
    return df.repartitionById(parts, number).sortWithinPartitions("shard")


class ShardSet:
    """Numbers of the shards that were written, a bit each: for one of them a missing file is an error."""

    def __init__(self, numbers: DataFrame):
        """Runs the job that gives the column ``shard`` (0 or more)."""
        bit = F.expr("shiftleft(1L, cast(shard % 64 as int))")
        rows = numbers.groupBy(F.floor(F.col("shard") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
        self._bits = np.zeros(max((r.word for r in rows), default=-1) + 1, np.int64)
        for r in rows:
            self._bits[r.word] = r.bits

    def __contains__(self, shard: int) -> bool:
        return shard // 64 < len(self._bits) and bool(int(self._bits[shard // 64]) >> (shard % 64) & 1)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes; each is preceded by its type and length."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        out.append(np.array([len(a)], np.int64).tobytes() + a.dtype.str.encode().ljust(8))
        out.append(np.ascontiguousarray(a).tobytes())
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for _ in range(n):
        size = int(np.frombuffer(blob, np.int64, 1, at)[0])
        kind = np.dtype(blob[at + 8 : at + 16].decode().strip())
        out.append(np.frombuffer(blob, kind, size, at + 16))
        at += 16 + size * kind.itemsize
    return out
