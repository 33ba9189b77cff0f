"""Columnar shuffles of 64-bit hashes, and a bounded bitmap of the repeated ones.

Python tasks hand numpy arrays to each other as binary blocks, one per slice of rows and
bucket of hashes, instead of one Spark row per hash.  A bucket is a range of the top bits
of the hash.  The number of buckets follows the session's shuffle partitions, so the
bytes of a bucket stay as bounded as those of a shuffle partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import _text as tx

#: Bits of the broadcast bitmap: 2**27 bits are 16 MB however large the corpus is.
BITMAP_BITS = 27
#: Bits of a bitmap of ids, at most: 2**26 bits are 8 MB; beyond four million ids more rows pass it than need to.
ID_BITS = 26
BLOCK = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])
BLOCK_DDL = "bucket int, body binary"


def buckets_for(spark: SparkSession, least_bits: int = 6) -> int:
    """Bits of the bucket number: about two buckets for each shuffle partition."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(BITMAP_BITS - 6, max(least_bits, (2 * n - 1).bit_length()))


def cut(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of sorted hashes begins; 2**bits + 1 places."""
    n = 1 << bits
    return np.concatenate([np.searchsorted(sorted_hashes, np.arange(n, dtype=tx.U64) << tx.U64(64 - bits)), [len(sorted_hashes)]])


def hash_blocks(hashes: np.ndarray, bits: int) -> dict:
    """Columns of BLOCK that deal out the hashes."""
    hashes = np.sort(hashes)
    at = cut(hashes, bits)
    full = np.flatnonzero(np.diff(at))
    return {"bucket": full.astype(np.int32), "body": [hashes[at[b] : at[b + 1]].tobytes() for b in full]}


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Bucket by bucket, its blocks; the rows must be sorted by bucket."""
    now, bodies = None, []
    for batch in batches:
        for b, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != now:
                if bodies:
                    yield now, bodies
                now, bodies = b, []
            bodies.append(body)
    if bodies:
        yield now, bodies


def dealt(blocks: DataFrame, bits: int) -> DataFrame:
    """Blocks with every bucket in one partition, bucket after bucket."""
    return blocks.repartition(max(2, (1 << bits) // 2), "bucket").sortWithinPartitions("bucket")


def repeated_bitmap(blocks: DataFrame, bits: int) -> Broadcast:
    """A bitmap over the top bits of the hashes that come in two blocks or more.

    Each block must hold a hash once, or twice if its slice alone already repeats it.
    Other hashes may be marked too (by chance, more often in a larger corpus); none that
    is repeated is missed.  The driver gets 2**BITMAP_BITS bits at most.
    """
    low = BITMAP_BITS - bits

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, bodies in gathered(batches):
            h = np.sort(np.concatenate([np.frombuffer(b, dtype=tx.U64) for b in bodies]))
            twice = h[1:][h[1:] == h[:-1]]
            marks = np.zeros(1 << low, dtype=bool)
            marks[((twice >> tx.U64(64 - BITMAP_BITS)) & tx.U64((1 << low) - 1)).astype(np.int64)] = True
            if marks.any():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], schema=BLOCK)

    size = (1 << low) // 8
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for bucket, body in dealt(blocks, bits).mapInArrow(tx.tidy(find), BLOCK_DDL).toLocalIterator():
        bitmap[bucket * size : (bucket + 1) * size] |= np.frombuffer(body, dtype=np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(bitmap)


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for each hash whose bit is set."""
    at = (hashes >> tx.U64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def id_bitmap(ids: DataFrame, column: str, n: int) -> Broadcast:
    """A bitmap of n mixed ids: 16 bits for each, 2**ID_BITS at most; no id is missed, and others may be marked too."""
    from pyspark.sql import functions as F

    bits = min(ID_BITS, max(16, (16 * n).bit_length()))
    h = F.xxhash64(column)
    words = ids.select(F.shiftrightunsigned(h, 64 - bits + 6).alias("w"), F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit(63)).alias("b"))
    rows = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(b as int))")).alias("v")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    bitmap[np.asarray(rows["w"])] = np.asarray(rows["v"])
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def in_bitmap(bitmap: np.ndarray, xxhashes: np.ndarray) -> np.ndarray:
    """True for each xxhash64 (as Spark's long) whose bit is set."""
    bits = len(bitmap).bit_length() - 1 + 6
    at = (xxhashes.view(tx.U64) >> tx.U64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1
