"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Every document becomes its token ids and an end id; only documents longer than the
capacity are cut, from the end, so that the first piece may be shorter.  Full pieces are
sequences of their own.  The others are dealt into partitions of bounded size by hash.
Each partition packs best-fit decreasing and computes the lower bound of dual feasible
functions (items above C - a count as whole bins, items below a as nothing, for every
a <= C / 2; Fekete and Schepers 2001, Martello and Toth 1990).  A partition whose bins
equal its bound is certified.  It releases only its emptiest bin; a partition with a gap
releases its emptiest bins, up to a fixed number of documents.  What is released is
exchanged between fewer partitions, which pack again, until one partition is left.

Defined results: a null text is empty and is one end id; rows without doc_id and
repeated rows are packed as documents of their own; an empty table gives no sequences;
extra columns are ignored.  Every step depends on stored rows only, so a retried task
packs alike.  The string of an added token in a text is that token, as in ``tokenizers``.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._io import saved

CAPACITY, END_ID = 2048, 0
#: Documents a partition packs at a time, and those it releases at most.
PART, RELEASED = 1 << 16, 1 << 12


@lru_cache(2)
def encoder(path: str):
    """ids(text) for a tokenizers file of byte-level BPE.

    The merges are run by tiktoken, several times as fast, from the same vocabulary;
    the ids are those of ``tokenizers`` with ``add_special_tokens=False``: texts are split
    at the file's added tokens first.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t[flag] for t in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that take in their surroundings aren't supported")
    # the byte alphabet of byte-level BPE: printable bytes stand for themselves
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    ranks = {bytes(symbols[c] for c in piece): rank for piece, rank in model["vocab"].items() if piece not in added}
    made = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(text: str) -> list[int]:
        if any(content in text for content in added):
            return made.encode(text, allowed_special="all")
        return made.encode_ordinary(text)

    return ids


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def cut_points(n: int, capacity: int) -> range:
    """Starts of the pieces of n tokens, but for the first piece's start 0 if it is shorter."""
    return range(n % capacity, n, capacity)


def cutter(path: str, capacity: int, keep_ids: bool):
    def run(rows: pa.RecordBatch, _) -> Iterator[dict]:
        encode = encoder(path)
        out: dict[str, list] = {f.name: [] for f in PIECES}
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
            ids = encode(text) if text else []
            ids.append(END_ID)
            body = memoryview(array("I", ids).tobytes())
            n = len(ids)
            starts = list(cut_points(n, capacity))
            if n % capacity:
                starts = [0, *starts]
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                part = body[4 * a : 4 * b]
                out["doc_id"].append(doc_id)
                out["piece"].append(piece)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(part))
                out["ids"].append(bytes(part) if keep_ids else None)
        yield out

    return tx.mapper(run, PIECES, fold=None)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with a row number; ids as little-endian unsigned 32 bits if kept."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(cutter(path or tokenizer_path(), capacity, keep_ids), ddl)
    if not keep_ids:
        found = found.drop("ids")
    return saved(found.withColumn("row", F.monotonically_increasing_id()), "pieces")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best dual feasible function bound over all thresholds."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    total = count * np.arange(capacity + 1)
    n_upto, s_upto = np.cumsum(count), np.cumsum(total)
    half = capacity // 2
    best = -(-int(s_upto[-1]) // capacity)
    a = np.arange(1, half + 1)
    whole = n_upto[-1] - n_upto[capacity - a]  # larger than capacity - a
    large = n_upto[capacity - a] - n_upto[half]  # larger than half, with room for items of a
    middle = s_upto[half] - s_upto[a - 1]
    room = large * capacity - (s_upto[capacity - a] - s_upto[half])
    return max(best, int((whole + large + np.maximum(0, -(-(middle - room) // capacity))).max()))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item by best-fit decreasing; ties keep their order."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0  # bit r of the mask: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, used
            used += 1
        bins[i] = b
        room -= s
        if not by_room[room]:
            mask |= 1 << room
        by_room[room].append(b)
    return bins


PACKED = "row long, length long, sequence_id long, offset long"


def packer(capacity: int, turn: int, last: bool):
    """Packs one partition; rows to exchange come without a sequence."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows, sizes = (table.column(c).to_numpy() for c in ("row", "length"))
        order = np.argsort(rows, kind="stable")  # the order of arrival doesn't matter
        rows, sizes = rows[order], sizes[order]
        bins = best_fit(sizes, capacity)
        n_bins = int(bins.max()) + 1
        by = np.lexsort((rows, bins))
        rows, sizes, bins = rows[by], sizes[by], bins[by]
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        before = np.cumsum(sizes) - sizes
        offset = before - before[first][np.cumsum(first) - 1]
        open_bin = np.zeros(n_bins, dtype=bool)
        if not last:
            fill, items = np.bincount(bins, sizes, n_bins), np.bincount(bins, minlength=n_bins)
            emptiest = np.argsort(fill, kind="stable")
            gap = n_bins - lower_bound(sizes, capacity)
            give = np.cumsum(items[emptiest]) <= RELEASED if gap else np.arange(n_bins) < 1
            open_bin[emptiest[give & (fill[emptiest] < capacity)]] = True
        sequence = (np.int64(turn) << 52) + (np.int64(part) << 20) + bins
        return pa.table({"row": rows, "length": sizes, "sequence_id": pa.array(sequence, mask=open_bin[bins]), "offset": offset})

    return run


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (pieces) with sequence_id and offset."""
    full = found.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    left = found.where(F.col("length") < capacity).select("row", "length")
    n = left.count()
    done, turn = None, 0
    while n:
        parts = -(-n // PART)
        dealt = left.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        got = saved(dealt.groupBy("part").applyInArrow(packer(capacity, turn, parts == 1), PACKED), "packed")
        settled = got.where("sequence_id is not null").select("row", "sequence_id", "offset")
        done = settled if done is None else done.union(settled)
        left = got.where("sequence_id is null").select("row", "length")
        turn, n = turn + 1, left.count() if parts > 1 else 0
    if done is None:
        return full
    return full.unionByName(found.join(done, "row"))


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, its pieces in place and its ids (binary), of pieces that keep their ids."""
    put = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    whole = packed_pieces.groupBy("sequence_id").agg(put.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return whole.select("sequence_id", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"), ids.alias("ids"))


def digest(docs: DataFrame) -> DataFrame:
    """Every piece with its place in its sequence."""
    return packed(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
