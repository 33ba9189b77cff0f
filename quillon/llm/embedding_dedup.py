"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A vector's code holds the signs of its randomly rotated direction (random signs and
Hadamard transforms, three rounds), and its correction factor the inner product of the
direction with its code.  The inner product of the code with another rotated vector,
divided by the factor, is an unbiased estimate of the cosine with a known error (RaBitQ,
Gao and Long 2024).

1. The index holds a code for every distinct vector.  Slices of the code's bits key some
   tables; tables whose slices don't fit the code take the signs under fresh rotations,
   which then follow in the code.  The bits in a slice follow the number of distinct
   vectors so that buckets stay near BUCKET rows, and the number of tables follows from
   the wanted chance that a pair right at the threshold shares a bucket (pairs above it
   find each other more often).
2. Only codes travel to the buckets.  Two codes whose signs differ in more places than a
   pair at the threshold does, by SIGMAS standard errors, are no pair; the others ask for
   their vectors, once for each bucket, not for each pair.
3. Vectors that were asked for are compared in their bucket by estimate, one side by its
   code and factor, the other quantised to four bits.  Pairs whose upper confidence bound
   reaches the threshold are recomputed exactly in double precision; only these can link.

Equal vectors are one class with a multiplicity, named by a number of its own, since a
vec_id may stand for several vectors.  A bucket of more than BLOCK rows is cut into blocks
that are compared in pairs, so no task holds more than two blocks; nothing is capped.
Tasks report counts and a spanning forest, never all pairs.

Defined results: null vectors, zero vectors and vectors with null or non-finite
components link with nothing; vectors of different lengths never link; rows without
vec_id link with nothing and have a null component; repeated rows link as copies, and rows
that share a vec_id but not the vector link each on their own; labels and extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._graph import components, least_labels
from ._io import saved

THRESHOLD, RECALL = 0.9, 0.98
BUCKET, BLOCK = 512, 4096
#: Least bits of a code, and standard errors on each side of an estimate.
LEAST_BITS, SIGMAS = 256, 4.0
#: Hot buckets up to which their table is broadcast.
BROADCAST_ROWS = 100_000


def code_bits(dim: int) -> int:
    return max(LEAST_BITS, 1 << (dim - 1).bit_length() if dim > 1 else 1)


def rotate(x: np.ndarray, group: int = 0) -> np.ndarray:
    """Rows of x, padded with zeros to a power of two, under the group's fixed random rotation."""
    bits = code_bits(x.shape[1])
    y = np.zeros((len(x), bits))
    y[:, : x.shape[1]] = x
    for turn in range(3):
        y *= np.where(tx.stream(1000 + 3 * group + turn, bits) >> tx.U64(63), -1.0, 1.0)
        step = 1
        while step < bits:
            z = y.reshape(len(y), -1, 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), bits)
            step *= 2
        y /= math.sqrt(bits)
    return y


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated directions, their codes (rows of 64-bit words) and correction factors."""
    y = rotate(x / np.linalg.norm(x, axis=1)[:, None])
    code = np.packbits(y >= 0, axis=1, bitorder="little").view(tx.U64)
    return y, code, np.abs(y).sum(axis=1) / math.sqrt(y.shape[1])


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Four-bit quantised rows: bit planes, least value, step, and sum of the levels."""
    lo = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - lo) / 15, 1e-300)
    # a fixed dither rounds up with the chance of the remainder, which keeps the estimate unbiased
    dither = (tx.stream(77, y.shape[1]) >> tx.U64(11)).astype(np.float64) / (1 << 53)
    level = np.minimum(np.floor((y - lo[:, None]) / step[:, None] + dither), 15).astype(np.uint8)
    bits = np.stack([np.packbits((level >> k) & 1, axis=1, bitorder="little").view(tx.U64) for k in range(4)], axis=1)
    return bits, lo, step, level.sum(axis=1, dtype=np.int64)


def estimates(code: np.ndarray, factor: np.ndarray, query: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates (queries by rows of codes) and each code's error bound."""
    bits, lo, step, total = query
    size = code.shape[1] * 64
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    dot = np.zeros((len(bits), len(code)), np.int32)
    for k in range(4):
        for word in range(code.shape[1]):
            dot += np.bitwise_count(bits[:, k, word][:, None] & code[:, word][None, :]).astype(np.int32) << k
    signed = lo[:, None] * (2 * ones - size)[None, :] + step[:, None] * (2 * dot - total[:, None])
    bound = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(size - 1)
    return signed / math.sqrt(size) / factor[None, :], bound


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact cosines of some pairs of rows, in double precision."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 15):
        a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        out[lo : lo + (1 << 15)] = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b])
    return out


PROFILE = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])


def told(vector: pa.ListScalar) -> tuple[np.ndarray, int, int, int]:
    """A vector's components, its length, and a digest of them; length 0 for vectors that can't link."""
    x = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64) if vector.is_valid else np.empty(0)
    ok = len(x) and np.isfinite(x).all() and x.any()
    d1, d2 = np.frombuffer(hashlib.md5((x + 0.0).tobytes() if ok else b"").digest(), np.int64).tolist()
    return x, len(x) if ok else 0, d1, d2


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of each vector."""
    for batch in batches:
        cols = list(zip(*(told(v)[1:] for v in batch.column(1)))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(PROFILE)[1:]))], schema=PROFILE)


STORE = pa.schema([*PROFILE, ("vec", pa.binary())])


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of vectors that can link, in single precision where that is exact; a task tells repeated rows once."""
    seen: set[tuple] = set()
    for batch in batches:
        rows = []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            x, *name = told(vector)
            if name[0] and vec_id is not None and (vec_id, *name) not in seen:
                seen.add((vec_id, *name))
                with np.errstate(over="ignore"):
                    single = x.astype(np.float32)
                rows.append((vec_id, *name, (single if (single == x).all() else x).tobytes()))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, STORE)], schema=STORE)


def unstored(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in vecs])


CODES = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("code", pa.binary()), ("factor", pa.float64())])
CODES_DDL = "node long, dim int, code binary, factor double"
INDEX = pa.schema([("dim", pa.int32()), ("tab", pa.int32()), ("slot", pa.int64()), ("node", pa.int64()), ("code", pa.binary())])
INDEX_DDL = "dim int, tab int, slot long, node long, code binary"


def groups_for(tables: int, bits: int, dim: int) -> int:
    """Rotations whose signs the tables' slices take up."""
    return -(-tables // (code_bits(dim) // bits))


def coded(x: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with the signs of all rotations that the tables need, and correction factors."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    _, code, factor = encode(x)
    more = [np.packbits(rotate(unit, g) >= 0, axis=1, bitorder="little").view(tx.U64) for g in range(1, groups_for(tables, bits, x.shape[1]))]
    return np.concatenate([code, *more], axis=1), factor


def slots_of(code: np.ndarray, tables: int, bits: int, dim: int) -> np.ndarray:
    """The slot of each code in each table, from slices of its bits that don't overlap: rows by tables."""
    room, size = code_bits(dim) // bits, code_bits(dim)
    flat = np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")
    table = np.arange(tables)
    at = (table // room * size + table % room * bits)[:, None] + np.arange(bits)
    return (flat[:, at].astype(np.int64) << np.arange(bits)).sum(axis=2)


def coder(tables: int, bits: int):
    """mapInArrow function: the code and factor of every stored vector (node, dim, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                for lo in range(0, len(rows), 1024):
                    part = rows.slice(lo, 1024)
                    code, factor = coded(unstored(part.column(2).to_pylist(), dim), tables, bits)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor)], schema=CODES)

    return tx.tidy(run)


def indexer(tables: int, bits: int):
    """mapInArrow function: a row for each code and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                for lo in range(0, len(rows), 1024):
                    part = rows.slice(lo, 1024)
                    code = np.frombuffer(b"".join(part.column(2).to_pylist()), tx.U64).reshape(len(part), -1)
                    slot = slots_of(code, tables, bits, dim)
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.full(len(part), t, np.int32)), pa.array(slot[:, t]), part.column(0), part.column(2)], schema=INDEX)

    return tx.tidy(run)


def most_apart(threshold: float, bits: int) -> int:
    """Signs in which the codes of a pair at the threshold may differ, SIGMAS standard errors allowed.

    Two random signs of vectors at an angle differ with the chance angle / pi.
    """
    share = math.acos(threshold) / math.pi
    return min(bits, math.ceil(bits * share + SIGMAS * math.sqrt(bits * share * (1 - share))))


ASKED = pa.schema([("dim", pa.int32()), ("tab", pa.int32()), ("slot", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("own", pa.int32()), ("node", pa.int64())])
ASKED_DDL = "dim int, tab int, slot long, bi int, bj int, own int, node long"


def screener(tables: int, bits: int, threshold: float):
    """applyInArrow function over a bucket's codes, or two blocks of them: those with a partner of near enough signs.

    A pair counts in the first table that brings it together.
    """

    def run(table: pa.Table) -> pa.Table:
        dim, tab = table.column("dim")[0].as_py(), table.column("tab")[0].as_py()
        own = table.column("own").to_numpy()
        crossing = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), tx.U64).reshape(len(table), -1)
        slot = slots_of(code, tab, bits, dim) if tab else np.empty((len(table), 0), np.int64)
        words, most = code_bits(dim) // 64, most_apart(threshold, code_bits(dim))
        asked = np.zeros(len(table), dtype=bool)
        step = max(1, (1 << 18) // len(table))
        for lo in range(0, len(table), step):
            hi = min(lo + step, len(table))
            apart = np.zeros((hi - lo, len(table) - lo), np.int32)
            for word in range(words):
                apart += np.bitwise_count(code[lo:hi, word][:, None] ^ code[lo:, word][None, :])
            near = apart <= most
            near &= np.arange(lo, len(table))[None, :] > np.arange(lo, hi)[:, None]
            if crossing:
                near &= own[lo:][None, :] != own[lo:hi][:, None]
            i, j = np.nonzero(near)
            i, j = i + lo, j + lo
            first = ~(slot[i] == slot[j]).any(axis=1)
            asked[i[first]] = True
            asked[j[first]] = True
        return table.filter(pa.array(asked)).select(ASKED.names).cast(ASKED)

    return run


LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
LINKS_DDL = "node long, root long, links long"


def linker(tables: int, bits: int, threshold: float):
    """applyInArrow function over vectors asked for in a bucket, or in two blocks of one: links by estimate, then exactly."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        dim, tab = table.column("dim")[0].as_py(), table.column("tab")[0].as_py()
        own = table.column("own").to_numpy()
        crossing = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
        node, copies, factor = (table.column(c).to_numpy() for c in ("node", "copies", "factor"))
        whole = np.frombuffer(b"".join(table.column("code").to_pylist()), tx.U64).reshape(len(node), -1)
        code = np.ascontiguousarray(whole[:, : code_bits(dim) // 64])
        x = unstored(table.column("vec").to_pylist(), dim)
        slot = slots_of(whole, tab, bits, dim) if tab else np.empty((len(node), 0), np.int64)
        found_i, found_j = [], []
        step = max(1, (1 << 18) // max(1, len(node)))
        for lo in range(0, len(node), step):
            hi = min(lo + step, len(node))
            y = rotate(x[lo:hi] / np.linalg.norm(x[lo:hi], axis=1)[:, None])
            guess, bound = estimates(code[lo:], factor[lo:], planes(y))
            near = guess + bound[None, :] >= threshold
            near &= np.arange(lo, len(node))[None, :] > np.arange(lo, hi)[:, None]
            if crossing:
                near &= own[lo:][None, :] != own[lo:hi][:, None]
            i, j = np.nonzero(near)
            i, j = i + lo, j + lo
            first = ~(slot[i] == slot[j]).any(axis=1)
            i, j = i[first], j[first]
            hit = cosines(x, i, j) >= threshold
            found_i.append(i[hit])
            found_j.append(j[hit])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = node[least_labels(len(node), i, j)]
        some = links > 0
        return pa.table({"node": node[some], "root": root[some], "links": links[some]}, schema=LINKS)

    return run


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Tables and bits of a slice for n distinct vectors."""
    bits = max(1, round(math.log2(max(2.0, n / BUCKET))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - share))), bits


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = saved(own.mapInArrow(tx.tidy(profile), "vec_id long, dim int, d1 long, d2 long"), "vectors")
    usable = rows.where("dim > 0 and vec_id is not null")
    classes = usable.groupBy("dim", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    n, total = classes.count(), rows.count()
    tables, bits = shape(n, threshold, recall)
    name = ["vec_id", "dim", "d1", "d2"]
    store = own.mapInArrow(tx.tidy(stored), "vec_id long, dim int, d1 long, d2 long, vec binary").join(classes.withColumnRenamed("rep", "vec_id"), name)
    store = saved(store.select("node", "dim", "vec", "copies").dropDuplicates(["node"]), "vector-store")
    codes = saved(store.select("node", "dim", "vec").mapInArrow(coder(tables, bits), CODES_DDL), "vector-codes")
    index = codes.select("node", "dim", "code").mapInArrow(indexer(tables, bits), INDEX_DDL)
    key = ["dim", "tab", "slot"]
    hot = saved(index.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1"), "vector-hot", narrow=True)
    dealt = index.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", "blocks")
    asked = saved(dealt.groupBy(*key, "bi", "bj").applyInArrow(screener(tables, bits, threshold), ASKED_DDL), "vector-asked")
    wanted = asked.join(store.drop("dim"), "node").join(codes.drop("dim"), "node")
    links = saved(wanted.groupBy(*key, "bi", "bj").applyInArrow(linker(tables, bits, threshold), LINKS_DDL), "vector-links")
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    answer = classes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = answer.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = answer.join(least, "root").select("dim", "d1", "d2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    answer = saved(answer, "vector-answer", narrow=True)
    # classes with over a thousandth of the rows are fewer than a thousand: broadcast them, join the others
    keys, floor = ["dim", "d1", "d2"], total // 1000 + 1
    tagged = rows.withColumn("dim", F.when(F.col("vec_id").isNotNull(), F.col("dim")).otherwise(F.lit(0)))
    hot = tagged.join(F.broadcast(answer.where(F.col("copies") > floor)), keys, "left")
    cold = hot.where("n_links is null").select("vec_id", *keys).join(answer.where(F.col("copies") <= floor), keys, "left")
    out = hot.where("n_links is not null").select("vec_id", "n_links", "component_id").union(cold.select("vec_id", F.coalesce("n_links", F.lit(0)), F.coalesce("component_id", "vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def digest(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
