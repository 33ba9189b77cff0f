"""Exact Jaccard similarity join of documents' word-shingle sets in metric space.

Distances are metric, so a pivot's distances bound others by the triangle inequality.
The join has two levels of pivots.

1. One pass gives each document its set's size and 128-bit digest (documents with equal
   sets are one class from here on), a sketch, and the shingles frequent in a task.
2. Sets of different documents are nearly all at Jaccard distance 1 from any few document
   pivots; such pivots alone would replicate every document to every region.  The outer
   pivots are therefore the singletons {s}.  All singletons in a set x are equally near,
   at 1 - 1/|x|; a global order, rare shingles first, decides x's Voronoi region, and its
   window replicates it to the regions of its next shingles: a document within distance r
   shares one of the first floor(r|x|) + 1.  (This level is what others call a prefix
   filter.)  Regions are dealt out in columnar blocks of (region, class, size, place).
3. A region of up to SMALL classes compares all pairs that size and place allow, first on
   sketches, then on the sets.  Larger regions with nearly the same members, as each
   group of near copies has one for every shingle of its windows, are joined to one.
4. In a larger region the pivots are documents.  The distance is that of the sketches: a
   sketch holds the parities of a set's shingles in bins, so the Hamming distance of two
   sketches never exceeds the sets' symmetric difference, and obeys the triangle
   inequality.  Sets that link with x differ from it in at most reach(x) shingles.  Each
   member has its home in the cell of its nearest pivot and visits every other cell whose
   pivot is at most 2 reach(x) farther: no link is lost.  Cells divide recursively.
   Regions of more than BLOCK members are divided by Spark, cell by cell, until one task
   holds a cell; in the task the division goes on down to SMALL members.  Where it doesn't
   thin the pairs out (all members about equally far from all pivots), the pairs of blocks
   of the region are compared directly.
5. A task tells the links of its cell exactly on the shingle sets: nearest sketches
   first, and only between members that aren't connected yet.  The links give components.

So no link between components is lost, and a group of g near copies costs about g exact
comparisons and at most g * g comparisons of sketches.

Defined results: null or empty texts and texts without words have an empty set and link
with nothing; a text of fewer words than a shingle is one shingle; rows without doc_id
link with nothing and have a null component; repeated rows are copies, and rows that share
a doc_id but not the text are documents of their own; extra columns are ignored; an empty
table gives an empty result.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as bl
from . import _text as tx
from ._graph import components, least_labels
from ._io import saved

SHINGLE, PERCENT = 4, 85
#: Frequent shingles that are put last in the order: a bound on what is broadcast. The result doesn't depend on it.
FREQUENT = 1 << 18
#: Distinct shingles a task counts at a time, and the count from which one is frequent there.
COUNTED, LOCALLY_FREQUENT = 1 << 19, 3
#: Count of a shingle from which its region is not gathered in one task first.
HOT = 1 << 20
#: Regions of so many classes compare all their pairs; in a cell, a member tries so many nearest others first, then twice as many.
SMALL, NEAREST = 64, 8
#: Members, and shingles of all members, that a task takes as one cell.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Pivots of a region that Spark divides, and how often it does; further regions, and such as don't shrink, go in blocks.
PIVOTS, DEPTH = 32, 6
#: Document ids up to which a list of them is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 500_000

PROFILE = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary())])
PAIRS = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def shingle_sets(w: tx.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and their offsets."""
    counts = w.counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    off = np.concatenate([[0], np.cumsum(n)])
    start = tx.ragged(w.first[:-1], n)
    flat = tx.spans_hash(w.hashes, start, start + np.repeat(np.where(counts >= k, k, counts), n))
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a > 1:
            flat[a:b].sort()
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[off[:-1][n > 0]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def digests(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent order-free 64-bit sums of each set."""
    out = []
    for seed in (21, 22):
        total = np.concatenate([np.zeros(1, tx.U64), np.cumsum(tx.mix64(flat ^ tx.stream(seed, 1)))])
        out.append(tx.signed(tx.mix64((total[off[1:]] - total[off[:-1]]) ^ np.diff(off).astype(tx.U64))))
    return out[0], out[1]


def sketches(flat: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parities of each set's hashes in a power of two of bins, at least as many as its size."""
    n = np.diff(off)
    bits = np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(1 << bits)])
    mask = np.repeat((1 << bits).astype(tx.U64) - tx.U64(1), n)
    at = np.repeat(base[:-1], n) + (tx.mix64(flat ^ tx.stream(23, 1)) & mask).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=base[-1]) & 1, bitorder="little").tobytes()
    return [packed[a >> 3 : b >> 3] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound on the symmetric difference of two sets, from their sketches."""
    a, b = np.frombuffer(x, tx.U64), np.frombuffer(y, tx.U64)
    while len(a) != len(b):  # the parities of half as many bins
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


class Counter:
    """Counts of hashes in bounded memory: those seen once go first when it is full."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.keys, self.counts = np.empty(0, tx.U64), np.empty(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.parts.append(hashes)
        self.size += len(hashes)
        if self.size >= COUNTED:
            self.merge()

    def merge(self) -> None:
        new, n = np.unique(np.concatenate([np.empty(0, tx.U64), *self.parts]), return_counts=True)
        keys = np.concatenate([self.keys, new])
        counts = np.concatenate([self.counts, n])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[first], (np.add.reduceat(counts, first) if len(first) else counts)
        if len(self.keys) > COUNTED:
            keep = self.counts > 1
            self.keys, self.counts = self.keys[keep], self.counts[keep]
        self.parts, self.size = [], 0


def profile(k: int):
    """mapInArrow function: a row for each document, then the task's frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counter = Counter()

        def rows_of(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
            flat, off = shingle_sets(w, k)
            d1, d2 = digests(flat, off)
            new = np.zeros(len(rows), dtype=bool)
            for i, d in enumerate(d1.tolist()):
                if d not in seen:
                    seen.add(d)
                    new[i] = True
            counter.add(flat[np.repeat(new, np.diff(off))])
            yield {"kind": np.zeros(len(rows), np.int32), "doc_id": rows.column("doc_id"), "text_key": rows.column("text_key"), "n": np.diff(off), "d1": d1, "d2": d2, "sketch": sketches(flat, off)}

        yield from tx.mapper(rows_of, PROFILE, fold=True)(batches)
        counter.merge()
        often = counter.counts >= LOCALLY_FREQUENT
        key, n = counter.keys[often], counter.counts[often]
        for lo in range(0, len(key), 1 << 16):
            some = key[lo : lo + (1 << 16)]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), none, none, pa.array(n[lo : lo + len(some)].astype(np.int64)), pa.array(tx.signed(some)), none, pa.nulls(len(some), pa.binary())], schema=PROFILE)

    return run


def ordered(flat: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Region of each shingle, a 64-bit number in the global order: frequent shingles are last."""
    key = flat >> tx.U64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
        hit = frequent[at] == flat
        key[hit] = tx.U64(1 << 63) + rank[at[hit]].astype(tx.U64)
    return key


def regions(k: int, percent: int, bits: int, order):
    """mapInArrow function: blocks of (region, class, size, place) for every set's window.

    Regions of shingles from hot_rank on are taken as large unseen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        frequent, rank, hot_rank = order.value

        def deal(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
            flat, off = shingle_sets(w, k)
            d1, d2 = digests(flat, off)
            n = np.diff(off)
            known = np.asarray(rows.column("doc_id").is_valid())
            take = np.zeros(len(rows), dtype=np.int64)
            key = ordered(flat, frequent, rank)
            for i, (d, a, b) in enumerate(zip(zip(d1.tolist(), d2.tolist()), off[:-1].tolist(), off[1:].tolist())):
                if known[i] and b > a and d not in seen:
                    seen.add(d)
                    key[a:b].sort()
                    m = b - a
                    take[i] = m - (percent * m + 99) // 100 + 1
            at = tx.ragged(off[:-1], take)
            if not len(at):
                return
            own = np.repeat(np.arange(len(rows)), take)
            region = key[at]
            hot = region >= tx.U64((1 << 63) + hot_rank)
            # frequent regions differ in their low bits only: deal by a mixed number
            region = tx.mix64(region)

            def packed(some: np.ndarray) -> bytes:
                o = own[some]
                return region[some].tobytes() + d1[o].tobytes() + np.stack([n[o], at[some] - off[o]]).astype(np.uint32).tobytes()

            by = np.argsort(region)
            hot, by = by[hot[by]], by[~hot[by]]
            cuts = bl.cut(region[by], bits)
            full = np.flatnonzero(np.diff(cuts))
            bucket, body = full.tolist(), [packed(by[cuts[b] : cuts[b + 1]]) for b in full]
            if len(hot):  # members of hot regions meet in no task of their own: any bucket below zero takes them
                bucket.append(-1 - int(tx.mix64(d1[own[hot[:1]]].view(tx.U64))[0] >> tx.U64(64 - bits)))
                body.append(packed(hot))
            yield {"bucket": bucket, "body": body}

        yield from tx.mapper(deal, bl.BLOCK, fold=True)(batches)

    return run


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection with which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def alike(mixed: np.ndarray) -> int:
    """A name for a set of mixed classes: two sets share it with the square of their Jaccard similarity as the chance."""
    least = np.array([mixed.min(), tx.mix64(mixed ^ tx.stream(24, 1)).min()], tx.U64)
    return int(tx.signed(tx.mix64(least ^ tx.stream(25, 2)))[0] ^ tx.signed(tx.mix64(least ^ tx.stream(26, 2)))[1])


def compare(percent: int):
    """mapInArrow function over blocks: pairs to compare (kind 0) and members of large regions (kind 1)."""

    def may_link(n_a, p_a, n_b, p_b):
        """Sizes and places allow a link whose first common shingle is this region's.

        No shingle before that one is shared, so the places add to the difference.
        """
        need = least_overlap(n_a, n_b, percent)
        return (need <= np.minimum(n_a, n_b)) & (np.minimum(n_a - p_a, n_b - p_b) >= need) & (p_a + p_b <= n_a + n_b - 2 * need)

    def in_reach(n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Members of a region that may link with its member of the least place, at any size."""
        least = np.full(len(p), p.min())
        first = int(np.argmin(p))
        least[first] = np.delete(p, first).min()
        largest = 100 * n // percent
        return p + least <= n + largest - 2 * least_overlap(n, largest, percent) + 2  # rounding may favour a smaller size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()

        def rows_of(kind: int, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows[0]), 1 << 16):
                part = [np.ascontiguousarray(r[lo : lo + (1 << 16)]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *map(pa.array, part)], schema=PAIRS)

        for bucket, bodies in bl.gathered(batches):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for body in bodies:
                m = len(body) // 24
                cols[0].append(np.frombuffer(body, tx.U64, m))
                cols[1].append(np.frombuffer(body, np.int64, m, 8 * m))
                small = np.frombuffer(body, np.uint32, 2 * m, 16 * m).astype(np.int64)
                cols[2].append(small[:m])
                cols[3].append(small[m:])
            region, cls, n, place = map(np.concatenate, cols)
            if bucket < 0:
                yield from rows_of(1, [region.view(np.int64), cls, n])
                continue
            order = np.argsort(region)
            region = region[order]
            several = np.zeros(len(region), dtype=bool)
            several[1:] = region[1:] == region[:-1]
            several[:-1] |= several[1:]
            region, order = region[several], order[several]
            cls, n, place = cls[order], n[order], place[order]
            order = np.lexsort((cls, n, region))
            region, cls, n, place = region[order], cls[order], n[order], place[order]
            new = np.ones(len(region), dtype=bool)  # copies of a class are one
            new[1:] = (region[1:] != region[:-1]) | (cls[1:] != cls[:-1])
            region, cls, n, place = region[new], cls[new], n[new], place[new]
            if not len(region):
                continue
            start = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
            size = np.diff(np.concatenate([start, [len(region)]]))
            group = np.repeat(np.arange(len(start)), size)
            few = size[group] <= SMALL
            found = []
            for step in range(1, SMALL):
                i = np.flatnonzero(few[:-step] & (group[:-step] == group[step:])) if step < len(group) else np.empty(0, np.int64)
                if not len(i):
                    break
                i = i[may_link(n[i], place[i], n[i + step], place[i + step])]
                found.append(np.stack([np.minimum(cls[i], cls[i + step]), np.maximum(cls[i], cls[i + step])]))
            members = []
            for a, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                near = in_reach(n[a : a + m], place[a : a + m])
                c, s, m = cls[a : a + m][near], n[a : a + m][near], int(near.sum())
                if m < 2:
                    continue
                mixed = tx.mix64(c.view(tx.U64))
                same = int(np.bitwise_xor.reduce(mixed))
                if same in done:
                    continue
                done.add(same)
                members.append(np.stack([np.full(m, alike(mixed)), c, s]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
            yield from rows_of(0, [*pairs, np.zeros(pairs.shape[1], np.int64)])
            if members:
                yield from rows_of(1, list(np.concatenate(members, axis=1)))

    return run


def stacked(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, with the parities of as many bins as the width says."""
    out = np.empty((len(sketches), width // 64), tx.U64)
    for k, sketch in enumerate(sketches):
        x = np.frombuffer(sketch, tx.U64)
        while len(x) > out.shape[1]:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between the rows of x and those of y."""
    out = np.zeros((len(x), len(y)), np.int32)
    for word in range(x.shape[1]):
        out += np.bitwise_count(x[:, word][:, None] ^ y[:, word][None, :])
    return out


def reach(n: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles by which a set that links with one of size n differs from it."""
    return (100 - percent) * n // percent


def voronoi(d: np.ndarray, radius: np.ndarray, visitor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Residents and visitors of each pivot's cell, from the distances of rows to pivots.

    A resident lives with its nearest pivot and visits later cells whose pivot is at most
    twice its radius farther.  For x at home in a, y in b, with d(x, y) <= radius(x):
    d(x, b) <= d(y, b) + d(x, y) <= d(y, a) + d(x, y) <= d(x, a) + 2 d(x, y).  Visitors of
    the divided region visit, and are at home nowhere.
    """
    near = d.argmin(axis=1)
    most = d[np.arange(len(d)), near] + 2 * radius
    cells = []
    for j in range(d.shape[1]):
        cells.append((np.flatnonzero((near == j) & ~visitor), np.flatnonzero((d[:, j] <= most) & (visitor | (near < j)))))
    return cells


CELL = pa.schema([("parent", pa.int64()), ("region", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("width", pa.int32()), ("guest", pa.bool_()), ("visitor", pa.bool_())])


def divider(percent: int, depth: int):
    """cogrouped applyInArrow function: rows of a region, and its pivots, to rows of cells.

    A region without pivots stays one cell.
    """

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.Table.from_batches([], CELL)
        rows = rows.combine_chunks()
        parent, width = rows.column("region")[0].as_py(), rows.column("width")[0].as_py()
        cells = [(np.arange(len(rows)), np.empty(0, np.int64))]
        if len(pivots):
            points = stacked([p["sketch"] for p in pivots.column("pivots")[0].as_py()], width)
            d = hamming(stacked(rows.column("sketch").to_pylist(), width), points)
            visitor = rows.column("visitor").to_numpy()
            cells = voronoi(d, reach(rows.column("n").to_numpy(), percent), visitor)
        out = []
        for j, (home, visit) in enumerate(cells):
            if len(home) + len(visit):
                part = rows.take(pa.array(np.concatenate([home, visit])))
                name = int(tx.signed(tx.mix64(np.array([(parent & tx.MASK) ^ (((depth << 32) + j + 1) * 0x9E3779B97F4A7C15 & tx.MASK)], tx.U64)))[0])
                visits = part.column("visitor").to_numpy().copy()
                if len(pivots):
                    visits[len(home) :] = True
                cols = {"parent": np.full(len(part), parent), "region": np.full(len(part), name), "visitor": visits}
                out.append(pa.table({f.name: cols[f.name] if f.name in cols else part.column(f.name) for f in CELL}, schema=CELL))
        return pa.concat_tables(out) if out else pa.Table.from_batches([], CELL)

    return run


class Cell:
    """Members of one cell: which pairs may link, told by pivots and sketches, and which do."""

    def __init__(self, rows: list[pa.RecordBatch], percent: int) -> None:
        col = lambda k: np.concatenate([np.asarray(r.column(k)) for r in rows])
        self.percent = percent
        self.node, self.n, self.guest, self.visitor, self.part = col("node"), col("n"), col("guest"), col("visitor"), col("part")
        self.crossing = bool((self.part >= 0).any())
        raw = [x.as_py() for r in rows for x in r.column("sketch")]
        self.sketch = stacked(raw, rows[0].column("width")[0].as_py())
        self.sets = [np.frombuffer(x.as_buffer(), tx.U64) for r in rows for x in r.column("hashes")]
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        self._divide(np.arange(len(self.node)), self.visitor, 0)

    def _divide(self, at: np.ndarray, visitor: np.ndarray, depth: int) -> None:
        homes, visits = at[~visitor], at[visitor]
        pairs = lambda h, v: h * (h - 1) // 2 + h * v
        p = int(np.sqrt(len(homes)))
        if len(at) > SMALL and p > 1 and depth < DEPTH:
            pivots = homes[np.argsort(tx.mix64(self.node[homes].view(tx.U64) ^ tx.U64(depth)), kind="stable")[:p]]
            cells = voronoi(hamming(self.sketch[at], self.sketch[pivots]), reach(self.n[at], self.percent), visitor)
            if 2 * sum(pairs(len(h), len(v)) for h, v in cells) < pairs(len(homes), len(visits)):
                for h, v in cells:
                    if len(h):
                        self._divide(at[np.concatenate([h, v])], np.arange(len(h) + len(v)) >= len(h), depth + 1)
                return
        if len(homes) and len(at) > 1:
            self.groups.append((homes, visits))

    def _candidates(self, lo: int, hi: int, root: np.ndarray) -> tuple[np.ndarray, bool]:
        """(difference, i, j) of each resident's partners of rank lo to hi - 1, nearest sketch first, in other components."""
        found, more = [np.empty((3, 0), np.int64)], False
        for homes, visits in self.groups:
            others = np.concatenate([homes, visits])
            step = max(1, (1 << 18) // len(others))
            for k in range(0, len(homes), step):
                h = homes[k : k + step]
                diff = hamming(self.sketch[h], self.sketch[others])
                a, b = self.n[h][:, None], self.n[others][None, :]
                need = least_overlap(a, b, self.percent)
                ok = (need <= np.minimum(a, b)) & (diff <= a + b - 2 * need) & (h[:, None] != others[None, :]) & ~(self.guest[h][:, None] & self.guest[others][None, :])
                if self.crossing:
                    ok &= self.part[h][:, None] != self.part[others][None, :]
                count = ok.sum(axis=1)
                live = np.flatnonzero((count > lo) & (ok & (root[h][:, None] != root[others][None, :])).any(axis=1))
                diff[~ok] = np.iinfo(np.int32).max
                for r in live.tolist():
                    order = np.argsort(diff[r], kind="stable")[lo : min(hi, count[r])]
                    j = others[order]
                    apart = root[j] != root[h[r]]
                    found.append(np.stack([diff[r][order][apart].astype(np.int64), np.full(int(apart.sum()), h[r]), j[apart]]))
                more = more or bool((count[live] > hi).any())
        return np.concatenate(found, axis=1), more

    def links(self) -> list[tuple[int, int, int, int]]:
        """(node, node, both, either) of links that connect all that the cell's links connect."""
        m = len(self.node)
        out, ends, lo, more = [], [], 0, True
        root = np.arange(m)
        while more:
            hi = 2 * lo + NEAREST
            pairs, more = self._candidates(lo, hi, root)
            label = root.tolist()

            def find(x: int) -> int:
                while label[x] != x:
                    label[x] = label[label[x]]
                    x = label[x]
                return x

            for k in np.argsort(pairs[0], kind="stable").tolist():
                i, j = int(pairs[1, k]), int(pairs[2, k])
                a, b = find(i), find(j)
                if a != b:
                    both, either = shared(self.sets[i], self.sets[j])
                    if 100 * both >= self.percent * either:
                        label[max(a, b)] = min(a, b)
                        ends.append((i, j))
                        x, y = int(self.node[i]), int(self.node[j])
                        out.append((min(x, y), max(x, y), both, either))
            root = least_labels(m, *np.array(ends, np.int64).reshape(-1, 2).T)
            lo = hi
        return out


VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("either", pa.int64())])


def cell_links(percent: int):
    """mapInArrow function over rows sorted by cell: the links of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(map(len, rows)) > 1 and (found := Cell(rows, percent).links()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=VERIFIED)

        now, held = None, []
        for batch in batches:
            key = np.asarray(batch.column("cell"))
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if held and key[a] != now:
                    yield from out(held)
                    held = []
                now = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held)

    return tx.tidy(run)


SETS = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("hashes", pa.binary())])


def needed_sets(k: int, bitmap):
    """mapInArrow function: the shingle sets of marked documents, once a task for repeated rows."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = bitmap.value, set()

        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bl.in_bitmap(marks, np.asarray(batch.column("key")))))

        def run(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
            flat, off = shingle_sets(w, k)
            d1, d2 = digests(flat, off)
            new = []
            for i, name in enumerate(zip(rows.column("doc_id").to_pylist(), d1.tolist(), d2.tolist())):
                if name not in seen:
                    seen.add(name)
                    new.append(i)
            yield {"doc_id": rows.column("doc_id").take(pa.array(new, pa.int64())), "d1": d1[new], "d2": d2[new], "hashes": [flat[off[i] : off[i + 1]].tobytes() for i in new]}

        return tx.mapper(run, SETS, fold=True)(some())

    return both


def shared(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return both, len(z) - both


def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact intersection and union sizes of joined pairs of sets."""
    for batch in batches:
        sizes = [shared(np.frombuffer(x.as_buffer(), tx.U64), np.frombuffer(y.as_buffer(), tx.U64)) for x, y in zip(batch.column(2), batch.column(3))]
        both, either = zip(*sizes) if sizes else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], schema=VERIFIED)


class Join:
    """The join of one documents table: profiles, classes, links and components.

    A class is named by its node, a number of its own: a doc_id may stand for several texts.
    """

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> None:
        if not 50 < percent <= 100:
            raise ValueError("the similarity must be over 50 and at most 100 per cent")
        self.spark: SparkSession = docs.sparkSession
        self.k, self.percent = shingle, percent
        text = F.col("text").cast("string")
        self.docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key"))
        found = saved(self.docs.mapInArrow(profile(self.k), _ddl(PROFILE)), "jaccard-profile")
        self.profiles = found.where("kind = 0").drop("kind")
        self.frequent = found.where("kind = 1")
        usable = self.profiles.where("n > 0 and doc_id is not null")
        classes = usable.groupBy("d1", "d2", "n", "sketch").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"))
        named = classes.select("d1", "d2", "n", "sketch", "copies", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"), F.monotonically_increasing_id().alias("node"))
        self.classes = saved(named, "jaccard-classes")

    def _order(self):
        """Frequent shingles and their rank by count; at most FREQUENT of them, broadcast."""
        top = self.frequent.groupBy("d1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d1").limit(FREQUENT).toArrow()
        key = np.array(top["d1"], np.int64).view(tx.U64)
        rank = len(key) - np.arange(len(key))
        by = np.argsort(key)
        hot_rank = int(rank[np.array(top["n"], np.int64) >= HOT].min(initial=FREQUENT + 1))
        return self.spark.sparkContext.broadcast((key[by], rank[by], hot_rank))

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs of digests (x, y) as pairs of nodes (a, b), without those that the sketches rule out."""
        side = self.classes.select("d1", "node", "n", "sketch")
        one = pairs.join(side.withColumnsRenamed({"d1": "x", "node": "na", "n": "sa", "sketch": "ka"}), "x")
        two = one.join(side.withColumnsRenamed({"d1": "y", "node": "nb", "n": "sb", "sketch": "kb"}), "y")
        percent = self.percent

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, sa, sb = (np.asarray(batch.column(k)) for k in range(4))
                most = sa + sb - 2 * least_overlap(sa, sb, percent)
                least = np.fromiter((least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(4), batch.column(5))), np.int64, len(batch))
                ok = (least <= most) & (a != b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])

        return two.select("na", "nb", "sa", "sb", "ka", "kb").mapInArrow(tx.tidy(keep), "a long, b long").distinct()

    def _members(self, found: DataFrame) -> DataFrame:
        """Members of large regions by the width of their sketches: region, node, n, sketch, width, guest, visitor.

        A member is also a guest among sets of half as many bins if it may link with one;
        guests are not compared with each other there.
        """
        side = self.classes.select(F.col("d1").alias("y"), "node", "sketch")
        rows = found.where("kind = 1").dropDuplicates(["x", "y"]).join(side, "y")
        width = (8 * F.length("sketch")).cast("int")
        half = (width / 2).cast("int")
        own, less = F.struct(width.alias("width"), F.lit(False).alias("guest")), F.struct(half.alias("width"), F.lit(True).alias("guest"))
        fits = (width > 64) & (F.lit(self.percent) * F.col("n") <= 100 * half)
        rows = rows.withColumn("as", F.explode(F.when(fits, F.array(own, less)).otherwise(F.array(own))))
        return rows.select(F.xxhash64("x", "as.width").alias("region"), "node", "n", "sketch", "as.width", "as.guest", F.lit(False).alias("visitor"))

    def _cells(self, rows: DataFrame) -> DataFrame:
        """Rows of cells that one task can take: cell, part and the columns of rows; part is -1, or the block of two that are compared."""
        whole = ["node", "n", "sketch", "width", "guest", "visitor"]
        rows, leaves, depth = saved(rows, "jaccard-members"), [], 0
        large = (F.col("m") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES) & (F.col("m") > 2)
        while True:
            sizes = saved(rows.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("visitor").alias("strangers")).where("m > 1 and not strangers").drop("strangers"), "jaccard-sizes", narrow=True)
            leaves.append(rows.join(sizes.where(~large).select("region"), "region", "left_semi").select(F.col("region").alias("cell"), F.lit(-1).alias("part"), *whole))
            if sizes.where(large).isEmpty():
                break
            big = rows.join(sizes.where(large), "region")
            if depth == DEPTH:
                leaves.append(self._blocks(big).select("cell", "part", *whole))
                break
            parted = saved(self._divided(big, depth), "jaccard-cells")
            grown = parted.groupBy("parent", "region").agg(F.count("*").alias("c")).groupBy("parent").agg(F.max("c").alias("most"), F.sum("c").alias("all"))
            grown = grown.join(sizes.select(F.col("region").alias("parent"), "m"), "parent")
            stuck = saved(grown.where((F.col("most") > 0.75 * F.col("m")) | (F.col("all") > 4 * F.col("m"))).select("parent"), "jaccard-stuck", narrow=True)
            leaves.append(self._blocks(big.join(stuck, F.col("region") == F.col("parent"), "left_semi")).select("cell", "part", *whole))
            rows = parted.join(stuck, "parent", "left_anti").select("region", *whole)
            depth += 1
        out = leaves[0]
        for more in leaves[1:]:
            out = out.unionByName(more)
        return out

    def _divided(self, big: DataFrame, depth: int) -> DataFrame:
        """Regions as the cells of some of their members; a region's rows are spread over tasks, its few pivots go to each."""
        shares = F.ceil(F.col("m") / F.lit(BLOCK))
        rows = big.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(depth)), shares))
        every = F.greatest(F.floor(F.col("m") / F.lit(PIVOTS)), F.lit(1))
        pick = big.where(~F.col("visitor") & (F.pmod(F.xxhash64(F.lit(depth), "node"), every) == 0)).withColumn("shares", shares)
        pivots = pick.groupBy("region", "shares").agg(F.slice(F.sort_array(F.collect_list(F.struct("node", "sketch"))), 1, 2 * PIVOTS).alias("pivots"))
        # read again: Spark rejects a cogroup of two frames with the same columns of one origin
        pivots = saved(pivots, "jaccard-pivots", narrow=True).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        left = rows.select("region", "salt", "node", "n", "sketch", "width", "guest", "visitor").groupBy("region", "salt")
        ddl = "parent long, region long, node long, n long, sketch binary, width int, guest boolean, visitor boolean"
        return left.cogroup(pivots.select("region", "salt", "pivots").groupBy("region", "salt")).applyInArrow(divider(self.percent, depth), ddl)

    def _blocks(self, big: DataFrame) -> DataFrame:
        """Regions as pairs of blocks of their members."""
        n = F.greatest(F.ceil(2 * F.col("m") / F.lit(BLOCK)), F.least(F.ceil(2 * F.col("shingles") / F.lit(BLOCK_SHINGLES)), F.col("m"))).cast("long")
        rows = big.withColumn("own", F.pmod(F.xxhash64("node"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        return rows.withColumn("cell", F.xxhash64("region", low, high)).withColumn("part", F.when(low == high, F.lit(-1)).otherwise(F.col("own")).cast("int"))

    def _ship(self, nodes: DataFrame) -> DataFrame:
        """The shingle sets of nodes: node, hashes."""
        reps = self.classes.select("node", F.col("rep").alias("doc_id"), "d1", "d2")
        wanted = saved(nodes.distinct().join(reps, "node"), "jaccard-wanted", narrow=True)
        marks = bl.id_bitmap(wanted, "doc_id", wanted.count())
        keyed = self.docs.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id"))
        sets = keyed.mapInArrow(needed_sets(self.k, marks), _ddl(SETS)).join(wanted, ["doc_id", "d1", "d2"])
        return saved(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "jaccard-sets")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b, both, either) that connect every component, and (node, root)."""
        bits = bl.buckets_for(self.spark)
        blocks = self.docs.mapInArrow(regions(self.k, self.percent, bits, self._order()), bl.BLOCK_DDL)
        found = saved(bl.dealt(blocks, bits).mapInArrow(tx.tidy(compare(self.percent)), _ddl(PAIRS)), "jaccard-pairs")
        pairs = saved(self._possible(found.where("kind = 0").select("x", "y").distinct()), "jaccard-possible", narrow=True)
        cells = self._cells(self._members(found))
        sets = self._ship(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(cells.select("node")))
        left = pairs.join(sets.withColumnsRenamed({"node": "a", "hashes": "ha"}), "a")
        both = left.join(sets.withColumnsRenamed({"node": "b", "hashes": "hb"}), "b")
        small = both.select("a", "b", "ha", "hb").mapInArrow(tx.tidy(intersect), _ddl(VERIFIED)).where(F.col("both") * 100 >= F.col("either") * self.percent)
        rows = cells.join(sets, "node").select("cell", "part", "node", "n", "sketch", "width", "guest", "visitor", "hashes")
        large = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(cell_links(self.percent), _ddl(VERIFIED))
        links = saved(small.unionByName(large), "jaccard-links")
        return links, components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def membership(self) -> DataFrame:
        """doc_id, text_key, n_shingles, component_id and component_key.

        The last two name the component's first row by doc_id and text_key.
        """
        _, roots = self.links()
        linked = self.classes.select("node", "rep", "rep_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = linked.groupBy("root").agg(F.min(F.struct("rep", "rep_key")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
        moved = linked.join(least, "root").select("node", "first")
        first = F.coalesce("first", F.struct("rep", "rep_key"))
        cls = self.classes.join(moved, "node", "left").select("d1", "d2", "n", "copies", first["rep"].alias("component_id"), first["rep_key"].alias("component_key"))
        cls = saved(cls, "jaccard-roots", narrow=True)
        # classes with over a thousandth of the rows are fewer than a thousand: broadcast them, join the others
        floor = self.profiles.count() // 1000
        keys = ["d1", "d2", "n"]  # the sketch follows from the set
        rows = self.profiles.drop("sketch").withColumn("n_shingles", F.col("n"))
        hot = rows.join(F.broadcast(cls.where(F.col("copies") > floor + 1)), keys, "left")
        cold = hot.where("copies is null").select(*rows.columns).join(cls.where(F.col("copies") <= floor + 1), keys, "left")
        out = hot.where("copies is not null").unionByName(cold)
        own = lambda c, else_: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, else_)).alias(c)
        return out.select("doc_id", "text_key", "n_shingles", own("component_id", "doc_id"), own("component_key", "text_key"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return Join(docs).membership().drop("text_key", "component_key")


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with the first row only, by doc_id, of each component.

    Rows without doc_id or without words stay.  Of texts that share a doc_id and link, the one
    of the least hash stays; texts that share a doc_id and don't link stay or go on their own;
    of rows that share doc_id and text one stays.
    """
    member = saved(Join(docs, shingle, percent).membership(), "jaccard-member", narrow=True).where("doc_id is not null and n_shingles > 0")
    text = F.xxhash64(F.col("text").cast("string"))
    same = [docs["doc_id"].cast("long") == F.col("__quillon_id"), text == F.col("__quillon_key")]
    named = [F.col("doc_id").alias("__quillon_id"), F.col("text_key").alias("__quillon_key")]

    def listed(rows: DataFrame, name: str) -> DataFrame:
        rows = saved(rows.select(*named).distinct(), name, narrow=True)
        return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows

    kept = docs.join(listed(member.where("component_id <> doc_id or component_key <> text_key"), "jaccard-gone"), same, "left_anti")
    repeated = listed(member.groupBy("doc_id", "text_key").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-repeated")
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once)
