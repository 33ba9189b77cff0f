"""Removal of passages that an earlier document already holds, by a De Bruijn graph.

Nodes are the runs of K - 1 consecutive words, and every window of K words is an edge from
its first K - 1 words to its last.  A node's minimiser is the least hash of its M-word
grams.  The graph holds the edges that two documents share.

1. Minimisers that occur in two documents are found by a columnar shuffle and marked in
   a bitmap of fixed size.  Both nodes of a shared edge have marked minimisers.  (When a
   corpus marks most bits, more edges travel; the result stays.)
2. Edges with marked nodes are dealt out by the minimisers of their two nodes, so that all
   edges of a node meet in one bucket.  Within a slice of documents an edge is sent once,
   for the slice's smallest document, and within a task once for each slice that has a
   smaller document than those before it; its other holders are settled at once.  So a
   passage that a third of all documents hold costs a row for each task, not for each
   document.
3. A bucket finds the edges that two documents hold and each one's smallest holder, its
   source, counts the edges into and out of every node, and joins edges at nodes with one
   of each.  Edges that follow each other in their source are one piece.
4. Pieces of a source that continue each other are chained, and the chains are compacted by
   Spark joins to nonbranching paths: each chain points at the one before it, and pointers
   double until all point at the head of their path.
5. Occurrences of shared edges that continue each other in the document and in its source
   are one span.  Each span's words are compared with those at its coordinates in the
   source: a digest of the words is taken there, joined to the span, and taken again in
   the document.  Spans settled within a slice are compared there, word by word.  Only
   words of verified spans are removed.

Defined results: a null or empty text has no words; a row without doc_id is neither a
source nor shortened; rows that share a doc_id are separate texts, and neither is a
source for the other; texts with fewer than K words stay whole; extra columns are
ignored; an empty table gives an empty result.  Edges are told apart by 63 bits of their
hash and 64 bits of their nodes' tags; words are compared by 64-bit hashes.  A long text
is read whole by one task; what a source owns is bounded by its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as bl
from . import _text as tx
from ._io import saved

K, M = 13, 6
#: Shared edges that a task remembers having sent.
REMEMBERED = 1 << 17
#: Texts up to which their ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Kind 0 are spans, kind 1 pieces of paths: for these the source columns hold the hash of the last edge, and of the edge before the first or 0.
FOUND = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "text_key", "start", "n", "source_id", "source_key", "source_start")), ("same", pa.bool_())])
FOUND_DDL = "kind int, doc_id long, text_key long, start long, n long, source_id long, source_key long, source_start long, same boolean"
EVEN = tx.U64(tx.MASK - 1)


def node_minimisers(w: tx.Words) -> np.ndarray:
    """The least gram hash of the K - 1 words from each word on, whatever document they belong to."""
    n = max(0, len(w.hashes) - M + 1)
    least, span = tx.spans_hash(w.hashes, np.arange(n), np.arange(n) + M), 1
    while span < K - M:  # least of the next 2, 4, ... grams
        step = min(span, K - M - span)
        least = np.minimum(least[: max(0, len(least) - step)], least[step:])
        span += step
    # least values crowd near zero: mixed, they fill buckets and bitmap evenly
    return tx.mix64(least)


def starts_of(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """True where any of the keys differs from the one before."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


def minimisers(rows: pa.RecordBatch, w: tx.Words, bits: int) -> Iterator[dict]:
    """Blocks of the slice's distinct minimisers, twice those of two of its documents."""
    own = w.owner()
    n = len(own) - K + 2
    at = np.flatnonzero(own[: max(0, n)] == own[K - 2 :]) if n > 0 else np.empty(0, np.int64)
    at = at[np.asarray(rows.column("doc_id").is_valid())[own[at]]]
    if not len(at):
        return
    least, own = node_minimisers(w)[at], own[at].astype(np.int64)
    # a minimiser comes in runs: keep the first of each run, then find those of several documents
    first = starts_of([least, own])
    least, own = least[first], own[first]
    order = np.lexsort((own, least))
    least, own = least[order], own[order]
    new = starts_of([least])
    several = np.zeros(int(new.sum()), dtype=bool)
    several[(np.cumsum(new) - 1)[1:][~new[1:] & (own[1:] != own[:-1])]] = True
    distinct = least[new]
    yield bl.hash_blocks(np.concatenate([distinct, distinct[several]]), bits)


class Sent:
    """Shared edges that a task has sent: hash, and doc, text and place of the smallest holder."""

    def __init__(self) -> None:
        self.rows = np.empty((4, 0), np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are there, and their rows (doc, key, pos)."""
        own = self.rows[0].view(tx.U64)
        if not len(own):
            return np.zeros(len(h), dtype=bool), np.zeros((3, len(h)), np.int64)
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        return own[at] == h, self.rows[1:, at]

    def add(self, h: np.ndarray, doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> None:
        new = np.stack([tx.signed(h), doc, key, pos])
        if self.rows.shape[1] + new.shape[1] <= REMEMBERED:
            new = np.concatenate([self.rows, new], axis=1)
        order = np.lexsort((new[3], new[2], new[1], new[0].view(tx.U64)))
        new = new[:, order]
        self.rows = np.ascontiguousarray(new[:, starts_of([new[0]])][:, :REMEMBERED])


def runs(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of maximal runs, where follow[i] says that i + 1 continues i."""
    start = np.flatnonzero(np.concatenate([[True], ~follow]))
    return start, np.diff(np.concatenate([start, [len(follow) + 1]]))


def dealer(bitmap: Broadcast, bits: int):
    """mapInArrow function: blocks of the marked edges to settle elsewhere, and of spans settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        yield from tx.mapper(lambda rows, w: deal(rows, w, bitmap.value, bits, sent), bl.BLOCK)(batches)

    return run


def deal(rows: pa.RecordBatch, w: tx.Words, bitmap: np.ndarray, bits: int, sent: Sent) -> Iterator[dict]:
    at, h = w.windows(K)
    if not len(at):
        return
    least = node_minimisers(w)
    keep = bl.marked(bitmap, least[at]) & bl.marked(bitmap, least[at + 1]) & np.asarray(rows.column("doc_id").is_valid())[w.owner()[at]]
    at, h = at[keep], h[keep] & EVEN
    if not len(at):
        return
    row = w.owner()[at]
    doc, key = (np.asarray(rows.column(c).fill_null(0)).astype(np.int64)[row] for c in ("doc_id", "text_key"))
    pos = at - w.first[row]
    order = np.lexsort((pos, key, doc, h))
    new = starts_of([h[order]])
    source = np.empty(len(at), dtype=np.int64)
    source[order] = order[new][np.cumsum(new) - 1]  # the edge's occurrence in the slice's smallest document
    settled = doc[source] < doc
    for k in range(K):  # word by word
        settled &= w.hashes[at + k] == w.hashes[at[source] + k]
    several = np.zeros(len(at), dtype=bool)
    several[source[settled]] = True
    several = several[source]
    known, (c_doc, c_key, c_pos) = sent.find(h)
    known &= ~settled & (c_doc < doc)
    spans = []
    i = np.flatnonzero(settled)
    if len(i):
        s = source[i]
        start, length = runs((np.diff(i) == 1) & (np.diff(at[i]) == 1) & (np.diff(row[i]) == 0) & (np.diff(at[s]) == 1) & (np.diff(row[s]) == 0))
        a, b = i[start], s[start]
        spans.append(np.stack([doc[a], key[a], pos[a], length, doc[b], key[b], pos[b], np.ones(len(a), np.int64)]))
    i = np.flatnonzero(known)
    if len(i):
        start, length = runs((np.diff(i) == 1) & (np.diff(at[i]) == 1) & (np.diff(row[i]) == 0) & (np.diff(c_doc[i]) == 0) & (np.diff(c_key[i]) == 0) & (np.diff(c_pos[i]) == 1))
        a = i[start]
        spans.append(np.stack([doc[a], key[a], pos[a], length, c_doc[a], c_key[a], c_pos[a], np.zeros(len(a), np.int64)]))
    i = np.flatnonzero(~settled & ~known)
    head = i[several[i] & (source[i] == i)]
    sent.add(h[head], doc[head], key[head], pos[head])
    bodies: dict[int, list[bytes]] = {}
    if len(i):
        shift = tx.U64(64 - bits)
        here, there = (least[at[i]] >> shift).astype(np.int64), (least[at[i] + 1] >> shift).astype(np.int64)
        ghost = np.concatenate([np.zeros(len(i), dtype=bool), np.ones(int((here != there).sum()), dtype=bool)])
        bucket = np.concatenate([here, there[here != there]])
        beyond = np.concatenate([there, there[here != there]]) != bucket  # the edge's second node lies in another bucket
        i = np.concatenate([i, i[here != there]])
        order = np.lexsort((at[i], bucket))
        i, bucket, ghost, beyond = i[order], bucket[order], ghost[order], beyond[order]
        start, length = runs((np.diff(bucket) == 0) & (np.diff(at[i]) == 1) & (np.diff(row[i]) == 0) & ~ghost[1:])
        flags = ghost[start].astype(np.uint32) | (~beyond[start + length - 1]).astype(np.uint32) << 1
        edge = h[i] | several[i].astype(tx.U64)
        tags = (tx.spans_hash(tx.mix64(w.hashes ^ tx.stream(31, 1)), *((x := np.arange(max(0, len(w.hashes) - K + 2))), x + K - 1)) >> tx.U64(32)).astype(np.uint32)
        cuts = np.flatnonzero(starts_of([bucket[start]])).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(start)]):
            s, m = start[lo:hi], length[lo:hi]
            texts, own = np.unique(row[i[s]], return_inverse=True)
            first = np.searchsorted(row, texts)
            table = np.stack([doc[first], key[first]], axis=1)
            four = np.stack([own, pos[i[s]], m, flags[lo:hi]], axis=1).astype(np.uint32)
            bodies[int(bucket[s[0]])] = [table, four, edge[s[0] : s[-1] + m[-1]], tags[at[i[s]].repeat(m + 1) + tx.ragged(np.zeros(len(m), np.int64), m + 1)]]
    none = [np.empty((0, 2), np.int64), np.empty((0, 4), np.uint32), np.empty(0, tx.U64), np.empty(0, np.uint32)]
    out = {b: [*parts, np.empty((0, 8), np.int64)] for b, parts in bodies.items()}
    if spans:  # settled spans need no bucket of their own: any will do, another for each slice
        each = np.ascontiguousarray(np.concatenate(spans, axis=1).T)
        b = int(tx.mix64((each[:1, 0] ^ each[:1, 1] + each[:1, 2]).view(tx.U64))[0] >> tx.U64(64 - bits))
        out[b] = [*out.get(b, none)[:4], each]
    yield {"bucket": list(out), "body": [np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts) for parts in out.values()]}


def unpacked(bodies: list[bytes]) -> list[np.ndarray]:
    """Runs (doc, key, pos, n, flags), edges, tags and spans of several blocks."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for body in bodies:
        sizes, at = np.frombuffer(body, np.int64, 5), 40
        got = []
        for n, kind, width in zip(sizes.tolist(), (np.int64, np.uint32, tx.U64, np.uint32, np.int64), (2, 4, 1, 1, 8)):
            got.append(np.frombuffer(body, kind, n * width, at).reshape(-1, width))
            at += got[-1].nbytes
        four = got[1].astype(np.int64)
        parts[0].append(np.column_stack([got[0][four[:, 0]], four[:, 1:]]))
        for k in (1, 2, 3):
            parts[k].append(got[k + 1])
    return [np.concatenate(parts[0]), np.concatenate(parts[1])[:, 0], np.concatenate(parts[2])[:, 0], np.concatenate(parts[3])]


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of edges that a smaller document holds, and pieces of nonbranching paths."""

    def rows_of(kind: int, cols: list[np.ndarray], same: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(same), 1 << 15):
            part = [pa.array(np.ascontiguousarray(c[lo : lo + (1 << 15)])) for c in (*cols, same)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], schema=FOUND)

    for _, bodies in bl.gathered(batches):
        of, edge, tag, spans = unpacked(bodies)
        if len(spans):
            yield from rows_of(0, list(spans[:, :7].T), spans[:, 7] == 1)
        if not len(edge):
            continue
        n = of[:, 3]
        which, step = np.repeat(np.arange(len(of)), n), tx.ragged(np.zeros(len(n), np.int64), n)
        doc, key, pos = of[which, 0], of[which, 1], of[which, 2] + step
        h, flagged = edge & EVEN, (edge & tx.U64(1)).astype(bool)
        at = np.arange(len(edge)) + which  # a run has one tag more than edges
        one, two = tag[at], tag[at + 1]
        ghost = (step == 0) & (of[which, 4] & 1 == 1)
        inside = (step < n[which] - 1) | (of[which, 4] & 2 == 2)
        order = np.lexsort((pos, key, doc, two, one, h))
        new = starts_of([x[order] for x in (h, one, two)])
        start = np.flatnonzero(new)
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        owner = order[start]
        last = order[np.concatenate([start[1:], [len(h)]]) - 1]
        shared = np.logical_or.reduceat(flagged[order], start) | (doc[last] > doc[owner])
        # spans: occurrences whose owner is a smaller document, told once, by the bucket of the first node
        i = np.flatnonzero(shared[group] & ~ghost & (doc[owner][group] < doc))
        if len(i):
            s = owner[group[i]]
            first, length = runs((np.diff(i) == 1) & (np.diff(which[i]) == 0) & (np.diff(doc[s]) == 0) & (np.diff(key[s]) == 0) & (np.diff(pos[s]) == 1))
            a, b = i[first], s[first]
            yield from rows_of(0, [doc[a], key[a], pos[a], length, doc[b], key[b], pos[b]], np.zeros(len(a), dtype=bool))
        # pieces: shared edges joined at nodes with one edge in and one out
        e = owner[shared]
        if not len(e):
            continue
        own, ends = ~ghost[e], inside[e]
        nodes, place = np.unique(np.concatenate([one[e], two[e]]), return_inverse=True)
        out_of, into = place[: len(e)], place[len(e) :]
        single = (np.bincount(out_of[own], minlength=len(nodes)) == 1) & (np.bincount(into[ends], minlength=len(nodes)) == 1)
        entering = np.full(len(nodes), -1)
        entering[into[ends]] = np.flatnonzero(ends)
        before = np.where(single[out_of], entering[out_of], -1)
        before[before == np.arange(len(e))] = -1
        mine = np.flatnonzero(own)
        mine = mine[np.lexsort((pos[e[mine]], key[e[mine]], doc[e[mine]]))]
        if len(mine):
            x = e[mine]
            first, length = runs((np.diff(doc[x]) == 0) & (np.diff(key[x]) == 0) & (np.diff(pos[x]) == 1) & (before[mine[1:]] == mine[:-1]))
            a, z = x[first], x[first + length - 1]
            prev = before[mine[first]]
            prev = np.where(prev >= 0, tx.signed(h[e[prev]]), 0)
            yield from rows_of(1, [doc[a], key[a], pos[a], length, tx.signed(h[z]), prev, np.zeros(len(a), np.int64)], np.zeros(len(a), dtype=bool))


def chain(columns: list[str], follow: Callable[..., np.ndarray], ends: str | None = None):
    """mapInArrow function over sorted rows: rows that follow each other become one, n summed, column ends taken from the last."""
    n, last = columns.index("n"), columns.index(ends) if ends else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(batch):
                continue
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            start, length = runs(follow([c[:-1] for c in cols], [c[1:] for c in cols]))
            out = [c[start] for c in cols]
            out[n] = np.add.reduceat(cols[n], start)
            if last is not None:
                out[last] = cols[last][start + length - 1]
            held = [c[-1:] for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in out], columns)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], columns)

    return tx.tidy(run)


SPAN = ["doc_id", "text_key", "start", "n", "source_id", "source_key", "source_start", "same"]
RUN = ["doc_id", "text_key", "start", "n", "last", "before"]


def _span_goes_on(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    same = np.logical_and.reduce([a[k] == b[k] for k in (0, 1, 4, 5, 7)])
    return same & (a[2] + a[3] == b[2]) & (a[6] + a[3] == b[6])


def _run_goes_on(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] + a[3] == b[2]) & (a[4] == b[5])


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"))


def found(docs: DataFrame) -> DataFrame:
    """Spans (kind 0) and pieces of paths (kind 1), as the buckets tell them."""
    spark = docs.sparkSession
    bits = bl.buckets_for(spark)
    own = keyed(docs)
    marks = bl.repeated_bitmap(own.mapInArrow(tx.mapper(lambda r, w: minimisers(r, w, bits), bl.BLOCK), bl.BLOCK_DDL), bits)
    blocks = own.mapInArrow(dealer(marks, bits), bl.BLOCK_DDL)
    return saved(bl.dealt(blocks, bits).mapInArrow(tx.tidy(settle), FOUND_DDL), "substring-found")


def spans_of(rows: DataFrame) -> DataFrame:
    """Spans as long as document and source go on together."""
    spans = rows.where("kind = 0").drop("kind").repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "start", "n", "source_id", "source_start")
    ddl = ", ".join(f"{c} {'boolean' if c == 'same' else 'long'}" for c in SPAN)
    return saved(spans.mapInArrow(chain(SPAN, _span_goes_on), ddl), "substring-spans")


def paths(rows: DataFrame) -> DataFrame:
    """Nonbranching paths by their runs in sources: doc_id, text_key, start, n, path, offset (edges of the path before the run).

    A run points at the run that ends with the edge before it.  In each round a pointer
    moves to where its target points, by a join, and so doubles its reach; a round that
    brings no run to its head leaves circles only, which are cut everywhere.
    """
    pieces = rows.where("kind = 1").select("doc_id", "text_key", "start", "n", F.col("source_id").alias("last"), F.col("source_key").alias("before"))
    pieces = pieces.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "start")
    lanes = saved(pieces.mapInArrow(chain(RUN, _run_goes_on, "last"), ", ".join(f"{c} long" for c in RUN)), "substring-runs", narrow=True)
    rest = lanes.where("before <> 0").select("last", F.col("before").alias("to"))
    ahead = lanes.select(F.col("last").alias("to"), F.col("n").alias("away"), (F.col("before") == 0).alias("done"))
    state, left = saved(rest.join(ahead, "to"), "substring-pointers", narrow=True), None
    while (open_ := state.where("not done").count()) and open_ != left:
        left = open_
        there = state.select(F.col("last").alias("to"), F.col("to").alias("_to"), F.col("away").alias("_away"), F.col("done").alias("_done"))
        moved = state.where("not done").join(there, "to", "left").select("last", F.coalesce("_to", "to").alias("to"), (F.col("away") + F.coalesce("_away", F.lit(0))).alias("away"), F.coalesce("_done", F.lit(True)).alias("done"))
        state = saved(state.where("done").select("last", "to", "away", "done").unionByName(moved), "substring-pointers", narrow=True)
    heads = lanes.join(state.where("done").select("last", "to", "away"), "last", "left")
    return heads.select("doc_id", "text_key", "start", "n", F.coalesce("to", "last").alias("path"), F.coalesce("away", F.lit(0)).alias("offset"))


CHECKED = pa.schema([*((c, pa.int64()) for c in ("source_id", "source_key", "source_start", "n", "d1", "d2", "path", "offset"))])


def word_digests(w: tx.Words, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a digest of the words that n edges from a word on cover."""
    out = np.empty((2, len(start)), np.int64)
    for k, (a, b) in enumerate(zip(start.tolist(), (start + n + K - 1).tolist())):
        out[:, k] = np.frombuffer(hashlib.blake2b(w.hashes[a:b].tobytes(), digest_size=16).digest(), np.int64)
    return out


def flat_list(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of a column of lists of structs, and the fields of all of them."""
    counts = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    return counts, [np.asarray(flat.field(flat.type.get_field_index(c)).cast(pa.int64()).fill_null(0)) for c in names]


def at_sources(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
    """Digests of the words asked for in sources, and the path and place on it of each."""
    counts, (start, n) = flat_list(rows.column("asked"), ["source_start", "n"])
    owned, (run, length, path, offset) = flat_list(rows.column("owned"), ["start", "n", "path", "offset"])
    row, of = np.repeat(np.arange(len(rows)), counts), np.repeat(np.arange(len(rows)), owned)
    d1, d2 = word_digests(w, w.first[:-1][row] + start, n)
    order = np.lexsort((run, of))
    run, length, path, offset, of = run[order], length[order], path[order], offset[order], of[order]
    # the run of the source that holds the span's first edge
    base = np.int64(int(max(run.max(initial=0), start.max(initial=0))) + 1)
    k = np.searchsorted(of * base + run, row * base + start, side="right") - 1
    hit = (k >= 0) & (len(run) > 0)
    k = np.maximum(k, 0)
    if len(run):
        hit &= (of[k] == row) & (start < run[k] + length[k])
    own_path = np.where(hit, path[k], 0) if len(run) else np.zeros(len(row), np.int64)
    place = np.where(hit, offset[k] + start - run[k], 0) if len(run) else own_path
    ids, keys = (np.asarray(rows.column(c)).astype(np.int64)[row] for c in ("doc_id", "text_key"))
    yield {"source_id": ids, "source_key": keys, "source_start": start, "n": n, "d1": d1, "d2": d2, "path": own_path, "offset": place}


def _of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The texts among ids, or the others (how is left_semi or left_anti); ids are distinct (doc_id, text_key)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "text_key"], how)


def with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with their spans (start, n, source_id, source_start, d1, d2, path, offset), and texts without any."""
    own = keyed(docs)
    rows = found(docs)
    spans = spans_of(rows)
    asked = spans.where("not same").select("source_id", "source_key", "source_start", "n").distinct()
    asked = asked.groupBy(F.col("source_id").alias("doc_id"), F.col("source_key").alias("text_key")).agg(F.collect_list(F.struct("source_start", "n")).alias("asked"))
    owned = paths(rows).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n", "path", "offset")).alias("owned"))
    asked = saved(asked.join(owned, ["doc_id", "text_key"], "left"), "substring-asked", narrow=True)
    sources = _of(own, asked.select("doc_id", "text_key"), "left_semi").join(asked.hint("merge"), ["doc_id", "text_key"])
    told = sources.mapInArrow(tx.mapper(at_sources, CHECKED), ", ".join(f"{f.name} long" for f in CHECKED))
    key = ["source_id", "source_key", "source_start", "n"]
    # written, so that a span that many documents hold is a skewed key that Spark can split
    told = saved(told.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("d1", "d2", "path", "offset"))), "substring-told", narrow=True)
    none = [F.lit(None).cast("long").alias(c) for c in ("d1", "d2", "path", "offset")]
    checked = spans.where("not same").join(told, key).select(*SPAN, "d1", "d2", "path", "offset")
    every = spans.where("same").select(*SPAN, *none).unionByName(checked)
    lists = saved(every.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n", "source_id", "source_start", "same", "d1", "d2", "path", "offset")).alias("spans")), "substring-lists")
    ids = lists.select("doc_id", "text_key")
    return _of(own, ids, "left_semi").join(lists.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text", "spans"), _of(own, ids, "left_anti").select("doc_id", "text")


def verified(rows: pa.RecordBatch, w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, first word and edges of each span whose words are those at its source, and the spans."""
    column = rows.column("spans")
    counts, (start, n, same, d1, d2) = flat_list(column, ["start", "n", "same", "d1", "d2"])
    row = np.repeat(np.arange(len(rows)), counts)
    ok = same == 1
    k = np.flatnonzero(~ok)
    ok[k] = (word_digests(w, w.first[:-1][row[k]] + start[k], n[k]) == np.stack([d1[k], d2[k]])).all(axis=0)
    return row[ok], start[ok], n[ok], column.flatten().filter(pa.array(ok))


SPANS = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "end", "source_id", "source_start", "path", "offset")])


def told_spans(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
    row, start, n, spans = verified(rows, w)
    field = lambda c: spans.field(spans.type.get_field_index(c))
    yield {"doc_id": rows.column("doc_id").take(pa.array(row)), "start": start, "end": start + n + K - 1} | {c: field(c) for c in ("source_id", "source_start", "path", "offset")}


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (words), source_id, source_start of every verified span, and its path and place there.

    Spans settled within a slice have no path.
    """
    return with_spans(docs)[0].mapInArrow(tx.mapper(told_spans, SPANS), ", ".join(f"{f.name} long" for f in SPANS))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def strip(rows: pa.RecordBatch, w: tx.Words, out_text: bool = False) -> Iterator[dict]:
    """What is left of each text: kept words joined by one space."""
    gone = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    if "spans" in rows.schema.names:
        row, start, n, _ = verified(rows, w)
        base = w.first[:-1][row] + start
        np.add.at(gone, base, 1)
        np.add.at(gone, base + n + K - 1, -1)
    kept = np.cumsum(gone[:-1]) == 0
    own = w.owner()
    # the bytes of kept words, and one space after each but a document's last
    out = w.buf.copy()
    mask = np.zeros(len(w.buf) + 1, dtype=np.int8)
    np.add.at(mask, w.starts[kept], 1)
    np.add.at(mask, w.ends[kept], -1)
    take = np.cumsum(mask[:-1]).astype(bool)
    k = np.flatnonzero(kept)
    k = k[:-1][own[k][1:] == own[k][:-1]]
    out[w.ends[k]] = 32
    take[w.ends[k]] = True
    upto = np.concatenate([[0], np.cumsum(take)])[w.off]
    left = out[take].tobytes()
    n_words = w.counts
    n_kept = np.bincount(own[kept], minlength=len(rows))
    cols = {"doc_id": rows.column("doc_id"), "n_words": n_words, "n_removed": n_words - n_kept}
    texts = [left[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
    yield cols | ({"text": [t.decode() for t in texts]} if out_text else {"kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})


def _stripped(docs: DataFrame, schema: pa.Schema, ddl: str, out_text: bool) -> DataFrame:
    some, others = with_spans(docs)
    put = tx.mapper(lambda r, w: strip(r, w, out_text), schema)
    return some.mapInArrow(put, ddl).unionByName(others.mapInArrow(put, ddl))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, and the text that is left."""
    schema = pa.schema([*list(RESULT)[:3], ("text", pa.string())])
    return _stripped(docs, schema, "doc_id long, n_words long, n_removed long, text string", True)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of the kept words."""
    return _stripped(docs, RESULT, "doc_id long, n_words long, n_removed long, kept_sha256 string", False)
