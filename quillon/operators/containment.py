"""Files whose pages lie in other files, counted in cells of bounded size.

The counts are a product of two sparse tables, pages by trigrams and trigrams by files.
Its pairs never become Spark rows: a cell is one block of files against one slice of
pages, and a task holds the block as lists of files by trigram, counts its pages one
slice of pairs after another and returns only what reaches both shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trigrams of the files that a cell holds.
BLOCK = 2_000_000
#: Pairs of a page's trigram and a file that are counted at once.
PAIRS = 1_000_000
#: Rows of a batch of results.
ROWS = 1 << 17
#: Cells for each core at most, so that none waits long for the last; fewer while reading a block costs more than its pairs.
CELLS_A_CORE = 4
#: A cell of fewer trigrams isn't worth a task.
LEAST = 20_000


def trigrams(text: Column) -> Column:
    """Hashes of the distinct word trigrams of a text, whose words are read once."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= 3, F.array_distinct(hashed(w))).otherwise(F.array().cast("array<bigint>")))[0]


def _saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that executors share and read again; where none is set, kept by Spark."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return df.persist()
    path = f"{shared.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _least(share: float, of: str) -> Column:
    """The least whole number that is share * of or more, in decimals as in SQL; 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.lit(Decimal(str(share))) * F.col(of).cast("decimal(19,0)")).cast("bigint"))


def _judged(pages: DataFrame, share: float, file_share: float) -> DataFrame:
    """A row for each page: file, need, file_need, own (the file's distinct trigrams), and those of its trigrams that other files hold too; need is null for pages without a key."""
    rows = pages.where("file is not null").select("file", "page", trigrams(F.col("text")).alias("grams"))
    whole = F.array_distinct(F.flatten(F.collect_list("grams")))
    held = _saved(rows.repartition("file").groupBy("file", "page").agg(whole.alias("grams")).where("size(grams) > 0"), "trigrams")
    flat = held.select("file", "page", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    repeated = flat.groupBy("gram").agg((F.min("file") != F.max("file")).alias("shared"), F.count("*").alias("rows")).where("rows > 1").select("gram", "shared")
    lists = [F.collect_list(F.when(F.col("shared") == yes, F.col("gram"))).alias(name) for yes, name in ((True, "grams"), (False, "apart"))]
    paged = _saved(flat.join(repeated, "gram").repartition("file").groupBy("file", "page", "n").agg(*lists), "repeated-trigrams")
    # only repeated trigrams can be in two pages of a file
    again = paged.select("file", F.explode(F.concat("grams", "apart")).alias("gram")).groupBy("file").agg((F.count("*") - F.count_distinct("gram")).alias("again"))
    files = held.groupBy("file").agg(F.count("*").alias("pages"), F.sum(F.size("grams")).alias("all")).join(again, "file", "left")
    own = F.col("all") - F.coalesce("again", F.lit(0))
    need = F.when(F.col("page").isNotNull(), _least(share, "n"))
    return _saved(paged.where("size(grams) > 0").join(files, "file").select("file", need.alias("need"), _least(file_share, "pages").alias("file_need"), own.alias("own"), "grams"), "shared-trigrams")


def _dealt(rows: DataFrame, most: int) -> DataFrame | None:
    """The rows of every cell in one partition, its files before its pages, both by size.

    Blocks are ranges of sizes with as many trigrams each, about most of them; equal sizes are divided by hash.
    A page meets only blocks that reach its file's size.
    """
    spark = rows.sparkSession
    # fewer rows than the square root of twice the trigrams: a file of size n holds n of them
    sizes = sorted((r["own"], r["w"]) for r in rows.groupBy("own").agg(F.sum(F.size("grams")).alias("w")).collect())
    if not sizes:
        return None
    own, w = (np.array(x, dtype=np.float64) for x in zip(*sizes))
    total = w.sum()
    blocks = int(-(-total // most))
    ends = np.stack([np.cumsum(w) - w, np.cumsum(w)], axis=1).ravel()
    edges = np.interp(total * np.arange(1, blocks) / blocks, ends, np.stack([own, own + 1], axis=1).ravel()).tolist()
    cells = min(spark.sparkContext.defaultParallelism * min(CELLS_A_CORE, blocks), max(1, int(total // LEAST)))
    slices = [-(-2 * cells * (k + 1) // (blocks * (blocks + 1))) for k in range(blocks)]
    first = np.cumsum([0, *slices[:-1]]).tolist()

    def block(at: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= at)) if edges else F.lit(0)

    def of(values: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("block"))

    h = F.xxhash64("file")
    files = rows.withColumn("block", block(F.col("own") + F.pmod(h, F.lit(1 << 20)) / (1 << 20))).withColumn("slice", F.explode(F.sequence(F.lit(0), of(slices) - 1)))
    asked = rows.where("size(grams) >= need").withColumn("block", F.explode(F.sequence(block(F.col("own").cast("double")), F.lit(blocks - 1))))
    asked = asked.withColumn("slice", F.pmod(F.shiftrightunsigned(h, 24), of(slices)).cast("int"))
    both = [x.select((of(first) + F.col("slice")).cast("int").alias("cell"), F.lit(side).alias("side"), *rows.columns) for side, x in enumerate((files, asked))]
    return both[0].unionByName(both[1]).repartitionById(sum(slices), F.col("cell")).sortWithinPartitions("side", "own", "file").drop("cell")


def _starts(column: pa.Array) -> np.ndarray:
    """Where a new value begins."""
    new = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], new]))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] times, for every k."""
    end = np.cumsum(n)
    place = np.repeat((first - end + n).astype(np.int32), n)
    place += np.arange(len(place), dtype=np.int32)
    return place


class _Block:
    """Files of a cell as lists by trigram; files are numbered by size."""

    def __init__(self, rows: list[pa.RecordBatch], pairs: int):
        self.pairs = pairs
        table = pa.Table.from_batches(rows).combine_chunks()
        rows.clear()
        name = table.column("file").chunk(0)
        at = _starts(name)
        self.names, self.sizes = name.take(pa.array(at)), table.column("own").to_numpy()[at]
        self.k = len(at)
        grams, n = _lists(table.column("grams").chunk(0))
        owner = np.repeat(np.repeat(np.arange(self.k, dtype=np.int32), np.diff(at, append=len(name))), n)
        order = np.argsort(grams)
        grams, owner = grams[order], owner[order]
        del order, table
        new = _runs(grams)
        place = np.repeat(np.arange(len(new), dtype=np.int64) * self.k, np.diff(new, append=len(grams)))
        place += owner
        place.sort()
        place = place[_runs(place)]  # pages of one file may hold the same trigram
        self.grams, self.place, self.owner = grams[new], place, (place % self.k).astype(np.int32)
        self.end = np.searchsorted(place, np.arange(1, len(new) + 1) * self.k)
        self.open: tuple | None = None

    def ask(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Results of the pages' files but the last, of which more pages may follow."""
        name = batch.column("file")
        at = _starts(name)
        self.asked = name.take(pa.array(at))
        self.file_need = batch.column("file_need").to_numpy()[at]
        self.self = pc.fill_null(pc.index_in(self.asked, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        file = np.repeat(np.arange(len(at)), np.diff(at, append=len(name)))
        keys, counts = [], []
        if self.open and self.open[0].equals(self.asked.slice(0, 1)):
            keys, counts = [self.open[1]], [self.open[2]]
        else:
            yield from self.rest()
        held = sum(map(len, keys))
        for page, who in self.hits(batch, np.searchsorted(self.sizes, batch.column("own").to_numpy())):
            keys.append(file[page] * self.k + who)
            counts.append(np.ones(len(who), dtype=np.int64))
            held += len(who)
            if held > self.pairs:
                key, n = self.summed(keys, counts)
                done = np.searchsorted(key, file[page[-1]] * self.k) if len(page) else 0
                yield from self.told(key[:done], n[:done])
                keys, counts, held = [key[done:]], [n[done:]], 0
        key, n = self.summed(keys, counts)
        last = (len(at) - 1) * self.k
        done = np.searchsorted(key, last)
        yield from self.told(key[:done], n[:done])
        self.open = (self.asked.slice(len(at) - 1), key[done:] - last, n[done:], self.file_need[-1:], self.self[-1:])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """Results of the file that is still open."""
        if self.open:
            kept = self.asked, self.file_need, self.self
            self.asked, key, n, self.file_need, self.self = self.open
            yield from self.told(key, n)
            self.asked, self.file_need, self.self = kept
            self.open = None

    def summed(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (keys, counts))
        order = np.argsort(key)
        key, n = key[order], n[order]
        at = _runs(key)
        return key[at], np.add.reduceat(n, at) if len(at) else n

    def told(self, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        file, who = np.divmod(key, self.k)
        good = (n >= self.file_need[file]) & (who != self.self[file])
        file, who, n = file[good], who[good], n[good]
        for k in range(0, len(n), ROWS):
            part = slice(k, k + ROWS)
            columns = [self.asked.take(pa.array(file[part])), self.names.take(pa.array(who[part])), pa.array(n[part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "inside", "n"])

    def hits(self, batch: pa.RecordBatch, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pages, and files from number least on that hold enough of each, in the order of pages."""
        grams, n = _lists(batch.column("grams"))
        need = batch.column("need").to_numpy(zero_copy_only=False).astype(np.int64)
        page = np.repeat(np.arange(len(n)), n)
        order = np.argsort(grams)
        at = np.empty(len(grams), dtype=np.int64)
        at[order] = np.searchsorted(self.grams, grams[order])
        known = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == grams)
        page, at = page[known], at[known]
        first, end = np.searchsorted(self.place, at * self.k + least[page]), self.end[at]
        lists = np.flatnonzero(first < end)
        page, first, n = page[lists], first[lists], (end - first)[lists]
        starts = np.append(_runs(page), len(page))
        until = np.append(0, np.cumsum(n))[starts]
        k = 0
        while k < len(starts) - 1:
            stop = int(np.searchsorted(until, until[k] + self.pairs, side="right")) - 1
            if stop <= k:  # more pairs than that in one page
                count = np.zeros(self.k, dtype=np.int64)
                for a, b in zip(first[starts[k] : starts[k + 1]], n[starts[k] : starts[k + 1]]):
                    count[self.owner[a : a + b]] += 1
                who = np.flatnonzero(count >= need[page[starts[k]]])
                yield np.full(len(who), page[starts[k]]), who
                k += 1
                continue
            part = slice(starts[k], starts[stop])
            base = page[part.start]
            kind = np.uint32 if (page[part.stop - 1] - base + 1) * self.k < 1 << 32 else np.int64
            key = np.repeat(((page[part] - base) * self.k).astype(kind), n[part])
            key += self.owner[_spread(first[part], n[part])].astype(kind)
            key.sort()
            new = _runs(key)
            whose, who = np.divmod(key[new].astype(np.int64), self.k)
            enough = np.diff(new, append=len(key)) >= need[whose + base]
            yield whose[enough] + base, who[enough]
            k = stop


def _compared(batches: Iterator[pa.RecordBatch], pairs: int) -> Iterator[pa.RecordBatch]:
    files, block = [], None
    for batch in batches:
        side = batch.column("side").to_numpy()
        at = int(np.searchsorted(side, 1))
        if at:
            files.append(batch.slice(0, at))
        if at == len(side) or not (files or block):
            continue
        block = block or _Block(files, pairs)
        n = np.append(0, np.cumsum(pc.list_value_length(batch.column("grams")).to_numpy(zero_copy_only=False)))
        while at < len(side):
            stop = max(at + 1, int(np.searchsorted(n, n[at] + pairs // 2, side="right")) - 1)
            yield from block.ask(batch.slice(at, stop - at))
            at = stop
    if block:
        yield from block.rest()


def contained(pages: DataFrame, share: float, file_share: float, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """(file, inside, n): see quality.containment.  block and pairs bound a task's memory, not the result."""
    spark: SparkSession = pages.sparkSession
    kind = pages.schema["file"].dataType.simpleString()
    schema = f"file {kind}, inside {kind}, n bigint"
    cells = _dealt(_judged(pages, share, file_share), block)
    return spark.createDataFrame([], schema) if cells is None else cells.mapInArrow(partial(_compared, pairs=pairs), schema)
