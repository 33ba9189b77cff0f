"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (hash order), laid end to end, and cut into blocks of
equally many words, one more or less: blocks of about BLOCK_WORDS, but LEAST_BLOCKS of them
at least, or one for each word.  A source's target is a number of its blocks, its slots.
Slot n of the mix holds the point frac((n + 1) / golden ratio); the source whose interval
of cumulative shares of slots contains it owns the slot.  Slots are ranked per source, and
the k-th slot of a source takes its block k modulo its blocks, so a source is read again
only after all of it was read.  Golden-ratio points come near each share within a few
slots; ranks beyond a source's slots fall away, and missing ones follow at the end, so each
source gets its slots exactly.

Points are looked up in cells that hold the few sources near them.  Slots are ranked in
chunks with prefix sums over chunks, and documents are placed in ranges of their hash with
prefix sums over ranges; no task holds a whole source, and the number of ranges doesn't
change the order.

Defined results: a null text has size 0; rows of size 0 are kept with ``taken`` 0;
sources follow code point order with null last; repeated rows count as documents of
their own; an empty table gives an empty mix; extra columns are carried by ``realised``
and ignored by ``mix``.  Reruns agree because every order is a hash of the values.

Bounds: a source's taken words differ from its target by half a block and what its blocks
differ by: by less than 1 part in LEAST_BLOCKS, and for sources of fewer words than that by
one word at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import saved

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and blocks of a source that has so many words, at least.
BLOCK_WORDS, LEAST_BLOCKS = 1024, 256
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
CHUNK = 4096


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size) with rank and target.

    Weights repeat over the sources in code point order.  All sizes together are shared
    by weight; a target stops at ``most`` times its source's size and the excess is
    shared again by weight among the others: target = min(cap, weight * level), where
    the level follows from sorting the sources by cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the level is right at the first source, in this order, that stays below its cap
    t = t.withColumn("level", F.max(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.col("level"))).over(everything))
    return t.withColumn("target", F.least("cap", F.col("w") * F.coalesce("level", F.lit(0.0)))).drop("w", "cap", "level")


def with_blocks(plan: DataFrame, block_words: int = BLOCK_WORDS, least: int = LEAST_BLOCKS) -> DataFrame:
    """The plan with blocks, words (of a block; ``longer`` of them have one more), and slots."""
    size = F.col("source_size")
    p = plan.withColumn("blocks", F.greatest(F.ceil(size / F.lit(float(block_words))).cast("long"), F.least(size, F.lit(least).cast("long"))))
    some = F.nullif(F.col("blocks"), F.lit(0).cast("long"))
    p = p.withColumn("words", F.floor(size / some).cast("long")).withColumn("longer", size % some)
    return p.withColumn("slots", F.coalesce(F.floor(F.col("target") / F.nullif(size, F.lit(0).cast("long")) * F.col("blocks") + 0.5).cast("long"), F.lit(0).cast("long")))


def placed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (doc_id, source, size, key) with the plan's columns, row and begin.

    begin is the number of words before the document in its source's shuffled order; bucket
    and row name the row within its source.
    """
    spark = docs.sparkSession
    bits = min(20, max(8, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    mixed = docs.withColumn("_h", F.xxhash64("doc_id", "size", "key")).withColumn("bucket", F.shiftright("_h", 64 - bits))
    sums = mixed.groupBy("source", "bucket").agg(F.sum("size").alias("_s"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_s").over(upto), F.lit(0))).drop("_s")
    starts = starts.join(plan.withColumnRenamed("source", "_p"), F.col("source").eqNullSafe(F.col("_p"))).drop("_p").withColumnsRenamed({"source": "_src", "bucket": "_bk"})
    # rows that agree in hash, id and size may change places, which changes nothing
    order = Window.partitionBy("source", "bucket").orderBy("_h", "doc_id", "size")
    own = mixed.withColumn("_in", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("row", F.row_number().over(order))
    own = own.join(starts.hint("merge"), F.col("source").eqNullSafe(F.col("_src")) & (F.col("bucket") == F.col("_bk")))
    return own.withColumn("begin", F.col("_start") + F.col("_in")).drop("_h", "_src", "_bk", "_start", "_in")


def schedule(plan: DataFrame) -> DataFrame:
    """rank (of the source), slot, and nth: which slot of its source it is, from 0, for a plan with rank and slots."""
    spark = plan.sparkSession
    n, sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    cells = 1 << max(1, (2 * sources).bit_length())
    upto = Window.orderBy("rank")
    ends = plan.where("slots > 0").withColumn("hi", F.sum("slots").over(upto.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(max(1, n)))).withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
    # the last interval reaches 1 whatever the rounding
    ends = ends.withColumn("hi", F.when(F.lead("hi").over(upto).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    cell = lambda x: F.least(F.floor(x * F.lit(float(cells))).cast("long"), F.lit(cells - 1).cast("long"))
    near = ends.select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    # what follows from the small plan looks small to the planner: say which side is
    near = F.broadcast(near) if sources <= BROADCAST_SOURCES else near.hint("merge")
    points = spark.range(0, n, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).select(F.col("id").alias("slot"), F.floor(F.col("id") / F.lit(CHUNK)).cast("long").alias("chunk"))
    # frac((slot + 1) * golden) by parts, so that large slots keep their precision
    x = F.pmod(F.col("chunk") * F.lit((CHUNK * GOLDEN) % 1.0) + (F.col("slot") - F.col("chunk") * CHUNK + 1) * F.lit(GOLDEN), F.lit(1.0))
    points = points.withColumn("x", x).withColumn("cell", cell(F.col("x")))
    slots = points.join(near, "cell").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "chunk", "rank")
    inside = Window.partitionBy("chunk", "rank").orderBy("slot")
    numbered = slots.withColumn("_k", F.row_number().over(inside) - 1)
    sums = slots.groupBy("rank", "chunk").count()
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    # slots look as small as their chunks to the planner, which must not broadcast them
    ranked = numbered.join(starts.hint("merge"), ["rank", "chunk"]).select("rank", "slot", (F.col("_start") + F.col("_k")).alias("nth"))
    quota = plan.select("rank", "slots")
    quota = F.broadcast(quota) if sources <= BROADCAST_SOURCES else quota.hint("merge")
    within = ranked.join(quota, "rank").where("nth < slots").select("rank", "slot", "nth")
    got = sums.groupBy("rank").agg(F.sum("count").alias("got"))
    short = plan.select("rank", "slots").join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < slots")
    short = short.withColumn("_at", F.coalesce(F.sum(F.col("slots") - F.col("got")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    late = short.select("rank", "_at", "got", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("nth"))
    return within.unionByName(late.select("rank", (F.lit(n) + F.col("_at") + F.col("nth") - F.col("got")).alias("slot"), "nth"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, key (a hash of the text), size, source_size, target, taken, copies.

    ``taken`` counts the words the schedule takes of the document; ``copies`` is how often
    the document is read whole to come nearest to that.
    """
    text = F.col("text").cast("string")
    sized = saved(docs.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64(text).alias("key")), "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    plan = saved(with_blocks(plan, block_words), "mix-plan")
    blocks = plan.select("rank", "blocks")
    blocks = F.broadcast(blocks) if plan.count() <= BROADCAST_SOURCES else blocks.hint("merge")
    # join the slots to blocks: how often each block is taken
    picked = schedule(plan.select("rank", "slots")).join(blocks, "rank")
    taken = picked.groupBy("rank", F.pmod("nth", "blocks").alias("block")).agg(F.count("*").alias("times"))
    at = placed(sized, plan)
    full = at.where("size > 0")
    n, size = F.col("blocks"), F.col("source_size")
    # blocks begin at the whole words next to equal steps, so that any run of blocks has its share of words
    start_of = lambda b: F.when(b >= n, size).otherwise(b * F.col("words") + F.floor(b * (F.col("longer") / n)))
    near = lambda w: F.least(F.floor(w / size * n).cast("long"), n - 1)
    block_at = lambda w: F.when(start_of(near(w)) > w, near(w) - 1).when(start_of(near(w) + 1) <= w, near(w) + 1).otherwise(near(w))
    stop = F.col("begin") + F.col("size")
    parts = full.withColumn("block", F.explode(F.sequence(block_at(F.col("begin")), block_at(stop - 1))))
    overlap = F.least(start_of(F.col("block") + 1), stop) - F.greatest(start_of(F.col("block")), F.col("begin"))
    got = parts.withColumn("_o", overlap).join(taken.hint("merge"), ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    keys = ["doc_id", "source", "key", "size", "source_size", "target"]
    out = got.groupBy(*keys, "rank", "bucket", "row").agg(F.sum(F.col("_o") * F.col("times")).cast("long").alias("taken")).select(*keys, "taken")
    out = out.unionByName(at.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))
    return out.withColumn("copies", F.coalesce(F.floor(F.col("taken") / F.nullif(F.col("size"), F.lit(0).cast("long")) + 0.5).cast("long"), F.lit(0).cast("long")))


def realised(docs: DataFrame, **settings) -> DataFrame:
    """docs as the mix reads them: each row as many times as comes nearest to its taken words.

    A document that the mix takes less than half of, or that has no words, is not returned.
    Rows that share doc_id and text are told together: each comes equally often, and what is
    left over comes from one of them.
    """
    own = lambda name: f"__quillon_{name}"
    m = mix(docs, **settings).groupBy(F.col("doc_id").alias(own("id")), F.col("key").alias(own("key"))).agg(F.sum("copies").alias("c"), F.count("*").alias("m")).where("c > 0")
    m = m.select(own("id"), own("key"), F.floor(F.col("c") / F.col("m")).cast("int").alias(own("each")), (F.col("c") % F.col("m")).cast("int").alias(own("over")))
    same = F.col("doc_id").eqNullSafe(F.col(own("id"))) & F.col(own("hash")).eqNullSafe(F.col(own("key")))
    rows = docs.withColumn(own("hash"), F.xxhash64(F.col("text").cast("string"))).join(m, same)
    again = lambda rows, times: rows.withColumn(own("i"), F.explode(F.sequence(F.lit(1), F.col(own(times))))).select(*docs.columns)
    once = rows.where(F.col(own("over")) > 0).dropDuplicates(["doc_id", own("hash")])
    return again(rows.where(F.col(own("each")) > 0), "each").unionByName(again(once, "over"))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: the words the mix takes of it, and its source's target."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
