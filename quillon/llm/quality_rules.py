"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the measurements and a
long of failure bits; a policy is a named, versioned set of rules, applied later as a
mask without reading the texts again.  Ablations are bitwise aggregates of the ledger.

Defined results: a null text has no words and fails ``few_words``; repeated rows are
judged one by one; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "longest_word"]
SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])
#: Prefix of columns that are put beside a caller's own.
OWN = "__quillon_"
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True


def measure(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
    """Measurements of each document of a slice, over its whole text."""
    n = len(rows)
    docs = np.arange(n)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[w.off[1:]] - total[w.off[:-1]]

    # lines: from each line feed or document start to the next
    cut = np.zeros(len(w.buf) + 1, dtype=bool)
    feed = np.flatnonzero(w.buf == 10)
    cut[feed + 1] = True
    cut[w.off] = True
    begin = np.flatnonzero(cut[:-1])
    end = np.concatenate([begin[1:], [len(w.buf)]]).astype(np.int64) if len(begin) else begin
    end = end - (w.buf[np.maximum(end - 1, 0)] == 10) if len(begin) else end
    full = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin) if len(begin) else np.zeros(0, dtype=bool)
    begin, end = begin[full], end[full]
    line_doc = np.searchsorted(w.off, begin, side="right") - 1
    key = tx.mix64(tx.spans_hash(w.buf, begin, end, tx.BYTE_VALUE) ^ tx.stream(11, n)[line_doc]) if len(begin) else np.empty(0, dtype=np.uint64)
    n_lines = np.bincount(line_doc, minlength=n)
    _, once = np.unique(key, return_index=True)
    n_dup_lines = n_lines - np.bincount(line_doc[once], minlength=n)

    # words covered by a 3-word window that the text holds at least twice
    at, h = w.windows(3)
    own = w.owner()
    covered = np.zeros(len(w.hashes) + 3, dtype=bool)
    if len(at):
        h = tx.mix64(h ^ tx.stream(13, n)[own[at]])
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    n_repeat = np.bincount(own[covered[: len(own)]], minlength=n)

    lead = (w.buf & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, own, chars[w.ends] - chars[w.starts])
    yield {
        "doc_id": rows.column("doc_id"),
        "n_words": w.counts[docs],
        "word_chars": per_doc(lead & ~tx.SPACE[w.buf]),
        "n_symbols": per_doc(SYMBOL[w.buf]),
        "n_lines": n_lines,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "longest_word": longest,
    }


def rules(prefix: str = "") -> dict[str, Column]:
    """Rule name to failure condition over the measurements; a rule's place is its bit."""
    c = lambda name: F.col(prefix + name)
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        "duplicate_lines": (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 60 * c("n_lines")),
        "short_words": 10 * c("word_chars") < 20 * c("n_words"),
        "long_words": c("word_chars") > 18 * c("n_words"),
    }


#: Policies by name and version.  "base" holds the two rules every policy has.
POLICIES = {
    "base.v1": ["few_words", "repeated_words"],
    "web.v1": ["few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"],
    "lenient.v1": ["few_words", "repeated_words", "symbols"],
}


def mask(policy: str) -> int:
    names = list(rules())
    return sum(1 << names.index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``fail_bits`` with one bit for each rule."""
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tx.mapper(measure, SCHEMA), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(cond, F.lit(1 << k)).otherwise(F.lit(0)) for k, cond in enumerate(rules().values())), F.lit(0))
    return out.withColumn("fail_bits", bits.cast("long"))


def verdict(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it rejects, those only it rejects, and those kept without it."""
    names, all_bits = list(rules()), mask(policy)
    hit = F.col("fail_bits").bitwiseAND(F.lit(all_bits))
    aggs = [F.count("*").alias("n"), F.count_if(hit == 0).alias("kept")]
    for r in POLICIES[policy]:
        bit = 1 << names.index(r)
        aggs += [F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias(f"{r}_r"), F.count_if(hit == bit).alias(f"{r}_o")]
    row = book.agg(*aggs)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_r").alias("n_rejected"), F.col(f"{r}_o").alias("n_only"), (F.col("kept") + F.col(f"{r}_o")).alias("n_kept_without"), F.col("n").alias("n_documents")) for r in POLICIES[policy]])
    return row.select(F.inline(each))


def accepted(docs: DataFrame, policy: str = "web.v1") -> DataFrame:
    """The rows of docs that the policy doesn't reject, with all their columns.

    The measurements are taken beside the rows' own columns, so no join is needed.
    """
    names = [f.name for f in docs.schema]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi in tx.slices(batch.column(at)):
                rows = batch.slice(lo, hi - lo)
                w = tx.split(rows.column(at))
                ids = pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64())], ["doc_id"])
                m = next(measure(ids, w))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(m[k], pa.int64()) for k in MEASURES)], [*names, *(f"{OWN}{k}" for k in MEASURES)])

    measured = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(tx.tidy(judge), T.StructType([*docs.schema.fields, *(T.StructField(f"{OWN}{m}", T.LongType()) for m in MEASURES)]))
    failed = {name: cond for name, cond in rules(OWN).items() if name in POLICIES[policy]}
    keep = F.lit(True)
    for cond in failed.values():
        keep = keep & ~cond
    return measured.where(keep).select(*names)


def digest(docs: DataFrame, policy: str = "web.v1") -> DataFrame:
    """The ledger with the base verdict and the policy's."""
    base = ~verdict("base.v1")
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict(policy)).alias("kept"), "fail_bits")
