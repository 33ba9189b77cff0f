"""Derived tables: passages, cited provisions and raw citations of documents.

The text rules run in Arrow batches, one pass over the documents without a shuffle; a
document that fails gives a row with an error instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C
from ..functions import text as X

_TYPES = {"string": pa.string(), "int": pa.int32(), "date": pa.date32(), "double": pa.float64()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])


def per_document(docs: DataFrame, rows_of: Callable[[dict], list[dict]], ddl: str, batch: int = 2000) -> DataFrame:
    """rows_of(document) for every document, and an error column."""
    out = _arrow(f"{ddl}, error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for some in batches:
            for document in some.to_pylist():
                try:
                    held += rows_of(document)
                except Exception as wrong:  # noqa: BLE001 - reported as data
                    held.append({out.names[0]: document.get("doc_id"), "error": f"{type(wrong).__name__}: {wrong}"})
                if len(held) >= batch:
                    yield pa.RecordBatch.from_pylist(held, schema=out)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=out)

    return docs.mapInArrow(run, f"{ddl}, error string")


def _layers(d: dict) -> dict[str, str | None]:
    return {"summary": d["summary"], "body": d["body_text"], "lower_body": d["lower_body_text"]}


def build_passages(docs: DataFrame) -> DataFrame:
    """Passages of every document's layers."""
    own = docs.select("doc_id", "summary", "body_text", "lower_body_text", "page_offsets")
    return per_document(own, lambda d: [{"doc_id": d["doc_id"]} | p for p in X.layer_passages(_layers(d), d["page_offsets"])], schema.PASSAGES)


def build_citations(docs: DataFrame) -> DataFrame:
    """Raw citations of every layer, not yet resolved."""
    own = docs.select("doc_id", "summary", "body_text", "lower_body_text", "document_date")
    return per_document(own, lambda d: [{"from_doc_id": d["doc_id"], "layer": layer} | c for layer, text in _layers(d).items() for c in X.citations(text, d["document_date"])], schema.CITATIONS)


def build_provisions(docs: DataFrame) -> DataFrame:
    """(doc_id, law, gr, mgr, sfx) of every provision the body cites."""
    return per_document(docs.select("doc_id", "body_text"), lambda d: [{"doc_id": d["doc_id"]} | p for p in X.provisions(d["body_text"])], "doc_id string, law string, gr int, mgr int, sfx string")


def with_provisions(docs: DataFrame) -> DataFrame:
    """documents with cited_provisions rebuilt; none is an empty array."""
    found = build_provisions(docs).where("error is null").groupBy("doc_id").agg(F.collect_list(F.struct("law", "gr", "mgr", "sfx")).alias("_found"))
    empty = F.array().cast(f"array<{schema.PROVISION}>")
    return docs.drop("cited_provisions").join(found, "doc_id", "left").withColumn("cited_provisions", F.coalesce("_found", empty)).drop("_found")


def stale(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Documents whose texts differ from the hash that their derived rows were built from."""
    now = C.text_hash(F.col("summary"), F.col("body_text"), F.col("lower_body_text"))
    kept = hashes.select(F.col("doc_id"), F.col("hash").alias("_hash"))
    return docs.join(kept, "doc_id", "left").where(~F.col("_hash").eqNullSafe(now)).drop("_hash")


def hashes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", C.text_hash(F.col("summary"), F.col("body_text"), F.col("lower_body_text")).alias("hash"))


def doc_lemmas(docs: DataFrame, text: str = "text", key: str = "doc_id", lemmas: DataFrame | None = None, letters_only: bool = True) -> DataFrame:
    """The inverted index (key, lemma, tf, positions) of a text column.

    Letters-only tokens for Icelandic, word characters otherwise.  lemmas (form, lemma)
    maps forms to dictionary lemmas; others stand for themselves in lower case.
    """
    pattern = r"\p{L}+" if letters_only else r"[\p{L}\p{N}_]+"
    tokens = docs.select(key, F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("pos", "lemma"))
    if lemmas is not None:
        known = lemmas.select(F.lower("form").alias("lemma"), F.col("lemma").alias("_lemma")).dropDuplicates(["lemma"])
        tokens = tokens.join(known, "lemma", "left").select(key, "pos", F.coalesce("_lemma", "lemma").alias("lemma"))
    return tokens.groupBy(key, "lemma").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def selection(docs: DataFrame, hashes: DataFrame, sources: list[str], force: bool = False, source: str | None = None, doc: str | None = None, since: str | None = None, most: int | None = None) -> DataFrame:
    """The documents a batch job works on (F16): stale ones of its sources, from a date on, at most so many by id.

    A document that is named is taken whether stale or not, but of the job's sources only.
    """
    rows = docs.where(F.col("source_short").isin(sources))
    if doc is not None:
        return rows.where(F.col("doc_id") == doc)
    if source is not None:
        rows = rows.where(F.col("source_short") == source)
    if since is not None:
        rows = rows.where(F.col("document_date") >= F.lit(since).cast("date"))
    rows = rows if force else stale(rows, hashes)
    return rows if most is None else rows.orderBy("doc_id").limit(most)


def document_lemmas(docs: DataFrame, passage_lemmas: DataFrame) -> DataFrame:
    """doc_id and the text that a document is found by: number, court and verdict, then its passages' lemmas in order.

    passage_lemmas: doc_id, ordinal, lemmas (a text).
    """
    own = passage_lemmas.where("coalesce(lemmas, '') <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "lemmas"))).alias("_p"))
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("case_number", "court", "verdict_type")]
    joined = F.array_join(F.transform("_p", lambda p: p["lemmas"]), " ")
    return docs.join(own, "doc_id", "left").select("doc_id", F.trim(F.concat_ws(" ", *parts, joined)).alias("lemma_text"))


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """The index partitioned by a hash of the lemma and sorted, so that a query reads few row groups."""
    part = F.pmod(F.xxhash64("lemma"), F.lit(buckets)).cast("int")
    index.withColumn("part", part).repartition(buckets, "part").sortWithinPartitions("part", "lemma").write.partitionBy("part").mode("overwrite").parquet(path)


def read_index(spark, path: str, lemmas: list[str], buckets: int = 64) -> DataFrame:
    """Rows of the index for some lemmas; partitions and row groups of others are not read."""
    wanted = spark.createDataFrame([(w,) for w in lemmas], "lemma string").select(F.pmod(F.xxhash64("lemma"), F.lit(buckets)).cast("int"))
    parts = [r[0] for r in wanted.collect()]
    return spark.read.parquet(path).where(F.col("part").isin(parts) & F.col("lemma").isin(lemmas)).drop("part")
