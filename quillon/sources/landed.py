"""Readers of landed files.  Fetching them is left to others; a scan here reads what has landed.

Connectors that list JSON pages, XML feeds, HTML pages or archives all come down to one
of these readers, a projection per source, and the merges of ``operators.merge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import statutes


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON pages with a declared schema; rows that don't parse are kept in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline).json(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Records of an XML feed such as OAI-PMH."""
    return spark.read.format("xml").schema(schema).option("rowTag", row).load(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry sheet that landed as CSV."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_pages(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """path and html of landed pages, one row for each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", charset).alias("html"))


def read_statutes(spark: SparkSession, path: str) -> DataFrame:
    """Statutes in landed archives: file, md5, law, title, provisions."""
    provisions = pa.list_(pa.struct([("num", pa.int32()), ("suffix", pa.string()), ("text", pa.string()), ("sub", pa.list_(pa.struct([("num", pa.int32()), ("text", pa.string())])))]))
    out = pa.schema([("file", pa.string()), ("md5", pa.string()), ("law", pa.string()), ("title", pa.string()), ("provisions", provisions)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for content in batch.column(0):
                rows = [{"file": n, "md5": hashlib.md5(b).hexdigest()} | statutes.parse(b, n) for n, b in statutes.unzip(content.as_py())]
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    ddl = "file string, md5 string, law string, title string, provisions array<struct<num:int,suffix:string,text:string,sub:array<struct<num:int,text:string>>>>"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """YAML issue manifests as one row for each article, with the issue's fields."""
    out = pa.schema([("file", pa.string()), ("source", pa.string()), ("year", pa.int32()), ("volume", pa.int32()), ("issue", pa.string()), ("status", pa.string()), ("title", pa.string()), ("authors", pa.list_(pa.string())), ("page_start", pa.int32()), ("page_end", pa.int32()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = yaml.safe_load(content.as_py()) or {}
                head = {"file": file, "source": m.get("source"), "year": m.get("year"), "volume": m.get("volume"), "issue": None if m.get("issue") is None else str(m["issue"]), "status": m.get("status")}
                rows = [head | {k: a.get(k) for k in ("title", "authors", "page_start", "page_end", "confidence")} for a in m.get("articles") or []]
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    ddl = "file string, source string, year int, volume int, issue string, status string, title string, authors array<string>, page_start int, page_end int, confidence double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)


#: Columns a source may name differently, best first; each silver column is the first that is there.
ALTERNATIVES = {
    "case_number": ["case_number", "caseNumber", "number"],
    "title": ["title", "caseTitle"],
    "summary": ["presentings", "abstract", "summary"],
    "document_date": ["document_date", "verdictDate", "date"],
    "body_text": ["body_text", "text", "body"],
}


def silver(raw: DataFrame, source: str, alternatives: dict[str, list[str]] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """Silver columns of one source: the first alternative that holds something, else the source's default."""
    cols = [F.lit(source).alias("source_short")]
    for name, keys in (alternatives or ALTERNATIVES).items():
        there = [F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys if k in raw.columns]
        default = (defaults or {}).get(name)
        cols.append(F.coalesce(*there, F.lit(default).cast("string")).alias(name))
    return raw.select(*cols)


def crawl_gaps(landed: DataFrame, key: str = "id", stop_after: int = 20) -> DataFrame:
    """(first, last) of the ids that a sequential crawl hasn't got, and whether it would have stopped there.

    Only the ends of gaps, found by joins, are sorted in one window.
    """
    ids = landed.select(F.col(key).cast("long").alias("id")).distinct()
    # the ids that have no successor begin a gap, those without a predecessor end one
    after = ids.join(ids.select((F.col("id") - 1).alias("id")), "id", "left_anti").select((F.col("id") + 1).alias("first"))
    before = ids.join(ids.select((F.col("id") + 1).alias("id")), "id", "left_anti").select((F.col("id") - 1).alias("last"))
    edges = after.select(F.col("first").alias("at"), F.lit(0).alias("side")).union(before.select(F.col("last").alias("at"), F.lit(1).alias("side")))
    w = Window.orderBy("at", "side")
    rows = edges.withColumn("last", F.lead("at").over(w)).where("side = 0 and last is not null")
    return rows.select(F.col("at").alias("first"), "last", (F.col("last") - F.col("at") + 1 >= stop_after).alias("stops"))


def pdf_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """path and link of every PDF that a listing names."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"(?i)href\s*=\s*[\x22']([^\x22']+\.pdf(?:\?[^\x22']*)?)[\x22']"), F.lit(1))
    return pages.select("path", F.explode(F.array_distinct(links)).alias("link"))


def decoded(raw: DataFrame, column: str = "pdf", to: str = "content") -> DataFrame:
    """Base64 payloads as bytes; what is no base64 is null."""
    return raw.withColumn(to, F.try_to_binary(F.col(column), F.lit("base64")))


def tiered(raw: DataFrame, tiers: dict[str, list[str]]) -> DataFrame:
    """Each column from the first of its tiers that holds something, and which one that was."""
    out = raw
    for name, columns in tiers.items():
        held = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.struct(F.col(c).alias("value"), F.lit(c).alias("tier"))) for c in columns]
        out = out.withColumn("_tier", F.coalesce(*held)).withColumn(name, F.col("_tier.value")).withColumn(f"{name}_from", F.col("_tier.tier")).drop("_tier")
    return out
