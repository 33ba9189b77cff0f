"""One document with its links and citations, compact rows for tools, and the audit of citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import graph, quality, search

PAGE = 50


@dataclass
class Detail:
    """Everything the document view shows; each part is a frame that no one has computed yet."""

    row: DataFrame
    links: DataFrame
    outgoing: DataFrame
    incoming: DataFrame
    unresolved: DataFrame


def document(docs: DataFrame, links: DataFrame, citations: DataFrame, passages: DataFrame, doc_id: str, page: int = 1) -> Detail:
    """A document, its links but for citations, a page of citations each way and the count of unresolved ones (Q4, Q5).

    Citations point at the passage they stand in; outgoing ones come oldest first, incoming
    ones newest first.
    """
    own = docs.where(F.col("doc_id") == doc_id)
    cite = C.ruling_citation(F.col("court"), F.col("case_number"), F.col("document_date"), F.col("verdict_type"))
    others = docs.select(F.col("doc_id").alias("other"), cite.alias("citation"), F.col("document_date").alias("day"), "court", C.norm_case_number(F.col("case_number")).alias("number"))
    near = links.where((F.col("from_doc_id") == doc_id) & (F.col("relation") != "cites")).select(F.col("to_doc_id").alias("other"), "relation", "confidence", "method")
    sides = {}
    for outgoing in (True, False):
        rows = graph.citation_pages(citations, links, doc_id, outgoing)
        rows = graph.passage_of_citation(rows, passages, ["from_doc_id", "layer", "char_start"]).select("other", "layer", "char_start", "raw_text", "ordinal", "also_appeal")
        order = F.asc_nulls_last("day") if outgoing else F.desc_nulls_last("day")
        sides[outgoing] = search.paged(rows.join(others, "other", "left").orderBy(order, "other"), page, PAGE)
    open_ = citations.where((F.col("from_doc_id") == doc_id) & F.col("status").isin("unresolved", "ambiguous")).agg(F.count("*").alias("n"))
    return Detail(own.withColumn("citation", cite), near.join(others, "other", "left"), sides[True], sides[False], open_)


def journal_block(articles: DataFrame, issues: DataFrame, today: str) -> DataFrame:
    """Articles with their issue, and whether the file is there, locked or under embargo."""
    rows = articles.join(issues.select("issue_id", F.col("label").alias("issue_label"), "embargo_until", "locked"), "issue_id", "left")
    embargo = F.coalesce(F.col("embargo_until") > F.lit(today).cast("date"), F.lit(False))
    return rows.withColumn("embargoed", embargo).withColumn("has_pdf", F.col("pdf_path").isNotNull() & ~embargo & ~F.coalesce("locked", F.lit(False)))


def compact(hits: DataFrame) -> DataFrame:
    """Search rows for a tool: few columns, at most five keywords, a short abstract."""
    cite = C.ruling_citation(F.col("court"), F.col("case_number"), F.col("document_date"), F.col("verdict_type"))
    return hits.select("doc_id", cite.alias("citation"), F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 5).alias("keywords"), short(F.col("summary"), 300).alias("summary"))


def short(text: Column, most: int) -> Column:
    """The text cut at the last blank before the limit."""
    head = F.substring(text, 1, most)
    cut = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def date_precision(source: Column, raw_json: Column, by_date: list[str]) -> Column:
    """How exact a web journal's date is; null for other sources, whose raw payload is not read."""
    return F.when(source.isin(by_date), F.get_json_object(raw_json, "$.date_precision"))


def audit(citations: DataFrame, docs: DataFrame, per_stratum: int = 40, seed: int = 1) -> DataFrame:
    """A sample of resolved citations by method, with checks that don't use the resolver.

    number: the raw text holds the target's number; court and date agree with the target;
    order: the target isn't later than the citing document; span: the citing text has the
    raw text where the citation says.
    """
    rows = quality.sample_per_stratum(citations.where("status = 'resolved'").withColumn("_key", merge_key()), "method", "_key", per_stratum, seed)
    target = docs.select(F.col("doc_id").alias("to_doc_id"), F.col("case_number").alias("t_number"), F.col("court").alias("t_court"), F.col("document_date").alias("t_date"))
    layers = F.when(F.col("layer") == "summary", F.col("summary")).when(F.col("layer") == "body", F.col("body_text")).otherwise(F.col("lower_body_text"))
    citing = docs.select(F.col("doc_id").alias("from_doc_id"), F.col("document_date").alias("f_date"), "summary", "body_text", "lower_body_text")
    both = rows.join(target, "to_doc_id", "left").join(citing, "from_doc_id", "left")
    digits = F.regexp_replace(C.norm_case_number(F.col("t_number")), r"^[A-ZÞÆÖ]{1,2}-", "")
    return both.select(
        "from_doc_id",
        "layer",
        "char_start",
        "to_doc_id",
        "method",
        F.contains(F.regexp_replace("raw_text", r"\b0+(?=\d)", ""), digits).alias("number_ok"),
        ((F.col("target_court") == F.col("t_court")) | ((F.col("target_court") == "Hérd.") & F.col("t_court").startswith("Hérd."))).alias("court_ok"),
        (F.col("target_date").isNull() | (F.col("target_date") == F.col("t_date"))).alias("date_ok"),
        F.coalesce(F.col("t_date") <= F.col("f_date"), F.lit(True)).alias("order_ok"),
        F.contains(F.left(layers, F.col("char_end")), F.col("raw_text")).alias("span_ok"),
    )


def merge_key() -> Column:
    return F.concat_ws("\x1f", "from_doc_id", "layer", F.col("char_start").cast("string"))


def golden_candidates(passages: DataFrame, docs: DataFrame, lo: int = 200, hi: int = 2000, per_source: int = 50, seed: int = 1) -> DataFrame:
    """Passages to draft questions from: of fitting length, the same number for each source, in hash order."""
    pool = passages.where(F.length("text").between(lo, hi)).join(docs.select("doc_id", "source_short", "document_date"), "doc_id").where("document_date is not null")
    return quality.sample_per_stratum(pool.withColumn("_key", F.concat_ws("-", "doc_id", F.col("ordinal").cast("string"))), "source_short", "_key", per_source, seed).drop("_key")
