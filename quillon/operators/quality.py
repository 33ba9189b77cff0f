"""Duplicates, retrieval metrics, samples and histograms."""

from __future__ import annotations

import difflib
import math
import re
import time
from collections import Counter
from collections.abc import Callable
from itertools import combinations
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import contained

DUPLICATE_KEY = ["source_short", "court", "case_number", "document_date", "verdict_type"]


def duplicate_groups(docs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Keys that several rows share; keys with a null part never group."""
    key = key or DUPLICATE_KEY
    known = docs.where(" and ".join(f"{k} is not null" for k in key))
    return known.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def _normal(text: str | None) -> str:
    return re.sub(r"\W+", " ", (text or "").lower()).strip()


def _similarity(a: str, b: str, least: float) -> float:
    """The difflib ratio of whole texts, their equal ends matched first; an upper bound if that is below least."""
    if a == b:
        return 1.0
    ends = len(commonprefix([a, b]))
    x, y = a[ends:], b[ends:]
    last = len(commonprefix([x[::-1], y[::-1]]))
    x, y, ends = x[: len(x) - last], y[: len(y) - last], ends + last
    most = 2 * (ends + (Counter(x) & Counter(y)).total()) / (len(a) + len(b))
    if most < least:
        return most
    blocks = difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
    return 2 * (ends + sum(m.size for m in blocks)) / (len(a) + len(b))


def least_similarity(texts: list[str | None], least: float = 0.0) -> float:
    """The least difflib ratio over all pairs of normalised texts; 0 if any is empty (X34). Exact from least on."""
    normal = sorted(map(_normal, texts))
    if len(normal) < 2 or not normal[0]:
        return 0.0
    worst = 1.0
    for a, b in combinations(normal, 2):
        worst = min(worst, _similarity(a, b, least))
        if worst < least:
            break
    return worst


def deduplicate(docs: DataFrame, least: float = 0.995, key: list[str] | None = None, newest: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): of rows that share a key and are alike in pairs, the newest stays.

    Groups are small by their key, so each is compared in one Arrow group.
    """
    key = key or DUPLICATE_KEY
    rows = docs.join(duplicate_groups(docs, key).drop("n"), key).select("doc_id", *key, "body_text")

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": group["doc_id"], "_score": least_similarity(list(group["body_text"]), least)})

    scores = rows.groupBy(*key).applyInPandas(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _score double")
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last(newest), "doc_id")
    alike = docs.join(scores.where(F.col("_score") >= least), "doc_id").withColumn("_k", F.row_number().over(order))
    dropped = alike.where("_k > 1").select(*docs.columns)
    return docs.join(dropped.select("doc_id"), "doc_id", "left_anti"), dropped


def keep_newest(rows: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("_k = 1").drop("_k")


def containment(pages: DataFrame, share: float = 0.5, file_share: float = 0.7) -> DataFrame:
    """(file, inside, n): files with enough pages whose trigrams mostly lie in another, larger file.

    n counts pages that hold share of their trigrams in the other file.  Rows of one page
    count together; files without a common trigram never meet.
    """
    return contained(pages, share, file_share)


def retrieval_metrics(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """recall@k, MRR, hit@1, median and p95 latency, and questions without results.

    recall is the share of a question's expected documents among the first k; hit is the
    share of questions with any of them there, which is the same for one document each.
    results: question, rank (from 1), doc, ms; expected: question, doc.  p95 is the element
    at int(0.95 * (n - 1)) of the sorted latencies.
    """
    top = results.where(F.col("rank") <= k)
    hit = top.join(expected, ["question", "doc"]).groupBy("question").agg(F.min("rank").alias("first"), F.count_distinct("doc").alias("found"))
    want = expected.groupBy("question").agg(F.count_distinct("doc").alias("wanted"))
    timing = results.groupBy("question").agg(F.max("ms").alias("ms"), F.count(F.when(F.col("doc").isNotNull(), 1)).alias("n"))
    rows = want.join(hit, "question", "left").join(timing, "question", "left")
    known = rows.where("ms is not null").select("ms")
    at = math.floor(0.95 * (known.count() - 1))
    p95 = known.orderBy("ms").offset(max(0, at)).limit(1).agg(F.max("ms").alias("p95"))
    return rows.agg(
        F.avg(F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"),
        F.avg(F.col("first").isNotNull().cast("double")).alias("hit"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("hit1"),
        F.median("ms").alias("p50"),
        F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("zero"),
    ).join(F.broadcast(p95))


def sweep(expected: DataFrame, settings: list, ask: Callable, k: int = 10) -> DataFrame:
    """retrieval_metrics of a golden set under each setting, most hits first, with the number of widened searches (Q15).

    expected: question, doc.  ask(question, setting) gives a search's Results.  A golden set
    is small: its questions are asked one after another, and only a page of ids comes back.
    """
    spark = expected.sparkSession
    questions = [r["question"] for r in expected.select("question").distinct().orderBy("question").collect()]
    out = None
    for setting in settings:
        rows, widened = [], 0
        for question in questions:
            began = time.perf_counter()
            found = ask(question, setting)
            top = [r["doc_id"] for r in found.page.select("doc_id").collect()][:k]
            ms = (time.perf_counter() - began) * 1000
            widened += found.relaxed
            rows += [(question, n, doc, ms) for n, doc in enumerate(top, 1)] or [(question, 0, None, ms)]
        results = spark.createDataFrame(rows, "question string, rank int, doc string, ms double")
        run = retrieval_metrics(results, expected, k).select(F.lit(str(setting)).alias("setting"), "*", F.lit(widened).alias("widened"))
        out = run if out is None else out.unionByName(run)
    return out.orderBy(F.desc("hit"), F.desc("mrr"))


def sample_per_stratum(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of each stratum in hash order, alike on every run."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def apportion(weights: dict[str, float], seats: int) -> dict[str, int]:
    """Hamilton's method: whole quotas, then the largest remainders."""
    total = sum(weights.values())
    if not total:
        return dict.fromkeys(weights, 0)
    quota = {k: seats * w / total for k, w in weights.items()}
    out = {k: math.floor(q) for k, q in quota.items()}
    for k in sorted(quota, key=lambda k: (out[k] - quota[k], k))[: seats - sum(out.values())]:
        out[k] += 1
    return out


def greedy_caps(rows: list[dict], caps: dict[str, int]) -> list[dict]:
    """Rows in order, as long as none of the capped fields' values is used up."""
    used: dict[tuple, int] = {}
    out = []
    for row in rows:
        keys = [(f, row[f]) for f in caps]
        if all(used.get(k, 0) < caps[k[0]] for k in keys):
            out.append(row)
            for k in keys:
                used[k] = used.get(k, 0) + 1
    return out


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal-width bins with values beyond the ends clamped, and of missing values as bin null."""
    at = F.floor((F.col(value) - lo) / ((hi - lo) / bins)).cast("int")
    return rows.groupBy(F.when(F.col(value).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), at))).alias("bin")).agg(F.count("*").alias("n"))


def thresholds(rows: DataFrame, value: str, cuts: list[float], good: str) -> DataFrame:
    """For every cut: rows at or above it, and the good ones among them."""
    aggs = [F.struct(F.lit(c).alias("cut"), F.count_if(F.col(value) >= c).alias("n"), F.count_if((F.col(value) >= c) & F.col(good)).alias("good")) for c in cuts]
    return rows.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def coverage(docs: DataFrame, passages: DataFrame, source: str = "source_short") -> DataFrame:
    """Documents with text, and those of them with passages, for each source."""
    with_text = docs.where("coalesce(summary, body_text, lower_body_text) is not null").select("doc_id", source)
    done = passages.select("doc_id").distinct().withColumn("_done", F.lit(True))
    return with_text.join(done, "doc_id", "left").groupBy(source).agg(F.count("*").alias("with_text"), F.count("_done").alias("with_passages"))


def shape(text: Column) -> Column:
    """Digits as #, for histograms of number forms."""
    return F.regexp_replace(text, r"\d", "#")


def citation_report(citations: DataFrame) -> dict[str, DataFrame]:
    """Status, layer and top shapes of citations."""
    per_doc = citations.where("status = 'resolved'").groupBy("from_doc_id").agg(F.count_distinct("to_doc_id").alias("targets"))
    return {
        "status": citations.groupBy("target_court").pivot("status", ["resolved", "ambiguous", "unresolved", "self", "pre_coverage"]).count(),
        "layer": citations.groupBy("layer").agg(F.count("*").alias("n")),
        "shapes": citations.where("status = 'unresolved'").groupBy(shape(F.col("target_case_number")).alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(10),
        "spread": per_doc.agg(F.avg("targets").alias("mean"), F.max("targets").alias("most")),
        "targets": per_doc.groupBy(F.least("targets", F.lit(10)).alias("targets")).agg(F.count("*").alias("n")),
        "coverage": citations.where("layer in ('summary', 'body') and status in ('resolved', 'ambiguous', 'unresolved')").agg(F.avg((F.col("status") == "resolved").cast("double")).alias("share")),
    }


def article_confidence(checks: dict[str, Column], from_model: bool = False) -> Column:
    """Weighted sum of an article's four checks; lists read by a model stop at 0.70."""
    #: Weights of the checks.
    weights = {"title": 0.35, "author": 0.30, "page": 0.15, "record": 0.20}
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.when(F.coalesce(checks[name], F.lit(False)), weight).otherwise(0.0)
    return F.round(F.least(total, F.lit(0.70)) if from_model else total, 4)


def issue_status(articles: DataFrame, issue: str = "issue_id") -> DataFrame:
    """approved when every article reaches 0.9 and no gap between articles exceeds six pages."""
    w = Window.partitionBy(issue).orderBy("page_start")
    gap = F.col("page_start") - F.lag("page_end").over(w) - 1
    rows = articles.withColumn("_gap", gap)
    ok = (F.min("confidence") >= 0.9) & (F.coalesce(F.max("_gap"), F.lit(0)) <= 6)
    return rows.groupBy(issue).agg(F.when(ok, "approved").otherwise("review").alias("status"))


def best_record(articles: DataFrame, records: DataFrame, score: Column, least: float = 0.5) -> DataFrame:
    """The catalogue record of each article: same year, best score, none on a tie."""
    pairs = articles.join(records, (articles["year"] == records["record_year"]) & (F.col("volume").isNull() | F.col("record_volume").isNull() | (F.col("volume") == F.col("record_volume")))).withColumn("_score", score)
    order = Window.partitionBy("article_id").orderBy(F.desc("_score"), "record_id")
    ranked = pairs.where(F.col("_score") >= least).withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead("_score").over(order))
    return ranked.where("_k = 1 and (_next is null or _next < _score)").select("article_id", "record_id", F.col("_score").alias("score"))


def record_score(title_similarity: Column, page_equal: Column, year_equal: Column) -> Column:
    """How well a catalogue record fits an article: title .7, first page .25, year .05; matches from 0.55 on."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.round(0.7 * F.coalesce(title_similarity, F.lit(0.0)) + 0.25 * yes(page_equal) + 0.05 * yes(year_equal), 4)
