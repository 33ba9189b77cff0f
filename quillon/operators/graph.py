"""Citations and links between documents: resolution, derived edges, appeal chains, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: The year from which the supreme court's rulings are covered.
COVERED_FROM = 1999
KEY = ["from_doc_id", "layer", "char_start"]


def citation_index(docs: DataFrame) -> DataFrame:
    """(court, number) to candidate rulings; district courts also under the bare court word."""
    rows = docs.where("court is not null").select(F.col("doc_id").alias("to_doc_id"), "court", C.norm_case_number(F.col("case_number")).alias("number"), F.col("document_date").alias("to_date"), F.col("verdict_type").alias("to_verdict"))
    rows = rows.where("number is not null")
    courts = F.when(F.col("court").startswith("Hérd. "), F.array("court", F.lit("Hérd."))).otherwise(F.array("court"))
    return rows.withColumn("key_court", F.explode(courts)).drop("court")


def resolve(raw: DataFrame, index: DataFrame, dates: DataFrame) -> DataFrame:
    """raw citations with status, to_doc_id, method and confidence.

    dates has (doc_id, document_date) of the citing documents.  Candidates dated after
    the citing document don't count; a stated date filters hard; else a verdict word
    narrows when it leaves something; more than one left is ambiguous.
    """
    rows = raw.join(dates.select(F.col("doc_id").alias("from_doc_id"), F.col("document_date").alias("from_date")), "from_doc_id", "left")
    number = C.norm_case_number(F.col("target_case_number"))
    bare_labour = (F.col("target_court") == "Féld.") & number.rlike(r"^\d{1,4}/\d{4}$")
    rows = rows.withColumn("_number", F.when(F.col("form") != "reporter", number))
    keys = F.when(bare_labour, F.array(F.col("_number"), F.concat(F.lit("F-"), F.col("_number")))).otherwise(F.array("_number"))
    asked = rows.where("_number is not null and target_court is not null").select(*KEY, "target_court", "target_date", "target_verdict", "from_date", F.explode(keys).alias("number"))
    hit = (asked["number"] == index["number"]) & (asked["target_court"] == index["key_court"])
    found = asked.join(index, hit).where("from_date is null or to_date is null or to_date <= from_date").dropDuplicates([*KEY, "to_doc_id"])
    dated, spoken = F.col("to_date") == F.col("target_date"), F.col("to_verdict") == F.col("target_verdict")
    ids = lambda cond=None: F.collect_set("to_doc_id" if cond is None else F.when(cond, F.col("to_doc_id")))
    left = found.groupBy(*KEY).agg(ids().alias("all"), ids(dated).alias("dated"), ids(spoken).alias("spoken"))
    out = rows.join(left, KEY, "left")
    n = F.coalesce(F.size("all"), F.lit(0))
    by_date = F.col("target_date").isNotNull()
    by_verdict = ~by_date & F.col("target_verdict").isNotNull() & (n > 1) & (F.size("spoken") > 0)
    chosen = F.when(by_date, F.col("dated")).when(by_verdict, F.col("spoken")).otherwise(F.col("all"))
    out = out.withColumn("_n", F.greatest(n, F.lit(0))).withColumn("_chosen", chosen).withColumn("_method", F.when(by_date, "casenum_date").when(by_verdict, "casenum_verdict").otherwise("casenum_unique"))
    early = (F.col("target_court") == "Hrd.") & (C.case_year(F.col("target_case_number")) < COVERED_FROM)
    size = F.coalesce(F.size("_chosen"), F.lit(0))
    status = (
        F.when(F.col("_number").isNull(), "pre_coverage")
        .when((F.col("_n") <= 0) & F.coalesce(early, F.lit(False)), "pre_coverage")
        .when((F.col("_n") <= 0) | (size <= 0), "unresolved")
        .when(size > 1, "ambiguous")
        .when(F.get("_chosen", F.lit(0)) == F.col("from_doc_id"), "self")
        .otherwise("resolved")
    )
    out = out.withColumn("status", status)
    settled = F.col("status").isin("resolved", "self")
    confidence = F.when(F.col("_method") == "casenum_date", 1.0).when(F.col("_method") == "casenum_verdict", 0.9).otherwise(0.8)
    return out.select(*raw.columns, "status", F.when(settled, F.get("_chosen", F.lit(0))).alias("to_doc_id"), F.when(settled, F.col("_method")).alias("method"), F.when(settled, confidence).alias("confidence"))


def cites_edges(citations: DataFrame) -> DataFrame:
    """One edge for each resolved target of a summary or body, with the best confidence."""
    rows = citations.where("status = 'resolved' and layer in ('summary', 'body')")
    return rows.groupBy("from_doc_id", "to_doc_id").agg(F.max("confidence").alias("confidence")).select("from_doc_id", "to_doc_id", F.lit("cites").alias("relation"), "confidence", F.lit("citation").alias("method"))


def relink(citations: DataFrame, index: DataFrame, dates: DataFrame, ids: DataFrame) -> DataFrame:
    """Citations with unresolved, ambiguous and dangling ones resolved anew, all read as prose (B2)."""
    alive = citations.join(ids.select(F.col("doc_id").alias("to_doc_id"), F.lit(True).alias("_alive")), "to_doc_id", "left")
    again = F.col("status").isin("unresolved", "ambiguous") | ((F.col("status") == "resolved") & F.col("_alive").isNull())
    plain = [c for c in citations.columns if c not in ("status", "to_doc_id", "method", "confidence")]
    redo = alive.where(again).select(*[F.lit("prose").alias(c) if c == "form" else F.col(c) for c in plain])
    return alive.where(~again).select(*citations.columns).unionByName(resolve(redo, index, dates).select(*citations.columns))


def citation_pages(citations: DataFrame, links: DataFrame, doc_id: str, outgoing: bool = True) -> DataFrame:
    """One row for each other document: its best citation, body first, and whether an appeal links the two."""
    own, other = ("from_doc_id", "to_doc_id") if outgoing else ("to_doc_id", "from_doc_id")
    rows = citations.where((F.col(own) == doc_id) & F.col(other).isNotNull() & (F.col("status") == "resolved")).withColumn("other", F.col(other))
    first = Window.partitionBy("other").orderBy(F.desc(F.col("layer") == "body"), "char_start")
    best = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    pairs = links.where(F.col("relation").isin(C.APPEAL_RELATIONS)).select(F.least("from_doc_id", "to_doc_id").alias("_a"), F.greatest("from_doc_id", "to_doc_id").alias("_b")).distinct().withColumn("also_appeal", F.lit(True))
    tagged = best.join(pairs, (F.least("from_doc_id", "to_doc_id") == F.col("_a")) & (F.greatest("from_doc_id", "to_doc_id") == F.col("_b")), "left").drop("_a", "_b")
    return tagged.withColumn("also_appeal", F.coalesce("also_appeal", F.lit(False)))


def passage_of_citation(citations: DataFrame, passages: DataFrame, key: list[str]) -> DataFrame:
    """citations with the ordinal of the last passage of the same document and layer that starts at or before them.

    Both sides are sorted together once and the ordinal carried forward; no pairs arise.
    """
    p = passages.select(F.col("doc_id").alias("_doc"), F.col("layer").alias("_layer"), F.col("char_start").alias("_at"), F.lit(0).alias("_side"), F.col("ordinal").alias("_ordinal"), *[F.lit(None).cast(citations.schema[k].dataType).alias(k) for k in key])
    c = citations.select(F.col("from_doc_id").alias("_doc"), F.col("layer").alias("_layer"), F.col("char_start").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_ordinal"), *key)
    upto = Window.partitionBy("_doc", "_layer").orderBy("_at", "_side", "_ordinal").rowsBetween(Window.unboundedPreceding, 0)
    carried = p.unionByName(c).withColumn("ordinal", F.last("_ordinal", ignorenulls=True).over(upto)).where("_side = 1").select(*key, "ordinal")
    return citations.join(carried.dropDuplicates(key), key, "left")


def in_degree(docs: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("to_doc_id").alias("doc_id")).agg(F.count("*").alias("cited_by"))
    return docs.join(n, "doc_id", "left").withColumn("cited_by", F.coalesce("cited_by", F.lit(0)))


def has_appeal_links(docs: DataFrame, links: DataFrame) -> DataFrame:
    """A flag on documents with a link other than a citation; petitions' links count on their own side only."""
    rows = links.where("relation <> 'cites'")
    both = rows.where("relation in ('appealed_to', 'appealed_from')").select(F.col("to_doc_id").alias("doc_id"))
    ids = rows.select(F.col("from_doc_id").alias("doc_id")).union(both).distinct().withColumn("has_appeal_links", F.lit(True))
    return docs.join(ids, "doc_id", "left").withColumn("has_appeal_links", F.coalesce("has_appeal_links", F.lit(False)))


def mirrored(links: DataFrame) -> DataFrame:
    """Every appeal link with its mirror image, the best confidence of each."""
    turn = F.create_map(*(F.lit(x) for kv in C.MIRROR.items() for x in kv))
    swap = links.where(F.col("relation").isin(list(C.MIRROR))).select(F.col("to_doc_id").alias("from_doc_id"), F.col("from_doc_id").alias("to_doc_id"), turn[F.col("relation")].alias("relation"), "confidence", "method")
    return best_links(links.unionByName(swap))


def best_links(links: DataFrame) -> DataFrame:
    """One row for each (from, to, relation): the greatest confidence and its method (K4)."""
    return links.groupBy("from_doc_id", "to_doc_id", "relation").agg(F.max("confidence").alias("confidence"), F.max_by("method", F.struct("confidence", "method")).alias("method"))


def chained(links: DataFrame, confidence: float = 0.95) -> DataFrame:
    """A to B and B to C give A to C, unless it is there or A is C."""
    up = links.where("relation = 'appealed_to'")
    hop = up.alias("x").join(up.alias("y"), F.col("x.to_doc_id") == F.col("y.from_doc_id")).select(F.col("x.from_doc_id"), F.col("y.to_doc_id"))
    new = hop.where("from_doc_id <> to_doc_id").distinct().join(up, ["from_doc_id", "to_doc_id"], "left_anti")
    return new.select("from_doc_id", "to_doc_id", F.lit("appealed_to").alias("relation"), F.lit(confidence).alias("confidence"), F.lit("chain_inference").alias("method"))


def link_appeals(upper: DataFrame, lower: DataFrame, threshold: float = 0.5, window: int = 14, floor: float = 0.3) -> DataFrame:
    """The lower ruling behind each appeal (B4): by case number, else by court and date within a window.

    upper: doc_id, casenums, lower_court, lower_date, nums, words (arrays of its copied
    lower ruling); lower: doc_id, court, case_number, document_date, nums, words.  The
    candidate with the best overlap wins; ties and weak ones give nothing.
    """
    side = lower.select(F.col("doc_id").alias("to_doc_id"), F.col("court").alias("_court"), C.norm_case_number(F.col("case_number")).alias("_number"), F.col("document_date").alias("_date"), F.col("nums").alias("_nums"), F.col("words").alias("_words"))
    asked = upper.select(F.col("doc_id").alias("from_doc_id"), "casenums", "lower_court", "lower_date", "nums", "words")
    a = asked.withColumn("_asked", F.explode("casenums")).withColumn("_asked", C.norm_case_number(F.col("_asked")))
    a = a.join(side, (F.col("_asked") == F.col("_number")) & (F.col("lower_court").isNull() | (F.col("lower_court") == F.col("_court")))).drop("_asked").withColumn("method", F.lit("casenum"))
    step = F.lit(window)
    buckets = F.array(*[F.floor(F.unix_date("lower_date") / step) + k for k in (-1, 0, 1)])
    b = asked.join(a.select("from_doc_id").distinct(), "from_doc_id", "left_anti").withColumn("_bucket", F.explode(buckets))
    near = (F.col("lower_court") == F.col("_court")) & (F.col("_bucket") == F.floor(F.unix_date("_date") / step)) & (F.abs(F.datediff("_date", "lower_date")) <= window)
    b = b.join(side, near).drop("_bucket").withColumn("method", F.when(F.col("_date") == F.col("lower_date"), "court_date").otherwise("court_window"))
    both = a.unionByName(b).withColumn("score", F.round(F.greatest(multiset_overlap(F.col("nums"), F.col("_nums")), set_overlap(F.col("words"), F.col("_words"))), 4))
    best = both.where((F.col("score") >= threshold) | ((F.col("method") == "casenum") & (F.col("score") >= floor)))
    order = Window.partitionBy("from_doc_id").orderBy(F.desc("score"), "to_doc_id")
    ranked = best.dropDuplicates(["from_doc_id", "to_doc_id"]).withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order))
    won = ranked.where("_k = 1 and (_next is null or _next < score)")
    return won.select("from_doc_id", "to_doc_id", F.lit("appealed_from").alias("relation"), F.col("score").alias("confidence"), "method")


def resolution_links(docs: DataFrame, upper: str, lower: list[str]) -> DataFrame:
    """Edges from rulings to the ones that their payload links to, by external id, both ways.

    docs: doc_id, source_short, external_id, link.  The id follows ?id= or the last slash.
    """
    link = F.col("link")
    wanted = F.when(F.contains(link, F.lit("?id=")), F.substring_index(F.substring_index(link, "?id=", -1), "&", 1)).otherwise(F.substring_index(link, "/", -1))
    asked = docs.where((F.col("source_short") == upper) & (F.coalesce(link, F.lit("")) != "")).select(F.col("doc_id").alias("from_doc_id"), wanted.alias("external_id"))
    there = docs.where(F.col("source_short").isin(lower)).select(F.col("doc_id").alias("to_doc_id"), "external_id")
    edges = asked.join(there, "external_id").select("from_doc_id", "to_doc_id", F.lit("appealed_from").alias("relation"), F.lit(1.0).alias("confidence"), F.lit("resolution_link").alias("method"))
    return mirrored(edges.distinct())


def near_in_time(rows: DataFrame, group: str, key: str, day: str, days: int) -> DataFrame:
    """(first, second): pairs of a group's rows at most so many days apart, the smaller key first.

    A range join as an equi-join on group and slot of days, each row also in its neighbours' slots.
    """
    slot = F.floor(F.unix_date(day) / (days + 1))
    own = rows.select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.col(day).alias("_day"), slot.alias("_slot"))
    a = own.select("_g", F.col("_key").alias("first"), F.col("_day").alias("_one"), F.explode(F.array(F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1)).alias("_slot"))
    b = own.select("_g", F.col("_key").alias("second"), F.col("_day").alias("_two"), "_slot")
    return a.join(b, ["_g", "_slot"]).where((F.col("first") < F.col("second")) & (F.abs(F.datediff("_one", "_two")) <= days)).select("first", "second")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Shared tokens, with repeats, over the smaller number of tokens."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(times(a, v), times(b, v)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def set_overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(F.lit(0.0))


def petition_links(petitions: DataFrame, rulings: DataFrame) -> DataFrame:
    """The decision each petition is about (J18, T8): same court and number, the latest before the petition, narrowed by verdict word when that leaves one; several of one day are ambiguous and give nothing.

    petitions: doc_id, target_court, target_number, target_verdict, document_date.
    """
    side = rulings.select(F.col("doc_id").alias("to_doc_id"), F.col("court").alias("target_court"), C.norm_case_number(F.col("case_number")).alias("_number"), F.col("document_date").alias("_date"), F.col("verdict_type").alias("_verdict"))
    rows = petitions.select(F.col("doc_id").alias("from_doc_id"), "target_court", C.norm_case_number(F.col("target_number")).alias("_number"), "target_verdict", "document_date")
    found = rows.join(side, ["target_court", "_number"]).where("document_date is null or _date is null or _date < document_date")
    spoken = F.coalesce(F.col("_verdict") == F.col("target_verdict"), F.lit(False))
    found = found.withColumn("_place", F.struct(spoken.cast("int").alias("spoken"), "_date"))
    best = found.groupBy("from_doc_id").agg(F.max("_place").alias("_best"))
    first = found.join(best, "from_doc_id").where(F.col("_place").eqNullSafe(F.col("_best"))).groupBy("from_doc_id").agg(F.min("to_doc_id").alias("to_doc_id"), F.count_distinct("to_doc_id").alias("_n"))
    return first.where("_n = 1").select("from_doc_id", "to_doc_id", F.lit("leyfisbeidni_um").alias("relation"), F.lit(1.0).alias("confidence"), F.lit("casenum").alias("method"))


def petition_judgments(petition_edges: DataFrame, appeals: DataFrame, dates: DataFrame) -> DataFrame:
    """The earliest judgment after a granted petition on the decision it was about.

    Appeal links of either direction are read both ways first, so the hop is one equi-join.
    """
    both = appeals.select(F.col("from_doc_id").alias("_mid"), F.col("to_doc_id").alias("_other")).union(appeals.select("to_doc_id", "from_doc_id")).distinct()
    day = dates.select(F.col("doc_id").alias("_id"), F.col("document_date").alias("_day"))
    hop = petition_edges.select(F.col("from_doc_id").alias("petition"), F.col("to_doc_id").alias("_mid")).join(both, "_mid")
    hop = hop.join(day.withColumnsRenamed({"_id": "_other", "_day": "_later"}), "_other").join(day.withColumnsRenamed({"_id": "petition", "_day": "_asked"}), "petition").where("_later > _asked")
    first = hop.groupBy("petition").agg(F.min_by("_other", F.struct("_later", "_other")).alias("to_doc_id"))
    return first.select(F.col("petition").alias("from_doc_id"), "to_doc_id", F.lit("leiddi_til_doms").alias("relation"), F.lit(0.9).alias("confidence"), F.lit("chain_via_target").alias("method"))


def integrity(links: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Four checks on links; every frame should be empty (Q14)."""
    side = lambda p: docs.select(F.col("doc_id").alias(f"{p}_doc_id"), F.col("instance_tier").alias(f"{p}_tier"), F.col("document_date").alias(f"{p}_date"))
    rows = links.join(side("from"), "from_doc_id").join(side("to"), "to_doc_id")
    swap = links.select(F.col("to_doc_id").alias("from_doc_id"), F.col("from_doc_id").alias("to_doc_id"), F.create_map(*(F.lit(x) for kv in C.MIRROR.items() for x in kv))[F.col("relation")].alias("relation"))
    return {
        "orientation": rows.where("(relation = 'appealed_to' and from_tier >= to_tier) or (relation = 'appealed_from' and from_tier <= to_tier)").select(*links.columns),
        "two_relations": links.where("relation in ('appealed_to', 'appealed_from')").groupBy("from_doc_id", "to_doc_id").agg(F.count_distinct("relation").alias("n")).where("n > 1"),
        "no_mirror": links.where("relation in ('appealed_to', 'appealed_from')").join(swap, ["from_doc_id", "to_doc_id", "relation"], "left_anti"),
        "cites_later": rows.where("relation = 'cites' and to_date > from_date").select(*links.columns),
    }
