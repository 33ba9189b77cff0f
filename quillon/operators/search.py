"""Search in seven modes over documents and passages, facets, windows and details.

Requests are validated on the driver before any job runs.  Keyword search is one
aggregation: m, the weight of the query's lemmas that a document holds, decides the
tier, so widening needs neither unions nor anti-joins.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.text import headline, provision_query, snippet

MODES = {"keyword", "exact", "prefix", "substring", "any", "proximity", "regex"}
RELAX_BELOW, RELAX_CAP, CANDIDATES, PAGE_MOST = 10, 300, 2000, 100
#: Lemmas left of a provision reference; they say nothing as a text query.
NOISE = {"mgr", "gr", "lag", "lög", "nr", "sbr"}
FIELDS = ["case_number", "summary", "body_text", "lower_body_text", "parties", "keywords"]


class SearchError(ValueError):
    """Input that no query can be made of."""


@dataclass(frozen=True)
class Scope:
    """Sources, and sources narrowed to verdict types; no clause matches nothing."""

    plain: frozenset[str] = frozenset()
    narrowed: tuple[tuple[frozenset[str], frozenset[str]], ...] = ()

    def column(self, source: str = "source_short", verdict: str = "verdict_type") -> Column:
        out = F.lit(False)
        if self.plain:
            out = out | F.col(source).isin(sorted(self.plain))
        for sources, verdicts in self.narrowed:
            out = out | (F.col(source).isin(sorted(sources)) & F.col(verdict).isin(sorted(verdicts)))
        return out


def leaves(tree: list[dict]) -> dict[str, list[dict]]:
    """Key to the leaves below it, itself included; keys of all nodes."""
    out: dict[str, list[dict]] = {}

    def walk(node: dict) -> list[dict]:
        own = [leaf for child in node.get("children", []) for leaf in walk(child)] or [node]
        out[node["key"]] = own
        return own

    for node in tree:
        walk(node)
    return out


def resolve_scope(tree: list[dict], keys: list[str] | None) -> Scope | None:
    """None without a restriction.  A parent stands for all sources below it, a leaf keeps its verdict types; unknown keys add nothing."""
    if not keys or "all" in keys:
        return None
    below = leaves(tree)
    plain: set[str] = set()
    narrowed = []
    for key in keys:
        for leaf in below.get(key, []):
            if leaf["key"] == key and leaf.get("verdict_types"):
                narrowed.append((frozenset(leaf["sources"]), frozenset(leaf["verdict_types"])))
            else:
                plain |= set(leaf.get("sources", []))
    return Scope(frozenset(plain), tuple(narrowed))


@dataclass
class Request:
    """A search; page and size are clamped, everything else is checked."""

    q: str = ""
    mode: str = "keyword"
    scope: Scope | None = None
    date_from: str | None = None
    date_to: str | None = None
    sort: str = "relevance"
    page: int = 1
    size: int = 20
    fields: list[str] = field(default_factory=lambda: ["body_text", "lower_body_text"])
    within: int = 5
    provision: str | None = None
    keyword: str | None = None
    section_kinds: list[str] | None = None
    strategy: str = "breadth_coloc"
    relax_below: int = RELAX_BELOW

    def __post_init__(self) -> None:
        self.page, self.size = max(1, self.page), min(PAGE_MOST, max(1, self.size))
        if self.mode not in MODES:
            raise SearchError(f"no mode {self.mode!r}")
        if self.sort not in ("relevance", "newest", "oldest"):
            raise SearchError(f"no order {self.sort!r}")
        if self.strategy not in C.RANKS:
            raise SearchError(f"no rank strategy {self.strategy!r}")
        if self.section_kinds:
            if wrong := set(self.section_kinds) - set(C.SECTION_KINDS):
                raise SearchError(f"no section kind {sorted(wrong)}")
            if self.mode not in ("keyword", "proximity"):
                raise SearchError("section kinds need keyword or proximity search")
        if self.relax_below >= RELAX_CAP:
            raise SearchError("relaxing must stop below the candidates' cap")
        if self.mode == "regex":
            if wrong := set(self.fields) - set(FIELDS):
                raise SearchError(f"no field {sorted(wrong)}")
            try:
                re.compile(re.sub(r"\\[mM]|\[:\w+:\]", ".", self.q))
            except re.error as bad:
                raise SearchError(f"bad pattern: {bad}") from bad

    def filters(self) -> Column:
        """Everything but the text."""
        out = F.lit(True)
        if self.scope is not None:
            out = out & self.scope.column()
        if self.date_from:
            out = out & (F.col("document_date") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            out = out & (F.col("document_date") <= F.lit(self.date_to).cast("date"))
        if self.provision and (p := provision_query(self.provision)):
            out = out & C.provision_match(F.col("cited_provisions"), *p)
        elif self.provision and re.fullmatch(r"\d+/\d{4}", self.provision.strip()):
            out = out & C.provision_match(F.col("cited_provisions"), self.provision.strip())
        if self.keyword:
            out = out & C.keyword_match(F.col("keywords"), self.keyword)
        return out


def weights(lemmas: list[str]) -> dict[str, int]:
    """Distinct lemmas with their multiplicity, without operator characters."""
    clean = [re.sub(r"[&|!():'*<>]", "", w) for w in lemmas]
    return dict(Counter(w for w in clean if w))


def query_lemmas(q: str, lemma_of: dict[str, str] | None = None) -> list[str]:
    """Lemmas of a query's letter tokens: dictionary lemmas, others in lower case."""
    tokens = re.findall(r"[^\W\d_]+", q.lower())
    return [w for t in tokens for w in (lemma_of or {}).get(t, t).split()]


def tier(m: Column, n: int) -> Column:
    """0: all lemmas; 1: all but one, for three to eight lemmas; 2: any."""
    one_less = (m == n - 1) & F.lit(3 <= n <= 8)
    return F.when(m == n, 0).when(one_less, 1).otherwise(2)


def should_relax(strict: int, n: int, below: int = RELAX_BELOW) -> bool:
    return n >= 2 and below > 0 and strict < below


def matched(index: DataFrame, query: dict[str, int], key: str | list[str] = "doc_id") -> DataFrame:
    """key, m (weight of the lemmas held) and doc_rank of the strict query, from an inverted index."""
    keys = [key] if isinstance(key, str) else key
    weight = F.create_map(*(F.lit(x) for kv in query.items() for x in kv))
    rows = index.where(F.col("lemma").isin(list(query)))
    part = weight[F.col("lemma")] * (1 + F.ln(F.col("tf").cast("double")))
    rows = rows.groupBy(*keys).agg(F.sum(weight[F.col("lemma")]).cast("int").alias("m"), F.sum(part).alias("_s"))
    # rounded, so that equal scores stay equal whatever the order of summing
    return rows.withColumn("rank", F.round(F.col("_s") / (F.col("_s") + 1), 9)).drop("_s")


def tiered(docs: DataFrame, index: DataFrame, request: Request, lemmas: list[str]) -> tuple[DataFrame, int, bool]:
    """Candidates (doc_id, tier, doc_rank, document_date), the strict total, and whether the search was widened."""
    query = weights(lemmas)
    n = sum(query.values())
    allowed = docs.where(request.filters()).select("doc_id", "document_date")
    held = matched(index, query).join(allowed, "doc_id")
    strict = held.where(F.col("m") == n).count()
    relaxed = should_relax(strict, n, request.relax_below)
    found = held.withColumn("tier", tier(F.col("m"), n)).withColumn("doc_rank", F.when(F.col("m") == n, F.col("rank")).otherwise(F.lit(0.0)))
    if not relaxed:
        order = [F.desc("doc_rank"), F.asc("doc_id")] if request.sort == "relevance" else C.rank_order(request.strategy, request.sort)
        return found.where("tier = 0").orderBy(*order).limit(CANDIDATES).select("doc_id", "tier", "doc_rank", "document_date"), strict, False
    return relaxed_cut(found, request.sort).select("doc_id", "tier", "doc_rank", "document_date"), strict, True


def relaxed_cut(found: DataFrame, sort: str = "relevance", date: str = "document_date") -> DataFrame:
    """The first RELAX_CAP rows by tier and date (T5): the newest of each, or the oldest when asked for.

    A tier can't fill more of the cut than the cut holds, so its own cap needs no window.
    """
    day = F.asc_nulls_last(date) if sort == "oldest" else F.desc_nulls_last(date)
    return found.orderBy("tier", day, "doc_id").limit(RELAX_CAP)


def best_passages(candidates: DataFrame, passage_index: DataFrame, query: dict[str, int]) -> DataFrame:
    """candidates with best_rank, match_count, best_ordinal and colocated.

    A document with passages that hold every lemma counts only those; others count the
    passages that hold any.  Documents without a passage drop out.
    """
    n = sum(query.values())
    hits = matched(passage_index, query, ["doc_id", "ordinal"]).join(candidates, "doc_id")
    every = F.col("m") == n
    whole = Window.partitionBy("doc_id")
    kept = hits.withColumn("colocated", F.max(every).over(whole)).where(every | ~F.col("colocated"))
    best = F.max_by("ordinal", F.struct(F.col("rank"), -F.col("ordinal"))).alias("best_ordinal")
    return kept.groupBy("doc_id", "tier", "doc_rank", "document_date", "colocated").agg(F.max("rank").alias("best_rank"), F.count("*").alias("match_count"), best)


@dataclass
class Results:
    page: DataFrame
    total: int
    strict_total: int
    relaxed: bool


def keyword_search(docs: DataFrame, index: DataFrame, passage_index: DataFrame, request: Request, lemma_of: dict[str, str] | None = None) -> Results:
    """One page of hits; passage_index has section_kind when sections are asked for."""
    lemmas = query_lemmas(request.q, lemma_of)
    if request.provision and set(lemmas) <= NOISE:
        lemmas = []
    if not lemmas:
        return browse(docs.where(request.filters()), request)
    candidates, strict, relaxed = tiered(docs, index, request, lemmas)
    own = passage_index.where(F.col("section_kind").isin(request.section_kinds)) if request.section_kinds else passage_index
    hits = best_passages(candidates, own, weights(lemmas))
    total = hits.count() if relaxed or request.section_kinds else strict
    return Results(paged(hits.orderBy(*C.rank_order(request.strategy, request.sort)), request.page, request.size), total, strict, relaxed)


def browse(found: DataFrame, request: Request) -> Results:
    total = found.count()
    order = C.rank_order(request.strategy, "newest" if request.sort == "relevance" else request.sort)
    return Results(paged(found.orderBy(*order), request.page, request.size), total, total, False)


def paged(ordered: DataFrame, page: int, size: int) -> DataFrame:
    return ordered.offset((max(1, page) - 1) * size).limit(size)


def within(first: Column, second: Column, n: int) -> Column:
    """Some positions of the two arrays differ by 1 to n, in either order: one lookup for each place near the second."""
    near = F.flatten(F.transform(second, lambda b: F.filter(F.sequence(b - n, b + n), lambda x: x != b)))
    return F.arrays_overlap(first, near)


def proximity(index: DataFrame, lemmas: list[str], n: int, key: str | list[str] = "doc_id") -> DataFrame:
    """Keys whose consecutive lemmas all stand within n positions of each other; one lemma only needs to occur."""
    distinct, keys = list(dict.fromkeys(lemmas)), [key] if isinstance(key, str) else key
    at = {w: F.max(F.when(F.col("lemma") == w, F.col("positions"))).alias(f"p{k}") for k, w in enumerate(distinct)}
    rows = index.where(F.col("lemma").isin(distinct)).groupBy(*keys).agg(*at.values())
    for k in range(len(distinct)):
        rows = rows.where(F.col(f"p{k}").isNotNull())
    for a, b in zip(lemmas, lemmas[1:]):
        rows = rows.where(within(F.col(f"p{distinct.index(a)}"), F.col(f"p{distinct.index(b)}"), n))
    return rows.select(*keys)


def field_column(name: str) -> Column:
    """A searchable field as text; parties and keywords as their JSON."""
    if name == "parties":
        return F.concat(F.coalesce(F.to_json("plaintiffs"), F.lit("")), F.lit(" "), F.coalesce(F.to_json("defendants"), F.lit("")))
    return F.to_json("keywords") if name == "keywords" else F.col(name)


def text_filter(mode: str, q: str, fields: list[str]) -> Column:
    """exact, prefix, substring: every word in some field; any: one of them; regex: the pattern in some field.

    Fields that don't exist are left out; without any field there is no restriction.
    """
    cols = [field_column(f) for f in fields if f in FIELDS]
    anywhere = lambda pattern: F.coalesce(_any(c.rlike(pattern) for c in cols), F.lit(False))
    words = q.split()
    if not cols or mode != "regex" and not words:
        return F.lit(True)
    if mode == "regex":
        return anywhere(C.java_regex(q))
    if mode == "any":
        return anywhere("(?iu)(" + "|".join(C.java_literal(w) for w in words) + ")")
    out = F.lit(True)
    for w in words:
        out = out & anywhere(C.word_pattern(w, mode))
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def search(docs: DataFrame, index: DataFrame, passage_index: DataFrame, request: Request, lemma_of: dict[str, str] | None = None) -> Results:
    """Any mode."""
    if request.mode == "keyword":
        return keyword_search(docs, index, passage_index, request, lemma_of)
    if request.mode == "proximity":
        lemmas = query_lemmas(request.q, lemma_of)
        found = docs.where(request.filters())
        if lemmas and request.section_kinds:  # then one passage of those kinds must hold them
            own = passage_index.where(F.col("section_kind").isin(request.section_kinds))
            near = proximity(own, lemmas, request.within, ["doc_id", "ordinal"])
        elif lemmas:
            near = proximity(index, lemmas, request.within)
        return browse(found.join(near, "doc_id", "left_semi") if lemmas else found, request)
    return browse(docs.where(request.filters() & text_filter(request.mode, request.q, request.fields)), request)


def facets(found: DataFrame, source: str = "source_short", verdict: str = "verdict_type") -> tuple[DataFrame, DataFrame]:
    """Counts by source, and by source and verdict type (known ones)."""
    fine = found.groupBy(source, verdict).agg(F.count("*").alias("n"))
    return fine.groupBy(source).agg(F.sum("n").alias("n")), fine.where(F.col(verdict).isNotNull())


def closure(tree: list[dict]) -> list[tuple[str, str, str | None]]:
    """(key, source, verdict type or None) for every node: what its count adds up."""
    return sorted({(key, s, v) for key, own in leaves(tree).items() for leaf in own for s in leaf.get("sources", []) for v in leaf.get("verdict_types") or [None]}, key=str)


def scope_counts(found: DataFrame, tree: list[dict], source: str = "source_short", verdict: str = "verdict_type") -> DataFrame:
    """Count of every node of the scope tree; nodes without documents count 0."""
    fine = found.groupBy(source, verdict).agg(F.count("*").alias("_n"))
    nodes = found.sparkSession.createDataFrame(closure(tree), "key string, _source string, _verdict string")
    hit = (F.col(source) == F.col("_source")) & (F.col("_verdict").isNull() | (F.col("_verdict") == F.col(verdict)))
    return F.broadcast(nodes).join(fine, hit, "left").groupBy("key").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def passage_window(passages: DataFrame, doc_id, lo: int, hi: int, section_kinds: list[str] | None = None, layer: str | None = None, most: int = 200) -> DataFrame:
    """A document's passages with lo <= ordinal <= hi, in order."""
    if lo < 0 or hi < lo or hi - lo >= most:
        raise SearchError(f"the window must have 1 to {most} passages")
    if layer is not None and layer not in C.LAYERS:
        raise SearchError(f"no layer {layer!r}")
    if section_kinds and (wrong := set(section_kinds) - set(C.SECTION_KINDS)):
        raise SearchError(f"no section kind {sorted(wrong)}")
    rows = passages.where((F.col("doc_id") == doc_id) & F.col("ordinal").between(lo, hi))
    if section_kinds:
        rows = rows.where(F.col("section_kind").isin(section_kinds))
    if layer:
        rows = rows.where(F.col("layer") == layer)
    return rows.orderBy("ordinal")


def passage_context(passages: DataFrame, doc_id, ordinal: int, before: int = 2, after: int = 2) -> DataFrame:
    before, after = min(10, max(0, before)), min(10, max(0, after))
    return passage_window(passages, doc_id, max(0, ordinal - before), ordinal + after)


def sections(passages: DataFrame) -> DataFrame:
    """Sections of all documents with their first and last passage."""
    return passages.groupBy("doc_id", "layer", "section_kind").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"))


def outline(passages: DataFrame, doc_id) -> DataFrame:
    """Sections of a document, in order."""
    return sections(passages.where(F.col("doc_id") == doc_id)).drop("doc_id").orderBy("first")


def next_ordinal(passages: DataFrame, doc_id, lo: int, section_kinds: list[str] | None = None, layer: str | None = None) -> DataFrame:
    """The least ordinal from lo on that passes the filters, or null: where the next page begins."""
    rows = passages.where((F.col("doc_id") == doc_id) & (F.col("ordinal") >= lo))
    if section_kinds:
        rows = rows.where(F.col("section_kind").isin(section_kinds))
    if layer:
        rows = rows.where(F.col("layer") == layer)
    return rows.agg(F.min("ordinal").alias("ordinal"))


#: Characters of each text that a snippet is looked for in.
SNIPPET_HEAD = 100_000


def with_snippets(page: DataFrame, docs: DataFrame, passages: DataFrame, request: Request, lemma_of: dict[str, str] | None = None) -> DataFrame:
    """A page of hits with citation, anchor and snippet.

    Keyword hits show the best passage, its wanted words marked; other modes show the first
    match in the text, or how it begins.  A page has at most PAGE_MOST rows.
    """
    from .builders import per_document

    c = F.col
    cite = C.ruling_citation(c("court"), c("case_number"), c("document_date"), c("verdict_type"))
    if "best_ordinal" in page.columns:
        wanted = set(query_lemmas(request.q, lemma_of))
        label = C.anchor(c("layer"), c("para_from"), c("para_to"), c("section_path"), c("ordinal"), c("page_from"), c("page_to"))
        own = passages.select("doc_id", "text", label.alias("anchor"), F.col("ordinal").alias("best_ordinal"))
        rows = page.select("doc_id", "best_ordinal").join(own, ["doc_id", "best_ordinal"]).join(docs.select("doc_id", cite.alias("citation")), "doc_id")
        mark = lambda d: headline(d["text"], wanted, lemma_of=lemma_of)
    else:
        head = F.concat_ws("\n", F.left("body_text", F.lit(SNIPPET_HEAD)), F.left("lower_body_text", F.lit(SNIPPET_HEAD)))
        rows = page.select("doc_id", head.alias("text"), "summary", F.lit(None).cast("string").alias("anchor"), cite.alias("citation"))
        words = [re.escape(w) for w in request.q.split()]
        pattern = re.compile(re.sub(r"\\[mM]", r"\\b", request.q) if request.mode == "regex" else "|".join(words) or "(?!)", re.I)
        mark = lambda d: snippet(d["text"], pattern, d["summary"])
    return per_document(rows, lambda d: [{"doc_id": d["doc_id"], "citation": d["citation"], "anchor": d["anchor"], "snippet": mark(d)}], "doc_id string, citation string, anchor string, snippet string").drop("error")


def catalog(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Every source with its number of documents, 0 included."""
    n = docs.groupBy(F.col("source_short").alias("short_name")).agg(F.count("*").alias("n"))
    return sources.join(n, "short_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def provision_of(statutes: DataFrame, law: str, gr: int, sfx: str | None = None, mgr: int | None = None) -> DataFrame:
    """Text of an article, or of one of its paragraphs, from nested provisions."""
    same = lambda p: (p["num"] == gr) & F.coalesce(p["suffix"], F.lit("")).eqNullSafe(F.lit(sfx or ""))
    article = F.get(F.filter("provisions", same), F.lit(0))
    text = article["text"] if mgr is None else F.get(F.filter(article["sub"], lambda s: s["num"] == mgr), F.lit(0))["text"]
    return statutes.where(F.col("law") == law).select("law", F.lit(gr).alias("gr"), text.alias("text")).where(F.col("text").isNotNull())
