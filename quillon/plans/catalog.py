"""The registered queries over the driver's tables, and the SQL they are checked against.

A query is a function of (spark, sf_dir); the SQL of the same name is its oracle.  The
documents table stands for documents, its source for publishers and its lang for verdict
types; conversations stand for documents' passages, lineitem and orders for edges and
dated facts.  Queries without SQL run text rules that no SQL expresses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import builders, graph, merge, quality, search, sqlguard
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = ["the", "of", "that", "from"]
TREE = [
    {"key": "north", "children": [{"key": "north_en", "sources": ["src0", "src1", "src2"], "verdict_types": ["en"]}, {"key": "north_rest", "sources": ["src3", "src4"]}]},
    {"key": "south", "children": [{"key": "south_de", "sources": ["src5"], "verdict_types": ["de", "fr"]}, {"key": "south_none", "sources": ["missing"]}]},
    {"key": "east", "sources": ["src6", "src7"]},
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents under the names the search operators use."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_short"), F.col("lang").alias("verdict_type"), "n_chars")


def held(words: list[str] = WORDS) -> DataFrame:
    """m of the query's words per document, map-side: no explode and no shuffle."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))


LISTED = ", ".join(f"'{w}'" for w in WORDS)
TOKENS_SQL = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}]+'))"


@query(f"SELECT lang AS verdict_type, CAST(count(*) AS BIGINT) AS strict_total FROM documents WHERE len(list_intersect({TOKENS_SQL}, [{LISTED}])) = 4 GROUP BY 1")
def keyword_strict_count(spark, sf_dir):
    return documents(spark, sf_dir).where(held() == len(WORDS)).groupBy("verdict_type").agg(F.count("*").alias("strict_total"))


@query(
    f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents),
    t0 AS (SELECT doc_id, 0 AS tier FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'that') AND list_contains(w, 'from')),
    t1 AS (SELECT doc_id, 1 AS tier FROM t WHERE doc_id NOT IN (SELECT doc_id FROM t0) AND (
        (list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'that')) OR (list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'from'))
        OR (list_contains(w, 'the') AND list_contains(w, 'that') AND list_contains(w, 'from')) OR (list_contains(w, 'of') AND list_contains(w, 'that') AND list_contains(w, 'from')))),
    t2 AS (SELECT doc_id, 2 AS tier FROM t WHERE doc_id NOT IN (SELECT doc_id FROM t0) AND doc_id NOT IN (SELECT doc_id FROM t1)
        AND (list_contains(w, 'the') OR list_contains(w, 'of') OR list_contains(w, 'that') OR list_contains(w, 'from')))
    SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2"""
)
def keyword_tiered(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("m", held()).where("m > 0")
    return rows.select("doc_id", search.tier(F.col("m"), len(WORDS)).alias("tier"))


@query(
    f"""WITH t AS (SELECT doc_id, n_chars, len(list_intersect({TOKENS_SQL}, [{LISTED}])) AS m FROM documents),
    r AS (SELECT doc_id, n_chars, CASE m WHEN 4 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS tier FROM t WHERE m > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM r)
    SELECT doc_id, tier FROM k WHERE tier = 0 OR k <= 300 ORDER BY tier, n_chars DESC NULLS LAST, doc_id LIMIT 300"""
)
def keyword_relaxed_page(spark, sf_dir):
    """The relaxed candidate cut: 300 a tier by date, then 300 in all (the cut is the operator)."""
    rows = documents(spark, sf_dir).withColumn("m", held()).where("m > 0").withColumn("tier", search.tier(F.col("m"), len(WORDS)))
    return search.relaxed_cut(rows, date="n_chars").select("doc_id", "tier")


@query(f"SELECT source AS source_short, count(*) FILTER (WHERE len(list_intersect({TOKENS_SQL}, [{LISTED}])) = 4) < 10 AS relax FROM documents GROUP BY 1")
def relax_decision(spark, sf_dir):
    rows = documents(spark, sf_dir).groupBy("source_short").agg(F.count_if(held() == len(WORDS)).alias("n"))
    return rows.select("source_short", (F.col("n") < search.RELAX_BELOW).alias("relax"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}]+') AS w FROM documents),
    p AS (SELECT doc_id, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'of') AS b, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'that') AS c FROM t),
    n AS (SELECT doc_id, a, b, flatten(list_transform(b, lambda x: [x - 3, x - 2, x - 1, x + 1, x + 2, x + 3])) AS near_b, flatten(list_transform(c, lambda x: [x - 3, x - 2, x - 1, x + 1, x + 2, x + 3])) AS near_c FROM p)
    SELECT doc_id FROM n WHERE len(list_intersect(a, near_b)) > 0 AND len(list_intersect(b, near_c)) > 0"""
)
def proximity_within_n(spark, sf_dir):
    """Positions of the query's words only are kept, inside each row: no explode and no shuffle."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.alias("w"))
    at = lambda word: F.filter(F.transform("w", lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", at("the").alias("a"), at("of").alias("b"), at("that").alias("c"))
    return rows.where(search.within(F.col("a"), F.col("b"), 3) & search.within(F.col("b"), F.col("c"), 3)).select("doc_id")


NOT_WORD, WORD_END = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{NOT_WORD}thin{WORD_END}', 'i') AND regexp_matches(text, '{NOT_WORD}with{WORD_END}', 'i')")
def exact_words(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.where(F.col("text").rlike(C.word_pattern("thin", "exact")) & F.col("text").rlike(C.word_pattern("with", "exact"))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{NOT_WORD}que', 'i')")
def prefix_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(C.word_pattern("que", "prefix"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tionst') OR contains(lower(source), 'src1')")
def substring_any_field(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.where(F.contains(F.lower("text"), F.lit("tionst")) | F.contains(F.lower("source"), F.lit("src1"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(idiot|sch[aeiou]+n|ción\\s+de)', 'i')")
def regex_alternatives(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumnRenamed("text", "body_text")
    return rows.where(search.text_filter("regex", r"(idiot|sch[aeiou]+n|ción\s+de)", ["body_text"])).select("doc_id")


@query("SELECT source AS source_short, lang AS verdict_type, CAST(count(*) AS BIGINT) AS n FROM documents WHERE contains(lower(text), 'the') GROUP BY 1, 2")
def scope_facets(spark, sf_dir):
    return search.facets(documents(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("the"))))[1]


@query(
    """SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT 'north_en' AS key, count(*) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2') AND lang = 'en'
    UNION ALL SELECT 'north_rest', count(*) FROM documents WHERE source IN ('src3', 'src4')
    UNION ALL SELECT 'north', count(*) FROM documents WHERE source IN ('src0', 'src1', 'src2') AND lang = 'en'
    UNION ALL SELECT 'north', count(*) FROM documents WHERE source IN ('src3', 'src4')
    UNION ALL SELECT 'south_de', count(*) FROM documents WHERE source = 'src5' AND lang IN ('de', 'fr')
    UNION ALL SELECT 'south', count(*) FROM documents WHERE source = 'src5' AND lang IN ('de', 'fr')
    UNION ALL SELECT 'south_none', 0 UNION ALL SELECT 'east', count(*) FROM documents WHERE source IN ('src6', 'src7')) GROUP BY key"""
)
def scope_rollup(spark, sf_dir):
    return search.scope_counts(documents(spark, sf_dir), TREE)


@query("SELECT doc_id FROM documents WHERE source IN ('src3', 'src4', 'src6', 'src7') OR (source IN ('src0', 'src1', 'src2') AND lang = 'en')")
def scope_filter(spark, sf_dir):
    scope = search.resolve_scope(TREE, ["north_en", "north_rest", "east", "unknown"])
    return documents(spark, sf_dir).where(scope.column()).select("doc_id")


@query("SELECT s.short_name, CAST(count(d.doc_id) AS BIGINT) AS n FROM (SELECT 'src' || i AS short_name FROM range(25) t(i)) s LEFT JOIN documents d ON d.source = s.short_name GROUP BY 1")
def source_catalog(spark, sf_dir):
    sources = spark.range(25).select(F.concat(F.lit("src"), F.col("id")).alias("short_name"))
    return search.catalog(sources, documents(spark, sf_dir))


PASSAGE_WORDS = {"the": 1, "of": 1, "in": 2}


@query(
    r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS lemma FROM conversations),
    q AS (SELECT * FROM (VALUES ('the', 1), ('of', 1), ('in', 2)) v(lemma, weight)),
    c AS (SELECT conv_id, turn, lemma, weight, count(*) AS tf FROM t JOIN q USING (lemma) GROUP BY ALL),
    r AS (SELECT conv_id, turn, sum(weight) AS m, sum(weight * (1 + ln(tf))) AS s FROM c GROUP BY ALL),
    p AS (SELECT conv_id, turn, m, s / (s + 1) AS rank, bool_or(m = 4) OVER (PARTITION BY conv_id) AS colocated FROM r),
    k AS (SELECT * FROM p WHERE m = 4 OR NOT colocated),
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(rank, 9) DESC, turn) AS pos FROM k)
    SELECT conv_id AS doc_id, bool_or(colocated) AS colocated, round(max(rank), 6) AS best_rank, CAST(count(*) AS BIGINT) AS match_count, min(turn) FILTER (WHERE pos = 1) AS best_ordinal FROM b GROUP BY 1"""
)
def passage_best_per_doc(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), "text")
    index = builders.doc_lemmas(rows.withColumn("key", F.struct("doc_id", "ordinal")), key="key").select("key.doc_id", "key.ordinal", "lemma", "tf")
    everyone = rows.select("doc_id").distinct().select("doc_id", F.lit(0).alias("tier"), F.lit(0.0).alias("doc_rank"), F.lit(None).cast("date").alias("document_date"))
    hits = search.best_passages(everyone, index, PASSAGE_WORDS)
    return hits.select("doc_id", "colocated", F.round("best_rank", 6).alias("best_rank"), "match_count", "best_ordinal")


@query(
    """SELECT c.conv_id AS doc_id, c.turn AS hit, n.turn AS ordinal, n.role FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn BETWEEN c.turn - 1 AND c.turn + 1
    WHERE contains(c.text, 'from')"""
)
def passage_context(spark, sf_dir):
    """Neighbours of every hit by exploding the hit's window and joining on (document, ordinal)."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    hits = rows.where(F.contains("text", F.lit("from"))).select("doc_id", F.col("turn").alias("hit"), F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("ordinal"))
    return hits.join(rows.select("doc_id", F.col("turn").alias("ordinal"), "role"), ["doc_id", "ordinal"]).select("doc_id", "hit", "ordinal", "role")


@query("SELECT conv_id AS doc_id, role AS section_kind, min(turn) AS first, max(turn) AS last, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1, 2")
def doc_outline(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("body").alias("layer"), F.col("role").alias("section_kind"), F.col("turn").alias("ordinal"))
    return search.sections(rows).drop("layer")


@query(
    """SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def asof_passage(spark, sf_dir):
    """The last view at or before each purchase of a user: views as passages, purchases as citations."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.lit("body").alias("layer"), F.col("ts").alias("char_start"))
    views = rows.where("event_type = 'view'").select(F.col("user_id").alias("doc_id"), "layer", "char_start", F.col("event_id").alias("ordinal"))
    bought = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("from_doc_id"), "layer", "char_start", "event_id")
    return graph.passage_of_citation(bought, views, ["event_id"]).select("event_id", F.col("ordinal").alias("view_id"))


@query(
    """SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber FROM lineitem
    ORDER BY l_partkey, (l_returnflag = 'R') DESC, l_shipdate, l_orderkey, l_linenumber, l_suppkey"""
)
def distinct_on_citation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    order = [F.desc(F.col("l_returnflag") == "R"), *map(F.asc, ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"))]
    return quality.keep_newest(rows, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    """SELECT o_orderkey, CAST(total AS BIGINT) AS total FROM (SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F')
    ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50"""
)
def citation_page_with_total(spark, sf_dir):
    """Page two of a dated list with its total: the total is one aggregate, not an unpartitioned window."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    total = rows.agg(F.count("*").alias("total"))
    page = search.paged(rows.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey"), 2, 50)
    return page.select("o_orderkey").crossJoin(F.broadcast(total))


@query("SELECT p_partkey AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS cited_by FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def in_degree(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("to_doc_id"))
    return graph.in_degree(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id")), edges)


@query("SELECT l_suppkey AS from_doc_id, l_partkey AS to_doc_id, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2")
def edge_max_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("from_doc_id"), F.col("l_partkey").alias("to_doc_id"), F.col("l_discount").alias("confidence"))
    return graph.cites_edges(rows.withColumns({"status": F.lit("resolved"), "layer": F.lit("body")})).select("from_doc_id", "to_doc_id", "confidence")


NATION_EDGES_SQL = """SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_returnflag = 'R' AND l_discount >= 0.08"""


def nation_edges(spark, sf_dir) -> DataFrame:
    """Edges between nations: dimensions are joined to the filtered lines, then made distinct."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_returnflag = 'R' and l_discount >= 0.08").select("l_orderkey", "l_suppkey")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()


@query(f"WITH e AS ({NATION_EDGES_SQL}) SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e m WHERE m.a = e.b AND m.b = e.a)")
def mirror_edge_missing(spark, sf_dir):
    e = nation_edges(spark, sf_dir)
    return e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")


@query(f"WITH e AS ({NATION_EDGES_SQL}) SELECT DISTINCT x.a, y.b FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM e d WHERE d.a = x.a AND d.b = y.b)")
def chain_two_hop(spark, sf_dir):
    e = nation_edges(spark, sf_dir).select(F.col("a").alias("from_doc_id"), F.col("b").alias("to_doc_id"), F.lit("appealed_to").alias("relation"))
    return graph.chained(e).select(F.col("from_doc_id").alias("a"), F.col("to_doc_id").alias("b"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def later_dated_edge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_suppkey, l_partkey, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def dup_relation_pair(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n > 1")


@query("SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 14")
def range_window_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return graph.near_in_time(rows, "o_custkey", "o_orderkey", "day", 14)


@query(
    r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM conversations),
    c AS (SELECT conv_id, turn, w, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT conv_id, turn, sum(n) AS total FROM c GROUP BY ALL)
    SELECT a.conv_id, a.turn, round(sum(least(a.n, b.n)) / least(any_value(x.total), any_value(y.total)), 4) AS overlap
    FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w JOIN s x ON x.conv_id = a.conv_id AND x.turn = a.turn JOIN s y ON y.conv_id = a.conv_id AND y.turn = a.turn + 1 GROUP BY 1, 2"""
)
def overlap_coefficient(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    both = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(graph.multiset_overlap(F.col("w"), F.col("v")), 4).alias("overlap")).where("overlap > 0")


@query("SELECT md5(text) AS key, max(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedupe_keep_newest(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("key")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


@query(
    r"""WITH w AS (SELECT conv_id AS file, turn AS page, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations),
    g AS (SELECT DISTINCT file, page, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3),
    size AS (SELECT file, page, count(*) AS n FROM g GROUP BY ALL), whole AS (SELECT DISTINCT file, gram FROM g), total AS (SELECT file, count(*) AS n FROM whole GROUP BY 1),
    common AS (SELECT g.file, g.page, whole.file AS inside, count(*) AS common FROM g JOIN whole ON g.gram = whole.gram AND g.file <> whole.file GROUP BY ALL),
    hit AS (SELECT common.file, inside, count(*) AS n FROM common JOIN size USING (file, page) WHERE common >= 0.02 * n GROUP BY ALL), pages AS (SELECT file, count(*) AS pages FROM size GROUP BY 1)
    SELECT hit.file, hit.inside, CAST(hit.n AS BIGINT) AS n FROM hit JOIN pages USING (file) JOIN total a ON a.file = hit.file JOIN total b ON b.file = hit.inside WHERE hit.n >= 0.2 * pages AND a.n <= b.n"""
)
def near_dup_containment(spark, sf_dir):
    return quality.containment(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page"), "text"), share=0.02, file_share=0.2)


@query(
    """WITH f AS (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS b FROM conversations GROUP BY 1)
    SELECT conv_id FROM f WHERE md5(coalesce(a, '') || chr(31)) IS DISTINCT FROM md5(coalesce(b, '') || chr(31))"""
)
def stale_by_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    none = F.lit(None).cast("string")
    return rows.where(C.is_stale(C.text_hash(F.col("a"), none), F.col("b"), none)).select("conv_id")


EVENT_STATE = """SELECT user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = '{}') WHERE k = 1"""


def state(spark, sf_dir, kind: str) -> DataFrame:
    """The newest event of a kind for each user."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("user_id", "x.ts", "x.event_id", "x.value")


@query(f"WITH o AS ({EVENT_STATE.format('view')}), n AS ({EVENT_STATE.format('click')}) SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id FROM o FULL JOIN n ON o.user_id = n.user_id")
def upsert_newest_wins(spark, sf_dir):
    return merge.upsert(state(spark, sf_dir, "view"), state(spark, sf_dir, "click"), ["user_id"], "ts").select("user_id", "event_id")


@query(
    f"""WITH o AS (SELECT user_id, event_id, CASE WHEN value > 10 THEN value END AS value FROM ({EVENT_STATE.format('view')})), n AS ({EVENT_STATE.format('click')})
    SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id, coalesce(o.value, n.value) AS value FROM o FULL JOIN n ON o.user_id = n.user_id"""
)
def fill_never_overwrite(spark, sf_dir):
    old = state(spark, sf_dir, "view").withColumn("value", F.when(F.col("value") > 10, F.col("value")))
    return merge.upsert(old, state(spark, sf_dir, "click"), ["user_id"], "ts", fill=["value"]).select("user_id", "event_id", "value")


@query("SELECT c_nationkey AS nation, 'customer' AS side FROM customer WHERE c_acctbal < 0 GROUP BY 1 UNION ALL SELECT n_nationkey, 'nation' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")).distinct().withColumn("side", F.lit("customer"))
    return merge.insert_ignore(old, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.lit("nation").alias("side")), ["nation"])


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def new_ids(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").select("o_orderkey")
    return merge.new_ids(listed, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT doc_id FROM labels WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.lang = 'en')")
def prune_to_wanted(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").where("lang = 'en'")
    return merge.prune(table(spark, sf_dir, "labels"), wanted, ["doc_id"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN k = 1 THEN source ELSE source || '-' || k END AS external_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def external_ids(spark, sf_dir):
    return merge.suffixed(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], "external_id").select("doc_id", "external_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")).where("k >= 50")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def json_expand(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.explode(F.json_object_keys("props")).alias("key")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT id, json_merge_patch(coalesce(old_json, '{}'), coalesce(new_json, '{}'))::VARCHAR AS merged FROM (" + fx.MERGES + ")")
def json_merge(spark, sf_dir):
    return spark.sql(fx.MERGES).select("id", merge.merge_json(F.col("old_json"), F.col("new_json")).alias("merged"))


@query("SELECT source AS source_short, CAST(count(*) AS BIGINT) AS with_text, CAST(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS BIGINT) AS with_passages FROM documents WHERE text IS NOT NULL GROUP BY 1")
def coverage_filter_counts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source_short", F.col("text").alias("body_text"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("lower_body_text"))
    return quality.coverage(docs, table(spark, sf_dir, "labels").select("doc_id"))


@query(
    """WITH r AS (SELECT source AS question, doc_id AS doc, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    e AS (SELECT d.source AS question, d.doc_id AS doc FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 GROUP BY ALL),
    h AS (SELECT e.question, min(rank) AS first, count(DISTINCT r.doc) AS found FROM e JOIN r ON r.question = e.question AND r.doc = e.doc AND rank <= 10 GROUP BY 1),
    q AS (SELECT e.question, count(*) AS wanted, any_value(h.first) AS first, any_value(h.found) AS found FROM e LEFT JOIN h ON h.question = e.question GROUP BY 1),
    t AS (SELECT question, max(n_chars) AS ms FROM r GROUP BY 1)
    SELECT round(avg(coalesce(found, 0) / wanted), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, median(ms) AS p50,
        list_sort(list(ms))[CAST(floor(0.95 * (count(ms) - 1)) AS INT) + 1] AS p95, CAST(0 AS BIGINT) AS zero FROM q JOIN t USING (question)"""
)
def eval_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    results = docs.select(F.col("source").alias("question"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("ms"), F.row_number().over(order).alias("rank"))
    expected = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(F.col("source").alias("question"), F.col("doc_id").alias("doc"))
    m = quality.retrieval_metrics(results, expected)
    return m.select(F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round("hit1", 6).alias("hit1"), "p50", "p95", "zero")


@query(
    " UNION ALL ".join(
        f"SELECT '{s}' AS strategy, doc_id, CAST(row_number() OVER (ORDER BY tier, {', '.join(f'round({e}, 9) DESC' if e not in ('colocated',) else f'{e} DESC' for e in sqls)}, document_date DESC NULLS LAST, doc_id) AS BIGINT) AS place FROM ({fx.HITS})"
        for s, sqls in {
            "tiered": ["colocated", "best_rank", "match_count"],
            "passage": ["best_rank", "match_count"],
            "doc": ["doc_rank", "best_rank"],
            "blend": ["doc_rank + best_rank", "match_count"],
            "blend_coloc": ["doc_rank + best_rank + CASE WHEN colocated THEN 0.25 ELSE 0 END", "match_count"],
            "breadth": ["doc_rank + best_rank * ln(1 + match_count)"],
            "breadth_coloc": ["doc_rank + best_rank * ln(1 + match_count) + CASE WHEN colocated THEN 0.25 ELSE 0 END"],
        }.items()
    )
)
def rank_strategies(spark, sf_dir):
    hits = spark.sql(fx.HITS)
    out = None
    for s in C.RANKS:
        rows = hits.withColumn("strategy", F.lit(s)).withColumn("place", F.row_number().over(Window.partitionBy("strategy").orderBy(*C.rank_order(s))).cast("long")).select("strategy", "doc_id", "place")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(r"SELECT number, nullif(regexp_replace(regexp_replace(upper(regexp_replace(number, '\s+', '', 'g')), '^([A-ZÞÆÖ]{1,2}-)?0+([0-9])', '\1\2'), '^$', ''), '') AS norm FROM (" + fx.NUMBERS + ")")
def norm_case_number(spark, sf_dir):
    return spark.sql(fx.NUMBERS).select("number", C.norm_case_number(F.col("number")).alias("norm"))


@query(
    """SELECT ordinal, CASE WHEN layer = 'summary' THEN 'Reifun' WHEN para_from IS NOT NULL AND para_from = para_to THEN para_from || '. mgr.' WHEN para_from IS NOT NULL AND para_to IS NOT NULL THEN para_from || '.–' || para_to || '. mgr.'
    WHEN page_from IS NOT NULL AND coalesce(page_to, page_from) = page_from THEN 'bls. ' || page_from WHEN page_from IS NOT NULL THEN 'bls. ' || page_from || '–' || page_to
    WHEN coalesce(section_path, '') <> '' THEN section_path ELSE 'hluti ' || (ordinal + 1) END AS label FROM (""" + fx.ANCHORS + ")"
)
def anchor_label(spark, sf_dir):
    c = F.col
    return spark.sql(fx.ANCHORS).select("ordinal", C.anchor(c("layer"), c("para_from"), c("para_to"), c("section_path"), c("ordinal"), c("page_from"), c("page_to")).alias("label"))


@query(
    """SELECT doc_id, concat_ws(' ', court, case_number, CASE WHEN document_date IS NOT NULL THEN day(document_date) || '. ' ||
    ['janúar', 'febrúar', 'mars', 'apríl', 'maí', 'júní', 'júlí', 'ágúst', 'september', 'október', 'nóvember', 'desember'][month(document_date)] || ' ' || year(document_date) END) || coalesce(' – ' || verdict_type, '') AS citation FROM (""" + fx.RULINGS + ")"
)
def citation_string(spark, sf_dir):
    c = F.col
    return spark.sql(fx.RULINGS).select("doc_id", C.ruling_citation(c("court"), c("case_number"), c("document_date"), c("verdict_type")).alias("citation"))


@query(
    """WITH d AS (""" + fx.DOCUMENT_ROWS + r"""), y AS (SELECT *, year(document_date) - coalesce(try_cast(nullif(regexp_extract(case_number, '^([0-9]{4})/[0-9]', 1), '') AS INT), try_cast(nullif(regexp_extract(case_number, '/([0-9]{4})$', 1), '') AS INT)) AS late FROM d)
    SELECT doc_id, CAST((case_number IS NULL)::INT + (document_date IS NULL)::INT + coalesce((document_date < DATE '1900-01-01' OR document_date > DATE '2030-01-01')::INT, 0) + coalesce((late < 0)::INT, 0) + coalesce((late >= 6)::INT, 0)
    + (court IS NULL)::INT + coalesce((NOT starts_with(court, 'Hrd.'))::INT, 0) + (verdict_type IS NULL)::INT + coalesce((verdict_type NOT IN ('Dómur', 'Úrskurður'))::INT, 0)
    + (coalesce(body_text, '') = '')::INT + coalesce((body_text <> '' AND length(body_text) < 200)::INT, 0)
    + (coalesce(n_plaintiffs, 0) <= 0 AND coalesce(n_defendants, 0) > 0)::INT + (coalesce(n_defendants, 0) <= 0 AND coalesce(n_plaintiffs, 0) > 0)::INT + (coalesce(n_keywords, 0) <= 0)::INT AS INT) AS errors FROM y"""
)
def validate_rules(spark, sf_dir):
    many = lambda n: F.when(F.col(n).isNotNull(), F.array_repeat(F.lit("x"), F.col(n)))
    rows = spark.sql(fx.DOCUMENT_ROWS).select("*", many("n_plaintiffs").alias("plaintiffs"), many("n_defendants").alias("defendants"), many("n_keywords").alias("keywords"))
    return rows.select("doc_id", F.size(C.validation_errors(C.document_rules(None, "Hrd.", ["Dómur", "Úrskurður"]))).alias("errors"))


@query(
    r"""WITH r AS (""" + fx.RULINGS + r"""), c AS (""" + fx.REFERENCES + r"""), f AS (""" + fx.CITING + r"""),
    i AS (SELECT doc_id, court, regexp_replace(upper(regexp_replace(case_number, '\s+', '', 'g')), '^([A-ZÞÆÖ]{1,2}-)?0+([0-9])', '\1\2') AS num, document_date, verdict_type FROM r WHERE court IS NOT NULL),
    m AS (SELECT c.*, f.document_date AS from_date, i.doc_id AS cand, i.document_date AS cand_date, i.verdict_type AS cand_verdict FROM c LEFT JOIN f ON f.doc_id = c.from_doc_id
        LEFT JOIN i ON c.form <> 'reporter' AND (i.court = c.target_court OR (c.target_court = 'Hérd.' AND starts_with(i.court, 'Hérd. ')))
        AND (i.num = c.target_case_number OR (c.target_court = 'Féld.' AND i.num = 'F-' || c.target_case_number)) AND (f.document_date IS NULL OR i.document_date IS NULL OR i.document_date <= f.document_date)),
    g AS (SELECT from_doc_id, layer, char_start, any_value(target_court) AS court, any_value(target_case_number) AS num, any_value(target_date) AS td, any_value(target_verdict) AS tv, any_value(form) AS form,
        list(cand) FILTER (WHERE cand IS NOT NULL) AS al, list(cand) FILTER (WHERE cand_date = target_date) AS dated, list(cand) FILTER (WHERE cand_verdict = target_verdict) AS spoken FROM m GROUP BY ALL),
    k AS (SELECT *, CASE WHEN td IS NOT NULL THEN dated WHEN tv IS NOT NULL AND len(al) > 1 AND len(spoken) > 0 THEN spoken ELSE al END AS pick,
        CASE WHEN td IS NOT NULL THEN 'casenum_date' WHEN tv IS NOT NULL AND len(al) > 1 AND len(spoken) > 0 THEN 'casenum_verdict' ELSE 'casenum_unique' END AS how FROM g),
    s AS (SELECT *, CASE WHEN form = 'reporter' OR num IS NULL THEN 'pre_coverage' WHEN coalesce(len(al), 0) = 0 AND court = 'Hrd.' AND try_cast(split_part(num, '/', 2) AS INT) < 1999 THEN 'pre_coverage'
        WHEN coalesce(len(al), 0) = 0 OR coalesce(len(pick), 0) = 0 THEN 'unresolved' WHEN len(pick) > 1 THEN 'ambiguous' WHEN pick[1] = from_doc_id THEN 'self' ELSE 'resolved' END AS status FROM k)
    SELECT from_doc_id, layer, char_start, status, CASE WHEN status IN ('resolved', 'self') THEN pick[1] END AS to_doc_id, CASE WHEN status IN ('resolved', 'self') THEN how END AS method,
        CASE WHEN status IN ('resolved', 'self') THEN CASE how WHEN 'casenum_date' THEN 1.0 WHEN 'casenum_verdict' THEN 0.9 ELSE 0.8 END END::DOUBLE AS confidence FROM s"""
)
def resolve_status(spark, sf_dir):
    out = graph.resolve(spark.sql(fx.REFERENCES), graph.citation_index(spark.sql(fx.RULINGS)), spark.sql(fx.CITING))
    return out.select("from_doc_id", "layer", "char_start", "status", "to_doc_id", "method", "confidence")


@query("WITH p AS (" + fx.PROVISION_ROWS + ") SELECT doc_id, bool_or(law = '19/1940') AS by_law, bool_or(law = '19/1940' AND gr = 218) AS by_article, coalesce(bool_or(law = '19/1940' AND gr = 218 AND mgr = 2), false) AS by_paragraph, coalesce(bool_or(law = '19/1940' AND gr = 218 AND sfx = 'a'), false) AS by_suffix FROM p GROUP BY 1")
def json_contains(spark, sf_dir):
    rows = spark.sql(fx.PROVISION_ROWS).groupBy("doc_id").agg(F.collect_list(F.struct("law", "gr", "mgr", "sfx")).alias("p"))
    p = F.col("p")
    return rows.select("doc_id", C.provision_match(p, "19/1940").alias("by_law"), C.provision_match(p, "19/1940", 218).alias("by_article"), C.provision_match(p, "19/1940", 218, None, 2).alias("by_paragraph"), C.provision_match(p, "19/1940", 218, "a").alias("by_suffix"))


@query("WITH l AS (" + fx.LINK_ROWS + ") SELECT from_doc_id, to_doc_id, relation, max(confidence) AS confidence FROM l GROUP BY ALL")
def link_best(spark, sf_dir):
    return graph.best_links(spark.sql(fx.LINK_ROWS)).drop("method")


@query("WITH l AS (" + fx.LINK_ROWS + ") SELECT from_doc_id, to_doc_id, CAST(count(DISTINCT relation) AS BIGINT) AS n FROM l WHERE relation IN ('appealed_to', 'appealed_from') GROUP BY 1, 2 HAVING count(DISTINCT relation) > 1")
def link_integrity(spark, sf_dir):
    none = spark.sql("SELECT 'x' AS doc_id, 1 AS instance_tier, DATE '2020-01-01' AS document_date")
    return graph.integrity(spark.sql(fx.LINK_ROWS), none)["two_relations"]


@query(
    """WITH a AS (""" + fx.ARTICLE_ROWS + """), c AS (SELECT *, round((coalesce(title_ok, false))::INT * 0.35 + (coalesce(author_ok, false))::INT * 0.3 + (coalesce(page_ok, false))::INT * 0.15 + (coalesce(record_ok, false))::INT * 0.2, 4) AS confidence,
    page_start - lag(page_end) OVER (PARTITION BY issue_id ORDER BY page_start) - 1 AS gap FROM a) SELECT issue_id, CASE WHEN min(confidence) >= 0.9 AND coalesce(max(gap), 0) <= 6 THEN 'approved' ELSE 'review' END AS status FROM c GROUP BY 1"""
)
def issue_status(spark, sf_dir):
    checks = {k: F.col(f"{k}_ok") for k in ("title", "author", "page", "record")}
    return quality.issue_status(spark.sql(fx.ARTICLE_ROWS).withColumn("confidence", quality.article_confidence(checks)))


@query(
    """SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS latest_before, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderdate > TIMESTAMP '1997-01-01') AS earliest_after
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1"""
)
def latest_before_earliest_after(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate").join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")
    day, key = F.lit("1997-01-01").cast("timestamp_ntz"), F.struct("o_orderdate", "o_orderkey")
    before, after = F.when(F.col("o_orderdate") < day, key), F.when(F.col("o_orderdate") > day, key)
    return rows.groupBy("c_custkey").agg(F.max(before)["o_orderkey"].alias("latest_before"), F.min(after)["o_orderkey"].alias("earliest_after"))


@query("SELECT CAST(CASE WHEN l_discount IS NOT NULL THEN greatest(0, least(4, floor((l_extendedprice - 0) / 20000))) END AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def histogram_bins(spark, sf_dir):
    return quality.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0, 100_000, 5)


@query("SELECT cut, CAST(count(*) FILTER (WHERE l_discount >= cut) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_discount >= cut AND l_returnflag = 'R') AS BIGINT) AS good FROM lineitem, (VALUES (0.02::DOUBLE), (0.05), (0.08)) t(cut) GROUP BY 1")
def threshold_table(spark, sf_dir):
    """All cuts in one pass: conditional counts instead of a join with the cuts."""
    return quality.thresholds(table(spark, sf_dir, "lineitem").withColumn("good", F.col("l_returnflag") == "R"), "l_discount", [0.02, 0.05, 0.08], "good")


@query("SELECT lang AS verdict_type, source AS source_short, CAST(count(*) AS BIGINT) AS n, min(h) AS least, max(h) AS most, CAST(sum(ascii(h[1]) * 65536 + ascii(h[2]) * 256 + ascii(h[3])) AS BIGINT) AS total FROM (SELECT lang, source, md5(coalesce(text, '') || chr(31) || '' || chr(31) || coalesce(source, '')) AS h FROM documents) GROUP BY 1, 2")
def text_hashes(spark, sf_dir):
    h = C.text_hash(F.col("text"), F.lit(None).cast("string"), F.col("source_short"))
    letters = F.expr("ascii(substr(h, 1, 1)) * 65536L + ascii(substr(h, 2, 1)) * 256L + ascii(substr(h, 3, 1))")
    return documents(spark, sf_dir).withColumn("h", h).groupBy("verdict_type", "source_short").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.max("h").alias("most"), F.sum(letters).cast("long").alias("total"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}]+') AS w FROM documents),
    c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('og', 'að', 'er', 'sem', 'ekki', 'því', 'við', 'um', 'það', 'til'))) AS i, len(list_filter(w, lambda x: x IN ('the', 'and', 'of', 'to', 'in', 'is', 'that', 'for', 'with', 'not'))) AS e FROM t)
    SELECT CASE WHEN greatest(i, e) < 3 THEN 'is' WHEN e > i THEN 'en' ELSE 'is' END AS lang, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1"""
)
def language_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(C.language(F.col("text")).alias("lang")).agg(F.count("*").alias("n"))


@query("SELECT regexp_replace(props, '[0-9]', '#', 'g') AS shape, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def number_shapes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(quality.shape(F.col("props")).alias("shape")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("n"))


ADHOC = "WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, n, most FROM s WHERE n > 0"


@query(ADHOC)
def adhoc_sql(spark, sf_dir):
    """A guarded statement over views; the row cap is the operator's."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return sqlguard.plan(spark, f"{ADHOC};  -- a trailing comment")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def date_filter_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("n"))


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_join_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id").distinct()


# ---------------------------------------------------------------- text rules, without SQL


def as_rulings(spark, sf_dir) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), none("string").alias("summary"), F.col("text").alias("body_text"), none("string").alias("lower_body_text"))
    return rows.select("*", none("date").alias("document_date"), none("array<struct<char:int,pdf_page:int,printed:int>>").alias("page_offsets"))


@query()
def segment_passages(spark, sf_dir):
    """Passages of all documents; tests hold their offsets against the texts."""
    return builders.build_passages(as_rulings(spark, sf_dir)).drop("text")


@query()
def extract_citations(spark, sf_dir):
    """Raw citations of all documents."""
    return builders.build_citations(as_rulings(spark, sf_dir))


@query()
def extract_provisions(spark, sf_dir):
    """Cited provisions of all documents."""
    return builders.build_provisions(as_rulings(spark, sf_dir))


@query()
def stratified_sample(spark, sf_dir):
    """Five documents a source in hash order (the sample is the operator)."""
    return quality.sample_per_stratum(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query()
def page_maps(spark, sf_dir):
    """Printed page numbers of conversations read as issues, one group each."""
    import pandas as pd

    def fit(pages: pd.DataFrame) -> pd.DataFrame:
        texts = [f"{i + 10}\n{t}" for i, t in enumerate(pages.sort_values("turn")["text"])]
        m = X.page_map(texts)
        return pd.DataFrame({"conv_id": [pages["conv_id"].iloc[0]], "offset": [m["offset"]], "quality": [m["quality"]]})

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(fit, "conv_id long, offset int, quality double")


def queries() -> dict[str, Query]:
    from . import rules  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
