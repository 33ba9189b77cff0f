"""Search, graph, merge, quality, SQL guard, readers and the incremental runner on small tables."""

import io
import json
import random
import zipfile
from collections import Counter, defaultdict
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import schema
from quillon.functions import columns as C
from quillon.operators import builders, containment, graph, merge, quality, search, sqlguard
from quillon.plans import catalog
from quillon.sources import landed
from quillon.streaming import incremental

COLUMNS = [f.split(" ")[0] for f in schema.DOCUMENTS.split(", ") if " " in f]


def document(doc_id, **given_):
    row = {"doc_id": doc_id, "source_short": "haestirettur", "external_id": doc_id, "court": "Hrd.", "case_number": "1/2020", "document_date": date(2020, 1, 1), "verdict_type": "Dómur", "instance_tier": 3, "lang": "is"}
    row |= {"summary": None, "body_text": "texti", "lower_body_text": None, "keywords": None, "plaintiffs": None, "defendants": None, "cited_provisions": None, "page_offsets": None, "created_at": datetime(2024, 1, 1), "updated_at": datetime(2024, 1, 1)}
    return row | given_


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        document("a", body_text="Krafa um skaðabætur var tekin til greina. Krafa þessi er rétt.", document_date=date(2021, 1, 1), keywords=["Skaðabætur", "100%"], cited_provisions=[{"law": "19/1940", "gr": 218, "mgr": 2, "sfx": None}]),
        document("b", body_text="Krafa um vexti.", verdict_type="Úrskurður", document_date=None, keywords=["Vextir"]),
        document("c", source_short="landsrettur", court="Lrd.", body_text="Skaðabætur og vextir. 12. gr. laga nr. 91/1991.", document_date=date(2019, 5, 5)),
        document("d", source_short="landsrettur", court="Lrd.", body_text=None, summary="Krafa, skaðabætur og vextir.", document_date=date(2022, 5, 5)),
        document("e", source_short="felagsdomur", court="Féld.", body_text="Þing og ÞINGMENN.", document_date=date(2018, 5, 5)),
    ]
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], schema.DOCUMENTS).cache()


@pytest.fixture(scope="module")
def passages(docs):
    return builders.build_passages(docs).cache()


@pytest.fixture(scope="module")
def index(docs):
    text = F.concat_ws(" ", "case_number", "court", "verdict_type", "summary", "body_text", "lower_body_text")
    return builders.doc_lemmas(docs.withColumn("all", text), "all").cache()


@pytest.fixture(scope="module")
def passage_index(passages):
    rows = passages.withColumn("key", F.struct("doc_id", "ordinal", "section_kind"))
    return builders.doc_lemmas(rows, "text", "key").select("key.*", "lemma", "tf", "positions").cache()


TREE = [{"key": "domstolar", "children": [{"key": "hrd", "children": [{"key": "hrd_domar", "sources": ["haestirettur"], "verdict_types": ["Dómur"]}, {"key": "hrd_urskurdir", "sources": ["haestirettur"], "verdict_types": ["Úrskurður"]}]}, {"key": "lrd", "sources": ["landsrettur"]}]}, {"key": "tomt", "sources": ["ekkert"]}]


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def find(docs, index, passage_index, **request):
    return search.search(docs, index, passage_index, search.Request(**request))


def test_keyword_search_strict_and_relaxed(docs, index, passage_index):
    strict = find(docs, index, passage_index, q="krafa skaðabætur", relax_below=0)
    assert (strict.total, strict.relaxed, ids(strict.page)) == (2, False, ["a", "d"])
    wide = find(docs, index, passage_index, q="krafa skaðabætur")
    rows = wide.page.collect()
    assert wide.relaxed and wide.strict_total == 2 and wide.total == 4
    assert [r.tier for r in rows] == [0, 0, 2, 2] and {r.doc_id for r in rows[2:]} == {"b", "c"}
    assert all(r.colocated for r in rows[:2]) and not any(r.colocated for r in rows[2:])


def test_tiers_against_boolean_evaluation():
    from itertools import combinations

    for lemmas in (["a"], ["a", "b"], ["a", "b", "c"], ["a", "a", "b", "c"], list("abcdefghi")):
        weights, n = search.weights(lemmas), len(lemmas)
        for mask in range(1, 1 << min(len(weights), 6)):
            own = {w for k, w in enumerate(weights) if mask >> k & 1}
            m = sum(weights[w] for w in own)
            strict = set(lemmas) <= own
            less = 3 <= n <= 8 and any(set(c) <= own for c in combinations(lemmas, n - 1))
            expected = 0 if strict else 1 if less else 2
            assert (0 if m == n else 1 if m == n - 1 and 3 <= n <= 8 else 2) == expected


def test_browse_filters_and_scope(docs, index, passage_index):
    assert ids(find(docs, index, passage_index, q="").page) == list("abcde")
    newest = [r.doc_id for r in find(docs, index, passage_index, q="").page.collect()]
    assert newest == ["d", "a", "c", "e", "b"]
    assert [r.doc_id for r in find(docs, index, passage_index, q="", sort="oldest").page.collect()] == ["e", "c", "a", "d", "b"]
    assert ids(find(docs, index, passage_index, date_from="2019-05-05", date_to="2021-01-01").page) == ["a", "c"]
    assert ids(find(docs, index, passage_index, provision="2. mgr. 218. gr. laga nr. 19/1940", q="mgr gr lag nr").page) == ["a"]
    assert ids(find(docs, index, passage_index, provision="19/1940").page) == ["a"]
    assert ids(find(docs, index, passage_index, keyword="VEXT").page) == ["b"]
    assert ids(find(docs, index, passage_index, keyword="skaða%\", \"1").page) == ["a"]
    scope = lambda *keys: search.resolve_scope(TREE, list(keys))
    assert ids(find(docs, index, passage_index, scope=scope("hrd_domar")).page) == ["a"]
    assert ids(find(docs, index, passage_index, scope=scope("hrd")).page) == ["a", "b"]
    assert ids(find(docs, index, passage_index, scope=scope("unknown")).page) == []
    assert scope("all") is None and scope() is None
    page = find(docs, index, passage_index, size=2, page=2)
    assert page.total == 5 and [r.doc_id for r in page.page.collect()] == ["c", "e"]


def test_word_modes(docs, index, passage_index):
    run = lambda q, mode, **k: ids(find(docs, index, passage_index, q=q, mode=mode, **k).page)
    assert run("krafa", "exact") == ["a", "b"]
    assert run("þing", "exact") == ["e"] and run("þing", "prefix") == ["e"] and run("menn", "prefix") == []
    assert run("menn", "substring") == ["e"]
    assert run("vexti þing", "any") == ["b", "c", "e"]
    assert run(r"\mvext[[:alpha:]]+\M", "regex") == ["b", "c"]
    assert run("krafa", "exact", fields=["summary"]) == ["d"]
    assert run("krafa", "exact", fields=["nothing"]) == list("abcde")


def test_proximity(docs, index, passage_index):
    near = lambda q, n: ids(find(docs, index, passage_index, q=q, mode="proximity", within=n).page)
    assert near("krafa skaðabætur", 2) == ["a", "d"]
    assert near("skaðabætur krafa", 1) == ["d"]
    assert near("krafa", 1) == ["a", "b", "d"]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.integers(1, 4))
def test_proximity_against_brute_force(spark, words, n):
    # the same condition as the operator's, in Python
    at = {w: [i for i, x in enumerate(words) if x == w] for w in "ab"}
    expected = any(1 <= abs(i - j) <= n for i in at["a"] for j in at["b"])
    row = spark.range(1).select(search.within(F.lit(at["a"]).cast("array<int>") if at["a"] else F.array().cast("array<int>"), F.lit(at["b"]).cast("array<int>") if at["b"] else F.array().cast("array<int>"), n).alias("x")).first()
    assert row.x == expected


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"sort": "x"}, {"strategy": "x"}, {"section_kinds": ["x"]}, {"mode": "exact", "section_kinds": ["annad"]}, {"mode": "regex", "q": "("}, {"mode": "regex", "q": "a", "fields": ["x"]}, {"relax_below": 300}])
def test_bad_requests(bad):
    with pytest.raises(search.SearchError):
        search.Request(**bad)


def test_facets_and_scope_counts(docs):
    by_source, by_verdict = search.facets(docs)
    assert {r.source_short: r.n for r in by_source.collect()} == {"haestirettur": 2, "landsrettur": 2, "felagsdomur": 1}
    assert sum(r.n for r in by_verdict.collect()) == 5
    assert {r.key: r.n for r in search.scope_counts(docs, TREE).collect()} == {"domstolar": 4, "hrd": 2, "hrd_domar": 1, "hrd_urskurdir": 1, "lrd": 2, "tomt": 0}


def test_windows_and_outline(passages):
    assert [r.ordinal for r in search.passage_window(passages, "a", 0, 5).collect()] == [0]
    assert search.passage_context(passages, "a", 0).count() == 1
    assert search.outline(passages, "d").first().section_kind == "reifun"
    for bad in ((3, 1, {}), (0, 500, {}), (0, 1, {"layer": "x"}), (0, 1, {"section_kinds": ["x"]})):
        with pytest.raises(search.SearchError):
            search.passage_window(passages, "a", bad[0], bad[1], **bad[2])


def test_index_on_disk(spark, index, tmp_path):
    builders.write_index(index, str(tmp_path / "index"), buckets=4)
    got = builders.read_index(spark, str(tmp_path / "index"), ["krafa", "vextir"], buckets=4)
    assert sorted((r.doc_id, r.lemma) for r in got.collect()) == sorted((r.doc_id, r.lemma) for r in index.where("lemma in ('krafa', 'vextir')").collect())


def test_lemma_table(spark):
    forms = spark.createDataFrame([("kröfu", "krafa")], "form string, lemma string")
    rows = spark.createDataFrame([("x", "Kröfu 12 kröfur")], "doc_id string, text string")
    assert sorted((r.lemma, r.tf) for r in builders.doc_lemmas(rows, lemmas=forms).collect()) == [("krafa", 1), ("kröfur", 1)]
    assert sorted(r.lemma for r in builders.doc_lemmas(rows, letters_only=False).collect()) == ["12", "kröfu", "kröfur"]


def test_staleness(docs):
    hashes = builders.hashes_of(docs.where("doc_id <> 'e'"))
    changed = docs.withColumn("body_text", F.when(F.col("doc_id") == "a", "nýr texti").otherwise(F.col("body_text")))
    assert ids(builders.stale(changed, hashes)) == ["a", "e"]


def test_builders_report_errors(docs):
    def fails(d):
        raise KeyError("no")

    rows = builders.per_document(docs.select("doc_id"), fails, "doc_id string, text string").collect()
    assert len(rows) == 5 and all(r.error.startswith("KeyError") for r in rows)
    assert [(r.doc_id, r.law, r.gr) for r in builders.build_provisions(docs).collect()] == [("c", "91/1991", 12)]


LINKS = [("h", "l", "appealed_to", 0.9, "casenum"), ("l", "s", "appealed_to", 0.8, "casenum"), ("s", "l", "appealed_from", 0.8, "casenum"), ("p", "l", "leyfisbeidni_um", 1.0, "casenum"), ("s", "z", "cites", 1.0, "citation")]


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(LINKS, schema.LINKS)


def test_link_graph(spark, links):
    chain = graph.chained(links).collect()
    assert [(r.from_doc_id, r.to_doc_id, r.confidence) for r in chain] == [("h", "s", 0.95)]
    both = {(r.from_doc_id, r.to_doc_id, r.relation) for r in graph.mirrored(links).collect()}
    assert ("l", "h", "appealed_from") in both and ("l", "p", "leiddi_til_doms") in both
    rows = spark.createDataFrame([(x,) for x in "hlspz"], "doc_id string")
    assert sorted(r.doc_id for r in graph.has_appeal_links(rows, links).where("has_appeal_links").collect()) == ["h", "l", "p", "s"]
    assert {r.doc_id: r.cited_by for r in graph.in_degree(rows, links).collect()} == {"h": 0, "l": 3, "s": 1, "p": 0, "z": 1}
    tiers = spark.createDataFrame([("h", 1, date(2020, 1, 1)), ("l", 2, date(2020, 2, 1)), ("s", 3, date(2020, 3, 1)), ("z", 3, date(2021, 1, 1))], "doc_id string, instance_tier int, document_date date")
    found = graph.integrity(links, tiers)
    assert found["orientation"].count() == 0 and found["cites_later"].count() == 1 and found["no_mirror"].count() == 1


def test_citation_pipeline(spark, docs):
    rows = [document("x", body_text="Sbr. dóm Hæstaréttar í máli nr. 1/2020 og Hrd. 99/1980.", summary="Dómur Landsréttar í máli nr. 5/2021.", document_date=date(2022, 1, 1)), document("y", case_number="001/2020", document_date=date(2020, 2, 2))]
    table = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], schema.DOCUMENTS)
    raw = builders.build_citations(table).where("error is null").drop("error")
    found = graph.resolve(raw, graph.citation_index(table), table)
    got = {(r.layer, r.target_case_number): (r.status, r.to_doc_id) for r in found.collect()}
    assert got == {("body", "1/2020"): ("ambiguous", None), ("body", "99/1980"): ("pre_coverage", None), ("summary", "5/2021"): ("unresolved", None)}
    later = spark.createDataFrame([tuple(document("v", court="Lrd.", case_number="5/2021", document_date=date(2021, 5, 5))[c] for c in COLUMNS)], schema.DOCUMENTS)
    again = graph.relink(found, graph.citation_index(table.union(later)), table, table.union(later))
    fixed = {(r.layer, r.target_case_number): r.to_doc_id for r in again.collect()}
    assert fixed[("summary", "5/2021")] == "v" and again.count() == found.count()
    assert [(r.from_doc_id, r.to_doc_id) for r in graph.cites_edges(again).collect()] == [("x", "v")]


def test_as_of_passage(spark):
    p = spark.createDataFrame([("a", "body", 0, 0), ("a", "body", 50, 1), ("a", "summary", 10, 2)], "doc_id string, layer string, char_start int, ordinal int")
    c = spark.createDataFrame([("a", "body", 49), ("a", "body", 50), ("a", "summary", 5), ("b", "body", 1)], "from_doc_id string, layer string, char_start int")
    got = graph.passage_of_citation(c, p, ["from_doc_id", "layer", "char_start"])
    assert {(r.layer, r.char_start): r.ordinal for r in got.collect()} == {("body", 49): 0, ("body", 50): 1, ("summary", 5): None, ("body", 1): None}


def test_appeals_by_number_and_by_date(spark):
    upper = spark.createDataFrame([("u1", ["E-012/2020"], None, None, ["5", "5", "7"], ["a", "b"]), ("u2", [], "Hérd. Rvk.", date(2020, 3, 10), ["1"], ["c", "d"]), ("u3", [], "Hérd. Rvk.", date(2010, 1, 1), [], [])], "doc_id string, casenums array<string>, lower_court string, lower_date date, nums array<string>, words array<string>")
    lower = spark.createDataFrame([("l1", "Hérd. Rvk.", "E-12/2020", date(2020, 1, 1), ["5", "7"], ["z"]), ("l2", "Hérd. Rvk.", "E-1/2019", date(2020, 3, 20), ["2"], ["c", "d", "e"]), ("l3", "Hérd. Rvk.", "E-2/2019", date(2020, 3, 12), ["2"], ["q"])], "doc_id string, court string, case_number string, document_date date, nums array<string>, words array<string>")
    got = {r.from_doc_id: (r.to_doc_id, r.method, r.confidence) for r in graph.link_appeals(upper, lower).collect()}
    assert got == {"u1": ("l1", "casenum", 1.0), "u2": ("l2", "court_window", 1.0)}


def test_petitions(spark):
    rulings = spark.createDataFrame([("r1", "Lrd.", "7/2019", date(2019, 1, 1), "Dómur"), ("r2", "Lrd.", "7/2019", date(2019, 6, 1), "Úrskurður"), ("j", "Hrd.", "1/2020", date(2020, 5, 5), "Dómur")], "doc_id string, court string, case_number string, document_date date, verdict_type string")
    petitions = spark.createDataFrame([("p", "Lrd.", "007/2019", "Dómur", date(2019, 9, 9))], "doc_id string, target_court string, target_number string, target_verdict string, document_date date")
    edges = graph.petition_links(petitions, rulings)
    assert [(r.from_doc_id, r.to_doc_id) for r in edges.collect()] == [("p", "r1")]
    appeals = spark.createDataFrame([("j", "r1", "appealed_from", 1.0, "casenum")], schema.LINKS)
    dates = rulings.select("doc_id", "document_date").union(petitions.select("doc_id", "document_date"))
    assert [(r.from_doc_id, r.to_doc_id) for r in graph.petition_judgments(edges, appeals, dates).collect()] == [("p", "j")]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None, 1), (2, "b", "kept", 1)], "k int, v string, f string, t int")
    new = spark.createDataFrame([(2, "B", "lost", 2), (3, "C", None, 2), (1, "A", "filled", 2)], "k int, v string, f string, t int")
    got = {r.k: (r.v, r.f) for r in merge.upsert(old, new, ["k"], "t", fill=["f"]).collect()}
    assert got == {1: ("A", "filled"), 2: ("B", "kept"), 3: ("C", None)}
    assert sorted(r.v for r in merge.insert_ignore(old, new.union(new), ["k"]).collect()) == ["C", "a", "b"]
    assert sorted(r.v for r in merge.replace_children(old, new.where("k = 2"), new.where("k = 2"), "k").collect()) == ["B", "a"]
    assert sorted(r.k for r in merge.changed(new, old, "k", "v").collect()) == [1, 2, 3]
    assert [r.k for r in merge.prune(old, new.where("k = 2"), ["k"]).collect()] == [2]
    kids = spark.createDataFrame([(1, 1), (2, 9)], "id int, k int")
    assert [r.k for r in merge.set_null(kids, old, "k", "k").orderBy("id").collect()] == [1, None]
    assert [r.id for r in merge.cascade(kids, old, "k", "k").collect()] == [1]
    typed = spark.createDataFrame([('{"a":1,"b":{"c":[1,true]},"d":"1"}', '{"d":2.5,"e":null,"f":false}')], "o string, n string").select(merge.merge_json(F.col("o"), F.col("n")).alias("j")).first().j
    assert json.loads(typed) == {"a": 1, "b": {"c": [1, True]}, "d": 2.5, "e": None, "f": False}
    js = spark.createDataFrame([('{"a":"1"}', '{"b":"2","a":"3"}')], "o string, n string").select(merge.merge_json(F.col("o"), F.col("n")).alias("j")).first().j
    assert json.loads(js) == {"a": "3", "b": "2"}
    kw = spark.createDataFrame([(None,), (["x"],), (["y"],)], "k array<string>").select(C.case_type_keywords(F.col("k"), F.lit("x")).alias("k"))
    assert sorted(map(tuple, (r.k for r in kw.collect()))) == [("x",), ("x",), ("y", "x")]


def test_move_source(spark):
    rows = spark.createDataFrame([("good", "1"), ("bad", "1"), ("bad", "2")], "source_short string, external_id string")
    assert sorted(map(tuple, merge.move_source(rows, "bad", "good").collect())) == [("good", "1"), ("good", "2")]


def test_deduplicate(spark):
    rows = [document("a", body_text="sami texti hér", created_at=datetime(2024, 1, 1)), document("b", body_text="Sami  texti hér!", created_at=datetime(2024, 2, 1)), document("c", case_number="2/2020", body_text="x"), document("d", case_number="2/2020", body_text="allt annað"), document("e", court=None, body_text="sami"), document("f", court=None, body_text="sami")]
    table = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], schema.DOCUMENTS)
    kept, dropped = quality.deduplicate(table)
    assert ids(kept) == ["b", "c", "d", "e", "f"] and ids(dropped) == ["a"]
    again, none = quality.deduplicate(kept)
    assert ids(again) == ids(kept) and none.count() == 0


def test_deduplicate_compares_whole_texts(spark):
    long = " ".join(f"orð{k}" for k in range(8000))
    assert len(long) > 60_000
    late, end = long + " viðbót" * 400, long + " endir"
    rows = [document("a", body_text=long, created_at=datetime(2024, 1, 1)), document("b", body_text=late, created_at=datetime(2024, 2, 1))]
    rows += [document("c", case_number="2/2020", body_text=long, created_at=datetime(2024, 1, 1)), document("d", case_number="2/2020", body_text=end, created_at=datetime(2024, 2, 1))]
    kept, dropped = quality.deduplicate(spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], schema.DOCUMENTS))
    assert ids(kept) == ["a", "b", "d"] and ids(dropped) == ["c"]


def test_containment(spark):
    rows = [("big", k, f"orð{k} eitt tvö þrjú fjögur{k} fimm{k}") for k in range(6)] + [("part", k, f"orð{k} eitt tvö þrjú fjögur{k} fimm{k}") for k in range(3)] + [("other", 1, "allt annar texti um annað mál")]
    got = quality.containment(spark.createDataFrame(rows, "file string, page int, text string")).collect()
    assert [(r.file, r.inside, r.n) for r in got] == [("part", "big", 3)]


def test_containment_counts_rows_of_one_page_together(spark):
    shared, rest = "eitt tvö þrjú fjögur", "fimm sex sjö átta níu tíu ellefu tólf"
    rows = [("a", 1, shared), ("a", 1, shared), ("a", 1, rest), ("b", 1, shared + " allt annað en hitt og þetta sem hér er")]
    got = quality.containment(spark.createDataFrame(rows, "file string, page int, text string"), share=0.3, file_share=0.5).collect()
    assert got == []  # 2 of the page's 8 trigrams


@pytest.mark.parametrize("block, pairs", [(4_000_000, 1_000_000), (150, 40), (20, 7)])
def test_containment_in_small_cells_equals_all_pairs(spark, block, pairs):
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(40)}", rng.choice([None, *range(9)]), " ".join(rng.choice("abcde") for _ in range(rng.randrange(14)))) for _ in range(300)]
    rows += [("big", k, " ".join(rng.choice("abcde") for _ in range(40))) for k in range(12)] + [(None, 1, "a b c d e"), ("none", 1, None), ("f1", 3, "a b")]
    grams = defaultdict(set)
    for file, page, text in rows:
        w = (text or "").split()
        for k in range(len(w) - 2):
            if file is not None:
                grams[file, page].add(tuple(w[k : k + 3]))
    whole, pages = defaultdict(set), Counter(file for file, _ in grams)
    for (file, _), g in grams.items():
        whole[file] |= g
    want = set()
    for a in whole:
        for b in whole:
            n = sum(10 * len(g & whole[b]) >= 7 * len(g) for (file, page), g in grams.items() if file == a and page is not None)
            if a != b and n and 10 * n >= 7 * pages[a] and len(whole[a]) <= len(whole[b]):
                want.add((a, b, n))
    found = containment.contained(spark.createDataFrame(rows, "file string, page int, text string"), 0.7, 0.7, block, pairs)
    got = [tuple(r) for r in found.collect()]
    assert len(want) > 20 and len(got) == len(want) and set(got) == want


def test_containment_makes_no_rows_of_pairs(spark):
    rows = spark.range(300).selectExpr("id AS file", "1 AS page", "concat('allar síður segja ', id, ' og ', id + 1000, ' ekki ', id + 2000) AS text")
    found = quality.containment(rows)
    assert found.count() == 0
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_metrics_samples_and_math(spark):
    assert quality.apportion({"a": 50, "b": 30, "c": 20}, 7) == {"a": 4, "b": 2, "c": 1}
    assert quality.apportion({"a": 0}, 3) == {"a": 0}
    rows = [{"s": "x", "k": 1}, {"s": "x", "k": 2}, {"s": "y", "k": 1}, {"s": "y", "k": 3}]
    assert quality.greedy_caps(rows, {"s": 2, "k": 1}) == [rows[0], rows[1], rows[3]]
    some = quality.sample_per_stratum(spark.range(100).withColumn("s", F.col("id") % 4), "s", "id", 3)
    assert Counter(r.s for r in some.collect()) == {0: 3, 1: 3, 2: 3, 3: 3}
    results = spark.createDataFrame([("q1", 1, "a", 10), ("q1", 2, "b", 10), ("q2", 1, "x", 30), ("q2", 2, "c", 30)], "question string, rank int, doc string, ms int")
    expected = spark.createDataFrame([("q1", "a"), ("q1", "z"), ("q2", "c"), ("q3", "c")], "question string, doc string")
    m = quality.retrieval_metrics(results, expected).first()
    assert (round(m.recall, 3), round(m.mrr, 3), round(m.hit1, 3), m.zero) == (0.5, 0.5, 0.333, 1)
    one = spark.createDataFrame([(["5", "5", "7"], ["5", "5", "5", "9"])], "a array<string>, b array<string>").select(graph.multiset_overlap(F.col("a"), F.col("b")).alias("m"), graph.set_overlap(F.col("a"), F.col("b")).alias("s")).first()
    assert (round(one.m, 3), one.s) == (0.667, 0.5)


def test_best_record(spark):
    articles = spark.createDataFrame([(1, "um lög", 2000, 5), (2, "annað", 2000, None)], "article_id int, title string, year int, volume int")
    records = spark.createDataFrame([(7, "um lög", 2000, 5), (8, "um lögin", 2000, 6), (9, "annað", 2000, 1), (10, "annað", 2000, 2)], "record_id int, record_title string, record_year int, record_volume int")
    got = quality.best_record(articles, records, F.when(F.col("title") == F.col("record_title"), 1.0).otherwise(0.6)).collect()
    assert [(r.article_id, r.record_id) for r in got] == [(1, 7)]


def test_column_rules(spark):
    one = spark.createDataFrame([("Dagsett 3. mars 2020.", "31. febrúar 2020", "Beiðni um áfrýjunarleyfi er samþykkt.", "Beiðni er hafnað.")], "a string, b string, c string, d string")
    r = one.select(C.icelandic_date(F.col("a")).alias("a"), C.icelandic_date(F.col("b")).alias("b"), C.outcome(F.col("c")).alias("c"), C.outcome(F.col("d")).alias("d"), C.file_stem(F.lit("Hrd. 1/2020 – Dómur Þjóð")).alias("e")).first()
    assert tuple(r) == (date(2020, 3, 3), None, "granted", "denied", "hrd-1-2020-domur-thjod")
    j = spark.createDataFrame([(["A", "B", "C"], "T", "Úlf", 5, "2", 1990, 3, 9)], "au array<string>, t string, j string, v int, i string, y int, f int, u int")
    c = F.col
    assert j.select(C.journal_citation(c("au"), c("t"), c("j"), c("v"), c("i"), c("y"), c("f"), c("u")).alias("x")).first().x == "A o.fl.: T. Úlf, 5. árg., 2. hefti, 1990, bls. 3–9"
    offsets = spark.createDataFrame([([(0, 1, 5), (100, 2, None), (200, 3, 7)],)], f"o array<{schema.PAGE_OFFSET}>")
    got = offsets.select(*(C.pages_of_span(F.col("o"), F.lit(a), F.lit(b)).alias(f"x{a}") for a, b in ((10, 90), (11, 250), (120, 180), (900, 950)))).first()
    assert [tuple(x) for x in got] == [(5, 5), (5, 7), (None, None), (7, 7)]


@pytest.mark.parametrize(
    "sql",
    ["SELECT 'a;b'", "  (SELECT 1) UNION ALL (SELECT 2);", "WITH x AS (SELECT 1 AS a) SELECT * FROM x -- end", "SELECT '%delete%', `update` FROM t", "/* a /* b */ c */ SELECT 1", "EXPLAIN SELECT 1", "VALUES (1)", "SHOW TABLES", "TABLE t"]
    + ["SELECT deleted, updated_at FROM t", "SELECT add FROM t", "SELECT 1 AS load", "SELECT a FROM t WHERE b IN (SELECT c FROM u) AND EXISTS (SELECT 1 FROM v)", "SELECT * FROM range(3) LATERAL VIEW explode(array(1)) AS x", "FROM t SELECT a", "SELECT sum(a) OVER (PARTITION BY b) FROM t LIMIT 3"],
)
def test_guard_accepts(spark, sql):
    assert sqlguard.checked(spark, sql) == sql


@pytest.mark.parametrize(
    "sql",
    [None, "", " ; ", "-- only", "DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x", "SELECT * INTO y FROM t", "SELECT reflect('java.lang.System', 'exit')", "SELECT a FROM t WHERE b = (SELECT java_method('java.lang.System', 'gc'))", "SELECT 'open", "/* open", "DROP TABLE t"]
    + ["SELECT 1 /* x */; drop table t", "SELECT TRANSFORM(a) USING 'cat /etc/hostname' AS (b string) FROM t", "SELECT * FROM text.`/etc/hostname`", "SELECT (SELECT max(a) FROM parquet.`/x`) FROM t", "EXPLAIN SELECT * FROM csv.`/x`", "WITH x AS (SELECT * FROM json.`/x`) SELECT * FROM x", "FROM t INSERT INTO u SELECT *"]
    + ["CREATE TABLE t AS SELECT 1", "SET spark.a = 1", "ADD JAR 'x'", "EXECUTE IMMEDIATE 'drop table t'", "BEGIN SELECT 1; END", "CACHE TABLE t", "SELECT input_file_name() FROM t"],
)
def test_guard_rejects(spark, sql):
    with pytest.raises(sqlguard.Rejected):
        sqlguard.checked(spark, sql)


def test_guarded_run(spark):
    spark.range(5).createOrReplaceTempView("five")
    got = sqlguard.run(spark, "SELECT id, repeat('x', 600) AS t, double('NaN') AS d FROM five ORDER BY id", rows=3)
    assert got.columns == ["id", "t", "d"] and len(got.rows) == 3 and got.truncated
    assert got.rows[0][0] == 0 and len(got.rows[0][1]) <= 501 and got.rows[0][2] is None
    assert ("five", "id", "bigint") in sqlguard.describe(spark, "five")


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"caseNumber": "1/2020", "abstract": "reifun"}\n{"caseNumber": ')
    rows = landed.read_json(spark, str(tmp_path / "a.json"), "caseNumber string, abstract string").cache()
    assert rows.where("_corrupt is not null").count() == 1
    silver = landed.silver(rows.where("_corrupt is null"), "hrd", defaults={"title": "Hrd."}).first()
    assert (silver.case_number, silver.summary, silver.title, silver.body_text) == ("1/2020", "reifun", "Hrd.", None)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("1940019.html", '<title>Lög</title><span id="G1"></span>1. gr. Texti')
        z.writestr("readme.txt", "x")
    (tmp_path / "laws.zip").write_bytes(buffer.getvalue())
    law = landed.read_statutes(spark, str(tmp_path / "laws.zip")).collect()
    assert [(r.law, r.provisions[0].num) for r in law] == [("19/1940", 1)]
    (tmp_path / "m.yaml").write_text("source: ulf\nyear: 1990\nissue: 2\narticles:\n  - {title: T, authors: [A], page_start: 1, page_end: 3}\n")
    assert [(r.source, r.issue, r.title, r.authors) for r in landed.read_manifests(spark, str(tmp_path / "m.yaml")).collect()] == [("ulf", "2", "T", ["A"])]
    (tmp_path / "p.html").write_bytes("Þing".encode("iso-8859-1"))
    assert landed.read_pages(spark, str(tmp_path / "p.html"), "iso-8859-1").first().html == "Þing"


def test_incremental_rebuild(spark, docs, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("landed", "out", "state"))
    docs.write.parquet(path)
    incremental.rebuild(spark, path, schema.DOCUMENTS, out, state, buckets=4)
    first = spark.read.parquet(out)
    assert sorted({r.doc_id for r in first.collect()}) == list("abcde")
    newer = docs.where("doc_id = 'a'").withColumn("body_text", F.lit("breytt")).withColumn("updated_at", F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz"))
    newer.write.mode("append").parquet(path)
    incremental.rebuild(spark, path, schema.DOCUMENTS, out, state, buckets=4)
    rows = {r.doc_id: r.text for r in spark.read.parquet(out).collect()}
    assert rows["a"] == "breytt" and len(rows) == 5


def test_catalog_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.oracle_sql()) >= 50


def test_document_detail_and_audit(spark, docs, passages):
    from quillon.operators import detail

    rows = [("a", "body", 3, 10, "Krafa", "Lrd.", "1/2020", None, None, "prose", "resolved", "c", "casenum_unique", 0.8), ("a", "summary", 1, 5, "x", "Lrd.", "1/2020", None, None, "prose", "resolved", "c", "casenum_unique", 0.8), ("a", "body", 20, 25, "y", "Hrd.", "9/2020", None, None, "prose", "unresolved", None, None, None), ("d", "body", 0, 5, "z", "Lrd.", "1/2020", None, None, "prose", "resolved", "a", "casenum_date", 1.0)]
    citations = spark.createDataFrame(rows, f"{schema.CITATIONS}, {schema.RESOLUTIONS}")
    links = spark.createDataFrame([("a", "c", "appealed_to", 1.0, "casenum"), ("a", "c", "cites", 0.8, "citation")], schema.LINKS)
    d = detail.document(docs, links, citations, passages, "a")
    assert d.row.first().citation == "Hrd. 1/2020 1. janúar 2021 – Dómur"
    assert [(r.other, r.relation) for r in d.links.collect()] == [("c", "appealed_to")]
    assert [(r.other, r.layer, r.also_appeal, r.ordinal) for r in d.outgoing.collect()] == [("c", "body", True, 0)]
    assert [r.other for r in d.incoming.collect()] == ["d"] and d.unresolved.first().n == 1
    checked = {r.to_doc_id: r for r in detail.audit(citations, docs).where("layer = 'body'").collect()}
    assert checked["c"].court_ok and not checked["c"].number_ok and checked["c"].order_ok and checked["c"].span_ok
    assert detail.compact(docs).columns == ["doc_id", "citation", "keywords", "summary"]
    one = spark.createDataFrame([("eitt tvö þrjú",)], "t string").select(detail.short(F.col("t"), 9).alias("s"), detail.date_precision(F.lit("x"), F.lit('{"date_precision": "year"}'), ["x"]).alias("p"), detail.date_precision(F.lit("z"), F.lit("{}"), ["x"]).alias("n")).first()
    assert tuple(one) == ("eitt tvö…", "year", None)
    assert detail.golden_candidates(passages, docs, 5, 2000, 1).count() == 3
