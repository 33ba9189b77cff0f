"""Registered queries that run the library's rules and small operators on literal rows.

The driver's tables hold no rulings, statutes or journals, so each query here has rows of
its own, and its SQL states the expected rows.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import citations as T
from ..functions import columns as C
from ..functions import journal as J
from ..functions import pages as P
from ..functions import rulings as R
from ..functions import statutes as S
from ..functions import text as X
from ..operators import builders, detail, graph, merge, quality, search, sqlguard
from ..sources import landed
from .catalog import query


def expect(columns: str, *rows: str) -> str:
    """SELECT of the expected rows; columns is a list of names and SQL types."""
    names = [c.strip().split(" ", 1) for c in columns.split(",")]
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({', '.join(n for n, _ in names)})"


def each(spark: SparkSession, inputs: list, rows_of, ddl: str) -> DataFrame:
    """rows_of(value) for every input, in an Arrow batch as the builders run them; id is the input's place from 1."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs, 1)], "id int, v string")
    return builders.per_document(rows, lambda d: [{"id": d["id"]} | r for r in rows_of(d["v"])], f"id int, {ddl}").drop("error")


def numbered(values: list, name: str = "x") -> list[dict]:
    return [{"place": k, name: v} for k, v in enumerate(values, 1)]


# ---------------------------------------------------------------- text rules

CITING = [
    "Í dómi Hæstaréttar 9. mars 2016 í máli nr. 412/2015 segir",
    "dóma Hæstaréttar í málum nr. 11/2003, 012/2003 og 13/2003",
    "úrskurði Landsréttar í máli nr. 045/2019 frá 3. maí 2019",
    "Héraðsdóms Norðurlands eystra í máli nr. E-31/2020",
    "úrskurður kærunefndar útboðsmála í máli nr. 5/2010",
    "samkvæmt lögum nr. 19/1940 og ákvörðun réttarins nr. 2019-155",
    "sjá Hrd. 514/2014, Hrd. 1983, bls. 1538 og Hérd. Reykn. E-7/2021",
    "Í dómi Landsréttar í máli nr. 8/2020 og dómi réttarins í máli nr. 9/2020",
    "dómur Hæstaréttar 3. maí sl. í máli nr. 5/2020",
]


@query(
    expect(
        "id INT, court VARCHAR, number VARCHAR, day DATE, verdict VARCHAR, form VARCHAR",
        "1, 'Hrd.', '412/2015', DATE '2016-03-09', 'Dómur', 'prose'",
        "2, 'Hrd.', '11/2003', NULL, 'Dómur', 'prose'",
        "2, 'Hrd.', '12/2003', NULL, 'Dómur', 'prose'",
        "2, 'Hrd.', '13/2003', NULL, 'Dómur', 'prose'",
        "3, 'Lrd.', '45/2019', DATE '2019-05-03', 'Úrskurður', 'prose'",
        "4, 'Hérd. Norðeyst.', 'E-31/2020', NULL, NULL, 'prose'",
        "6, 'Hrd. málsk.', '2019-155', NULL, 'Ákvörðun', 'prose'",
        "7, 'Hrd.', '514/2014', NULL, NULL, 'abbrev'",
        "7, 'Hrd.', NULL, NULL, NULL, 'reporter'",
        "7, 'Hérd. Reykn.', 'E-7/2021', NULL, NULL, 'abbrev'",
        "8, 'Lrd.', '8/2020', NULL, 'Dómur', 'prose'",
        "8, 'Lrd.', '9/2020', NULL, 'Dómur', 'prose'",
        "9, 'Hrd.', '5/2020', DATE '2020-05-03', 'Dómur', 'prose'",
    )
)
def cited_rulings(spark, sf_dir):
    """X9, W7."""
    rows = lambda v: [{"court": c["target_court"], "number": c["target_case_number"], "day": c["target_date"], "verdict": c["target_verdict"], "form": c["form"]} for c in T.citations(v, date(2020, 6, 1))]
    return each(spark, CITING, rows, "court string, number string, day date, verdict string, form string")


@query(
    expect(
        "id INT, law VARCHAR, gr INT, mgr INT, sfx VARCHAR",
        "1, '19/1940', 211, 2, NULL",
        "2, '91/1991', 3, NULL, NULL",
        "2, '91/1991', 2, NULL, NULL",
        "2, '91/1991', 1, NULL, NULL",
        "3, '19/1940', 218, NULL, 'a'",
        "4, '1/2000', 1, NULL, NULL",
        "4, '1/2000', 5, NULL, NULL",
        "5, '4/2001', 7, NULL, NULL",
    )
)
def cited_provisions(spark, sf_dir):
    """Backward chains, references back, each provision once."""
    texts = ["samkvæmt 2. mgr. 211. gr. almennra hegningarlaga nr. 19/1940", "sbr. 1. gr., 2. gr. og 3. gr. laga nr. 91/1991", "218. gr. a. laga nr. 19/1940", "1. gr. laga nr. 1/2000. Síðan segir í 5. gr. sömu laga", "7. gr. laga nr. 4/2001 og 7. gr. laga nr. 4/2001", "engin tilvísun"]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts, 1)], "doc_id string, body_text string")
    return builders.build_provisions(docs).select(F.col("doc_id").cast("int").alias("id"), "law", "gr", "mgr", "sfx")


@query(expect("id INT, law VARCHAR, gr INT, sfx VARCHAR, mgr INT", "1, '19/1940', 218, NULL, 2", "2, '33/1944', 3, NULL, NULL", "3, '19/1940', 218, 'a', NULL", "4, '19/1940', 218, NULL, NULL"))
def provision_queries(spark, sf_dir):
    """Either order; a law alone, or nothing, is no provision."""
    asked = ["2. mgr. 218. gr. laga nr. 19/1940", "3. gr. 33/1944", "218. gr. a. 19/1940", "19/1940, 218. gr.", "19/1940", ""]
    rows = lambda v: [dict(zip(("law", "gr", "sfx", "mgr"), p))] if (p := X.provision_query(v)) else []
    return each(spark, asked, rows, "law string, gr int, sfx string, mgr int")


HEADINGS = {"## Dómsorð:": "domsord", "D ó m s o r ð": "domsord", "Úrskurðarorð": "domsord", "IV. Niðurstaða": "nidurstada", "Forsendur og niðurstaða": "nidurstada", "Málavextir": "malsatvik", "Atvik máls": "malsatvik", "3. Málsástæður stefnda": "malsastaedur", "Kæra": "malsmedferd", "Kærandi": "annad", "Kröfurnar": "annad", "Dómsorðig": "annad", "Annað efni": "annad"}


@query(expect("id INT, kind VARCHAR", *(f"{k}, '{v}'" for k, v in enumerate(HEADINGS.values(), 1))))
def heading_kinds(spark, sf_dir):
    """X13."""
    return each(spark, list(HEADINGS), lambda v: [{"kind": X.section_kind(v)}], "kind string")


RULING = "## I. Málsatvik\n\n1. Fyrsta málsgrein. Hún er stutt.\n\n2. Önnur málsgrein.\n\n**II. Niðurstaða**\n3. Þriðja málsgrein.\n\n## Dómsorð:\nStefndi er sýkn."


@query(
    expect(
        "doc_id VARCHAR, ordinal INT, layer VARCHAR, section_kind VARCHAR, para_from INT, para_to INT, page_from INT, page_to INT",
        "'r', 0, 'summary', 'reifun', NULL, NULL, NULL, NULL",
        "'r', 1, 'body', 'malsatvik', 1, 2, 7, 8",
        "'r', 2, 'body', 'nidurstada', 3, 3, 8, 8",
        "'r', 3, 'body', 'domsord', NULL, NULL, 8, 8",
    )
)
def passages_of_a_ruling(spark, sf_dir):
    """Passages of all layers, their paragraphs and printed pages."""
    docs = spark.createDataFrame([("r", "Reifun máls.", RULING, None, [(0, 1, 7), (30, 2, 8)])], f"doc_id string, summary string, body_text string, lower_body_text string, page_offsets array<{schema.PAGE_OFFSET}>")
    return builders.build_passages(docs).select("doc_id", "ordinal", "layer", "section_kind", "para_from", "para_to", "page_from", "page_to")


@query(expect("id INT, verdict VARCHAR", "1, 'Dómur'", "2, 'Úrskurður'", "3, 'Úrskurður'", "4, 'Dómur'", "5, NULL", "6, 'Úrskurður'", "7, 'Dómur'", "8, NULL"))
def verdict_types(spark, sf_dir):
    """The most direct statement; contradictions are null."""
    texts = ["haestirettur|## Dómur Hæstaréttar\n\nUm úrskurð.", "haestirettur|Texti\n\n## Úrskurðarorð:\nHafnað.", "heradsdomstolar|## Ú r s k u r ð u r\n\nTexti", "x|Anna kveður upp dóm þennan.\n\nDómsorð:\nX", "x|Anna kveður upp úrskurð þennan.\n\nDómsorð:\nX", "x|Málið var tekið til úrskurðar 1. maí.", "x|Málið var dómtekið.", "x|nefndin kvað upp úrskurð"]
    rows = lambda v: [{"verdict": R.verdict_type(v.split("|", 1)[1], v.split("|")[0], v.startswith("haest"))}]
    return each(spark, texts, rows, "verdict string")


@query(expect("id INT, day DATE, body VARCHAR, lower_ruling BOOLEAN", "1, DATE '2022-05-05', 'Dómur þriðjudaginn 5. maí 2022. Texti', false", "2, DATE '2020-01-01', 'Meginmál.', true", "3, DATE '2020-01-01', 'Texti frá 5. maí 2022.', false"))
def split_rulings(spark, sf_dir):
    """Stamped dates beat the feed's, and a lower ruling is cut off."""
    texts = ["Dómur þriðjudaginn 5. maí 2022. Texti", "Meginmál.\n\n## Dómur Héraðsdóms Suðurlands\n\nNeðra mál.", "Texti frá 5. maí 2022."]
    rows = lambda v: [{"day": R.corrected_date(date(2020, 1, 1), v), "body": R.split_lower(v)[0], "n": int(R.split_lower(v)[1] is not None)}]
    return each(spark, texts, rows, "day date, body string, n int").select("id", "day", "body", (F.col("n") == 1).alias("lower_ruling"))


@query(expect("id INT, one VARCHAR, other VARCHAR", "1, 'A ehf.', 'B hf.'", "2, 'A (lögm.)', 'B (lögm.)'", "3, 'X', 'Y'", "4, 'Lögreglustjórinn', 'X'", "5, 'Bara heiti', NULL"))
def parties_of_titles(spark, sf_dir):
    """X18."""
    titles = ["A ehf. gegn B hf.", "Stefnandi: A (lögm.)\nStefndi: B (lögm.)", "Sækjandi: X\ngegn\nY", "Lögreglustjórinn\nVarnaraðili X", "Bara heiti"]
    rows = lambda v: [{"one": "; ".join(R.parties(v)[0]), "other": "; ".join(R.parties(v)[1]) or None}]
    return each(spark, titles, rows, "one string, other string")


@query(expect("id INT, place INT, keyword VARCHAR", "1, 1, 'Kærumál'", "1, 2, 'Gæsluvarðhald'", "1, 3, '2. mgr. 95. gr. laga nr. 88/2008'", "2, 1, 'Skaðabætur'"))
def preamble_keywords(spark, sf_dir):
    """X20."""
    texts = ["Lykilorð Kærumál. Gæsluvarðhald. 2. mgr. 95. gr. laga nr. 88/2008.\n\nDómur", "x Lykilorð\nSkaðabætur.\nÚtdráttur y", "ekkert"]
    return each(spark, texts, lambda v: numbered(R.preamble_keywords(v), "keyword"), "place int, keyword string")


@query(expect("id INT, name VARCHAR, link VARCHAR", "1, 'Almenn hegningarlög', '0123abcd-99'", "2, 'Lög um X', NULL"))
def law_names_and_links(spark, sf_dir):
    """P7, P14."""
    rows = lambda v: [{"name": R.law_name(v.split("|")[0]), "link": R.link_id(v.split("|")[1])}]
    return each(spark, ["1940 nr. 19 12. febrúar/ Almenn hegningarlög|https://x.example/domar/domur/?id=0123abcd-99", "55/2002: Lög um X|"], rows, "name string, link string")


@query(expect("citation VARCHAR", "'A o.fl.: T. Úlf, 5. árg., 2. hefti, 1990, bls. 3–9'", "'A og B: U. Úlf, 1991, bls. 4'"))
def journal_citations(spark, sf_dir):
    """P2."""
    rows = spark.createDataFrame([(["A", "B", "C"], "T", "Úlf", 5, "2", 1990, 3, 9), (["A", "B"], "U", "Úlf", None, None, 1991, 4, None)], "au array<string>, t string, j string, v int, i string, y int, f int, u int")
    c = F.col
    return rows.select(C.journal_citation(c("au"), c("t"), c("j"), c("v"), c("i"), c("y"), c("f"), c("u")).alias("citation"))


@query(expect("id INT, folded VARCHAR, isbn VARCHAR, joined VARCHAR", "1, 'thjod aerid olog', NULL, 'Þjóð Ærið — Ólög'", "2, 'isbn 978 0 306 40615 7', '9780306406157', 'ISBN 978-0-306-40615-7'", "3, 'laga regla og a b', NULL, 'lagaregla og A-\nB'", "4, '978 0 306 40615 8', NULL, '978-0-306-40615-8'"))
def small_text_rules(spark, sf_dir):
    """X25, X28, X36."""
    return each(spark, ["Þjóð Ærið — Ólög", "ISBN 978-0-306-40615-7", "laga-\nregla og A-\nB", "978-0-306-40615-8"], lambda v: [{"folded": X.fold(v), "isbn": X.isbn(v), "joined": X.dehyphenate(v)}], "folded string, isbn string, joined string")


@query(expect("id INT, similarity DOUBLE, run INT, share DOUBLE", "1, 1.0, 2, 1.0", "2, 0.7143, 1, 0.5", "3, 0.0, 0, 0.0"))
def similar_titles(spark, sf_dir):
    """X29, X32."""

    def rows(v: str) -> list[dict]:
        a, b = v.split("|")
        return [{"similarity": round(X.title_similarity(a, b), 4), "run": X.longest_common_run(X.fold(a).split(), X.fold(b).split()), "share": P.subsequence_share(a, b)}]

    return each(spark, ["Um lög|um lög!", "um lag|um log a", "xyz|abd"], rows, "similarity double, run int, share double")


@query(expect("id INT, place INT, name VARCHAR", "1, 1, 'Jón Jónsson'", "1, 2, 'Anna Önnudóttir'", "1, 3, 'Páll'", "2, 1, 'Ása Ásdóttir'"))
def bylines(spark, sf_dir):
    """X35."""
    return each(spark, ["Jón Jónsson, Anna Önnudóttir og Páll", "Ása Ásdóttir"], lambda v: numbered(X.authors(v), "name"), "place int, name string")


@query(expect("day DATE, impossible DATE, granted VARCHAR, denied VARCHAR, contradicted VARCHAR, stem VARCHAR", "DATE '2020-03-03', NULL, 'granted', 'denied', NULL, 'hrd-1-2020-domur-thjod'"))
def dates_and_outcomes(spark, sf_dir):
    """X37, P13, P11."""
    one = spark.createDataFrame([("Dagsett 3. mars 2020.", "31. febrúar 2020", "Beiðni um áfrýjunarleyfi er samþykkt.", "Beiðni er hafnað.")], "a string, b string, c string, d string")
    return one.select(C.icelandic_date(F.col("a")).alias("day"), C.icelandic_date(F.col("b")).alias("impossible"), C.outcome(F.col("c")).alias("granted"), C.outcome(F.col("d")).alias("denied"), C.outcome(F.concat("c", "d")).alias("contradicted"), C.file_stem(F.lit("Hrd. 1/2020 – Dómur Þjóð")).alias("stem"))


@query(expect("id INT, snippet VARCHAR, headline VARCHAR, short VARCHAR", "1, 'eitt <mark>tvö</mark> þrjú', 'eitt <mark>tvö</mark> þrjú', 'eitt tvö…'", "2, 'ekkert', 'ekkert', 'ekkert'"))
def snippets(spark, sf_dir):
    """P4, P5, P10."""
    import re

    return each(spark, ["eitt tvö þrjú", "ekkert"], lambda v: [{"snippet": X.snippet(v, re.compile("tvö")), "headline": X.headline(v, {"tvö"}), "short": X.truncate(v, 9)[0]}], "snippet string, headline string, short string")


@query(expect("id INT, place INT, page VARCHAR", "1, 1, 'texti 0\nendir 0'", "1, 2, 'texti 1\nendir 1'", "1, 3, 'texti 2\nendir 2'", "1, 4, 'texti 3\nendir 3'"))
def running_lines(spark, sf_dir):
    """Heads that recur on enough pages go, digits aside."""
    pages = [f"Tímarit {k}\ntexti {k}\nendir {k}" for k in range(4)]
    keep_last = [p + "\n" + w for p, w in zip(pages, ("a", "b", "c", "d"))]
    return each(spark, ["\f".join(keep_last)], lambda v: numbered([p.rpartition("\n")[0] for p in X.without_running_lines(v.split("\f"))], "page"), "place int, page string")


@query(expect("id INT, joined VARCHAR, second INT, body VARCHAR, notes INT, share DOUBLE", "1, 'lagaregla er', 4, 'lagaregla er', 0, 1.0", "2, 'Sjá texta1 og b2.\n1 Fyrri.\n2 Síðari.', NULL, 'Sjá texta1 og b2.', 2, 0.25"))
def page_texts(spark, sf_dir):
    """Pages joined over a cut word, notes apart, the share of known words."""

    def rows(v: str) -> list[dict]:
        text, offsets = P.joined_pages(v.split("\f"))
        body, notes = P.footnotes(text)
        known = P.known_share(text, {"lagaregla", "texta"})
        return [{"joined": text, "second": offsets[1]["char"] if len(offsets) > 1 else None, "body": body, "notes": len(notes), "share": round(known or 0.0, 4)}]

    return each(spark, ["laga-\fregla er", "Sjá texta1 og b2.\n1 Fyrri.\n2 Síðari."], rows, "joined string, second int, body string, notes int, share double")


@query(expect("id INT, place INT, begins INT, n INT", "1, 1, 0, 2", "1, 2, 3, 2", "2, 1, 0, 2", "2, 2, 3, 1"))
def found_in_text(spark, sf_dir):
    """Q12: matches in any case that don't overlap; too short queries and bad patterns find nothing."""
    rows = lambda v: [{"place": k, "begins": a, "n": n} for k, (a, n) in enumerate(P.matches(v.split("|")[0], v.split("|")[1], v.endswith("|r")) or [], 1)]
    return each(spark, ["Ab aB|ab", "aa a|a+|r", "aaa|a", "x|(|r"], rows, "place int, begins int, n int")


@query(expect("id INT, place INT, part VARCHAR", "1, 1, 'a b\n\nc d'", "1, 2, 'e'", "2, 1, 'a b'"))
def reader_parts(spark, sf_dir):
    """Q13."""
    return each(spark, ["a b\n\nc d\n\ne", "a b", " "], lambda v: numbered(P.parts(v, 3), "part"), "place int, part string")


@query(expect("law VARCHAR, title VARCHAR, num INT, suffix VARCHAR, paragraph INT, text VARCHAR", "'19/1940', 'Almenn hegningarlög', 1, NULL, 1, 'Fyrsta málsgrein.'", "'19/1940', 'Almenn hegningarlög', 1, NULL, 2, 'Önnur málsgrein.'", "'19/1940', 'Almenn hegningarlög', 218, 'a', NULL, '218. gr. a. Texti.'"))
def statute_articles(spark, sf_dir):
    """X21, S24."""
    html = '<html><head><title> Almenn  hegningarlög </title></head><body><span id="G1"></span><b>1. gr.</b> <img id="G1M1">Fyrsta málsgrein.<br><img id="G1M2">Önnur málsgrein.\n<span id="G218A"></span>218. gr. a. Texti.</body></html>'

    def rows(v: str) -> list[dict]:
        law = S.parse(v, "1940019.html")
        return [{"law": law["law"], "title": law["title"], "num": a["num"], "suffix": a["suffix"], "paragraph": s["num"], "text": s["text"]} for a in law["provisions"] for s in a["sub"] or [{"num": None, "text": a["text"]}]]

    return each(spark, [html], rows, "law string, title string, num int, suffix string, paragraph int, text string").drop("id")


LAWS = "law string, title string, provisions array<struct<num:int,suffix:string,text:string,sub:array<struct<num:int,text:string>>>>"


@query(expect("law VARCHAR, gr INT, text VARCHAR", "'19/1940', 218, 'Önnur'", "'19/1940', 7, 'Sjöunda a'"))
def provision_lookup(spark, sf_dir):
    """X22, Q8."""
    laws = spark.createDataFrame([("19/1940", "H", [(218, None, "Öll", [(1, "Fyrsta"), (2, "Önnur")]), (7, "a", "Sjöunda a", [])])], LAWS)
    return search.provision_of(laws, "19/1940", 218, None, 2).unionByName(search.provision_of(laws, "19/1940", 7, "a")).unionByName(search.provision_of(laws, "19/1940", 7))


# ---------------------------------------------------------------- journals


@query(expect("id INT, place INT, title VARCHAR, author VARCHAR, page INT", "1, 1, 'Um lög og rétt', 'Jón Jónsson', 3", "1, 2, 'Skaðabætur', 'Anna Önnudóttir', 12", "1, 3, 'Ritstjórnarpistill', NULL, 40", "2, 1, 'Um lög', 'Jón Jónsson', 4", "2, 2, 'Skaðabætur og vextir', NULL, 18", "2, 3, 'Lokaorð', NULL, 33"))
def contents_lists(spark, sf_dir):
    """Rows closed by numbers, and rows opened by them."""
    lists = ["EFNI\nJón Jónsson: Um lög og rétt ........ 3\nAnna Önnudóttir: Skaðabætur ........ l2\nRitstjórnarpistill ...... 40\n", "4 Jón Jónsson\nUm lög\n18 Skaðabætur\nog vextir\n33 Lokaorð", "9 Eitt\n2 Tvö\n8 Þrjú\n1 Fjögur"]
    rows = lambda v: [{"place": k, "title": e["title"], "author": "; ".join(e["authors"]) or None, "page": e["page_start"]} for k, e in enumerate(J.contents(v), 1)]
    return each(spark, lists, rows, "place int, title string, author string, page int")


@query(expect("id INT, page INT, printed INT, quality DOUBLE", *(f"1, {k}, {50 + k}, 0.875" for k in range(8))))
def printed_page_maps(spark, sf_dir):
    """Numbers of pages from segments of one offset."""

    def rows(v: str) -> list[dict]:
        m = X.page_map(v.split("\f"))
        return [{"page": k, "printed": p, "quality": m["quality"]} for k, p in enumerate(m["printed"]) if p is not None]

    pages = [("" if k == 3 else f"{50 + k}\n") + f"texti síðu {k} sem heldur áfram" for k in range(8)]
    return each(spark, ["\f".join(pages), "ekkert\fengin tala"], rows, "page int, printed int, quality double")


@query(expect("place INT, first_page INT, last_page INT, confidence DOUBLE, ok BOOLEAN", "1, 2, 3, 0.8, true", "2, 4, 5, 0.5, true"))
def located_articles(spark, sf_dir):
    """Where articles lie, what speaks for them, and whether the list fits."""

    def rows(v: str) -> list[dict]:
        pages = v.split("\f")
        printed = [None, None, 3, 4, 5, 6]
        found = J.located([{"title": "Um lög og rétt", "authors": ["Jón Jónsson"], "page_start": 3}, {"title": "Skaðabætur", "authors": [], "page_start": 5}], printed, pages)
        fits = J.gate(found, lambda t, i: t in pages[i], len(pages), front=2)["ok"]
        return [{"place": k, "first_page": a["pdf_pages"][0], "last_page": a["pdf_pages"][1], "confidence": J.confidence(J.checks(a, pages[a["pdf_pages"][0]], printed[a["pdf_pages"][0]])), "n": int(fits)} for k, a in enumerate(found, 1)]

    got = each(spark, ["kápa\fefni\fUm lög og rétt\nJón Jónsson\n3\fmeira\n4\fSkaðabætur\n5\fenn\n6"], rows, "place int, first_page int, last_page int, confidence double, n int")
    return got.select("place", "first_page", "last_page", "confidence", (F.col("n") == 1).alias("ok"))


@query(expect("place INT, title VARCHAR, note VARCHAR", "1, 'Rétt', 'mín'", "2, 'Handfærð', NULL", "3, 'Ný', NULL"))
def merged_manifest(spark, sf_dir):
    """What the user wrote stays."""
    old = [{"title": "Rétt", "page_start": 3, "provenance": {"title": "user"}, "note": "mín"}, {"title": "Handfærð", "page_start": 7, "provenance": {"title": "toc+user"}}, {"title": "Fallin", "page_start": 9, "provenance": {"title": "toc"}}]
    new = [{"title": "Rett", "page_start": 3, "provenance": {"title": "toc"}}, {"title": "Ný", "page_start": 20, "provenance": {}}]
    return each(spark, ["x"], lambda v: [{"place": k, "title": a["title"], "note": a.get("note")} for k, a in enumerate(J.merged(old, new), 1)], "place int, title string, note string").drop("id")


@query(expect("id INT, source VARCHAR, year INT, volume INT, issue INT", "1, 'tl', 1990, NULL, 2", "2, 'rann', 2010, 11, NULL"))
def file_identities(spark, sf_dir):
    """B11."""
    patterns = {"tl": r".*/TL (?P<year>\d{4})_(?P<issue>\d{2})\.pdf", "rann": r".*/Rann (?P<year>\d{4}) - (?P<volume>[IVXLC]+)\.pdf"}
    rows = lambda v: [{"volume": None, "issue": None} | m] if (m := J.identity(v, patterns)) else []
    return each(spark, ["a/TL 1990_02.pdf", "a/Rann 2010 - XI.pdf", "a/x.pdf"], rows, "source string, year int, volume int, issue int")


@query(expect("article_id INT, record_id INT, score DOUBLE", "1, 7, 1.0"))
def catalogue_matches(spark, sf_dir):
    """Gates of year and volume, weights .7, .25 and .05, and no match on a tie."""
    articles = spark.createDataFrame([(1, "um lög", 2000, 5, 3), (2, "annað", 2000, None, 9)], "article_id int, title string, year int, volume int, page int")
    records = spark.createDataFrame([(7, "um lög", 2000, 5, 3), (8, "um lögin", 2000, 6, 3), (9, "annað", 2000, 1, 1), (10, "annað", 2000, 2, 1)], "record_id int, record_title string, record_year int, record_volume int, record_page int")
    alike = F.when(F.col("title") == F.col("record_title"), 1.0).otherwise(0.5)
    score = quality.record_score(alike, F.col("page") == F.col("record_page"), F.col("year") == F.col("record_year"))
    return quality.best_record(articles, records, score, 0.55)


# ---------------------------------------------------------------- sinks and sources

KEPT = "k int, v string, f string, t int"


def stored(spark) -> tuple[DataFrame, DataFrame]:
    old = spark.createDataFrame([(1, "a", None, 1), (2, "b", "kept", 1)], KEPT)
    return old, spark.createDataFrame([(2, "B", "lost", 2), (3, "C", None, 2), (1, "A", "filled", 2)], KEPT)


@query(expect("k INT, v VARCHAR", "1, 'a'", "2, 'B'"))
def replaced_children(spark, sf_dir):
    """K6."""
    old, new = stored(spark)
    return merge.replace_children(old, new.where("k = 2"), new.where("k = 2"), "k").select("k", "v")


@query(expect("id INT, kept BOOLEAN, k INT", "1, true, 1", "2, false, NULL"))
def cascades(spark, sf_dir):
    """K7: children of missing parents go, or lose their reference."""
    kids = spark.createDataFrame([(1, 1), (2, 9)], "id int, k int")
    gone = merge.cascade(kids, stored(spark)[0], "k", "k").select("id", F.lit(True).alias("kept"))
    return merge.set_null(kids, stored(spark)[0], "k", "k").join(gone, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"), "k")


@query(expect("id INT, keywords VARCHAR", "1, 'x'", "2, 'x'", "3, 'y,x'"))
def appended_keywords(spark, sf_dir):
    """K8."""
    rows = spark.createDataFrame([(1, None), (2, ["x"]), (3, ["y"])], "id int, k array<string>")
    return rows.select("id", F.array_join(C.case_type_keywords(F.col("k"), F.lit("x")), ",").alias("keywords"))


@query(expect("k INT", "1", "2", "3"))
def changed_rows(spark, sf_dir):
    """S25, J25."""
    old, new = stored(spark)
    return merge.changed(new, old, "k", "v").select("k")


@query(expect("source_short VARCHAR, external_id VARCHAR", "'good', '1'", "'good', '2'"))
def moved_source(spark, sf_dir):
    """J24."""
    return merge.move_source(spark.createDataFrame([("good", "1"), ("bad", "1"), ("bad", "2")], "source_short string, external_id string"), "bad", "good")


@query(expect("first BIGINT, last BIGINT, stops BOOLEAN", "3, 4, false", "7, 29, true"))
def crawl_gaps(spark, sf_dir):
    """S14."""
    return landed.crawl_gaps(spark.createDataFrame([(k,) for k in (1, 2, 5, 6, 30)], "id long"))


@query(expect("path VARCHAR, link VARCHAR", "'a', '/x/1.pdf'", "'a', 'https://y.example/2.PDF?v=1'"))
def pdf_listings(spark, sf_dir):
    """S18, S19."""
    html = "<a href=\"/x/1.pdf\">1</a> <a href='https://y.example/2.PDF?v=1'>2</a> <a href=\"/x/1.pdf\">1</a> <a href='/3.html'>3</a>"
    return landed.pdf_links(spark.createDataFrame([("a", html), ("b", "")], "path string, html string"))


@query(expect("isbn VARCHAR, title VARCHAR, title_from VARCHAR, pdf VARCHAR", "'1', 'Bók', 'catalogue', 'abc'", "'2', 'Mín', 'own', NULL"))
def metadata_tiers(spark, sf_dir):
    """S2, S23."""
    raw = spark.createDataFrame([("1", " ", "Bók", "YWJj"), ("2", "Mín", "Önnur", "*")], "isbn string, own string, catalogue string, raw string")
    return landed.decoded(landed.tiered(raw, {"title": ["own", "catalogue"]}), "raw").select("isbn", "title", "title_from", F.decode("content", "utf-8").alias("pdf"))


@query(expect("source_short VARCHAR, case_number VARCHAR, summary VARCHAR, title VARCHAR, body_text VARCHAR", "'hrd', '1/2020', 'reifun', 'Hrd.', NULL"))
def silver_columns(spark, sf_dir):
    """The first alternative that holds something, else the source's default."""
    return landed.silver(spark.createDataFrame([("1/2020", " ", "reifun")], "caseNumber string, presentings string, abstract string"), "hrd", defaults={"title": "Hrd."}).drop("document_date")


# ---------------------------------------------------------------- documents, search and detail

COLUMNS = [f.split(" ")[0] for f in schema.DOCUMENTS.split(", ") if " " in f]


def document(doc_id: str, **given) -> tuple:
    row = {"doc_id": doc_id, "source_short": "haestirettur", "external_id": doc_id, "court": "Hrd.", "case_number": "1/2020", "document_date": date(2020, 1, 1), "verdict_type": "Dómur", "instance_tier": 3, "lang": "is", "body_text": "texti", "created_at": datetime(2024, 1, 1), "updated_at": datetime(2024, 1, 1)} | given
    return tuple(row.get(c) for c in COLUMNS)


def corpus(spark) -> DataFrame:
    rows = [
        document("a", body_text="Krafa um skaðabætur var tekin til greina. Krafa þessi er rétt.", document_date=date(2021, 1, 1), keywords=["Skaðabætur", "100%"], cited_provisions=[("19/1940", 218, 2, None)]),
        document("b", body_text="Krafa um vexti.", verdict_type="Úrskurður", document_date=None, keywords=["Vextir"]),
        document("c", source_short="landsrettur", court="Lrd.", body_text="Skaðabætur og vextir. 12. gr. laga nr. 91/1991.", document_date=date(2019, 5, 5)),
        document("d", source_short="landsrettur", court="Lrd.", body_text=None, summary="Krafa, skaðabætur og vextir.", document_date=date(2022, 5, 5)),
        document("e", source_short="felagsdomur", court="Féld.", body_text="Þing og ÞINGMENN.", document_date=date(2018, 5, 5)),
    ]
    return spark.createDataFrame(rows, schema.DOCUMENTS)


def indexes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages, and the inverted indexes of documents and passages."""
    passages = builders.build_passages(docs)
    own = builders.doc_lemmas(docs.withColumn("all", F.concat_ws(" ", "case_number", "court", "verdict_type", "summary", "body_text", "lower_body_text")), "all")
    keyed = builders.doc_lemmas(passages.withColumn("key", F.struct("doc_id", "ordinal", "section_kind")), "text", "key").select("key.*", "lemma", "tf", "positions")
    return passages, own, keyed


def find(spark, **request) -> search.Results:
    docs = corpus(spark)
    _, own, keyed = indexes(docs)
    return search.search(docs, own, keyed, search.Request(**request))


ASKED = {
    "newest": {"q": ""},
    "dates": {"date_from": "2019-05-05", "date_to": "2021-01-01"},
    "noise": {"q": "mgr gr lag nr", "provision": "2. mgr. 218. gr. laga nr. 19/1940"},
    "keyword": {"keyword": "VEXT"},
    "wildcard": {"keyword": 'skaða%", "1'},
    "any": {"q": "vexti þing", "mode": "any"},
    "prefix": {"q": "þing", "mode": "prefix"},
    "pattern": {"q": r"\mvext[[:alpha:]]+\M", "mode": "regex", "fields": ["body_text", "summary"]},
    "near": {"q": "krafa skaðabætur", "mode": "proximity", "within": 2},
    "near_in_abstract": {"q": "krafa skaðabætur", "mode": "proximity", "within": 2, "section_kinds": ["reifun"]},
}


@query(expect("name VARCHAR, doc_id VARCHAR", *(f"'{n}', '{d}'" for n, ids in {"newest": "abcde", "dates": "ac", "noise": "a", "keyword": "b", "wildcard": "a", "any": "bce", "prefix": "e", "pattern": "bcd", "near": "ad", "near_in_abstract": "d"}.items() for d in ids)))
def search_modes(spark, sf_dir):
    """Q1, F2, F4, F5, F7, F9, F11, F12, F14, T1, J1."""
    out = None
    for name, request in ASKED.items():
        rows = find(spark, **request).page.select(F.lit(name).alias("name"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(expect("sort VARCHAR, place INT, doc_id VARCHAR, tier INT", "'relevance', 1, 'a', 0", "'relevance', 2, 'd', 0", "'relevance', 3, 'c', 2", "'relevance', 4, 'b', 2", "'oldest', 1, 'c', 2", "'oldest', 2, 'a', 0", "'oldest', 3, 'd', 0", "'oldest', 4, 'b', 2"))
def relaxed_search(spark, sf_dir):
    """Widened search in both orders; a says krafa twice in one passage, d once."""
    from pyspark.sql import Window

    out = None
    for sort in ("relevance", "oldest"):
        page = find(spark, q="krafa skaðabætur", sort=sort, strategy="passage").page
        order = [F.asc("tier"), F.desc("best_rank"), F.desc("match_count")] if sort == "relevance" else []
        day = F.asc_nulls_last("document_date") if sort == "oldest" else F.desc_nulls_last("document_date")
        rows = page.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order, day, "doc_id"))).select(F.lit(sort).alias("sort"), "place", "doc_id", "tier")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(expect("doc_id VARCHAR, citation VARCHAR, anchor VARCHAR, snippet VARCHAR", "'a', 'Hrd. 1/2020 1. janúar 2021 – Dómur', 'hluti 1', '<mark>Krafa</mark> um <mark>skaðabætur</mark> var tekin til greina. <mark>Krafa</mark> þessi er rétt.'", "'d', 'Lrd. 1/2020 5. maí 2022 – Dómur', 'Reifun', '<mark>Krafa,</mark> <mark>skaðabætur</mark> og vextir.'"))
def search_snippets(spark, sf_dir):
    """Q1, P3, P4, P5."""
    docs = corpus(spark)
    passages, own, keyed = indexes(docs)
    request = search.Request(q="krafa skaðabætur", relax_below=0)
    return search.with_snippets(search.search(docs, own, keyed, request).page, docs, passages, request)


@query(expect("doc_id VARCHAR, lemma_text VARCHAR", "'a', '1/2020 Hrd. Dómur krafa um'", "'b', 'Hrd.'"))
def document_lemma_texts(spark, sf_dir):
    """X3."""
    docs = spark.createDataFrame([document("a"), document("b", case_number=None, verdict_type="")], schema.DOCUMENTS)
    return builders.document_lemmas(docs, spark.createDataFrame([("a", 1, "um"), ("a", 0, "krafa"), ("b", 0, "")], "doc_id string, ordinal int, lemmas string"))


@query(expect("lemma VARCHAR, tf INT", "'krafa', 1", "'kröfur', 1"))
def lemma_tables(spark, sf_dir):
    """X1."""
    forms = spark.createDataFrame([("kröfu", "krafa")], "form string, lemma string")
    return builders.doc_lemmas(spark.createDataFrame([("x", "Kröfu 12 kröfur")], "doc_id string, text string"), lemmas=forms).select("lemma", "tf")


@query(expect("lemma VARCHAR, tf INT", "'12', 1", "'kröfu', 1", "'kröfur', 1"))
def word_tokens(spark, sf_dir):
    """X2."""
    return builders.doc_lemmas(spark.createDataFrame([("x", "Kröfu 12 kröfur")], "doc_id string, text string"), letters_only=False).select("lemma", "tf")


@query(expect("setting VARCHAR, recall DOUBLE, hit DOUBLE, mrr DOUBLE, hit1 DOUBLE, zero BIGINT, widened INT", "'1', 0.5, 0.666667, 0.5, 0.333333, 1, 0", "'3', 0.666667, 0.666667, 0.5, 0.333333, 1, 1"))
def relaxation_sweep(spark, sf_dir):
    """Q15: two of three questions find something; with a higher bound the one of two words is widened and finds both its documents."""
    expected = spark.createDataFrame([("krafa skaðabætur", "d"), ("krafa skaðabætur", "b"), ("þing", "e"), ("hestur", "a")], "question string, doc string")
    runs = quality.sweep(expected, [1, 3], lambda q, below: find(spark, q=q, relax_below=below))
    return runs.select("setting", *(F.round(c, 6).alias(c) for c in ("recall", "hit", "mrr", "hit1")), "zero", "widened")


@query(expect("name VARCHAR, doc_id VARCHAR", "'stale', 'a'", "'stale', 'e'", "'forced', 'a'", "'forced', 'b'", "'since', 'a'", "'named', 'b'", "'limited', 'a'"))
def batch_selection(spark, sf_dir):
    """F15, F16."""
    docs = corpus(spark)
    hashes = builders.hashes_of(docs.where("doc_id in ('b', 'c', 'd')"))
    wanted = {"stale": {"sources": ["haestirettur", "landsrettur", "felagsdomur"]}, "forced": {"sources": ["haestirettur"], "force": True}, "since": {"sources": ["haestirettur", "felagsdomur"], "since": "2020-01-01"}, "named": {"sources": ["haestirettur"], "doc": "b"}, "limited": {"sources": ["haestirettur", "felagsdomur"], "most": 1}, "elsewhere": {"sources": ["haestirettur"], "doc": "c"}}
    out = None
    for name, how in wanted.items():
        rows = builders.selection(docs, hashes, **how).select(F.lit(name).alias("name"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


PASSAGE = "doc_id string, ordinal int, layer string, section_kind string"
PASSAGES = [("a", 0, "summary", "reifun"), ("a", 1, "body", "annad"), ("a", 2, "body", "domsord"), ("a", 3, "lower_body", "annad"), ("b", 1, "body", "annad")]


@query(expect("name VARCHAR, ordinal INT", "'window', 1", "'window', 2", "'layer', 1", "'layer', 2", "'kind', 2", "'context', 2", "'context', 3", "'next', 2"))
def passage_windows(spark, sf_dir):
    """Q6, Q7, T7, F13, A18."""
    p = spark.createDataFrame(PASSAGES, PASSAGE)
    found = {"window": search.passage_window(p, "a", 1, 2), "layer": search.passage_window(p, "a", 0, 9, layer="body"), "kind": search.passage_window(p, "a", 0, 9, ["domsord"]), "context": search.passage_context(p, "a", 3, 1, 5), "next": search.next_ordinal(p, "a", 1, ["domsord"])}
    out = None
    for name, rows in found.items():
        rows = rows.select(F.lit(name).alias("name"), "ordinal")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(expect("id INT, error VARCHAR", "1, 'SearchError'", "2, 'SearchError'", "3, 'SearchError'", "4, 'SearchError'", "5, NULL", "6, 'SearchError'", "7, 'SearchError'"))
def typed_errors(spark, sf_dir):
    """F18."""
    bad = [{"mode": "x"}, {"sort": "x"}, {"section_kinds": ["x"]}, {"mode": "regex", "q": "("}, {"mode": "regex", "q": r"\mx"}, {"mode": "exact", "section_kinds": ["annad"]}, {"relax_below": 300}]

    def wrong(request: dict) -> str | None:
        try:
            search.Request(**request)
        except search.SearchError as e:
            return type(e).__name__
        return None

    return spark.createDataFrame([(k, wrong(r)) for k, r in enumerate(bad, 1)], "id int, error string")


@query(expect("id INT, allowed BOOLEAN", "1, true", "2, true", "3, true", "4, false", "5, false", "6, false", "7, false", "8, false"))
def guarded_statements(spark, sf_dir):
    """Q10."""
    statements = ["SELECT add AS load FROM t -- drop table t", "WITH x AS (SELECT 1 AS a) SELECT * FROM x;", "EXPLAIN SELECT 1", "DROP TABLE t", "SELECT TRANSFORM(a) USING 'cat' AS (b string) FROM t", "SELECT * FROM text.`/etc/hostname`", "SELECT 1; SELECT 2", "SELECT reflect('a', 'b')"]

    def allowed(sql: str) -> bool:
        try:
            return bool(sqlguard.checked(spark, sql))
        except sqlguard.Rejected:
            return False

    return spark.createDataFrame([(k, allowed(s)) for k, s in enumerate(statements, 1)], "id int, allowed boolean")


@query(expect("id INT, cell VARCHAR, cut BOOLEAN", "1, NULL, false", "2, '1.50', false", "3, '<bytes 3>', false", "4, '2020-01-02', false", "5, 'eitt tvö…', true"))
def safe_cells(spark, sf_dir):
    """P9."""
    import decimal

    cells = [sqlguard.cell(v, 9) for v in (float("nan"), decimal.Decimal("1.50"), b"abc", date(2020, 1, 2), "eitt tvö þrjú")]
    return spark.createDataFrame([(k, v, cut) for k, (v, cut) in enumerate(cells, 1)], "id int, cell string, cut boolean")


@query(expect("view VARCHAR, name VARCHAR, type VARCHAR", "'quillon_five', 'id', 'bigint'", "'quillon_five', 'x', 'string'"))
def described_schema(spark, sf_dir):
    """Q9."""
    spark.range(5).withColumn("x", F.lit("a")).createOrReplaceTempView("quillon_five")
    return spark.createDataFrame(sqlguard.describe(spark, "quillon_five"), "view string, name string, type string")


@query(expect("doc_id VARCHAR, citation VARCHAR, n INT, summary VARCHAR", "'a', 'Hrd. 1/2020 1. janúar 2020 – Dómur', 5, 'eitt tvö'", "'b', 'Hrd. 1/2020 1. janúar 2020 – Dómur', 0, NULL"))
def compact_rows(spark, sf_dir):
    """P1, P8."""
    docs = spark.createDataFrame([document("a", keywords=list("abcdefg"), summary="eitt tvö"), document("b")], schema.DOCUMENTS)
    return detail.compact(docs).select("doc_id", "citation", F.size("keywords").alias("n"), "summary")


@query(expect("id INT, precision VARCHAR", "1, 'year'", "2, NULL"))
def date_precisions(spark, sf_dir):
    """P6."""
    rows = spark.createDataFrame([(1, "x"), (2, "z")], "id int, source string")
    return rows.select("id", detail.date_precision(F.col("source"), F.lit('{"date_precision": "year"}'), ["x"]).alias("precision"))


@query(expect("article INT, issue_label VARCHAR, embargoed BOOLEAN, has_pdf BOOLEAN", "1, '2. hefti', false, true", "2, '3. hefti', true, false", "3, NULL, false, false"))
def journal_blocks(spark, sf_dir):
    """J2, P16."""
    articles = spark.createDataFrame([(1, 1, "a.pdf"), (2, 2, "b.pdf"), (3, None, None)], "article int, issue_id int, pdf_path string")
    issues = spark.createDataFrame([(1, "2. hefti", date(2019, 1, 1), False), (2, "3. hefti", date(2030, 1, 1), False)], "issue_id int, label string, embargo_until date, locked boolean")
    return detail.journal_block(articles, issues, "2020-01-01").select("article", "issue_label", "embargoed", "has_pdf")


CITED = [("a", "body", 3, 10, "Krafa", "Lrd.", "1/2020", None, None, "prose", "resolved", "c", "casenum_unique", 0.8), ("a", "summary", 1, 5, "x", "Lrd.", "1/2020", None, None, "prose", "resolved", "c", "casenum_unique", 0.9), ("a", "body", 20, 25, "y", "Hrd.", "9/2020", None, None, "prose", "unresolved", None, None, None), ("d", "body", 0, 5, "z", "Lrd.", "1/2020", None, None, "prose", "resolved", "a", "casenum_date", 1.0)]


def cited(spark) -> DataFrame:
    return spark.createDataFrame(CITED, f"{schema.CITATIONS}, {schema.RESOLUTIONS}")


def linked(spark) -> DataFrame:
    return spark.createDataFrame([("h", "l", "appealed_to", 0.9, "casenum"), ("l", "s", "appealed_to", 0.8, "casenum"), ("s", "l", "appealed_from", 0.8, "casenum"), ("p", "l", "leyfisbeidni_um", 1.0, "casenum"), ("s", "z", "cites", 1.0, "citation")], schema.LINKS)


@query(expect("side VARCHAR, other VARCHAR, layer VARCHAR, ordinal INT, also_appeal BOOLEAN", "'out', 'c', 'body', 0, true", "'in', 'd', 'body', NULL, false"))
def document_citations(spark, sf_dir):
    """Q4, Q5, W3, J6, J11."""
    docs = corpus(spark)
    links = spark.createDataFrame([("a", "c", "appealed_to", 1.0, "casenum")], schema.LINKS)
    d = detail.document(docs, links, cited(spark), builders.build_passages(docs), "a")
    rows = lambda f, side: f.select(F.lit(side).alias("side"), "other", "layer", "ordinal", "also_appeal")
    return rows(d.outgoing, "out").unionByName(rows(d.incoming, "in"))


@query(expect("from_doc_id VARCHAR, to_doc_id VARCHAR, relation VARCHAR, confidence DOUBLE", "'a', 'c', 'cites', 0.9", "'d', 'a', 'cites', 1.0"))
def cites_edges(spark, sf_dir):
    """A14, K4."""
    return graph.cites_edges(cited(spark)).drop("method")


@query(expect("from_doc_id VARCHAR, number VARCHAR, status VARCHAR, to_doc_id VARCHAR", "'a', '1/2020', 'resolved', 'c'", "'a', '1/2020', 'resolved', 'c'", "'a', '9/2020', 'resolved', 'new'", "'d', '1/2020', 'resolved', 'a'"))
def relinked_citations(spark, sf_dir):
    """B2: open citations find a ruling that came later."""
    ids = spark.createDataFrame([(x,) for x in ("a", "c", "d", "new")], "doc_id string")
    later = spark.createDataFrame([document("new", case_number="9/2020", document_date=date(2019, 1, 1))], schema.DOCUMENTS)
    got = graph.relink(cited(spark), graph.citation_index(later), corpus(spark), ids)
    return got.select("from_doc_id", F.col("target_case_number").alias("number"), "status", "to_doc_id")


@query(expect("court VARCHAR, resolved BIGINT, unresolved BIGINT", "'Lrd.', 3, NULL", "'Hrd.', NULL, 1"))
def citation_statuses(spark, sf_dir):
    """A11."""
    return quality.citation_report(cited(spark))["status"].select(F.col("target_court").alias("court"), "resolved", "unresolved")


@query(expect("share DOUBLE, mean DOUBLE, most BIGINT", "0.75, 1.0, 1"))
def citation_coverage(spark, sf_dir):
    """A12."""
    report = quality.citation_report(cited(spark))
    return report["coverage"].join(report["spread"])


@query(expect("from_doc_id VARCHAR, to_doc_id VARCHAR, confidence DOUBLE, method VARCHAR", "'h', 's', 0.95, 'chain_inference'"))
def chained_appeals(spark, sf_dir):
    """J21, B6."""
    return graph.chained(linked(spark)).drop("relation")


@query(expect("from_doc_id VARCHAR, to_doc_id VARCHAR, relation VARCHAR", "'h', 'l', 'appealed_to'", "'l', 'h', 'appealed_from'", "'l', 's', 'appealed_to'", "'s', 'l', 'appealed_from'", "'p', 'l', 'leyfisbeidni_um'", "'l', 'p', 'leiddi_til_doms'", "'s', 'z', 'cites'"))
def mirrored_links(spark, sf_dir):
    """J13, K4."""
    return graph.mirrored(linked(spark)).select("from_doc_id", "to_doc_id", "relation")


@query(expect("doc_id VARCHAR, has_appeal_links BOOLEAN", "'h', true", "'l', true", "'s', true", "'p', true", "'z', false"))
def appeal_flags(spark, sf_dir):
    """J10."""
    return graph.has_appeal_links(spark.createDataFrame([(x,) for x in "hlspz"], "doc_id string"), linked(spark))


@query(expect("fault VARCHAR, n BIGINT", "'orientation', 1", "'two_relations', 1", "'no_mirror', 2", "'cites_later', 1"))
def integrity_checks(spark, sf_dir):
    """Q14, J13, A10."""
    docs = spark.createDataFrame([("h", 1, date(2020, 1, 1)), ("l", 2, date(2020, 2, 1)), ("s", 3, date(2020, 3, 1)), ("z", 3, date(2021, 1, 1))], "doc_id string, instance_tier int, document_date date")
    links = linked(spark).unionByName(spark.createDataFrame([("h", "l", "appealed_from", 0.9, "casenum")], schema.LINKS))
    out = None
    for name, rows in graph.integrity(links, docs).items():
        rows = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(expect("from_doc_id VARCHAR, to_doc_id VARCHAR, method VARCHAR, confidence DOUBLE", "'u1', 'l1', 'casenum', 1.0", "'u2', 'l2', 'court_window', 1.0"))
def linked_appeals(spark, sf_dir):
    """J16, J17, A19, B4."""
    upper = spark.createDataFrame([("u1", ["E-012/2020"], None, None, ["5", "5", "7"], ["a", "b"]), ("u2", [], "Hérd. Rvk.", date(2020, 3, 10), ["1"], ["c", "d"]), ("u3", [], "Hérd. Rvk.", date(2010, 1, 1), [], [])], "doc_id string, casenums array<string>, lower_court string, lower_date date, nums array<string>, words array<string>")
    lower = spark.createDataFrame([("l1", "Hérd. Rvk.", "E-12/2020", date(2020, 1, 1), ["5", "7"], ["z"]), ("l2", "Hérd. Rvk.", "E-1/2019", date(2020, 3, 20), ["2"], ["c", "d", "e"]), ("l3", "Hérd. Rvk.", "E-2/2019", date(2020, 3, 12), ["2"], ["q"])], "doc_id string, court string, case_number string, document_date date, nums array<string>, words array<string>")
    return graph.link_appeals(upper, lower).drop("relation")


@query(expect("from_doc_id VARCHAR, to_doc_id VARCHAR, relation VARCHAR", "'p', 'r1', 'leyfisbeidni_um'", "'p', 'j', 'leiddi_til_doms'"))
def petition_chains(spark, sf_dir):
    """Two decisions of one day are ambiguous."""
    rulings = spark.createDataFrame([("r1", "Lrd.", "7/2019", date(2019, 1, 1), "Dómur"), ("r2", "Lrd.", "7/2019", date(2019, 6, 1), "Úrskurður"), ("j", "Hrd.", "1/2020", date(2020, 5, 5), "Dómur"), ("t1", "Lrd.", "8/2019", date(2019, 1, 1), "Dómur"), ("t2", "Lrd.", "8/2019", date(2019, 1, 1), "Dómur")], "doc_id string, court string, case_number string, document_date date, verdict_type string")
    petitions = spark.createDataFrame([("p", "Lrd.", "007/2019", "Dómur", date(2019, 9, 9)), ("q", "Lrd.", "8/2019", None, date(2019, 9, 9))], "doc_id string, target_court string, target_number string, target_verdict string, document_date date")
    edges = graph.petition_links(petitions, rulings)
    appeals = spark.createDataFrame([("j", "r1", "appealed_from", 1.0, "casenum")], schema.LINKS)
    dates = rulings.select("doc_id", "document_date").union(petitions.select("doc_id", "document_date"))
    return edges.unionByName(graph.petition_judgments(edges, appeals, dates)).select("from_doc_id", "to_doc_id", "relation")


@query(expect("from_doc_id VARCHAR, to_doc_id VARCHAR, relation VARCHAR, confidence DOUBLE", "'h1', 'l1', 'appealed_from', 1.0", "'l1', 'h1', 'appealed_to', 1.0", "'h2', 'l2', 'appealed_from', 1.0", "'l2', 'h2', 'appealed_to', 1.0"))
def resolution_links(spark, sf_dir):
    """J20, P14, B6."""
    docs = spark.createDataFrame([("h1", "haestirettur", "x", "https://x.example/domur/?id=aa-1&v=2"), ("h2", "haestirettur", "y", "https://x.example/domar/bb-2"), ("h3", "haestirettur", "z", ""), ("l1", "landsrettur", "aa-1", None), ("l2", "heradsdomstolar", "bb-2", None)], "doc_id string, source_short string, external_id string, link string")
    return graph.resolution_links(docs, "haestirettur", ["landsrettur", "heradsdomstolar"]).drop("method")


# ---------------------------------------------------------------- quality


@query(expect("doc_id VARCHAR, kept BOOLEAN", "'a', false", "'b', true", "'c', true", "'d', true", "'e', true", "'f', true"))
def near_duplicate_rulings(spark, sf_dir):
    """Alike in pairs under one key; keys with a null part never group."""
    rows = [document("a", body_text="sami texti hér"), document("b", body_text="Sami  texti hér!", created_at=datetime(2024, 2, 1)), document("c", case_number="2/2020", body_text="x"), document("d", case_number="2/2020", body_text="allt annað"), document("e", court=None, body_text="sami"), document("f", court=None, body_text="sami")]
    kept, dropped = quality.deduplicate(spark.createDataFrame(rows, schema.DOCUMENTS))
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(dropped.select("doc_id", F.lit(False).alias("kept")))


@query(expect("stratum VARCHAR, seats INT", "'a', 4", "'b', 2", "'c', 1"))
def apportioned_seats(spark, sf_dir):
    """T11."""
    return spark.createDataFrame(list(quality.apportion({"a": 50, "b": 30, "c": 20}, 7).items()), "stratum string, seats int")


@query(expect("place INT, s VARCHAR, k INT", "1, 'x', 1", "2, 'x', 2", "3, 'y', 3"))
def greedy_choice(spark, sf_dir):
    """W5."""
    rows = [{"s": "x", "k": 1}, {"s": "x", "k": 2}, {"s": "y", "k": 1}, {"s": "y", "k": 3}]
    return spark.createDataFrame([(i, r["s"], r["k"]) for i, r in enumerate(quality.greedy_caps(rows, {"s": 2, "k": 1}), 1)], "place int, s string, k int")


@query(expect("source_short VARCHAR, n BIGINT", "'haestirettur', 1", "'landsrettur', 1", "'felagsdomur', 1"))
def question_pool(spark, sf_dir):
    """Fitting, dated passages, one a source."""
    docs = corpus(spark)
    return detail.golden_candidates(builders.build_passages(docs), docs, 5, 2000, 1).groupBy("source_short").agg(F.count("*").alias("n"))


@query(expect("to_doc_id VARCHAR, number_ok BOOLEAN, court_ok BOOLEAN, date_ok BOOLEAN, order_ok BOOLEAN, span_ok BOOLEAN", "'c', false, true, true, true, true", "'a', false, false, true, true, NULL"))
def audited_citations(spark, sf_dir):
    """B10."""
    got = detail.audit(cited(spark).where("layer = 'body'"), corpus(spark))
    return got.select("to_doc_id", "number_ok", "court_ok", "date_ok", "order_ok", "span_ok")
