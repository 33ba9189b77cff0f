"""The text rules on cases written for this engine, and their invariants."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import statutes
from quillon.functions import text as X

RULING = """## I. Málsatvik

1. Fyrsta málsgrein dómsins. Hún er stutt.

2. Önnur málsgrein.
Hún nær yfir tvær línur.

**II. Niðurstaða**
3. Þriðja málsgrein fylgir fyrirsögn.

## Dómsorð:
Stefndi er sýkn."""


def test_passages_follow_headings_and_paragraphs():
    found = X.passages(RULING)
    assert [p["section_kind"] for p in found] == ["malsatvik", "nidurstada", "domsord"]
    assert (found[0]["para_from"], found[0]["para_to"]) == (1, 2)
    assert found[1]["section_path"] == "II. Niðurstaða" and found[1]["para_from"] == 3
    assert found[2]["section_path"] == "Dómsorð"


text_like = st.text(alphabet="aB. \n\t#*1Ié", max_size=400)


@settings(max_examples=200, deadline=None)
@given(text_like, st.integers(2, 12), st.integers(5, 60))
def test_passages_keep_offsets(text, words, chars):
    found = X.passages(text, target_words=max(1, words // 2), max_words=words, max_chars=chars)
    at = 0
    for p in found:
        assert text[p["char_start"] : p["char_end"]] == p["text"] and p["char_start"] >= at
        assert not text[at : p["char_start"]].strip()
        assert p["word_count"] <= max(words, X.HEADING_WORDS) or len(p["text"].split()) == 1
        at = p["char_end"]
    assert not text[at:].strip()


def test_oversize_block_is_cut_at_sentences_then_words():
    text = "Ein setning hér. " * 40 + "orð " * 900
    found = X.passages(text)
    assert all(p["word_count"] <= 400 and len(p["text"]) <= 6000 for p in found)
    assert sum(p["word_count"] for p in found) == len(text.split())


@pytest.mark.parametrize(
    "heading, kind",
    [("## Dómsorð:", "domsord"), ("D ó m s o r ð", "domsord"), ("Úrskurðarorð", "domsord"), ("IV. Niðurstaða", "nidurstada"), ("Forsendur og niðurstaða", "nidurstada"), ("Málavextir", "malsatvik"), ("3. Málsástæður stefnda", "malsastaedur"), ("Dómkröfur", "malsmedferd"), ("Annað efni", "annad"), ("Kærandi", "annad"), ("Kröfurnar", "annad"), ("Dómsorðig", "annad"), ("DómsorðStefndi greiði", "domsord"), ("Urskurðarorð", "domsord"), ("NIÐURSTAÐA", "nidurstada"), (None, "annad"), ("Ályktunarorð", "domsord")],
)
def test_section_kinds(heading, kind):
    assert X.section_kind(heading) == kind


def test_printed_pages_of_a_span():
    pages = [{"char": 0, "printed": 5}, {"char": 100, "printed": None}, {"char": 200, "printed": 7}]
    assert X.printed_pages(pages, 10, 90) == (5, 5)
    assert X.printed_pages(pages, 10, 250) == (5, 7)
    assert X.printed_pages(pages, 120, 180) == (None, None)
    assert X.printed_pages(pages, 900, 950) == (7, 7)
    assert X.printed_pages(None, 0, 1) == (None, None)


def test_layers_are_numbered_through():
    found = X.layer_passages({"summary": "Reifun máls.", "body": "Meginmál.", "lower_body": None}, [{"char": 0, "printed": 3}])
    assert [(p["ordinal"], p["layer"], p["section_kind"], p["page_from"]) for p in found] == [(0, "summary", "reifun", None), (1, "body", "annad", 3)]


def p(law, gr, mgr=None, sfx=None):
    return {"law": law, "gr": gr, "mgr": mgr, "sfx": sfx}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("samkvæmt 2. mgr. 218. gr. almennra hegningarlaga nr. 19/1940", [p("19/1940", 218, 2)]),
        ("sbr. 1. gr., 2. gr. og 3. gr. laga nr. 91/1991", [p("91/1991", 3), p("91/1991", 2), p("91/1991", 1)]),
        ("218. gr. a. laga nr. 19/1940", [p("19/1940", 218, None, "a")]),
        ("1. gr. laga nr. 1/2000. Síðan segir í 5. gr. sömu laga", [p("1/2000", 1), p("1/2000", 5)]),
        ("1. gr. laga nr. 1/2000 og 1. gr. laga nr. 1/2000", [p("1/2000", 1)]),
        ("engin tilvísun hér", []),
        (None, []),
    ],
)
def test_provisions(text, expected):
    assert sorted(X.provisions(text), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(
    "q, expected",
    [
        ("2. mgr. 218. gr. laga nr. 19/1940", ("19/1940", 218, None, 2)),
        ("3. gr. 33/1944", ("33/1944", 3, None, None)),
        ("218. gr. 1. mgr. 19/1940", ("19/1940", 218, None, 1)),
        ("218. gr. a. 19/1940", ("19/1940", 218, "a", None)),
        ("3. mgr. 70. gr. almennra hegningarlaga nr. 19/1940", ("19/1940", 70, None, 3)),
        ("19/1940, 218. gr.", ("19/1940", 218, None, None)),
        ("19/1940", None),
        ("", None),
    ],
)
def test_provision_queries(q, expected):
    assert X.provision_query(q) == expected


def cited(text, today=None):
    return [(c["target_court"], c["target_case_number"], c["target_date"], c["target_verdict"], c["form"]) for c in X.citations(text, today)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Í dómi Hæstaréttar 8. nóvember 2017 í máli nr. 700/2017 segir", [("Hrd.", "700/2017", date(2017, 11, 8), "Dómur", "prose")]),
        ("dóma Hæstaréttar í málum nr. 1/2001, 2/2001 og 3/2001", [("Hrd.", "1/2001", None, "Dómur", "prose"), ("Hrd.", "2/2001", None, "Dómur", "prose"), ("Hrd.", "3/2001", None, "Dómur", "prose")]),
        ("úrskurði Landsréttar í máli nr. 012/2019 frá 3. maí 2019", [("Lrd.", "12/2019", date(2019, 5, 3), "Úrskurður", "prose")]),
        ("Héraðsdóms Reykjavíkur í máli nr. E-12/2020", [("Hérd. Rvk.", "E-12/2020", None, None, "prose")]),
        ("úrskurður kærunefndar útboðsmála í máli nr. 5/2010", []),
        ("dómur Hæstaréttar. Annað mál: úrskurðarnefndar í máli nr. 5/2010", []),
        ("samkvæmt lögum nr. 19/1940", []),
        ("Hæstiréttur vísaði til laga nr. 91/1991", []),
        ("ákvörðun réttarins nr. 2019-155", [("Hrd. málsk.", "2019-155", None, "Ákvörðun", "prose")]),
        ("sjá Hrd. 700/2017 og Lrd. 5/2019", [("Hrd.", "700/2017", None, None, "abbrev"), ("Lrd.", "5/2019", None, None, "abbrev")]),
        ("Hrd. 1983, bls. 1538", [("Hrd.", None, None, None, "reporter")]),
        ("H 1999:2015", [("Hrd.", None, None, None, "reporter")]),
        ("Hérd. Reykn. E-12/2020", [("Hérd. Reykn.", "E-12/2020", None, None, "abbrev")]),
        ("Félagsdóms í máli nr. 5/2012", [("Féld.", "5/2012", None, None, "prose")]),
        ("", []),
    ],
)
def test_citations(text, expected):
    assert cited(text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("sem áðurnefndur dómur Hæstaréttar í máli nr. 61/2004 og úrskurðarnefndar", [("Hrd.", "61/2004")]),
        ("dómur Hæstaréttar í áðurnefndu máli nr. 61/2004", [("Hrd.", "61/2004")]),
        ("Hæstiréttur taldi að stofnunin hefði í máli nr. 61/2004", []),
        ("í máli Hæstaréttar nr. 000/2004 og laga nr. 61/2004", [("Hrd.", "0/2004")]),
        ("Hrd. 514/2014; Hrd.1983/1538; Hrd. 2001/2002", [("Hrd.", "514/2014"), ("Hrd.", None), ("Hrd.", "2001/2002")]),
        ("mál nr. 7/2004 " + "x" * 130 + " dómur Landsréttar", []),
        ("dómur Landsréttar " + "x" * 130 + " í máli nr. 7/2004", []),
    ],
)
def test_landmarks(text, expected):
    assert [c[:2] for c in cited(text)] == expected


def test_provisions_take_linear_time():
    import time

    text = "1. gr. laga nr. 1/2000. " * 16_000
    began = time.perf_counter()
    assert X.provisions(text) == [p("1/2000", 1)]
    assert time.perf_counter() - began < 3


def test_relative_years():
    text = "Dómur Hæstaréttar 3. maí sl. í máli nr. 5/2020"
    assert cited(text, date(2020, 6, 1))[0][2] == date(2020, 5, 3)
    assert cited(text, date(2021, 2, 1))[0][2] == date(2020, 5, 3)
    assert cited(text)[0][2] is None


def test_court_is_inherited_in_a_sentence():
    found = cited("Í dómi Hæstaréttar í máli nr. 1/2001 og dómi réttarins í máli nr. 2/2001")
    assert [c[:2] for c in found] == [("Hrd.", "1/2001"), ("Hrd.", "2/2001")]


def test_citations_point_at_their_numbers():
    text = "Sbr. dóm Landsréttar í máli nr. 77/2018, Hrd. 5/2001 og fleira."
    for c in X.citations(text):
        assert text[c["char_start"] : c["char_end"]].endswith(c["target_case_number"])


def numbered(first, n, gap=()):
    return [("" if k in gap else f"{first + k}\n") + f"texti síðu {k} sem heldur áfram" for k in range(n)]


def test_page_maps():
    m = X.page_map(numbered(50, 8, gap={3}))
    assert m["offset"] == 50 and m["printed"] == list(range(50, 58)) and m["quality"] == 0.875
    assert X.page_map(["ekkert", "engin tala"])["offset"] is None
    assert X.page_map([])["printed"] == []
    two = X.page_map(numbered(1, 6) + ["kápa"] + numbered(20, 9))
    assert two["printed"][6] is None and two["printed"][7] == 20
    restart = X.page_map(numbered(1, 8) + numbered(1, 8))
    assert restart["offset"] is None
    assert X.page_numbers(["1950\ntexti", "texti\n12"]) == [None, 12]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 20)), max_size=14))
def test_chain_is_increasing_and_longest(read):
    from collections import Counter
    from itertools import combinations

    chain = X.increasing_chain(read)
    assert all(read[a] < read[b] and a < b for a, b in zip(chain, chain[1:]))
    votes = Counter(n - i for i, n in enumerate(read) if n is not None)
    usable = [i for i, n in enumerate(read) if n is not None and votes[n - i] >= X.AGREE]
    best = max((k for k in range(len(usable) + 1) for c in combinations(usable, k) if all(read[a] < read[b] for a, b in zip(c, c[1:]))), default=0)
    assert len(chain) == best


def test_small_rules():
    assert X.fold("Þjóð Ærið — Ólög") == "thjod aerid olog"
    assert X.title_similarity("Um lög", "um lög!") == 1.0
    assert X.dehyphenate("laga-\nregla og A-\nB") == "lagaregla og A-\nB"
    pages = [f"Tímarit {k}\ntexti {k} a\nannað" for k in range(6)]
    assert all("Tímarit" not in x for x in X.without_running_lines(pages))
    assert X.isbn("ISBN 978-0-306-40615-7") == "9780306406157" and X.isbn("0-306-40615-2") == "0306406152" and X.isbn("978-0-306-40615-8") is None
    assert X.authors("Jón Jónsson, Anna Önnudóttir og Páll") == ["Jón Jónsson", "Anna Önnudóttir", "Páll"]
    assert X.longest_common_run("a b c d".split(), "x b c d y".split()) == 3
    assert X.truncate("eitt tvö þrjú", 9) == ("eitt tvö…", True) and X.truncate("stutt", 9) == ("stutt", False)


def test_snippets():
    import re

    text = "a" * 300 + " leitarorð " + "b" * 300
    s = X.snippet(text, re.compile("leitarorð"))
    assert s.startswith("…") and s.endswith("…") and "<mark>leitarorð</mark>" in s
    assert X.snippet("ekkert", re.compile("x"), "reifun") == "reifun"
    assert X.headline("eitt tvö þrjú fjögur", {"þrjú"}) == "eitt tvö <mark>þrjú</mark> fjögur"


HTML = """<html><head><title> Almenn  hegningarlög </title></head><body><h1>Lög</h1>
<span id="G1"></span><b>1. gr.</b> <img id="G1M1">Fyrsta málsgrein.<br><img id="G1M2">Önnur málsgrein.
<span id="G218A"></span>218. gr. a. Texti.</body></html>"""


def test_statutes():
    found = statutes.parse(HTML.encode("iso-8859-1"), "1940019.html")
    assert found["law"] == "19/1940" and found["title"] == "Almenn hegningarlög"
    first, second = found["provisions"]
    assert first["num"] == 1 and [s["num"] for s in first["sub"]] == [1, 2] and first["sub"][1]["text"] == "Önnur málsgrein."
    assert second["suffix"] == "a" and second["text"].startswith("218. gr. a.")
