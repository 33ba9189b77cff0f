"""Column expressions of the legal corpus: normal forms, labels, hashes, filters, ranks.

All of them are built-in functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Icelandic month names, as citations print them.
MONTHS = ["janúar", "febrúar", "mars", "apríl", "maí", "júní", "júlí", "ágúst", "september", "október", "nóvember", "desember"]
#: Layers of a document in the order of its passages.
LAYERS = ["summary", "body", "lower_body"]
#: Kinds of sections.
SECTION_KINDS = ["reifun", "malsmedferd", "malsatvik", "malsastaedur", "nidurstada", "domsord", "annad"]
#: Relations between documents.
APPEAL_RELATIONS = ["appealed_to", "appealed_from", "leyfisbeidni_um", "leiddi_til_doms"]
MIRROR = {"appealed_to": "appealed_from", "appealed_from": "appealed_to", "leyfisbeidni_um": "leiddi_til_doms", "leiddi_til_doms": "leyfisbeidni_um"}
UNIT = "\x1f"
LETTER = r"\p{L}\p{N}_"


def norm_case_number(number: Column) -> Column:
    """Without blanks, upper case, without leading zeros after an optional letter prefix; empty is null."""
    tight = F.upper(F.regexp_replace(number, r"\s+", ""))
    return F.nullif(F.regexp_replace(tight, r"^([A-ZÞÆÖ]{1,2}-)?0+(?=\d)", "$1"), F.lit(""))


def case_year(number: Column) -> Column:
    """The four-digit year of a case number: after its last slash, else before its first hyphen."""
    tail = F.when(F.instr(number, "/") > 0, F.substring_index(number, "/", -1)).otherwise(F.substring_index(number, "-", 1))
    return F.when(tail.rlike(r"^\d{4}$"), tail).try_cast("int")


def text_hash(*layers: Column) -> Column:
    """MD5 over layers joined by the unit separator; a null layer counts as empty."""
    return F.md5(_joined(layers))


def text_sha256(*layers: Column) -> Column:
    return F.sha2(_joined(layers), 256)


def _joined(layers: tuple[Column, ...]) -> Column:
    parts: list[Column] = []
    for k, layer in enumerate(layers):
        parts += [F.lit(UNIT)] if k else []
        parts.append(F.coalesce(layer, F.lit("")))
    return F.concat(*parts)


def is_stale(stored: Column, *layers: Column) -> Column:
    """The stored hash is missing or differs from the layers' present one."""
    return ~stored.eqNullSafe(text_hash(*layers))


def anchor(layer: Column, para_from: Column, para_to: Column, section_path: Column, ordinal: Column, page_from: Column, page_to: Column) -> Column:
    """A passage's label: the abstract, paragraphs, printed pages, section, or its part."""
    text = lambda c: c.cast("string")
    return (
        F.when(layer == "summary", "Reifun")
        .when(para_from.isNotNull() & (para_from == para_to), F.concat(text(para_from), F.lit(". mgr.")))
        .when(para_from.isNotNull() & para_to.isNotNull(), F.concat(text(para_from), F.lit(".–"), text(para_to), F.lit(". mgr.")))
        .when(page_from.isNotNull() & (page_to.isNull() | (page_to == page_from)), F.concat(F.lit("bls. "), text(page_from)))
        .when(page_from.isNotNull(), F.concat(F.lit("bls. "), text(page_from), F.lit("–"), text(page_to)))
        .when(F.coalesce(section_path, F.lit("")) != "", section_path)
        .otherwise(F.concat(F.lit("hluti "), text(ordinal + 1)))
    )


def long_date(day: Column) -> Column:
    """As in 3. mars 2020."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), month, F.lit(" "), F.year(day).cast("string"))


def ruling_citation(court: Column, number: Column, day: Column, verdict: Column) -> Column:
    """As in Hrd. 25/2020 5. maí 2020 – Dómur; missing parts drop out."""
    blank = lambda c: F.nullif(c, F.lit(""))
    head = F.concat_ws(" ", blank(court), blank(number), long_date(day))
    return F.concat(head, F.coalesce(F.concat(F.lit(" – "), blank(verdict)), F.lit("")))


def journal_citation(authors: Column, title: Column, journal: Column, volume: Column, issue: Column, year: Column, page_from: Column, page_to: Column) -> Column:
    """Authors (one, two, or the first and others), title, journal, volume, issue, year, pages."""
    n = F.size(authors)
    who = F.when(n == 1, authors[0]).when(n == 2, F.concat(authors[0], F.lit(" og "), authors[1])).when(n > 2, F.concat(authors[0], F.lit(" o.fl.")))
    text = lambda c: c.cast("string")
    pages = F.when(page_to.isNull() | (page_to == page_from), F.concat(F.lit("bls. "), text(page_from))).otherwise(F.concat(F.lit("bls. "), text(page_from), F.lit("–"), text(page_to)))
    place = F.concat_ws(", ", journal, F.concat(text(volume), F.lit(". árg.")), F.concat(text(issue), F.lit(". hefti")), text(year), pages)
    return F.concat_ws(": ", who, F.concat_ws(". ", title, place))


def provision_match(provisions: Column, law: str, gr: int | None = None, sfx: str | None = None, mgr: int | None = None) -> Column:
    """One provision carries every given field; sfx and mgr count only with gr."""

    def one(p: Column) -> Column:
        hit = p["law"] == law
        if gr is not None:
            hit = hit & (p["gr"] == gr)
            if sfx is not None:
                hit = hit & (p["sfx"] == sfx)
            if mgr is not None:
                hit = hit & (p["mgr"] == mgr)
        return F.coalesce(hit, F.lit(False))

    return F.coalesce(F.exists(provisions, one), F.lit(False))


def keyword_match(keywords: Column, wanted: str) -> Column:
    """Case-insensitive LIKE over the array's JSON text, in which wildcards of the input count."""
    quoted = F.transform(keywords, lambda k: F.concat(F.lit('"'), F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).ilike(f"%{wanted}%")


def java_regex(pattern: str) -> str:
    """A PostgreSQL advanced pattern as a Java one: word boundaries, POSIX classes, no case."""
    out = pattern.replace(r"\m", f"(?<![{LETTER}])(?=[{LETTER}])").replace(r"\M", f"(?<=[{LETTER}])(?![{LETTER}])")
    #: POSIX class names and their Unicode properties.
    classes = {"alpha": r"\p{L}", "digit": r"\p{Nd}", "alnum": r"\p{L}\p{N}", "space": r"\s", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "punct": r"\p{P}", "xdigit": "0-9A-Fa-f"}
    return "(?iu)" + re.sub(r"\[:(\w+):\]", lambda m: classes.get(m[1], m[0]), out)


def java_literal(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", text)


def word_pattern(word: str, mode: str) -> str:
    """exact: the whole word; prefix: from a word's start; substring: anywhere."""
    w = java_literal(word)
    left, right = f"(?<![{LETTER}])", f"(?![{LETTER}])"
    return "(?iu)" + {"exact": left + w + right, "prefix": left + w, "substring": w}[mode]


#: Strategy to score columns, best first; ties go to the later date and then the smaller id.
RANKS = {
    "tiered": ["colocated", "best_rank", "match_count"],
    "passage": ["best_rank", "match_count"],
    "doc": ["doc_rank", "best_rank"],
    "blend": ["doc_rank + best_rank", "match_count"],
    "blend_coloc": ["doc_rank + best_rank + IF(colocated, 0.25D, 0D)", "match_count"],
    "breadth": ["doc_rank + best_rank * ln(1 + match_count)"],
    "breadth_coloc": ["doc_rank + best_rank * ln(1 + match_count) + IF(colocated, 0.25D, 0D)"],
}


def rank_order(strategy: str, sort: str = "relevance", date: str = "document_date", key: str = "doc_id") -> list[Column]:
    """Order of hits: tier first, then the strategy, or the date."""
    if sort == "oldest":
        return [F.asc_nulls_last(date), F.asc(key)]
    newest = [F.desc_nulls_last(date), F.asc(key)]
    if sort == "newest":
        return newest
    if strategy not in RANKS:
        raise ValueError(f"no rank strategy {strategy!r}")
    return [F.asc("tier"), *(F.expr(e).desc() for e in RANKS[strategy]), *newest]


def term_rank(weights: Column, frequencies: Column) -> Column:
    """Sum of weight * (1 + ln tf) over the terms held, squeezed into [0, 1)."""
    parts = F.zip_with(weights, frequencies, lambda w, tf: F.when(tf > 0, w * (1 + F.ln(tf.cast("double")))).otherwise(F.lit(0.0)))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return total / (total + 1)


def pages_of_span(offsets: Column, start: Column, end: Column) -> Column:
    """struct(lo, hi): least and largest printed page over which [start, end) runs.

    offsets is an array of (char, pdf_page, printed); the last page has no end.
    """
    pages = F.array_sort(F.transform(offsets, lambda p: F.struct(p["char"].alias("char"), p["printed"].alias("printed"))))
    ends = F.concat(F.slice(F.transform(pages, lambda p: p["char"]), 2, F.greatest(F.size(pages) - 1, F.lit(0))), F.array(F.lit(None).cast("int")))
    spans = F.arrays_zip(pages.alias("page"), ends.alias("stop"))
    inside = F.filter(spans, lambda s: (s["page"]["char"] < end) & (s["stop"].isNull() | (s["stop"] > start)) & s["page"]["printed"].isNotNull())
    printed = F.transform(inside, lambda s: s["page"]["printed"])
    return F.struct(F.array_min(printed).alias("lo"), F.array_max(printed).alias("hi"))


def case_type_keywords(keywords: Column, value: Column) -> Column:
    """keywords with the value appended unless it is there; null keywords become the value alone."""
    return F.when(value.isNull(), keywords).when(keywords.isNull(), F.array(value)).when(F.array_contains(keywords, value), keywords).otherwise(F.array_append(keywords, value))


def validation_errors(rules: list[tuple[str, Column, str]]) -> Column:
    """array of (field, message) for the rules whose condition holds."""
    found = F.array(*[F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, cond, message in rules])
    return F.filter(found, lambda e: e.isNotNull())


def document_rules(prefix: str | None = None, abbreviation: str = "", verdicts: list[str] | None = None) -> list[tuple[str, Column, str]]:
    """The checks on a document row, in the order in which they are reported."""
    c, blank = F.col, lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    day, opened = c("document_date"), F.coalesce(F.regexp_extract("case_number", r"^(\d{4})/\d", 1).try_cast("int"), F.regexp_extract("case_number", r"/(\d{4})$", 1).try_cast("int"))
    late = F.year(day) - opened
    rules = [("case_number", blank("case_number"), "missing")]
    if prefix:
        rules.append(("case_number", ~blank("case_number") & ~c("case_number").startswith(prefix), "unexpected prefix"))
    rules += [
        ("document_date", day.isNull(), "missing"),
        ("document_date", (day < F.lit("1900-01-01").cast("date")) | (day > F.lit("2030-01-01").cast("date")), "out of range"),
        ("document_date", late < 0, "before the case's year"),
        ("document_date", late >= 6, "long after the case's year"),
        ("court", blank("court"), "missing"),
        ("court", ~blank("court") & ~c("court").startswith(abbreviation), "unexpected court"),
        ("verdict_type", blank("verdict_type"), "missing"),
    ]
    if verdicts is not None:
        rules.append(("verdict_type", ~blank("verdict_type") & ~c("verdict_type").isin(verdicts), "unexpected type"))
    rules += [
        ("body_text", blank("body_text"), "missing"),
        ("body_text", ~blank("body_text") & (F.length("body_text") < 200), "short"),
        ("plaintiffs", (F.coalesce(F.size("plaintiffs"), F.lit(0)) <= 0) & (F.coalesce(F.size("defendants"), F.lit(0)) > 0), "empty"),
        ("defendants", (F.coalesce(F.size("defendants"), F.lit(0)) <= 0) & (F.coalesce(F.size("plaintiffs"), F.lit(0)) > 0), "empty"),
        ("keywords", F.coalesce(F.size("keywords"), F.lit(0)) <= 0, "missing"),
    ]
    return rules


def file_stem(citation: Column) -> Column:
    """ASCII file stem: accents folded, everything else a hyphen."""
    #: Letters and their ASCII forms.
    plain = F.translate(F.lower(citation), "áéíóúýöðäøåü", "aeiouyodaoau")
    plain = F.replace(F.replace(plain, F.lit("þ"), F.lit("th")), F.lit("æ"), F.lit("ae"))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def language(text: Column, default: str = "is") -> Column:
    """is or en by the more frequent function words; fewer than three of either is the default."""
    #: Function words of the two languages.
    words = {"is": ["og", "að", "er", "sem", "ekki", "því", "við", "um", "það", "til"], "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "not"]}
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    among = lambda listed: F.size(F.filter(tokens, lambda t: t.isin(listed)))
    n = {k: among(listed) for k, listed in words.items()}
    return F.when(F.greatest(n["is"], n["en"]) < 3, default).when(n["en"] > n["is"], "en").when(n["is"] > n["en"], "is").otherwise(default)


def icelandic_date(text: Column) -> Column:
    """The first date such as 3. mars 2020 in the text; an impossible date is null."""
    pattern = r"(?iu)(\d{1,2})\.\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
    part = lambda k: F.regexp_extract(text, pattern, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2)))
    return F.try_to_date(F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")


def outcome(body: Column) -> Column:
    """granted, denied or null from the last 600 characters; null also when they contradict each other."""
    tail = F.right(body, F.lit(600))
    yes = tail.rlike(r"(?iu)(beiðni\w*[^.]{0,60}samþykkt|leyfi[^.]{0,60}(er\s+)?veitt)")
    no = tail.rlike(r"(?iu)(beiðni\w*[^.]{0,60}hafnað|hafnað\s+er\s+beiðni)")
    return F.when(yes & ~no, "granted").when(no & ~yes, "denied")
