"""Text rules that need a scan with memory: passages, provisions, citations, page numbers.

Plain Python on one text at a time, without Spark.  ``quillon.operators.builders`` runs
them in Arrow batches and explodes what they find.
"""

from __future__ import annotations

import bisect
import difflib
import re
import unicodedata
from collections import Counter
from itertools import pairwise

from .citations import citations, normal_number  # noqa: F401 - part of this module's rules

UPPER = "A-ZÁÐÉÍÓÚÝÞÆÖ"

# ---------------------------------------------------------------- sections and passages

#: The words that open a section, by its kind, in the order in which they are tried.
OPERATIVE_WORDS = ["dómsorð", "úrskurðarorð", "ályktunarorð", "ályktarorð"]
SECTION_WORDS = {
    "nidurstada": ["niðurstaða", "niðurstöðu", "niðurstöður", "niðurstaðan", "forsendur", "álit"],
    "malsatvik": ["málsatvik", "málavextir", "atvik máls"],
    "malsastaedur": ["málsástæður", "lagarök", "röksemdir", "sjónarmið"],
    "malsmedferd": ["málsmeðferð", "dómkröfur", "kröfur", "kæruefni", "kæra"],
}
ENUMERATOR = re.compile(r"\s*(?:[IVXLC]+|\d{1,2})\.\s*", re.I)
HEADING = re.compile(rf"#{{1,6}}\s+\S|\*\*[IVX]+\.[^*\n]{{1,90}}\*\*\s*$")
NUMBERED = re.compile(rf"(\d{{1,3}})\.\s+[{UPPER}]")
BLANK_LINES = re.compile(r"\n[ \t\r]*\n\s*")
SENTENCE_END = re.compile(rf"(?<=[.!?])\s+(?=[{UPPER}„\"(])")
TOKEN = re.compile(r"\S+")
HEADING_WORDS = 30


def plain_heading(raw: str | None) -> str:
    """A heading without marks, runs of blanks, and closing colons or periods."""
    bare = re.sub(r"^\s*#{1,6}\s*|\*\*|_", "", raw or "")
    return " ".join(bare.split()).rstrip(":. ")


def joined_letters(text: str) -> str:
    """Words whose letters stand apart, as some old files have them, in one piece."""
    return re.sub(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)", lambda m: m[0].replace(" ", ""), text)


def _misread(word: str, true: str) -> bool:
    """The word is the true one but for letters that scans confuse, or for one letter that got lost."""
    plain = str.maketrans("ðóúáö", "douao")
    a, b = word.translate(plain), true.translate(plain)
    return a == b or len(b) > 6 and len(a) == len(b) - 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def opens_operative(heading: str | None) -> bool:
    """The heading opens the operative part: its first word is one of those, and a capital may follow at once."""
    text = joined_letters(plain_heading(heading))
    if not text.isupper():
        text = re.sub(rf"(?<=[^\W\d_{UPPER}])(?=[{UPPER}])", " ", text)
    first = re.match(r"[^\W\d_]+(?![\w-])", text)
    return bool(first) and any(_misread(first[0].lower(), w) for w in OPERATIVE_WORDS)


def section_kind(heading: str | None) -> str:
    """The kind of section a heading opens; annad when none fits."""
    if opens_operative(heading):
        return "domsord"
    rest = joined_letters(ENUMERATOR.sub("", plain_heading(heading), count=1)).lower()
    words = re.findall(r"[^\W\d_]+", rest)
    if not words or not rest.startswith(words[0]):
        return "annad"
    starts = [words[0], " ".join(words[:2])]
    if words[:2] == ["forsendur", "og"]:
        starts += words[2:3]
    for kind, openings in SECTION_WORDS.items():
        if any(w == o or kind == "nidurstada" and _misread(w, o) for w in starts for o in openings):
            return kind
    return "annad"


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _blocks(text: str):
    """(start, end, is_heading) of every block between blank lines; a heading line is a block of its own."""
    at = 0
    for a, b in [*((m.start(), m.end()) for m in BLANK_LINES.finditer(text)), (len(text), len(text))]:
        start, end = _trimmed(text, at, a)
        at = b
        if start == end:
            continue
        line_end = text.find("\n", start, end)
        line_end = end if line_end < 0 else line_end
        line = text[start:line_end]
        if HEADING.match(line) and len(line.split()) <= HEADING_WORDS:
            yield *_trimmed(text, start, line_end), True
            start, end = _trimmed(text, line_end, end)
            if start == end:
                continue
        yield start, end, False


def _small_spans(text: str, start: int, end: int, max_words: int, max_chars: int):
    """The block as sentences, and sentences over a limit as runs of words."""
    cuts = [start, *(m.end() for m in SENTENCE_END.finditer(text, start, end)), end]
    for a, b in pairwise(cuts):
        a, b = _trimmed(text, a, b)
        words = [m.span() for m in TOKEN.finditer(text, a, b)]
        while words:
            first = words[0][0]
            k = 1
            while k < min(len(words), max_words) and words[k][1] - first <= max_chars:
                k += 1
            yield first, words[k - 1][1]
            words = words[k:]


def passages(text: str | None, target_words: int = 250, max_words: int = 400, max_chars: int = 6000) -> list[dict]:
    """Citable slices of a text with exact offsets, never across a heading.

    Blocks are joined until ``target_words``; none goes over ``max_words`` or
    ``max_chars`` unless one token does.
    """
    pieces = []  # (start, end, words, paragraph number, section, kind, opens)
    section, kind = None, "annad"
    for start, end, is_heading in _blocks(text or ""):
        if is_heading:
            section = plain_heading(text[start:end])
            kind = section_kind(section)
            pieces.append((start, end, len(text[start:end].split()), None, section, kind, True))
            continue
        number = NUMBERED.match(text, start, end)
        para = int(number[1]) if number else None
        words = len(text[start:end].split())
        whole = words <= max_words and end - start <= max_chars
        for a, b in [(start, end)] if whole else _small_spans(text, start, end, max_words, max_chars):
            pieces.append((a, b, len(text[a:b].split()), para, section, kind, False))
    out: list[dict] = []
    held: list[tuple] = []

    def close() -> None:
        if held:
            paras = [p[3] for p in held if p[3] is not None]
            a, b = held[0][0], held[-1][1]
            out.append({"ordinal": len(out), "section_path": held[0][4], "section_kind": held[0][5], "para_from": min(paras, default=None), "para_to": max(paras, default=None), "char_start": a, "char_end": b, "text": text[a:b], "word_count": len(text[a:b].split())})
            held.clear()

    for piece in pieces:
        if piece[6] or held and (sum(p[2] for p in held) + piece[2] > max_words or piece[1] - held[0][0] > max_chars):
            close()
        held.append(piece)
        if sum(p[2] for p in held) >= target_words:
            close()
    close()
    return out


def printed_pages(offsets: list[dict] | None, start: int, end: int) -> tuple[int | None, int | None]:
    """Least and largest printed page that [start, end) touches; the last page has no end."""
    pages = sorted(offsets or [], key=lambda p: p["char"])
    stops = [*(p["char"] for p in pages[1:]), None]
    hit = [p["printed"] for p, stop in zip(pages, stops) if p["char"] < end and (stop is None or stop > start) and p.get("printed") is not None]
    return (min(hit), max(hit)) if hit else (None, None)


def layer_passages(layers: dict[str, str | None], offsets: list[dict] | None = None) -> list[dict]:
    """Passages of all layers, numbered through; printed pages for the body only."""
    out = []
    for layer, text in layers.items():
        for p in passages(text) if text and text.strip() else []:
            summary = layer == "summary"
            lo, hi = printed_pages(offsets, p["char_start"], p["char_end"]) if layer == "body" else (None, None)
            out.append(p | {"ordinal": len(out), "layer": layer, "page_from": lo, "page_to": hi} | ({"section_kind": "reifun", "para_from": None, "para_to": None} if summary else {}))
    return out


# ---------------------------------------------------------------- provisions

#: The forms of an article, a law's number, and references back to it.
ARTICLE = re.compile(r"(?:(?P<mgr>\d+)\.\s*mgr\.\s*)?(?P<gr>\d+)\.\s*gr\.(?:\s*(?P<sfx>[a-záðéíóúýþæö])\.(?!\s*\w*\.\s*gr))?(?:\s*(?P<after>\d+)\.\s*mgr\.(?!\s*\d+\.\s*gr))?", re.I)
LAW = re.compile(r"(?:\b(?:laga?|lögum|reglugerðar?)(?:\s+\w+){0,5}?\s+(?:nr\.\s*)?|nr\.\s*)(?P<law>\d+/\d{4})", re.I)
SAME_LAW = re.compile(r"(?:sömu|þeirra)\s+laga|laganna|sömu\s+lögum", re.I)
JOINER = re.compile(r"(?:\s|,|og\b|eða\b|sbr\.|einnig\b|sem\s+og\b|\d+\.\s*tölul\.|(?:\d+\.\s*(?:og\s+)?)+mgr\.)*", re.I)
LOOK_AHEAD = 150


def _provision(m: re.Match, law: str) -> dict:
    mgr = m["mgr"] or m["after"]
    return {"law": law, "gr": int(m["gr"]), "mgr": int(mgr) if mgr else None, "sfx": m["sfx"].lower() if m["sfx"] else None}


def provisions(text: str | None) -> list[dict]:
    """Cited provisions (law, gr, mgr, sfx), each once, in the order in which they are found.

    A law's number takes the nearest free article before it, and further ones as long as
    only joining words lie between them; then articles followed by a reference back take
    the last law named before them.
    """
    if not text:
        return []
    articles = list(ARTICLE.finditer(text))
    laws = [(m.start(), m["law"]) for m in LAW.finditer(text)]
    found: list[dict] = []
    free: list[int] = []  # articles before this law that no law has taken, the nearest last
    seen = 0
    for at, law in laws:
        while seen < len(articles) and articles[seen].end() <= at:
            free.append(seen)
            seen += 1
        last = None
        while free and (last is None or free[-1] == last - 1 and JOINER.fullmatch(text, articles[free[-1]].end(), articles[last].start())):
            last = free.pop()
            found.append(_provision(articles[last], law))
    starts = [at for at, _ in laws]
    for m in articles:
        before = bisect.bisect_left(starts, m.start()) - 1
        if before >= 0 and SAME_LAW.search(text, m.end(), m.end() + LOOK_AHEAD):
            found.append(_provision(m, laws[before][1]))
    return list({tuple(p.values()): p for p in reversed(found)}.values())[::-1] if found else []


QUERY_LAW = re.compile(r"(\d+/\d{4})")


def provision_query(q: str | None) -> tuple[str, int, str | None, int | None] | None:
    """(law, gr, sfx, mgr) of a query such as ``2. mgr. 218. gr. laga nr. 19/1940``, in either order; a law alone is nothing."""
    q = (q or "").strip()
    article = ARTICLE.search(q)
    if not article:
        return None
    p = None
    for law in QUERY_LAW.finditer(q):
        between = q[article.end() : law.start()] if law.start() >= article.end() else q[law.end() : article.start()]
        words = between.replace(",", " ").split()
        if law.start() >= article.end() and len(words) <= 8 or law.end() <= article.start() and not words:
            p = _provision(article, law[1])
            break
    return (p["law"], p["gr"], p["sfx"], p["mgr"]) if p else None


# ---------------------------------------------------------------- printed page numbers

AGREE, RIVAL, LARGEST_PAGE = 3, 0.25, 1799


def page_numbers(pages: list[str]) -> list[int | None]:
    """The number alone on the first or else the last line of each page; years are no page numbers."""
    out: list[int | None] = []
    for page in pages:
        lines = [x.strip() for x in page.splitlines() if x.strip()]
        edge = [x for x in (*lines[:1], *lines[-1:]) if re.fullmatch(r"\d{1,4}", x) and int(x) <= LARGEST_PAGE]
        out.append(int(edge[0]) if edge else None)
    return out


def increasing_chain(read: list[int | None]) -> list[int]:
    """Pages of the largest strictly increasing choice of reads, made of offsets with AGREE reads or more."""
    votes = Counter(n - i for i, n in enumerate(read) if n is not None)
    usable = [i for i, n in enumerate(read) if n is not None and votes[n - i] >= AGREE]
    tails: list[int] = []  # tails[k]: the page that ends a chain of k + 1 with the least number
    back: dict[int, int | None] = {}
    for i in usable:
        k = bisect.bisect_left([read[t] for t in tails], read[i])
        back[i] = tails[k - 1] if k else None
        tails[k : k + 1] = [i]
    chain, at = [], tails[-1] if tails else None
    while at is not None:
        chain.append(at)
        at = back[at]
    return chain[::-1]


def page_map(pages: list[str]) -> dict:
    """Printed number of every page, from segments of one offset; void when a rival group of reads is too large."""
    read = page_numbers(pages)
    chain = increasing_chain(read)
    segments: list[list[int]] = []  # offset, first, last, votes
    for i in chain:
        if segments and segments[-1][0] == read[i] - i:
            segments[-1][2:] = [i, segments[-1][3] + 1]
        else:
            segments.append([read[i] - i, i, i, 1])
    segments = [s for s in segments if s[3] >= AGREE]
    if not segments:
        return {"offset": None, "printed": [None] * len(pages), "quality": 0.0}
    main = max(segments, key=lambda s: s[3])
    inside = {i for s in segments for i in chain if s[1] <= i <= s[2] and read[i] - i == s[0]}
    rivals = Counter(n - i for i, n in enumerate(read) if n is not None and i not in inside)
    if max(rivals.values(), default=0) >= max(AGREE, RIVAL * main[3]):
        return {"offset": None, "printed": [None] * len(pages), "quality": 0.0}
    printed: list[int | None] = [None] * len(pages)
    for k, (offset, first, last, _) in enumerate(segments):
        for i in range(0 if k == 0 else first, len(pages) if k == len(segments) - 1 else last + 1):
            printed[i] = i + offset if i + offset > 0 else None
    twice = {n for n, c in Counter(p for p in printed if p is not None).items() if c > 1}
    printed = [None if p in twice else p for p in printed]
    agree = sum(r is not None and r == p for r, p in zip(read, printed))
    return {"offset": main[0], "printed": printed, "quality": round(agree / len(pages), 3)}


# ---------------------------------------------------------------- smaller rules


def fold(text: str | None) -> str:
    """Lower case without marks; ð, þ and æ spelt out; everything else a blank."""
    plain = unicodedata.normalize("NFKD", (text or "").lower())
    plain = "".join(c for c in plain if not unicodedata.combining(c)).translate(str.maketrans({"ð": "d", "þ": "th", "æ": "ae"}))
    return " ".join(re.findall(r"[^\W_]+", plain))


def title_similarity(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, fold(a), fold(b), autojunk=False).ratio()


def dehyphenate(text: str) -> str:
    """Words cut by a hyphen at a line's end are joined when the next line goes on in lower case."""
    return re.sub(r"(?<=[^\W\d_])[-­]\n[ \t]*(?=[a-záðéíóúýþæö])", "", text)


def without_running_lines(pages: list[str], share: float = 0.3, least: int = 3) -> list[str]:
    """Pages without first and last lines that recur, digits aside, on enough of them."""
    shape = lambda line: re.sub(r"\d+", "#", " ".join(line.lower().split()))
    split = [p.split("\n") for p in pages]
    edges = []
    for lines in split:
        full = [k for k, x in enumerate(lines) if x.strip()]
        edges.append({k: shape(lines[k]) for k in {*full[:1], *full[-1:]}})
    count = Counter(s for e in edges for s in set(e.values()))
    limit = max(least, share * len(pages))
    return ["\n".join(x for k, x in enumerate(lines) if count[e.get(k, "")] < limit or k not in e) for lines, e in zip(split, edges)]


def isbn(text: str | None) -> str | None:
    """The first ISBN-13 or ISBN-10 in the text with a right check digit."""
    for m in re.finditer(r"(?<!\d)(?:97[89][- ]?)?(?:\d[- ]?){9}[\dXx](?!\d)", text or ""):
        digits = re.sub(r"[- ]", "", m[0]).upper()
        if len(digits) == 13 and digits.isdigit() and sum(int(d) * (1, 3)[k % 2] for k, d in enumerate(digits)) % 10 == 0:
            return digits
        if len(digits) == 10 and sum((10 - k) * (10 if d == "X" else int(d)) for k, d in enumerate(digits)) % 11 == 0:
            return digits
    return None


def authors(line: str | None) -> list[str]:
    """Names of a byline, split at commas, ampersands and the word for and."""
    parts = re.split(r"\s*(?:,|;|&|\bog\b|\band\b)\s*", line or "")
    return [" ".join(p.split()) for p in parts if p.strip()]


def snippet(text: str | None, pattern: re.Pattern, summary: str | None = None, radius: int = 160) -> str:
    """The first match in its surroundings, marked; without one, how the text begins."""
    m = pattern.search(text) if text else None
    if not m:
        head = summary or text or ""
        return head[:240].replace("\n", " ") + ("…" if len(head) > 240 else "")
    a, b = max(0, m.start() - radius), min(len(text), m.end() + radius)
    body = f"{text[a : m.start()]}<mark>{m[0]}</mark>{text[m.end() : b]}".replace("\n", " ")
    return ("…" if a else "") + body + ("…" if b < len(text) else "")


def headline(text: str | None, words: set[str], most: int = 35, least: int = 12, lemma_of: dict[str, str] | None = None) -> str:
    """The window of words that holds the most wanted ones, marked; a word counts by its form or its lemma."""
    tokens = (text or "").split()
    forms = [re.sub(r"\W+", "", t).lower() for t in tokens]
    hit = [f in words or (lemma_of or {}).get(f) in words for f in forms]
    if not tokens:
        return ""
    total = [0]
    for h in hit:
        total.append(total[-1] + h)
    size = min(most, len(tokens))
    start = max(range(len(tokens) - size + 1), key=lambda k: (total[k + size] - total[k], -k))
    if not any(hit):
        size = min(least, len(tokens))
    return " ".join(f"<mark>{t}</mark>" if h else t for t, h in zip(tokens[start : start + size], hit[start : start + size]))


def longest_common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of tokens that both lists hold."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(b))]
        best = max(best, max(row))
    return best


def truncate(text: str | None, most: int) -> tuple[str | None, bool]:
    """Cut at the last blank before the limit; whether anything was cut."""
    if text is None or most <= 0 or len(text) <= most:
        return text, False
    head = text[:most]
    at = head.rfind(" ")
    return (head[:at] if at > most // 2 else head).rstrip() + "…", True
