"""Rules on extracted pages and on one document's text: joins, notes, tables, finding, splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from .text import fold

#: Conjunctions after a hyphen that stays, as in ríkis- og.
SUSPENDED = ("og", "eða", "né")


def closes_gap(before: str, after: str) -> bool | None:
    """What becomes of a hyphen at a line's end: True, it goes and the word is joined; False, it stays and is joined; None, both stay apart."""
    head = re.search(r"[\w]+$", before.rstrip("-­"))
    tail = re.match(r"[\w]+", after)
    if not head or not tail or tail[0] in SUSPENDED:
        return None
    if head[0].isdigit() or len(head[0]) > 1 and head[0].isupper():
        return False
    return True if tail[0][0].islower() else None


def joined_pages(pages: list[str]) -> tuple[str, list[dict]]:
    """One text of all pages, and where each page's text begins in it.

    A word cut at the end of a page is joined; other pages follow after a blank line.
    """
    text, offsets = "", []
    for k, page in enumerate(pages):
        page = page.strip("\n")
        gap = closes_gap(text, page) if text.endswith(("-", "­")) else None
        if text and page:
            text = text[:-1] if gap else text if gap is False else text + "\n\n"
        offsets.append({"char": len(text), "pdf_page": k + 1})
        text += page
    return text, offsets


def table_markdown(rows: list[list[str | None]]) -> str:
    """A table's cells as markdown; the first row is the head, empty rows are left out."""
    cells = [[" ".join((c or "").split()).replace("|", "\\|") for c in r] for r in rows if any((c or "").strip() for c in r)]
    if not cells:
        return ""
    width = max(map(len, cells))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def footnotes(text: str) -> tuple[str, dict[int, str]]:
    """The text without its notes, and the notes by number: lines at its end that begin with rising numbers, each of which the text refers to."""
    lines = text.split("\n")
    notes: dict[int, str] = {}
    cut = len(lines)
    for k in range(len(lines) - 1, -1, -1):
        m = re.match(r"\s*(\d{1,3})[.)]?\s+(\S.*)", lines[k])
        if not m:
            if lines[k].strip():
                break
            continue
        n = int(m[1])
        if notes and n != min(notes) - 1:
            break
        notes[n], cut = m[2].strip(), k
    body = "\n".join(lines[:cut]).rstrip()
    if notes and all(re.search(rf"(?<=[^\W\d_.,)”“])\[?{n}\]?(?!\d)", body) for n in notes):
        return body, notes
    return text, {}


def known_share(text: str | None, known: Collection[str] | Callable[[str], bool], sample: int = 2000) -> float | None:
    """Share of the first words of over two letters that a dictionary knows; None without such words."""
    knows = known if callable(known) else known.__contains__
    words = [w for w in re.findall(r"[^\W\d_]+", text or "") if len(w) > 2][:sample]
    return sum(map(knows, words)) / len(words) if words else None


def subsequence_share(needle: str | None, text: str | None) -> float:
    """Share of the needle's words that come in the text in the same order."""
    want, have = fold(needle).split(), iter(fold(text).split())
    return sum(any(w == h for h in have) for w in want) / len(want) if want else 0.0


def matches(text: str | None, query: str, regex: bool = False) -> list[tuple[int, int]] | None:
    """(start, length) of matches that don't overlap, in any case; None for a pattern that is none (Q12).

    Plain queries of fewer than two characters, and empty matches, find nothing.
    """
    q = query.strip()
    try:
        pattern = re.compile(q if regex else re.escape(q), re.I)
    except re.error:
        return None
    if len(q) < (1 if regex else 2):
        return []
    return [(m.start(), m.end() - m.start()) for m in pattern.finditer(text or "") if m[0]]


def parts(text: str | None, words: int = 500) -> list[str]:
    """The text in parts of whole paragraphs, each closed by the paragraph with its so many-th word (Q13)."""
    if not text or not text.strip():
        return []
    if len(text.split()) < words:
        return [text]
    out: list[list[str]] = [[]]
    n = 0
    for paragraph in filter(str.strip, text.split("\n\n")):
        if n >= words:
            out.append([])
            n = 0
        out[-1].append(paragraph)
        n += len(paragraph.split())
    return ["\n\n".join(p) for p in out]
