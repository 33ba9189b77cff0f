"""Statutes as landed HTML: articles, paragraphs and numbers, with the standard library's parser."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser

ARTICLE_ID = re.compile(r"G(\d+)([A-Z]?)")
PARAGRAPH_ID = re.compile(r"G\d+[A-Z]?M(\d+)")
TITLE = re.compile(r"(\d{4})\s+nr\.\s+(\d+)\s+(\d{1,2})\.\s+(\w+)")


class _Reader(HTMLParser):
    """Text dealt out to the article and paragraph whose anchor came last."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.articles: list[dict] = []
        self.title, self.head = "", ""
        self.inside_title = self.skip = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        anchor = dict(attrs).get("id") or ""
        if tag == "title":
            self.inside_title = True
        elif tag in ("script", "style"):
            self.skip = True
        if m := ARTICLE_ID.fullmatch(anchor):
            self.articles.append({"num": int(m[1]), "suffix": m[2].lower() or None, "text": "", "sub": []})
        elif (m := PARAGRAPH_ID.fullmatch(anchor)) and self.articles:
            self.articles[-1]["sub"].append({"num": int(m[1]), "text": ""})
        if tag in ("br", "p", "div"):
            self._put(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.inside_title = False
        elif tag in ("script", "style"):
            self.skip = False

    def handle_data(self, data: str) -> None:
        if self.inside_title:
            self.title += data
        elif not self.skip:
            self._put(data)

    def _put(self, data: str) -> None:
        if not self.articles:
            self.head += data
            return
        self.articles[-1]["text"] += data
        if self.articles[-1]["sub"]:
            self.articles[-1]["sub"][-1]["text"] += data


def parse(html: bytes | str, name: str = "") -> dict:
    """law, title and provisions (num, suffix, text, sub) of one statute; the number comes from the file's name."""
    reader = _Reader()
    reader.feed(html.decode("iso-8859-1") if isinstance(html, bytes) else html)
    reader.close()
    tidy = lambda s: " ".join(s.split())
    m = re.search(r"(\d{4})(\d{3})", name)
    for a in reader.articles:
        a["text"] = tidy(a["text"])
        for s in a["sub"]:
            s["text"] = tidy(s["text"])
    return {"law": f"{int(m[2])}/{m[1]}" if m else None, "title": tidy(reader.title), "provisions": reader.articles}


def unzip(content: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the HTML files in an archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(n, z.read(n)) for n in z.namelist() if n.lower().endswith((".html", ".htm"))]
