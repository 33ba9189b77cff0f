"""References to rulings in running text, read by a tokeniser and a small grammar.

The text becomes tokens; words get their class from the vocabulary tables below.  A
number after ``nr.`` is read by the word it hangs on: a case, a decision, a law, or
nothing.  A case's court is the nearest landmark before it in its sentence, where
landmarks are courts, words such as "the court" that stand for the court named last, and
other bodies that decide cases, which end the search.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from datetime import date

from .columns import MONTHS

#: How far, in characters, a court, a verdict word and a date after the number may be, and the length of a raw text.
COURT_REACH, VERDICT_REACH, DATE_REACH, RAW_LENGTH = 120, 40, 30, 240
#: Forms of court names, as a word begins, and the abbreviation of the court.
COURTS = {
    "Hæstaréttar": "Hrd.",
    "Hæstarétt": "Hrd.",
    "Hæstiréttur": "Hrd.",
    "Landsrétt": "Lrd.",
    "Félagsdóm": "Féld.",
    "Landsdóm": "Ld.",
    "Endurupptökudóm": "Eud.",
    "Héraðsdóm": "Hérd.",
    "héraðsdóm": "Hérd.",
}
#: The places of district courts, in the genitive, and their abbreviations.
PLACES = {
    "Reykjavíkur": "Rvk",
    "Reykjaness": "Reykn",
    "Suðurlands": "Suðl",
    "Norðurlands eystra": "Norðeyst",
    "Norðurlands vestra": "Norðvest",
    "Vesturlands": "Vestl",
    "Austurlands": "Austl",
    "Vestfjarða": "Vestfj",
}
#: Words that stand for the court named last.
SAME_COURT = {"réttarins", "réttinum", "dómstólsins", "dómstóllinn", "sama dómstóls", "sama réttar"}
#: How names of other deciding bodies begin, and what they hold within.
BODY_BEGINS = ("sýslumann", "ráðuneyt", "stofnun", "Persónuvernd", "stjórnvald", "stjórnsýslu", "úrskurðaraðil")
BODY_HOLDS = ("dómstól", "nefnd")
#: What makes a participle of a word in -nefnd, "named", and no committee.
NAMED = ("fyrr", "áður", "síðar", "ofan", "framan", "hér", "þar", "svo", "sam", "títt", "marg")
#: Nouns on which a number hangs.
LAW_WORDS, LAW_BEGINS = {"lög", "laga", "lögum", "lögunum"}, ("reglugerð", "auglýsing", "samþykkt")
CASE_WORDS = {"mál", "máli", "málinu", "máls", "málum", "málunum"}
DECISION = "ákvörðun"
#: How words that name a verdict begin, and its type.
VERDICTS = {"dóm": "Dómur", "úrskurð": "Úrskurður", "ákvörð": "Ákvörðun"}
#: Years said in words: that of the sentence, and that of the document.
YEAR_OF_SENTENCE, YEAR_OF_DOCUMENT = {"sama ár", "s.á.", "þess árs"}, ("sl.", "síðastliðin")
#: The court of petitions, whose numbers begin with the year, and that of numbers with F.
PETITIONS, LABOUR = "Hrd. málsk.", "Féld."

#: Forms of numbers: a letter, serial and year; serial and year; year and serial.
NUMBER = r"[A-ZÞÆÖ]{1,2}-\d{1,5}/\d{4}(?!\d)|\d{1,4}/\d{4}(?!\d)|\d{4}-\d{1,3}(?!\d)"
LEXEME = re.compile(rf"(?P<number>{NUMBER})|(?P<int>\d+)|(?P<word>[^\W\d_]+)|(?P<gap>\n\s*\n)|(?P<mark>[^\w\s])")
#: Without any of these there is nothing to read.
WORTH_READING = re.compile(r"nr\.|Hrd|Lrd|Hérd|\bH\s?\d")
PETITION = re.compile(r"\d{4}-\d{1,3}")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def normal_number(number: str) -> str:
    """Without blanks and leading zeros, in capitals."""
    prefix, hyphen, rest = "".join(number.split()).upper().rpartition("-")
    if hyphen and prefix.isdigit():  # a year and a serial
        return f"{prefix}-{rest}"
    short = rest.lstrip("0")
    return prefix + hyphen + ("0" if rest != short and not short[:1].isdigit() else "") + short


class Text:
    """Tokens of a text, its sentences, and the landmarks, dates and verdict words in it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [Token(m.lastgroup or "", m[0], m.start(), m.end()) for m in LEXEME.finditer(text)]
        self.starts = self._sentence_starts()
        self.landmarks: list[tuple[int, str, str]] = []  # where, what (court, same, body), which court
        self.verdicts: list[tuple[int, str]] = []
        self.days: list[tuple[int, int, int, int, str]] = []  # from, to, day, month, year as it is said
        self.years: list[tuple[int, int]] = []
        for k, t in enumerate(self.tokens):
            if t.kind == "word":
                self._word(k, t)
            elif t.kind == "int":
                self._integer(k, t)

    def word(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def _sentence_starts(self) -> list[int]:
        starts = [0]
        for t, after in zip(self.tokens, self.tokens[1:]):
            apart = after.start > t.end
            if t.kind == "gap" or t.text == ";" or t.text == "." and apart and after.text[0].isupper():
                starts.append(after.start)
        return starts

    def sentence(self, at: int) -> int:
        """Where the sentence before a place began; a sentence doesn't begin with the number itself."""
        return self.starts[max(0, bisect.bisect_left(self.starts, at) - 1)]

    def _word(self, k: int, t: Token) -> None:
        pair = f"{t.text} {self.word(k + 1)}"
        court = next((abbreviation for form, abbreviation in COURTS.items() if t.text.startswith(form)), None)
        if t.text in SAME_COURT or pair in SAME_COURT:
            self.landmarks.append((t.start, "same", ""))
        elif court == "Hérd.":
            place = PLACES.get(self.word(k + 1)) or PLACES.get(f"{self.word(k + 1)} {self.word(k + 2)}")
            self.landmarks.append((t.start, "court", f"Hérd. {place}." if place else court))
        elif court:
            self.landmarks.append((t.start, "court", court))
        elif is_body(t.text):
            self.landmarks.append((t.start, "body", ""))
        if verdict := next((v for form, v in VERDICTS.items() if t.text.startswith(form)), None):
            self.verdicts.append((t.start, verdict))

    def _integer(self, k: int, t: Token) -> None:
        around = self.text[max(0, t.start - 1) : t.start] + self.text[t.end : t.end + 1]
        if len(t.text) == 4 and 1800 <= int(t.text) <= 2099 and not set(around) & set("/-"):
            self.years.append((t.start, int(t.text)))
        if len(t.text) <= 2 and self.word(k + 1) == "." and self.word(k + 2) in MONTHS:
            said, last = self._said_year(k + 3)
            if said:
                self.days.append((t.start, self.tokens[last].end, int(t.text), MONTHS.index(self.word(k + 2)) + 1, said))

    def _said_year(self, k: int) -> tuple[str, int]:
        """The year that begins at a token, as it is said, and its last token."""
        one, two = self.word(k), f"{self.word(k)} {self.word(k + 1)}"
        if one.isdigit() and len(one) == 4 or one.startswith(YEAR_OF_DOCUMENT[1]):
            return one, k
        if two in YEAR_OF_SENTENCE:
            return two, k + 1
        for said, n in (("s.á.", 4), ("sl.", 2)):
            if "".join(map(self.word, range(k, k + n))) == said:
                return said, k + n - 1
        return "", k

    def day(self, found: tuple[int, int, int, int, str], today: date | None) -> date | None:
        start, _, day, month, said = found
        if said.isdigit():
            year = int(said)
        elif said in YEAR_OF_SENTENCE:
            low = self.sentence(start)
            year = next((y for at, y in reversed(self.years) if low <= at < start), 0)
        else:
            year = today.year - (month > today.month) if today else 0
        try:
            return date(year, month, day)
        except ValueError:
            return None

    def hangs_on(self, k: int) -> str:
        """What the number at token k hangs on: case, decision, law or nothing."""
        if (self.word(k - 2), self.word(k - 1)) != ("nr", "."):
            return ""
        at = k - 3
        noun = self.word(at)
        if noun.lower() in LAW_WORDS or noun.lower().startswith(LAW_BEGINS):
            return "law"
        if PETITION.fullmatch(self.word(k)) and (noun.startswith(DECISION) or noun == "réttarins" and self.word(at - 1).startswith(DECISION)):
            return "decision"
        for skipped in range(4):  # a court may stand between the noun and its number
            if self.word(at - skipped) in CASE_WORDS:
                between = [self.word(j) for j in range(at - skipped + 1, at + 1)]
                place = " ".join(between[1:])
                whole = not between or any(between[0].startswith(c) for c in COURTS) and (not place or between[0].lower().startswith("héraðsdóm") and place in PLACES)
                return "case" if whole else ""
        return ""

    def listed(self, k: int) -> list[int]:
        """Tokens of the numbers that go on from the one at k: with commas, and one with og at last."""
        found = [k]
        while self.word(found[-1] + 1) == "," and self._number(found[-1] + 2):
            found.append(found[-1] + 2)
        if self.word(found[-1] + 1) == "og" and self._number(found[-1] + 2):
            found.append(found[-1] + 2)
        return found

    def _number(self, k: int) -> bool:
        return k < len(self.tokens) and self.tokens[k].kind == "number"

    def dated_after(self, k: int) -> tuple[int, int, int, int, str] | None:
        """The date that a word such as frá ties to the number at token k."""
        at = k + 1 + (self.word(k + 1) == ",")
        word = self.word(at)
        last = at + 1 if word == "dags" and self.word(at + 1) == "." else at
        if not (word == "frá" or word.startswith("uppkveðn") or last > at) or last + 1 >= len(self.tokens):
            return None
        begin = self.tokens[last + 1].start
        if begin - self.tokens[k].end > DATE_REACH:
            return None
        return next((d for d in self.days if d[0] == begin), None)


def is_body(word: str) -> bool:
    """The word names a body other than a court that decides cases."""
    if word.startswith(BODY_BEGINS):
        return True
    for inside in BODY_HOLDS:
        head, found, _ = word.partition(inside)
        if found and not (inside == "nefnd" and head.endswith(NAMED)):
            return True
    return False


def court_of(number: str, court: str) -> str:
    """The number's own form beats the court word."""
    if PETITION.fullmatch(number):
        return PETITIONS
    if number.startswith("F-"):
        return LABOUR
    return "Hérd." if "-" in number and not court.startswith("Hérd.") else court


def _row(t: Text, start: int, end: int, raw_from: int, court: str, number: str | None, day: date | None, verdict: str | None, form: str) -> dict:
    return {
        "char_start": start,
        "char_end": end,
        "raw_text": t.text[raw_from:end][-RAW_LENGTH:],
        "target_court": court_of(number, court) if number else court,
        "target_case_number": normal_number(number) if number else None,
        "target_date": day,
        "target_verdict": verdict,
        "form": form,
    }


def _prose(t: Text, today: date | None) -> list[dict]:
    out = []
    hung = [(k, kind) for k, x in enumerate(t.tokens) if x.kind == "number" and (kind := t.hangs_on(k))]
    ahead = [t.tokens[k].start for k, _ in hung]
    sentence, carried = -1, ""
    for k, kind in hung:
        first = t.tokens[k]
        if kind == "law":
            continue
        opening = t.sentence(first.start)
        if opening != sentence:
            sentence, carried = opening, ""
        low = max(opening, first.start - COURT_REACH)
        owner, rival = None, False
        for at, what, which in reversed(t.landmarks[: bisect.bisect_left(t.landmarks, (first.start,))]):
            if at < low or what == "body":
                rival = at >= low
                break
            if what == "court" or carried:
                owner = (at, which if what == "court" else carried)
                break
        petition = PETITION.fullmatch(first.text) is not None
        if owner is None and petition and not rival:
            owner = (t.tokens[max(0, k - 3)].start, PETITIONS)
        if owner is None:
            continue
        at, carried = owner
        verdict = next((v for p, v in reversed(t.verdicts) if at - VERDICT_REACH <= p < at), "Ákvörðun" if kind == "decision" else None)
        before = [d for d in t.days if at <= d[0] and d[1] <= first.start]
        # a date belongs to the first number after it
        mine = before[-1] if before and not any(before[-1][1] <= p < first.start for p in ahead) else t.dated_after(k)
        for j in t.listed(k) if kind == "case" else [k]:
            n = t.tokens[j]
            out.append(_row(t, n.start, n.end, at, carried, n.text, t.day(mine, today) if mine and j == k else None, verdict, "prose"))
    return out


def _abbreviated(t: Text) -> list[dict]:
    """Hrd. 700/2017 and the like, and the yearbook form: a year and a page."""
    out = []
    shorts = set(PLACES.values())
    for k, x in enumerate(t.tokens):
        dot = k + 1 + (t.word(k + 1) == ".")
        value = t.word(dot)
        if x.text == "H" and t.word(k + 1).isdigit() and len(t.word(k + 1)) == 4 and t.word(k + 2) == ":" and t.word(k + 3).isdigit():
            out.append(_row(t, x.start, t.tokens[k + 3].end, x.start, "Hrd.", None, None, None, "reporter"))
        elif x.text == "Hrd" and (last := _yearbook(t, dot)):
            out.append(_row(t, x.start, t.tokens[last].end, x.start, "Hrd.", None, None, None, "reporter"))
        elif x.text in ("Hrd", "Lrd") and dot == k + 2 and t._number(dot) and "-" not in value:
            out.append(_row(t, t.tokens[dot].start, t.tokens[dot].end, x.start, f"{x.text}.", value, None, None, "abbrev"))
        elif x.text == "Hérd" and dot == k + 2 and value in shorts and t.word(k + 3) == "." and t._number(k + 4) and "-" in t.word(k + 4) and not PETITION.fullmatch(t.word(k + 4)):
            n = t.tokens[k + 4]
            out.append(_row(t, n.start, n.end, x.start, f"Hérd. {value}.", n.text, None, None, "abbrev"))
    for row in out:
        if row["form"] == "abbrev":
            row["raw_text"] = " ".join(row["raw_text"].split()) if "\n" in row["raw_text"] else row["raw_text"]
    return out


def _yearbook(t: Text, k: int) -> int | None:
    """The last token of a year and page that begin at k; a case number ends with a year, a page doesn't look like one."""
    if t._number(k):
        year, slash, page = t.word(k).partition("/")
        last = k
    else:
        year, slash = t.word(k), t.word(k + 1) if t.word(k + 1) in (",", ":", "/") else ""
        at = k + 2 + 2 * (t.word(k + 2) == "bls" and t.word(k + 3) == ".")
        page, last = t.word(at), at
    if not (year.isdigit() and len(year) == 4 and 1800 <= int(year) <= 2100 and slash and page.isdigit() and len(page) <= 5):
        return None
    return None if len(page) == 4 and 1800 <= int(page) <= 2100 else last


def citations(text: str | None, today: date | None = None) -> list[dict]:
    """References to rulings, in text order: where, what court, number, date, verdict and form."""
    if not text or not WORTH_READING.search(text):
        return []
    t = Text(text)
    laws = {x.start for k, x in enumerate(t.tokens) if x.kind == "number" and t.hangs_on(k) == "law"}
    found: dict[int, dict] = {}
    for row in _prose(t, today) + _abbreviated(t):
        if row["char_start"] not in laws:
            found.setdefault(row["char_start"], row)
    return [found[k] for k in sorted(found)]
