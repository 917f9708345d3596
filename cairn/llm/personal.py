"""Personal information inside free text: found as written, and replaced by typed placeholders.

A text is first brought to a plain reading by transducers that remember offsets: letters of
other widths and look-alikes become plain, accents are joined to their letters, characters that show nothing
fall away, disguised at and dot signs and spelled digits become signs and digits.  Detectors read the plain
text, and each span is mapped back to the characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.same_look import LOOK_ALIKES, UNSEEN
from cairn.llm.stopwords import STOPWORDS

# Given names that are common in English, Turkish, Spanish and German.
GIVEN = """Ada Alan Alice Amy Andrew Anna Anne Arthur Bruce Carl Carol Clara Daniel David Diana Edward Elena Ella Emily Emma Eric Eva Fiona
    Frank George Grace Hannah Harry Helen Henry Hugh Ian Irene Jack James Jane John Julia Karen Kate Kevin Laura Leo Linda Lisa Louis Lucy Luke
    Mark Martha Mary Maria Matthew Michael Nadia Nancy Nicholas Nina Noah Olivia Oscar Paul Peter Philip Rachel Robert Rose Ruth Sam Sarah Simon
    Sophia Susan Thomas Tom Victor William
    Ahmet Ali Ayla Aylin Ayşe Burak Cem Defne Deniz Derya Elif Emine Emre Fatma Hakan Hasan Hatice Hüseyin İbrahim Kemal Kerem Leyla Mehmet
    Merve Murat Mustafa Okan Orhan Osman Selim Selin Serkan Sevgi Yusuf Zehra Zeynep
    Alberto Alejandro Ana Andrés Antonio Carlos Carmen Diego Elvira Fernando Gloria Inés Isabel Javier Jorge José Juan Julio Lucía Luis Manuel
    Marta Miguel Pablo Pedro Pilar Rafael Raúl Rosa Sofía Teresa Tomás
    Andreas Anke Bernd Birgit Dieter Franz Fritz Greta Hans Heike Jonas Jürgen Karl Katrin Klara Klaus Lena Lukas Monika Otto Petra Sabine Stefan
    Ulrike Ute Wolfgang""".split()
# Titles before a person's name, without the point of their abbreviations.
TITLES = set(
    """Captain Capt Doctor Dr Dra Prof Professor Mr Mrs Ms Miss Sir Madam Nurse Rev Sergeant Officer Lieutenant
    Sayın Av Doç Kaptan Don Doña Sr Sra Srta Señor Señora Capitán Capitana Lic Ing
    Herrn Herr Frau Fräulein Kapitän Kapitänin Ing""".split()
)
# Words before a name that belongs to a vessel.
VESSELS = r"ferry|ship|boat|vessel|yacht|steamer|barge|tug|trawler|schooner|MV|SS|HMS|gemi|gemisi|feribot|feribotu|vapur|vapuru|tekne|teknesi|barco|buque|ferri|transbordador|velero|Fähre|Schiff|Boot|Dampfer|Kahn|Kutter"
# Kinds of streets.
STREETS_AFTER = r"Street|St\.?|Road|Rd\.?|Row|Lane|Ln\.?|Yard|Avenue|Ave\.?|Drive|Court|Close|Square|Terrace|Place|Way|Crescent|Gardens|Quay|Hill|Walk|Mews|Alley|Boulevard|Parade|Wharf"
STREETS_TR = r"Sokak|Sokağı|Sok\.|Sk\.|Caddesi|Cadde|Cad\.|Bulvarı|Bulv\.|Yolu|Meydanı|Mahallesi|Çıkmazı"
STREETS_ES = r"Calle|C/|Plaza|Pza\.|Avenida|Avda\.|Av\.|Paseo|Camino|Callejón|Ronda|Carretera|Travesía|Cuesta|Rambla"
STREETS_DE = r"straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer|steig|stieg"

KINDS = ("email", "address", "id_number", "phone", "name")
AT = r"\s*(?:\(\s*at\s*\)|\[\s*at\s*\]|\{\s*at\s*\}|<\s*at\s*>|\(\s*arroba\s*\)|\[\s*arroba\s*\]|\(a\)|\(ät\)|\[ät\]|\(\s*@\s*\)|\[\s*@\s*\])\s*"
DOT = r"\s*(?:\(\s*(?:dot|punto|punkt|nokta)\s*\)|\[\s*(?:dot|punto|punkt|nokta)\s*\]|\{\s*dot\s*\}|\(\s*\.\s*\)|\[\s*\.\s*\])\s*"
SPOKEN = r"(?<=[\w+-])\s+(?:at|arroba)\s+(?=[\w-]+(?:\s+(?:dot|punto|punkt|nokta)\s+[\w-]+)+)"
# Digits as words.
DIGITS = {
    "0": "zero oh null cero sıfır", "1": "one eins uno bir", "2": "two zwei dos iki", "3": "three drei tres üç", "4": "four vier cuatro dört",
    "5": "five fünf cinco beş", "6": "six sechs seis altı", "7": "seven sieben siete yedi", "8": "eight acht ocho sekiz", "9": "nine neun nueve dokuz",
}
_SPELLED = {w: d for d, words in DIGITS.items() for w in words.split()}
_DISGUISES = regex.compile(
    rf"(?P<at>(?<=[\w+-]){AT}(?=[\w-]))|(?P<spoken>{SPOKEN})|(?P<dot>(?<=[\w-]){DOT}(?=\w))"
    rf"|(?P<digits>\b(?:{'|'.join(_SPELLED)})(?:[\s,-]+(?:{'|'.join(_SPELLED)})){{6,}}\b)",
    regex.I,
)
_BRACKETED = re.compile(r"[(\[{<]\s*(?:at|arroba|a|ät|@|dot|punto|punkt|nokta|\.)\s*[)\]}>]", re.I)
_SPOKEN_SIGN = re.compile(r"\s(?:dot|punto|punkt|nokta)\s", re.I)
_CONTROL = re.compile(r"[\x00-\x08]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPOKEN = frozenset(("dot", "punto", "punkt", "nokta"))


@lru_cache(2)
def _spoken_words(text: str) -> list[str]:
    """The runs of letters of a text in lower case, for the plain tests; kept for the text at hand."""
    return _LETTERS.findall(text.lower().replace("i̇", "i"))


def _disguised(text: str) -> bool:
    """A bracketed or spoken sign, or seven spelled digits: the plain test before the transducer."""
    words = _spoken_words(text)
    if not _SPOKEN.isdisjoint(words) and _SPOKEN_SIGN.search(text):
        return True
    if ("(" in text or "[" in text or "{" in text or "<" in text) and _BRACKETED.search(text):
        return True
    return sum(map(_SPELLED.__contains__, words)) >= 7


_SPOKEN_DOT = regex.compile(r"\s+(?:dot|punto|punkt|nokta)\s+", regex.I)
_HIDDEN = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in UNSEEN if b < 0x10000 and a not in (0x00,)) + "\\x00-\\x08"


#: Code points that a rule may change; beyond them the database has no decompositions, marks or format characters.
SCANNED = ((0, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


@cache
def _changing() -> tuple[frozenset[str], frozenset[str]]:
    """(characters whose plain reading differs, by rule; combining marks)."""
    every = [chr(c) for a, b in SCANNED for c in range(a, b) if not 0xD800 <= c <= 0xDFFF]
    hidden = re.compile(f"[{_HIDDEN}]")
    changed = frozenset(c for c in every if (ord(c) > 0x7F and _plain_text(c) != c) or hidden.match(c))
    return changed, frozenset(c for c in every if unicodedata.category(c)[0] == "M")


@lru_cache(1024)
def _class_of(signs: str) -> re.Pattern:
    return re.compile(f"[{re.escape(signs)}]")


_MARKED = regex.compile(rf"[{_HIDDEN}]+|.\p{{M}}+|[^\x00-\x7f]")


def _replace(text: str, at: list[tuple[int, int]], hits: Iterator[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text with spans replaced, and the (plain, source) break points that map offsets back."""
    out, points, size, last, changed = [], [(0, 0)], 0, 0, False
    for start, end, new in hits:
        if text[start:end] == new:
            continue
        changed = True
        out.append(text[last:start])
        size += start - last
        points.append((size, start))
        out.append(new)
        size += len(new)
        points.append((size, end))
        last = end
    if not changed:
        return text, at
    out.append(text[last:])
    merged = [(p, _source(at, s)) for p, s in points]
    # break points of the earlier step, carried into this one
    starts = [s for _, s in points]
    for p, s in at:
        i = bisect_right(starts, p) - 1
        if i % 2 == 0:  # outside the replaced spans
            merged.append((points[i][0] + p - points[i][1], s))
    return "".join(out), sorted(set(merged))


def _source(points: list[tuple[int, int]], place: int) -> int:
    i = bisect_right(points, (place, 1 << 62)) - 1
    return points[i][1] + place - points[i][0]


def _plain_char(m) -> str:
    return _plain_text(m.group())


@lru_cache(1 << 14)
def _plain_text(text: str) -> str:
    if unicodedata.category(text[0]) in ("Cf", "Cc"):
        return ""
    text = unicodedata.normalize("NFC", text)
    if len(text) == 1:
        tag = unicodedata.decomposition(text)
        if tag.startswith(("<wide>", "<narrow>", "<noBreak>")) or unicodedata.category(text) == "Zs":
            text = unicodedata.normalize("NFKC", text)
    return "".join(LOOK_ALIKES.get(c, c) for c in text)


def plain(text: str) -> tuple[str, list[tuple[int, int]]]:
    """(plain reading, break points) of a text."""
    points = [(0, 0)]
    if not text.isascii() or _CONTROL.search(text):
        changed, marks = _changing()
        present = set(text)
        if not marks.isdisjoint(present):
            text, points = _replace(text, points, ((m.start(), m.end(), _plain_char(m)) for m in _MARKED.finditer(text)))
        elif signs := "".join(sorted(changed.intersection(present))):
            text, points = _replace(text, points, ((m.start(), m.end(), _plain_char(m)) for m in _class_of(signs).finditer(text)))

    def undisguised(text: str) -> Iterator[tuple[int, int, str]]:
        spoken_until = 0
        for m in _DISGUISES.finditer(text):
            if m["digits"]:
                yield m.start(), m.end(), "".join(_SPELLED[w] for w in re.findall(r"\w+", m["digits"].lower()))
            elif m["spoken"]:
                yield m.start(), m.end(), "@"
                tail = regex.compile(r"[\w-]+(?:\s+(?:dot|punto|punkt|nokta)\s+[\w-]+)+", regex.I).match(text, m.end())
                for d in _SPOKEN_DOT.finditer(text, m.end(), tail.end()):
                    yield d.start(), d.end(), "."
                spoken_until = tail.end()
            elif m.start() >= spoken_until:
                yield m.start(), m.end(), "@" if m["at"] else "."

    if _disguised(text):
        text, points = _replace(text, points, undisguised(text))
    return text, points


_EMAIL = regex.compile(r"(?<![\w.+@-])[\w](?:[\w.+%-]*[\w])?@(?:[\w](?:[\w-]*[\w])?\.)+\p{L}{2,}(?![\w-]|\.\w)")

_TOWN = r"\p{Lu}[\p{L}'’-]+(?:[ ](?:\p{Lu}[\p{L}'’-]+|am|an|der|de|del|la|las|los|bei|upon|on)){0,3}"
_POST = r"\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]?[ ]?\d[A-Z]{2}"
_JOIN = r"(?:,?[ ]|,?[ ]?\r?\n[ ]*)"  # of a postcode, which may stand on the next line
_PLACE = rf"(?:{_JOIN}(?:{_POST})[ ](?P<t1>{_TOWN})|,[ \r\n]+(?P<t2>{_TOWN})(?:,?{_JOIN}(?:{_POST})\b(?![ ]?\d))?|,?[ ](?:{_POST})\b(?![ ]?\d))?"
_EN = regex.compile(
    rf"(?<![\w.,#-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)[ ]\d+[A-Za-z]?,?[ \r\n]+)?\d{{1,4}}[A-Za-z]?[ ]+(?:\p{{Lu}}[\p{{L}}]*(?:['’]\p{{L}}+)?[ ]){{1,3}}(?:{STREETS_AFTER})(?!\w)"
    rf"(?:,[ ](?:Flat|Apt\.?|Unit)[ ]\d+[A-Za-z]?)?{_PLACE}"
)
_TR = regex.compile(
    rf"(?:(?<=^|[\s:>,;|(=])\p{{Lu}}\p{{L}}+[ ]){{1,3}}(?:{STREETS_TR})[ ]*,?[ ]*(?:No\.?[ ]?:?[ ]*)?\d{{1,4}}[A-Za-z]?(?:[/-]\d{{1,3}}[A-Za-z]?)?(?![\d/])"
    rf"(?:,?[ ]*(?:D|Daire|Kat|K)[.:]?[ ]*:?[ ]*\d+)*(?:(?:,?[ ]|,?[ ]?\r?\n[ ]*)\d{{5}}[ ](?P<t1>{_TOWN})|,?[ ](?P<t2>{_TOWN}))?"
)
_ES = regex.compile(
    rf"(?<!\w)(?:{STREETS_ES})[ ](?:(?:de[ ]la|de[ ]los|de[ ]las|del|de)[ ])?\p{{Lu}}\p{{L}}+(?:[ ](?:(?:de[ ]la|de[ ]los|del|de)[ ])?\p{{Lu}}\p{{L}}+){{0,3}},?[ ](?:n\.?º[ ]?)?\d{{1,4}}(?!\d)[A-Za-z]?(?![\w])"
    rf"(?:,?[ ]\d{{1,2}}\.?[ºª°o]\.?(?:[ ]?\p{{L}}\b)?)?{_PLACE}"
)
_DE = regex.compile(
    rf"(?<!\w)(?:\p{{Lu}}\p{{L}}*(?:{STREETS_DE})|(?:\p{{Lu}}\p{{L}}+[ -])?(?:Straße|Platz|Weg|Allee|Gasse|Str\.))[ ]\d{{1,4}}[ ]?[a-z]?(?![\w.:])(?!\d)(?:(?:,?[ ])(?:Whg\.?|Wohnung)[ ]\d+)?{_PLACE}|"
    rf"(?<!\w)\p{{Lu}}\p{{L}}*(?:{STREETS_DE})[ ]\d{{1,4}}[a-z]?(?=\.(?:\s|$))"
)

def _sign(kinds: str) -> re.Pattern:
    """The words of a kind of street in lower case, the plain test before a pattern of addresses."""
    return re.compile(kinds.lower().replace("\\.?", ""))


_EN_SIGN, _TR_SIGN, _ES_SIGN, _DE_SIGN = (_sign(x) for x in (STREETS_AFTER, STREETS_TR, STREETS_ES, STREETS_DE))

_LABEL = r"(?:kimlik|tckn|t\.c\.|steuer|steueridentifikations|ausweis|pass|pasaport|passport|dni|nie|nif|ssn|social[ ]security|insurance|identity|identidad|tax|vergi|sozialversicherung|seguridad[ ]social|cédula|id[ ]card)"
_LABELLED = regex.compile(_LABEL, regex.I)
_ID = re.compile(
    r"(?<![\w#/@.+-])(?:"
    r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]"  # insurance
    r"|\d{3}-\d{2}-\d{4}"  # social security
    r"|[XYZ]-?\d{7}-?[A-Z]"  # foreigner's
    r"|\d{8}-?[A-Z]|\d{1,2}\.\d{3}\.\d{3}-?[A-Z]"  # identity card
    r"|[A-Z]{2}\d{6,7}|[A-Z]\d{8}"  # passport
    r"|\d{3}[ ]\d{3}[ ]\d{3}[ ]\d{2}|\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}|\d{11}"  # identity, tax
    r")(?![\w/@]|-\w|[.,]\d)"
)
_PHONE = regex.compile(
    r"(?<![\w#/@.:+=-]|\d[ ]|(?:SN|No|Nr)[ -])(?<!\d,)(?:"
    r"\+\d{1,3}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,4}"
    r"|00\d{10,13}"
    r"|0?[ ]?\(0?\d{2,5}\)[ .-]?\d{2,8}(?:[ .-]\d{2,5}){0,3}"
    r"|0\d{2,4}/\d{5,9}"
    r"|0\d{2,4}[ .]\d{3,5}[ .]?\d{3,5}|07\d{3}[ ]?\d{6}|0\d{2}[ ]\d{4,5}[ ]?\d{3,4}"
    r"|0\d{3}[ ]\d{3}[ ]\d{2}[ ]\d{2}|0[ ]\d{3}[ ]\d{3}[ ]\d{2}[ ]\d{2}"
    r"|\d{3}-\d{2}-\d{2}-\d{2}|\d{3}[ ]\d{2}[ ]\d{2}[ ]\d{2}|\d{3}[ ]\d{3}[ ]\d{3}|\d{3}[-.]\d{3}[-.]\d{4}"
    r"|0000\d{7}"
    r")(?![\w/@]|-\d|[.,]\d|[ ]\d)"
)
_CALL = regex.compile(r"(?:tel|phone|call|fax|mobile|cell|line|hattı|ara|llama|teléfono|móvil|ruf|anruf|handy|numara)", regex.I)

@lru_cache(1 << 16)
def _low(word: str) -> str:
    return word.casefold().replace("i̇", "i")


_ORDINARY = {w.casefold() for words in STOPWORDS.values() for w in words.split()}
_GIVEN = {_low(g) for g in GIVEN}
_TITLES = {_low(t) for t in TITLES}
# Titles that are abbreviations, which alone may be followed by a point.
_SHORT = set("capt dr dra prof mr mrs ms rev av doç sr sra srta lic ing".split())
# a title or a given name that letters of two cases spell is met in either
_STARTING = frozenset(w for g in (_GIVEN, _TITLES) for x in g for w in (x, *_LETTERS.findall(x)))
_INITIAL = re.compile(r"(?<![^\W\d_])[^\W\d_]\.")
_WORD = regex.compile(r"\p{L}+(?:-\p{L}+)*")
_GAP = regex.compile(r"[^\S\r\n]*(?:\r?\n)?[^\S\r\n]*")
_BEFORE_VESSEL = regex.compile(rf"(?<!\w)(?:{VESSELS})\s+(?:[\"“'„«]\s*)?$", regex.I)
_STREET_AFTER = regex.compile(rf"\s+(?:{STREETS_AFTER}|{STREETS_TR})(?!\w)")


class _Words:
    """The words of a text with what stands between them; a word that an address sign touches is no name's."""

    def __init__(self, text: str, given: frozenset[str] = frozenset()):
        self.text, self.more = text, given
        self.at = [m.span() for m in _WORD.finditer(text)]
        self.low = [_low(text[a:b]) for a, b in self.at]

    def word(self, i: int) -> str:
        a, b = self.at[i] if 0 <= i < len(self.at) else (0, 0)
        return self.text[a:b]

    def gap(self, i: int) -> str:
        """What stands between word i and the next."""
        return self.text[self.at[i][1] : self.at[i + 1][0]] if 0 <= i < len(self.at) - 1 else "\n\n"

    def joined(self, i: int, sign: str = "", breaks: bool = False) -> bool:
        """Word i and the next are parted by the sign and white space, with one line break at most where breaks may be."""
        gap = self.gap(i)
        if not gap.startswith(sign):
            return False
        rest = gap[len(sign) :]
        return bool(rest or sign == ".") and len(rest) < 12 and (breaks or "\n" not in rest) and _GAP.fullmatch(rest) is not None

    def free(self, i: int) -> bool:
        a, b = self.at[i]
        before, after = self.text[a - 1 : a], self.text[b : b + 2]
        return not (before and (before in "@._+-/'’" or before.isdigit()) or after[:1] in ("@", "_", "+", "/") or after[:1].isdigit() or after[:1] == "." and after[1:].isalnum())

    def initial(self, i: int) -> bool:
        return len(w := self.word(i)) == 1 and w.isupper() and self.gap(i)[:1] == "." and self.free_initial(i)

    def free_initial(self, i: int) -> bool:
        a = self.at[i][0]
        before = self.text[a - 1 : a]
        return not (before and (before in "@._+-/'’º" or before.isdigit()))

    def title(self, i: int) -> bool:
        low = self.low[i]
        if low not in _TITLES or not self.word(i)[0].isupper() or not self.free_initial(i):
            return False
        return self.joined(i, breaks=True) or low in _SHORT and self.joined(i, ".", breaks=True)

    def given(self, i: int) -> bool:
        return 0 <= i < len(self.at) and (self.low[i] in _GIVEN or self.low[i] in self.more)

    def family(self, i: int, capital: bool = True) -> bool:
        """A word that may be a family name: long enough, free, no function word, written with a capital where names are."""
        if not 0 <= i < len(self.at):
            return False
        w = self.word(i)
        return len(w) >= 4 and (w[0].isupper() or not capital) and self.free(i) and not any(_low(p) in _ORDINARY or len(p) < 3 for p in w.split("-"))

    def after_given(self, i: int) -> int | None:
        """The place of the family name that follows a given name at i, over an initial or a second given name."""
        capital = self.word(i)[0].isupper()
        j = i
        if self.joined(j) and self.initial(j + 1) and self.joined(j + 1, "."):
            j += 1
            return j + 1 if self.family(j + 1) else None
        if self.joined(j) and self.given(j + 1) and self.joined(j + 1) and self.family(j + 2, capital):
            return j + 2
        return j + 1 if self.joined(j) and self.family(j + 1, capital) else None


def _name_at(words: _Words, i: int, titled: bool) -> tuple[int, int, int] | None:
    """(start, end, last word) of the name that begins at word i."""
    at = words.at
    if words.given(i) and words.free(i):
        last = words.after_given(i)
        if last is not None:
            return at[i][0], at[last][1], last
    if words.initial(i) and words.joined(i, "."):
        j = i + 1
        if words.initial(j) and words.joined(j, "."):
            j += 1
        if words.family(j):
            return at[i][0], at[j][1], j
    if words.family(i, capital=not titled) and not words.given(i):
        if words.joined(i, ","):
            j = i + 1
            if words.given(j) and words.free(j) and words.after_given(j) is None:
                if words.joined(j) and words.initial(j + 1):
                    return at[i][0], at[j + 1][1] + 1, j + 1
                return at[i][0], at[j][1], j
            if words.initial(j) and words.text[at[i][0]].isupper():
                return at[i][0], at[j][1] + 1, j
        elif words.joined(i) and words.given(i + 1) and words.free(i + 1) and words.after_given(i + 1) is None:
            if titled or _alone(words.text, at[i][0], at[i + 1][1]):
                return at[i][0], at[i + 1][1], i + 1
        if titled and words.word(i)[0].isupper():
            return at[i][0], at[i][1], i
    return None


def names(text: str, given: frozenset[str] = frozenset()) -> Iterator[tuple[int, int]]:
    """(start, end) of each person's name; ``given`` are names known besides the fixed ones."""
    spoken = _spoken_words(text)
    if _STARTING.isdisjoint(spoken) and (not given or given.isdisjoint(spoken)) and not _INITIAL.search(text):
        return
    words = _Words(text, given)
    at, n, done = words.at, len(words.at), 0
    # a name begins at a title, a given name, an initial, or a word before a given name or an initial
    starts = set()
    for i, low in enumerate(words.low):
        if low in _GIVEN or low in given:
            starts.update((i - 1, i))
        elif low in _TITLES:
            starts.add(i)
        if at[i][1] - at[i][0] == 1:
            starts.update((i - 1, i))
    for i in sorted(starts):
        if i < done:
            continue
        a, b = at[i]
        titled = words.title(i)
        if not (titled or words.given(i) or b - a == 1 or words.given(i + 1) or text[b : b + 1] == "," and words.initial(i + 1)):
            continue
        j = i
        while titled and j + 1 < n:
            j += 1
            if not words.title(j):
                break
        name = _name_at(words, j, titled)
        if name is None or _BEFORE_VESSEL.search(text[max(0, a - 24) : a]) or _STREET_AFTER.match(text, name[1]):
            continue
        yield name[0], name[1]
        done = name[2] + 1


def _alone(text: str, start: int, end: int) -> bool:
    """A family name before a given name counts where the pair stands alone: on a line, after a label, in a cell."""
    before, after = text[:start].rstrip(" "), text[end : end + 3].lstrip(" ")
    return (not before or before[-1] in "\n\r:|;>") and (not after or after[0] in "\n\r|;<,.")


def found(text: str | None, given: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each piece in the source text, in order and free of overlap; ``given`` as in ``names``."""
    if not text:
        return []
    read, points = plain(text)
    spans: list[tuple[int, int, int]] = []
    digits = sum(map(len, re.findall(r"\d+", read)))
    if "@" in read:
        spans += [(0, *m.span()) for m in _EMAIL.finditer(read)]
    low = read.lower() if digits else ""
    for pattern, sign in ((_EN, _EN_SIGN), (_TR, _TR_SIGN), (_ES, _ES_SIGN), (_DE, _DE_SIGN)) if digits else ():
        if not sign.search(low):
            continue
        for m in pattern.finditer(read):
            start, end = m.span()
            if m.groupdict().get("t2") and pattern is not _TR:
                first = regex.match(r"\p{L}+", m["t2"])
                if first and _low(first[0]) in _ORDINARY and not regex.search(_POST + "$", m[0]):
                    end = m.start("t2")
                    end = start + len(read[start:end].rstrip(", \r\n"))
            if m.groupdict().get("t2") and pattern is _TR and _low(m["t2"].split()[0]) in _ORDINARY:
                end = start + len(read[start : m.start("t2")].rstrip(", "))
            spans.append((1, start, end))
    for m in _ID.finditer(read) if digits >= 6 else ():
        number = m[0]
        if number.isdigit() and len(number) == 11:
            before = read[max(0, m.start() - 40) : m.start()]
            after = read[m.end() : m.end() + 24]
            labels = [x.end() for x in _LABELLED.finditer(before)] or [0] * bool(_LABELLED.search(after))
            calls = [x.end() for x in _CALL.finditer(before)]
            by_form = number.startswith(("0000", "07"))
            if calls and (not labels or calls[-1] > labels[-1]) or by_form and not labels:
                spans.append((3, *m.span()))
                continue
        spans.append((2, *m.span()))
    for m in _PHONE.finditer(read) if digits >= 7 else ():
        if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
            lead = len(m[0]) - len(m[0].lstrip())
            spans.append((3, m.start() + lead, m.end()))
    spans += [(4, *s) for s in names(read, given)]
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []  # in order and apart, so that two neighbours decide
    for kind, start, end in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        i = bisect_right(taken, (start, 1 << 62))
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
            taken.insert(i, (start, end))
            out.append((KINDS[kind], _source(points, start), _source_end(points, end)))
    return sorted(out, key=lambda s: s[1])


def _source_end(points: list[tuple[int, int]], end: int) -> int:
    """The source offset behind the last character of a span: what shows nothing after it stays outside."""
    return _last(points, end)


def _last(points: list[tuple[int, int]], end: int) -> int:
    i = bisect_right(points, (end - 1, 1 << 62)) - 1
    start = points[i][1] + end - 1 - points[i][0]
    nxt = points[i + 1] if i + 1 < len(points) else None
    if nxt is not None and nxt[0] == end:
        j = bisect_right(points, (end, -1))
        return points[j][1] if points[j][0] == end else nxt[1]
    return start + 1


def name_evidence(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, families: int = 2, share: float = 0.5) -> DataFrame:
    """(word, docs, families, share): words that the corpus itself shows to be given names.

    Family names are what stands behind the known given names and titles.  A capitalised word counts where it stands before or, with a comma,
    behind one of them; it is a given name if it does so in at least ``least`` texts, with ``families`` different family names, and in more than ``share`` of all places where it
    stands capitalised before or behind another capitalised word.  The pairs are read and counted in the JVM.
    """
    def last(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            read = plain(t)[0] if t else ""
            out.append(sorted({_low(_WORD.findall(read[a:b])[0 if "," in read[a:b] else -1]) for a, b in names(read) if len(_WORD.findall(read[a:b])) > 1}))
        return pd.Series(out)

    once = docs.select(key, text).filter(F.col(text).isNotNull()).distinct()
    known = once.select(F.explode(F.pandas_udf(last, T.ArrayType(T.StringType()))(F.col(text))).alias("family")).distinct()
    # a word may be the first of one pair and the second of the next, so the text is read from either
    side = lambda skip: F.regexp_extract_all(F.regexp_replace(text, skip, " "), F.lit(r"(?<![\p{L}'’.@-])(\p{Lu}\p{L}+,? \p{Lu}\p{L}{2,})(?![\p{L}@])"), 1)
    pairs = once.select(key, F.explode(F.array_distinct(F.concat(side(r"\x00"), side(r"(?<!\p{L})\p{Lu}\p{L}+,? (?=\p{Lu}\p{L}+,? \p{Lu})")))).alias("p"))
    low = F.lower(F.translate(F.translate("p", "İ", "i"), ",", ""))
    two = pairs.select(key, F.contains("p", F.lit(",")).alias("turned"), F.split(low, " ").alias("w")).select(
        key, F.when(F.col("turned"), F.get("w", 1)).otherwise(F.get("w", 0)).alias("word"), F.when(F.col("turned"), F.get("w", 0)).otherwise(F.get("w", 1)).alias("family"))
    met = two.join(known.withColumn("known", F.lit(1)), "family", "left")
    counted = met.groupBy("word").agg(
        F.count_distinct(F.when(F.col("known") == 1, F.col(key))).alias("docs"), F.count_distinct(F.when(F.col("known") == 1, F.col("family"))).alias("families"),
        F.round(F.avg(F.coalesce("known", F.lit(0)).cast("double")), 6).alias("share"))
    titles = docs.sparkSession.createDataFrame([(w,) for w in sorted(_TITLES | _ORDINARY)], "word string")
    return counted.filter((F.col("docs") >= least) & (F.col("families") >= families) & (F.col("share") > share)).join(F.broadcast(titles), "word", "left_anti")


#: Most learned names that are sent to the tasks, some megabytes; more raise an error.
MOST_NAMES = 200_000


def personal(docs: DataFrame, key: str = "doc_id", text: str = "text", given: DataFrame | None = None) -> DataFrame:
    """(key, kind, found): each different piece of a document once, exactly as written there.

    Null, empty and blank texts have none.  Texts are read whole, each where it lies; only
    the pieces found are shuffled, to count repeated ones and repeated rows once.  ``given`` (word), such as
    ``name_evidence`` gives, are given names besides the fixed ones.
    """
    more: frozenset[str] = frozenset()
    if given is not None:
        listed = given.select("word").distinct().limit(MOST_NAMES + 1).collect()
        if len(listed) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} learned names")
        more = frozenset(r[0] for r in listed)

    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([list({(k, t[a:b]) for k, a, b in found(t, more)}) if t else [] for t in texts])

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("found", T.StringType())]))
    return (
        docs.select(F.col(key), F.explode(F.pandas_udf(pieces, kind)(F.col(text))).alias("p"))
        .select(key, "p.kind", "p.found").distinct()
    )


def mask(text: str | None) -> str | None:
    """The text with a typed placeholder such as [EMAIL] for each piece, everything else unchanged."""
    if not text:
        return text
    out, last = [], 0
    for kind, a, b in found(text):
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with placeholders in its text; null stays null, other columns stay."""
    return docs.withColumn(text, F.pandas_udf(lambda s: s.map(mask, na_action="ignore"), T.StringType())(F.col(text)))
