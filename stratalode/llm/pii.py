"""Personal data inside free text: found under disguises, replaced by typed placeholders.

Offset-preserving deobfuscation: a chain of transducers rewrites the text for the detectors and keeps, for every
character it emits, the source character it came from: invisible characters vanish, homoglyphs and full-width forms
fold to ASCII, runs of spelled digits become digits, ``at``/``dot`` disguises become ``@`` and ``.``. Detectors run on
the rewritten text; their spans are mapped back, so the text outside of the placeholders stays as it was.

Detectors: email addresses, phone numbers, identity numbers, street addresses, and names of persons: an initial or a known given
name beside a capitalised family name, in either order; any two capitalised words after a title or a signature label; and any
two capitalised words that the tagger takes for a name. The tagger is a logistic model of shape (case, endings, whether the
words also occur in lower case), place in the line and neighbouring words, not of the words themselves. It is fitted on the
corpus itself: names found by the other rules are its labelled rows, other capitalised pairs the rest, of a bounded sample of
documents (``sample`` of them by a hash of the text, at most ``MAX_PAIRS`` pairs). Where spans overlap, the earlier in this
order wins: email, id_number, phone, address, name.

Bounds that are those of the formats: 64 characters before an at sign and 7 labels after it, 15 digits of a phone number, a label
within 24 characters before a bare number.

Defined results: null texts give no rows and stay null; empty texts stay empty; positions count code points from 1;
equal spans are one row; repeated rows are reported under each id; extra columns are not carried. Time grows linearly
with the text: all patterns are bounded in their repetition.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread

TYPES = ("email", "id_number", "phone", "address", "name")

# -- transducers ------------------------------------------------------------------------------------------------------

# Letters of other scripts that look like ASCII letters (fixed values).
_LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．", "aeopcyxijsdhqwABEKMHOPCTXIJSaiκvopτuxABEZHIKMNOPTYX@."))
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
# One character for one: the offsets stay as they are.
_SAME_LENGTH = {0xA0: " ", 0x2007: " ", 0x2009: " ", 0x202F: " ", 0xFF20: "@", 0xFF0E: ".", 0xFF0D: "-", 0xFF0B: "+"} | {
    0xFF00 + k: chr(0x20 + k) for k in (*range(0x10, 0x1A), *range(0x21, 0x3B), *range(0x41, 0x5B))}
_SAME_LENGTH_HINT = re.compile("[%s]" % "".join(map(chr, _SAME_LENGTH)))
# Words of Latin letters (or addresses) with letters of other scripts inside.
_MIXED = re.compile("[A-Za-z0-9@][\u0370-\u052f]|[\u0370-\u052f][A-Za-z0-9@]")
_MIXED_WORD = re.compile("[\\w@.+-]*(?:[A-Za-z0-9@][\u0370-\u052f]|[\u0370-\u052f][A-Za-z0-9@])[\\w@.+-]*")
_LOOKALIKES = str.maketrans(_LOOKALIKE)
_DIGIT_WORDS = {w: str(i) for words in (  # English, German, French, Spanish from zero to nine (fixed values)
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
) for i, w in enumerate(words.split())} | {"oh": "0", "zwo": "2"}
_PLUS = {"plus": "+", "más": "+"}
_TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}
_SPELLED_WORDS = frozenset(_DIGIT_WORDS) | frozenset(_PLUS) | frozenset(_TIMES)
_SPELLED = re.compile(r"\b(?:(?:%s)\b[ ,.-]{0,2}){7,30}" % "|".join(sorted(_SPELLED_WORDS, key=len, reverse=True)), re.I)
_BREAKS = "-,.;:()\"'"
_HAN = {c: str(i) for i, c in enumerate("零一二三四五六七八九")} | {"〇": "0", "幺": "1"}
_HAN_RUN = re.compile("[%s](?:[ -]?[%s]){6,29}" % (("".join(_HAN),) * 2))
_CASELESS = str.maketrans("ſİı", "sii")  # what re.I takes for s and i besides S and I
_AT = re.compile(r"[ \t]*(?:[\[({<][ \t]*(?:at|ät|arroba|arobase|a|@)[ \t]*[\])}>]|&#64;|&commat;|﹫)[ \t]*", re.I)
_AT_HINTS = ("at]", "at)", "at}", "at>", "at ]", "at )", "arroba", "arobase", "(a)", "[a]", "[@]", "(@)", "&#64;", "&commat;", "﹫", "(ät)", "[ät]")
_DOT = re.compile(r"[ \t]*[\[({<][ \t]*(?:dot|punkt|punto|point|\.)[ \t]*[\])}>][ \t]*", re.I)
_PLAIN_AT = re.compile(r"(?<=[\w])[ \t]+(?:at|AT)[ \t]+(?=[\w-]{1,40}(?:[ \t]+(?:dot|DOT)[ \t]+[\w-]{1,30}){1,4}\b)")
_PLAIN_DOT = re.compile(r"(?<=[\w])[ \t]+(?:dot|DOT)[ \t]+(?=\w)")


class Mapped:
    """A rewritten text and, for each of its characters, the source index (None: nothing was rewritten)."""

    __slots__ = ("text", "source", "length")

    def __init__(self, text: str):
        self.text, self.source, self.length = text, None, len(text)

    def replace(self, pattern: re.Pattern, value) -> None:
        if not (found := list(pattern.finditer(self.text))):
            return
        source = self.source if self.source is not None else list(range(len(self.text) + 1))
        out, where, at = [], [], 0
        for m in found:
            new = value(m) if callable(value) else value
            out += (self.text[at : m.start()], new)
            where += source[at : m.start()]
            where += [source[m.start()]] * len(new)
            at = m.end()
        out.append(self.text[at:])
        where += source[at:]
        self.text, self.source = "".join(out), where

    def start(self, i: int) -> int:
        return i if self.source is None else self.source[i]

    def end(self, i: int) -> int:
        """Source end (exclusive) of a span that ends before i."""
        if self.source is None:
            return i
        return max(self.source[i - 1] + 1, self.source[i]) if i < len(self.source) - 1 else self.source[i]


def _spelled(m: re.Match) -> str:
    out, times = [], 1
    for w in re.findall(r"\w+", m[0].translate(_CASELESS).lower()):
        if w in _TIMES:
            times = _TIMES[w]
        elif w in _PLUS:
            out.append("+")
        else:
            out.append(_DIGIT_WORDS[w] * times)
            times = 1
    end = re.search(r"[ ,.-]*\Z", m[0])[0]
    return "".join(out) + end


def rewrite(text: str) -> Mapped:
    m = Mapped(text)
    if not text.isascii():
        m.text = _SAME_LENGTH_HINT.sub(lambda x: _SAME_LENGTH[ord(x[0])], text)
        if _INVISIBLE.search(m.text):
            m.replace(_INVISIBLE, "")
        if _MIXED.search(m.text):
            m.text = _MIXED_WORD.sub(lambda x: x[0].translate(_LOOKALIKES), m.text)
        m.replace(_HAN_RUN, lambda x: "".join(_HAN.get(c, "") for c in x[0]))
    low = m.text.lower()
    words = low if low.isascii() else low.replace("ſ", "s").replace("ı", "i").replace("i\u0307", "i")
    for c in _BREAKS:
        words = words.replace(c, " ")
    # fewer than seven digit words in the whole text are no spelled number
    if sum(map(_SPELLED_WORDS.__contains__, words.split())) >= 7:
        m.replace(_SPELLED, _spelled)
        low = m.text.lower()
    if any(w in low for w in _AT_HINTS):
        m.replace(_AT, "@")
        m.replace(_DOT, ".")
    if " dot " in m.text or " DOT " in m.text:
        m.replace(_PLAIN_AT, "@")
        if "@" in m.text:
            m.replace(re.compile(r"(?<=@)[\w.-]{1,60}(?:[ \t]+(?:dot|DOT)[ \t]+[\w-]{1,30}){1,4}"),
                      lambda x: _PLAIN_DOT.sub(".", x[0]))
    return m


# -- detectors --------------------------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+%/-])[\w](?:[\w.+%'-]{0,62}[\w+])?@(?:[A-Za-z](?:[\w-]{0,61}\w)?\.){1,6}[A-Za-z]{2,24}(?![\w@])(?!:[\w/])")
_FILE_ENDS = frozenset("png jpg jpeg gif svg webp ico pdf js ts py css html md json yml yaml toml lock txt csv".split())

_S = r"[ .-]"
_PHONE = re.compile(
    r"(?<![\w+.,:/@#-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]\d{2,7}){1,5}"  # international, grouped
    r"|\+\d{8,15}"
    r"|00\d{2}[-.]\d{1,4}(?:[-. ]\d{2,6}){1,4}|00\d{2} \d{2,4} \d{4,6}(?: \d{2,4})?|00[1-9]\d{8,12}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,5})?"
    r"|0\d{1,4}/\d{4,9}(?:[ -]\d{1,4})?"
    r"|0\d{3,4} \d{3} \d{3,4}|0\d{4} \d{6}"
    r"|0[1-9](?:[ .-]\d{2}){4}"
    r"|[2-9]\d{2}\.\d{3}\.\d{4}"
    r")(?!\w|[-/.:]\d)"
)
_PHONE_BARE = re.compile(r"(?<![\w.+-])\d{3}[ -]\d{3}[ -]\d{3,4}(?!\w|[-/.]\d)")
_PHONE_CUE = re.compile(
    r"(?:\b(?:phone|tel|telefon|tél|teléfono|telefono|portable|mobile|mobil|cell|ring|call|fax|number was|llame al)|电话|手机)[\s:.=]{1,4}$", re.I)

_ID = re.compile(
    r"(?<![\w+.,@#/-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]{2}\d{7}"
    r"|[XYZ]-?\d{7}-?[A-Z]"
    r"|\d{8}-?[A-Z]"
    r"|\d{3}-\d{2}-\d{4}"
    r"|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r")(?!\w|[-/.]\w)"
)
_ID_CUED = re.compile(
    r"(?:\b(?:identity (?:number|card)|national[ _]id|ssn|passport(?: number)?|ausweisnummer|personalausweis|documento de identidad|"
    r"numéro d'identité|dni|nie)\b|身份号码|身份证号?)[\"'\s:=：]{0,4}(?:is|lautet|es|est)?[\"'\s:=：]{0,4}"
    r"(?P<n>[A-Z0-9](?:[A-Z0-9 -]{4,22})[A-Z0-9])(?!\w)", re.I)

_ID_HINTS = ("identity ", "national", "ssn", "passport", "ausweis", "documento de ", "numéro d", "dni", "身份")
_NIE = re.compile(r"\bnie[\"'\s:=：]{1,4}(?:is|lautet|es|est)?[\"'\s:=：]{0,4}[a-z]?-?\d")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]{1,40}"
_ADDRESS = re.compile(
    r"(?<![\w.,/-])(?:"
    rf"\d{{1,4}}[a-z]?(?: (?:bis|ter|quater))?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Qq]uai|[Ii]mpasse) (?:(?:des?|du|de la|de l'|d')\s?)?{_CAP}(?: {_CAP}){{0,2}}"
    rf"|(?:(?:An der|Am|Im|Zum) )?[A-ZÀ-ÖØ-Þ][\w-]{{1,40}}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm)(?: |, )\d{{1,4}} ?[a-z]?\b"
    rf"|(?:Calle|Plaza|Avenida|Paseo|Carrer|Camino|Ronda|Travesía)(?: (?:de la|de los|de las|del|de))? {_CAP}(?: {_CAP}){{0,2}},? \d{{1,4}}"
    rf"|\d{{1,5}}[A-Za-z]? {_CAP}(?: {_CAP}){{0,2}} (?:Street|Avenue|Road|Lane|Court|Close|Hill|Drive|Way|Boulevard|Square|Terrace|Place|Row|Gardens|Crescent|Grove|Mews|St|Ave|Rd|Ln|Blvd|Dr)\b\.?"
    r"|[一-鿿]{2,8}(?:路|街|大道|巷)\d{1,5}号"
    r")"
)
# What may follow the street: unit, postcode and town; it belongs to the address.
_ADDRESS_REST = re.compile(
    rf"(?:, ?(?:Apt|Apartment|Flat|Suite|Unit|No)\.? ?\d{{1,4}}[A-Za-z]?)?(?:, ?\d{{1,2}}º ?[A-Z])?(?:,? ?\d{{4,6}} {_CAP}|, {_CAP}(?: \d{{4,6}})?)?")

# Given names that the detector knows: a feature and the seed of the tagger's labels; a parameter, extended by callers.
GIVEN = (
    "Adam Alice Amadou Amir Ana Andrea Anita Anna Anne Anouk Antonio Astrid Barbara Beatriz Ben Björn Bruno Carla Carlos "
    "Carmen Catherine Chen Chloé Christine Claire Clara Daniel Dario David Diego Dmitri Elena Elif Elizabeth Emeka Emil Emily "
    "Emma Eric Erik Esther Eva Fatima Felix Fiona Francesca Franz Freya Gabriel Georg George Gideon Giulia Greta Halima Hanna "
    "Hannah Hans Hassan Heidi Helen Helena Henrik Henry Hiroshi Ilse Ines Ingrid Irina Isabel Ivan Ivo Jack Jakob James Jan Jane "
    "Javier Jean Jens Joanna Johan Johanna John Jolanda José Juan Julia Jörn Karin Karl Kaspar Katarina Keiko Kenji Klaus Lara "
    "Lars Laura Lea Leila Lena Leon Linda Linnea Lisa Lucas Lucía Luis Lukas Maëlle Magdalena Mara Marco Margaret Maria Marie "
    "Mario Marta Martin Mary Mateo Max Mehmet Mei Michael Miguel Mohammed Nadia Natalia Niels Nina Noah Nora Odette Olga Oliver "
    "Omar Oscar Ottilie Pablo Paloma Paul Pedro Peter Petra Pierre Priya Rachel Radek Rafael Raj Robert Rosa Rurik Samuel Sandra "
    "Sanna Sara Sarah Sergei Simon Sofia Solène Sophie Stefan Susanne Tamsin Teodor Teresa Thomas Tobias Tomasz Ulrich Vera "
    "Vesna Viktor Wei Wilmar Yasmin Yuki Yvaine Zofia Íñigo"
).split()

# Capitalised words that are no family names: beginnings of sentences and headings.
_NO_NAMES = frozenset(
    "the a an and or of in on at to for with from by as is are was were it its this that these those we you they he she no not "
    "call most each every once when while since until unless if after before under over within without against between "
    "release build run line lines page chapter section table figure ticket issue pin clone asset version module class note "
    "der die das und oder ein eine im am den dem von zu mit für auf ist nicht les le la une un des et ou dans pour sur avec "
    "el los las y o en con por para del una que según selon laut monday tuesday wednesday thursday friday saturday sunday "
    "january february march april may june july august september october november december street road lane court avenue".split()
)
_FAMILY = r"(?:(?:van|von|de|da|di|del|della|der|den|la|le|bin|al|el|O'|Mc|Mac) ?){0,2}[A-ZÀ-ÖØ-Þ][^\W\d_]{1,30}(?:['’-][A-ZÀ-ÖØ-Þ][^\W\d_]{1,30})?"
_TOKEN = re.compile(r"(?<![\w@.+-])[A-ZÀ-ÖØ-Þ][^\W\d_]{1,24}(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]{1,24})?(?![\w@])")
_AFTER = re.compile(rf"(?: [A-ZÀ-ÖØ-Þ]\.){{0,2}}[ \t]({_FAMILY})(?![\w@])")
_BEFORE = re.compile(rf"(?<![\w@.-])({_FAMILY}), ?$")
_INITIAL_AFTER = re.compile(r"(?: [A-ZÀ-ÖØ-Þ]\.)?(?!\w)")
_INITIALS = re.compile(rf"(?<![\w.@-])(?:[A-ZÀ-ÖØ-Þ]\.[ -]?){{1,3}}(?<=[. ])({_FAMILY})(?![\w@])(?!\.\w)")
# Titles and labels of signatures and bylines.
_CUE = re.compile(
    r"(?:\b(?:[Mm]aintainer|[Mm]aintained by|[Rr]eviewed by|Reviewed-by|Signed-off-by|[Aa]uthor|[Cc]ontact|[Cc]c|[Aa]ccording to|"
    r"Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|Señora?|Madame|Monsieur)|联系|\"user\")[.:=\"'\s]{1,5}")
_CUE_HINTS = ("aint", "eview", "Signed", "uthor", "ontact", "c: ", "ccording", "Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Madame", "Monsieur", "联系", '"user"')
_PAIR = re.compile(rf"([A-ZÀ-ÖØ-Þ][^\W\d_]{{1,24}})(?: [A-Z]\.)?[ ]({_FAMILY})(?=[\s]*(?:[,;.<(|\"']|at\b|unter\b|en\b|und\b|and\b|$))")


_TWO = re.compile(rf"(?<![\w@.+-])(?<![A-ZÀ-ÖØ-Þ]\. )([A-ZÀ-ÖØ-Þ][^\W\d_]{{1,24}}(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]{{1,24}})?)(?: [A-ZÀ-ÖØ-Þ]\.){{0,2}} ({_FAMILY})(?![\w@])")
_LAST_WORD = re.compile(r"[\w'-]+(?=\W*\Z)")
_NEXT_WORD = re.compile(r"\W{0,2}([\w'-]+)")
_ALPHA = re.compile(r"(?<!\w)[^\W\d_]{3,}(?!\w)")
COMMON = 6  # documents of the sample from which a word is common
SAMPLE, MAX_PAIRS, MAX_WORDS = 2000, 20_000, 50_000
SURE = 0.9


class Tagger:
    """Logistic model of capitalised pairs: which are names of persons."""

    def __init__(self, weights: dict[str, float], common: frozenset[str]):
        self.weights, self.common = weights, common

    @staticmethod
    def seen(one: str, two: str, common) -> list[str]:
        """How the two words occur in the sample: in lower case, capitalised, or hardly at all."""
        a, b = ("lower" if w.lower() in common else "capital" if w.title() in common else "rare" for w in (one, two))
        return [f"words {a} {b}", f"second {b}"]

    @staticmethod
    def features(t: str, m: re.Match, common) -> list[str]:
        a, z = m.span()
        one, two = m[1], m[2]
        before, after = t[max(0, a - 30) : a], t[z : z + 30]
        left = before.rstrip(" \t")
        out = ["bias", *Tagger.seen(one, two, common), f"caps {one.isupper() and len(one) > 2}"]
        starts = not left or left[-1] in "\n#>*|"
        if starts and after[:1] in ("", "\n", "\r"):
            out.append("whole line")
        out.append("starts line" if starts else f"left {left[-1]}" if not left[-1].isalnum() else "inside")
        p, n = _LAST_WORD.search(left), _NEXT_WORD.match(after)
        if p and not starts:
            out += [f"before {p[0].lower()}", f"before capital {p[0][0].isupper()}"]
        if n:
            out += [f"after {n[1].lower()}", f"after capital {n[1][0].isupper()}"]
        out.append(f"right {after[:1]!r}" if not after[:1].isalnum() else "right w")
        return out

    @classmethod
    def fit(cls, rows: list[tuple[list[str], bool]], common: frozenset[str], rounds: int = 300) -> Tagger | None:
        """Gradient steps on the log likelihood with a quadratic penalty; None without rows of both kinds."""
        y = np.array([float(b) for _, b in rows])
        if not len(y) or y.min() == y.max():
            return None
        index: dict[str, int] = {}
        row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
        col = np.array([index.setdefault(x, len(index)) for f, _ in rows for x in f])
        often = np.bincount(col) >= 5  # a context seen less often says nothing
        keep = often[col]
        row, col = row[keep], col[keep]
        w = np.zeros(len(index))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.bincount(row, w[col], len(y))))
            w += 0.5 * (np.bincount(col, (y - p)[row], len(w)) / np.sqrt(np.bincount(col, minlength=len(w)) + 5.0) / 4 - 0.02 * w)
        return cls(dict(zip(index, w.tolist())), common)

    def sure(self, t: str, m: re.Match) -> bool:
        x = sum(self.weights.get(f, 0.0) for f in self.features(t, m, self.common))
        return x >= math.log(SURE / (1 - SURE))


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


class Free:
    """Disjoint spans in order; asks and additions are binary searches."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.is_free(a, b):
                self.add(a, b)

    def is_free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


class Detector:
    def __init__(self, given: tuple[str, ...] | list[str] = tuple(GIVEN), tagger: Tagger | None = None):
        self.given = frozenset(_plain(g) for g in given)
        self.tagger = tagger
        self.memo: dict[str, bool] = {}

    def is_given(self, word: str) -> bool:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[word] = _plain(word) in self.given
        return known

    def names(self, t: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []

        def family(word: str, caps: bool) -> bool:
            last = word.split()[-1]
            if _plain(last) in _NO_NAMES or len(last) < 2:
                return False
            return last.isupper() if caps else not (last.isupper() and len(last) > 2 and "-" not in last)

        known = {w for w in set(_TOKEN.findall(t)) if self.is_given(w) or "-" in w and self.is_given(w.split("-")[0])}
        for m in _TOKEN.finditer(t) if known else ():
            word = m[0]
            if word not in known:
                continue
            caps = word.isupper()
            a = _AFTER.match(t, m.end())
            if a and family(a[1], caps) and not (self.is_given(a[1]) and t[a.end() : a.end() + 1] == " "):
                out.append((m.start(), a.end()))
                continue
            b = _BEFORE.search(t, max(0, m.start() - 70), m.start())
            if b and family(b[1], caps) and not (out and out[-1][1] > b.start()):
                out.append((b.start(1), _INITIAL_AFTER.match(t, m.end()).end()))
        for m in _INITIALS.finditer(t):
            if family(m[1], m[1].isupper() and len(m[1]) > 2):
                out.append((m.start(), m.end()))
        for m in _CUE.finditer(t) if any(w in t for w in _CUE_HINTS) else ():
            p = _PAIR.match(t, m.end())
            if p and family(p[2], p[1].isupper()) and _plain(p[1]) not in _NO_NAMES:
                out.append((p.start(), p.end()))
        if self.tagger:
            free = Free(out)
            for m in self.pairs(t):
                if free.is_free(*m.span()) and self.tagger.sure(t, m):
                    free.add(*m.span())
                    out.append(m.span())
        return out

    @staticmethod
    def pairs(t: str):
        """Two capitalised words, the first no function word: what the tagger judges."""
        at = 0
        while m := _TWO.search(t, at):
            at = m.end(1)  # the second word may begin a pair of its own
            if m[2][0].isupper() and _plain(m[1]) not in _NO_NAMES and _plain(m[2].split()[-1]) not in _NO_NAMES and not (m[1].isupper() or m[2].isupper()):
                yield m

    def labelled(self, text: str):
        """(match, rewritten text, whether the other rules take it for a name) of the pairs of a text."""
        t = rewrite(text).text
        taken = self.find(text) if self.tagger is None else []
        names = {(a, b) for a, b, k in taken if k == "name"}
        other = Free([(a, b) for a, b, k in taken if k != "name"])
        if t == text:  # where nothing moved, spans compare directly
            for m in self.pairs(t):
                if other.is_free(*m.span()):
                    yield m, t, any(a <= m.start() and m.end() <= b or m.start() <= a < m.end() for a, b in names)

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(type, start, end) in characters of the source from 0, end exclusive, ordered, free of overlaps."""
        m = rewrite(text)
        t = m.text
        spans: dict[str, list[tuple[int, int]]] = {k: [] for k in TYPES}
        if "@" in t:
            at, last = t.find("@"), 0
            while at >= 0:  # only the surroundings of each sign are searched
                x = _EMAIL.search(t, max(last, at - 66), at + 200)
                if x and x[0].rpartition(".")[2].lower() not in _FILE_ENDS:
                    spans["email"].append(x.span())
                    last = x.end()
                at = t.find("@", max(at + 1, last))
        spans["id_number"] += [x.span() for x in _ID.finditer(t)]
        low = t.lower()
        if any(w in low for w in _ID_HINTS) or "nie" in low and _NIE.search(low):
            spans["id_number"] += [x.span("n") for x in _ID_CUED.finditer(t) if sum(c.isdigit() for c in x["n"]) >= 5]
        spans["phone"] += [x.span() for x in _PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in x[0]) <= 15]
        spans["phone"] += [x.span() for x in _PHONE_BARE.finditer(t) if _PHONE_CUE.search(t, max(0, x.start() - 24), x.start())]
        for x in _ADDRESS.finditer(t):
            spans["address"].append((x.start(), _ADDRESS_REST.match(t, x.end()).end()))
        spans["name"] = self.names(t)
        taken: list[tuple[int, int, str]] = []
        free = Free()
        for kind in TYPES:
            for a, b in sorted(spans[kind]):
                if free.is_free(a, b):
                    free.add(a, b)
                    taken.append((a, b, kind))
        return sorted((m.start(a), m.end(b), k) for a, b, k in taken)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


_SPANS = pa.list_(pa.struct([("pii_type", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))


def fit_tagger(texts: DataFrame, given: tuple[str, ...] = tuple(GIVEN), sample: int = SAMPLE) -> Tagger | None:
    """From a frame of one text column: about ``sample`` of its rows by a hash of the text; equal texts share their fate."""
    rows = texts.toDF("text")
    share = min(1.0, sample / max(1, rows.count()))  # the count comes from file footers
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def label(batches):
        d = Detector(given)
        for b in batches:
            feats, labels, words = [], [], Counter()
            for text in b.column(0).to_pylist():
                if text:
                    words.update({w.title() if w.isupper() else w for w in _ALPHA.findall(text)})
                    for m, t, is_name in d.labelled(text):
                        feats.append([m[1], m[2], *Tagger.features(t, m, ())])
                        labels.append(int(is_name))
            feats += [[w] for w in words]
            labels += [-n for n in words.values()]
            yield pa.RecordBatch.from_arrays([pa.array(feats, pa.list_(pa.string())), pa.array(labels, pa.int32())], names=["features", "label"])

    seen = checkpoint(spread(picked).mapInArrow(label, "features array<string>, label int"))  # read twice
    # words (label < 0: minus their documents) and pairs, each with a bound of its own
    words = seen.where("label < 0").groupBy(F.col("features")[0].alias("w")).agg(F.sum(-F.col("label")).alias("n")).where(F.col("n") >= COMMON)
    words = words.orderBy(F.desc("n"), "w").limit(MAX_WORDS).select(F.array("w").alias("features"), F.lit(-1).alias("label"))
    pairs = seen.where("label >= 0").orderBy(F.xxhash64("features"), "features", "label").limit(MAX_PAIRS)
    rows = words.unionByName(pairs).collect()
    common = frozenset(r["features"][0] for r in rows if r["label"] < 0)
    fresh = lambda f: [x for x in Tagger.seen(f[0], f[1], common)] + [x for x in f[2:] if not x.startswith(("words ", "second "))]
    return Tagger.fit([(fresh(r["features"]), r["label"] == 1) for r in rows if r["label"] >= 0], common)


def scrub(df: DataFrame, *, id_col="doc_id", text_col="text", given: list[str] | None = None, with_text: bool = True, sample: int = SAMPLE) -> DataFrame:
    """(id, clean text, spans) of every row; a narrow map over two columns. Spans count from 1, the end inclusive."""
    names = tuple(given if given is not None else GIVEN)
    slim = spread(df.select(df[id_col], df[text_col]))
    kind = slim.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(fit_tagger(df.select(df[text_col]), names, sample))

    def run(batches):
        d = Detector(names, shared.value)
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                clean, spans = [], []
                for text in b.column(1).to_pylist():
                    found = d.find(text) if text else []
                    if with_text:
                        clean.append(redact(text, found) if found else text)
                    spans.append([{"pii_type": k, "start_pos": x + 1, "end_pos": y} for x, y, k in found])
                cols = [b.column(0), pa.array(clean if with_text else [None] * b.num_rows, pa.string()), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "clean", "spans"])

    return slim.mapInArrow(
        run, f"`{id_col}` {kind}, clean string, spans array<struct<pii_type: string, start_pos: bigint, end_pos: bigint>>")


def occurrences(scrubbed: DataFrame, id_col="doc_id") -> DataFrame:
    """(id, pii_type, start_pos, end_pos), one row per occurrence."""
    return scrubbed.select(id_col, F.explode("spans").alias("s")).select(id_col, "s.pii_type", "s.start_pos", "s.end_pos")
