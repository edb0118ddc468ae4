"""Noise in text of scanned pages: broken words, misread characters, running headers, page numbers.

Lines of a page are labelled by a hidden Markov model with the states header, top number, body, break and bottom number;
its observations are layout features: the form of the line, its place on the page, at how many tops of the paper it stands (one,
two, three or more), and whether a number fits the numbering of the paper (the commonest difference between printed number and
page index). So a year or the last cell of a table at the end of a page is body, and a title that runs over two pages only goes
out of the text although the definition of the ``header`` defect asks for three. Emissions and transitions start from documented
counts and are refined by Viterbi training on a bounded sample of pages (``sample``); the best path gives the labels, body lines
are put together into paragraphs between breaks, words broken at line ends are joined, misread words restored.

Statistics over all rows: the words of all contents with their counts (combined inside each map task before the shuffle),
of which those are kept that make up a share ``SHARE`` of all words, at most 1 / SHARE of them, so that the table that
workers get has a proven bound; and the top lines of each paper, folded so that case, page numbers and misread characters do not matter, counted
by (paper, line), and the numbers by (paper, difference): a paper that holds a third of all pages is as many groups as it has
different top lines, counted with map-side combine and joined back in salted parts.

Defined results: rows that are no pages, null ids and null contents take no part; repeated rows of one id count once; pages
without page index have no next page (a word broken at their end is judged alone); equal counts: the smaller word;
empty tables give no rows; other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread

SHARE = 2e-6
MIN_COUNT = 3
RATIO = 12
SAMPLE = 2000
SALT = 16
LONGEST = 1000  # characters from which a run is no word
MIN_TOPS = 3

# -- misread characters -----------------------------------------------------------------------------------------------

# What is printed -> what recognition makes of it, two steps in one where they meet (fixed values).
CONFUSIONS = (
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("s", "$"), ("i", "!"), ("l", "!"), ("a", "@"), ("i", "|"), ("l", "|"), ("b", "8"), ("z", "2"),
    ("g", "9"), ("g", "q"), ("e", "c"), ("n", "u"), ("t", "i"), ("i", "l"), ("m", "rn"), ("m", "nn"), ("u", "ii"), ("h", "li"), ("w", "vv"),
    ("h", "l!"), ("h", "1i"), ("h", "1!"), ("h", "l|"), ("u", "!i"), ("u", "i!"),
    ("u", "!!"), ("n", "ii"), ("ch", "di"), ("ch", "d!"), ("cl", "d"), ("d", "cl"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ffi", "ﬃ"), ("ff", "ﬀ"),
)
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _true, _seen in CONFUSIONS:
    _BY_FIRST.setdefault(_true[0], []).append((_true, _seen))

_LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬀ": "ff"}
# Letters that confusions make of one another, or of pairs, share a class or count for nothing.
_FOLD_TABLE = {ord(x): y for x, y in zip("0o5$s@a8bq9gcde2z", "oosssaabbgggeeezz")} | {ord(x): None for x in "ilt1!|nuhmrvw"}


def fold(word: str) -> str:
    """Equal for a word and its misread forms: an index key, the exact test is :func:`can_become`."""
    w = word.lower()
    for a, b in _LIGATURES.items():
        w = w.replace(a, b)
    return w.translate(_FOLD_TABLE)


def can_become(true: str, seen: str, left: int = 40) -> bool:
    """Whether recognition can make ``seen`` of ``true``; both in lower case."""
    if true == seen:
        return True
    i = 0
    while i < len(true) and i < len(seen) and true[i] == seen[i]:
        # a confusion may also start at an equal character; tried before going on
        for a, b in _BY_FIRST.get(true[i], ()):
            if len(b) > 1 or len(a) > 1:
                if true.startswith(a, i) and seen.startswith(b, i) and left and can_become(true[i + len(a) :], seen[i + len(b) :], left - 1):
                    return True
        i += 1
    if i == len(true) or i == len(seen):
        return i == len(true) == len(seen)
    for a, b in _BY_FIRST.get(true[i], ()):
        if true.startswith(a, i) and seen.startswith(b, i) and left and can_become(true[i + len(a) :], seen[i + len(b) :], left - 1):
            return True
    return False


_WORD = re.compile(r"[^\s\[\](){}\"“”«»,;:?]+")
_PARTS = re.compile(r"[^-_/.]+")
_NUMERIC = re.compile(r"[\d.,%$+#-]*\Z")
_MARK = "-¬\xad‐‑"
_BROKEN = re.compile(rf"(\S*[^\W\d_@!$|]|\S*[\w@!$|])[{_MARK}][ \t]*$")
_SYMBOL_INSIDE = re.compile(r"[a-z][!@$|][a-z]", re.I)


def words_of(text: str):
    for w in _WORD.findall(text):
        yield w.strip(".'’*").lower()


class Lexicon:
    """Frequent words with their counts, and an index by folded form."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.index: dict[str, list[str]] = {}
        self.heads: dict[str, int] = {}
        for w, n in counts.items():
            if "-" in w and w.count("-") == 1 and w[0] != "-":
                a, b = w.split("-")
                if a and b:
                    self.heads[a] = self.heads.get(a, 0) + n
            if w.isalpha() and w.isascii() or w.isalpha():
                self.index.setdefault(fold(w), []).append(w)
        for v in self.index.values():
            v.sort(key=lambda w: (-counts[w], w))
        self.memo: dict[str, str | None] = {}

    def known(self, w: str) -> int:
        return self.counts.get(w, 0)

    def true_form(self, part: str) -> str | None:
        """The word that was printed, if ``part`` is a misread form of one, else None."""
        if part in self.memo:
            return self.memo[part]
        if len(self.memo) > 300_000:
            self.memo.clear()
        out = None
        if not _NUMERIC.match(part) or part == "@":
            own = self.counts.get(part, 0)
            plain = part
            for a, b in _LIGATURES.items():
                plain = plain.replace(a, b)
            if plain != part:
                out = self.true_form(plain) or plain
            else:
                letters = part.isalpha()
                for w in self.index.get(fold(part), ()):
                    n = self.counts[w]
                    if w == part or n < RATIO * max(own, 1) and (letters or own > n):
                        continue
                    if letters and n < RATIO * max(own, 1):
                        continue
                    if len(w) < 2 and part != "@" or not len(w) - 2 <= len(part) <= 2 * len(w):
                        continue
                    if can_become(w, part):
                        out = w
                        break
                if out is None and _SYMBOL_INSIDE.search(part):
                    out = part.translate(str.maketrans("!@$|", "iasi"))
        self.memo[part] = out
        return out


def restore(word: str, lexicon: Lexicon) -> str | None:
    """The word with its misread parts restored, or None if nothing was misread. Keeps case and punctuation around."""
    hit = False

    def one(m: re.Match) -> str:
        nonlocal hit
        part = m[0]
        true = lexicon.true_form(part.lower())
        if true is None:
            return part
        hit = True
        if part.upper() == part and sum(c.isalpha() for c in part) > 1:
            return true.upper()
        return true.capitalize() if part[0].isupper() or part[0] in "|8$" and not part[1:2].isupper() else true

    core = word.rstrip(".'’*!") if not word.strip("!") == "" else word
    core = core or word
    tail = word[len(core) :]
    if "." in core or "/" in core:
        return None
    out = _PARTS.sub(one, core) + tail
    return out if hit else None


# -- lines --------------------------------------------------------------------------------------------------------------

_ROMAN = r"[ivxlc]{1,6}|[IVXLC]{1,6}"
_NUMBER_FORM = rf"(?:- ?(?:\d{{1,5}}|{_ROMAN}) ?-|[Pp]age \d{{1,5}}(?: of \d{{1,5}})?|Seite \d{{1,5}}|p\. ?\d{{1,5}}|\[\d{{1,5}}\]|\d{{1,5}}|{_ROMAN})"
_NUMBER_LINE = re.compile(rf"\s*{_NUMBER_FORM}\s*\Z")
_NUMBER_BEFORE = re.compile(rf"\s*{_NUMBER_FORM}(?:\s{{2,}}|\t)(?=\S)")
_NUMBER_AFTER = re.compile(rf"(?<=\S)(?:\s{{2,}}|\t){_NUMBER_FORM}\s*\Z")


def without_number(line: str) -> tuple[str, bool]:
    for p in (_NUMBER_BEFORE, _NUMBER_AFTER):
        m = p.search(line) if p is _NUMBER_AFTER else p.match(line)
        if m:
            return (line[: m.start()] + line[m.end() :]).strip(), True
    return line.strip(), False


_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def printed_number(line: str) -> int | None:
    """The value of a line that is a page number and nothing else."""
    if not _NUMBER_LINE.match(line):
        return None
    if m := re.search(r"\d+", line):
        return int(m[0])
    v = [_ROMAN_VALUES[c] for c in re.search(rf"(?:{_ROMAN})(?=\W*\Z)", line)[0].lower()]
    return sum(-a if a < max(v[i + 1 :], default=0) else a for i, a in enumerate(v))


def top_key(text: str) -> str | None:
    """Folded first line, None where it is blank or a number alone."""
    line = text.split("\n", 1)[0]
    if not line.strip() or _NUMBER_LINE.match(line):
        return None
    return " ".join(fold(w) for w in without_number(line)[0].split())


HEADER, TOP, BODY, BREAK, BOTTOM = range(5)
FORMS, PLACES = 4, 4  # number, blank, title, prose; first, second, middle, last
NONE, FITS, STRANGE = 0, 1, 2  # what is known of a number: nothing, it fits the paper's numbering, it does not
_START = np.array([40.0, 15.0, 60.0, 2.0, 0.1])
_MOVES = np.array([  # counts per 100 lines, to: header, top, body, break, bottom
    [0.1, 15, 80, 5, 0.5], [0.1, 0.1, 90, 10, 0.1], [0.05, 0.05, 85, 10, 5], [0.05, 0.05, 85, 5, 10], [0.05, 0.05, 0.1, 5, 0.1]])
_FORM = np.array([[0.5, 0.1, 70, 30], [98, 0.1, 1, 1], [0.6, 0.1, 4, 95], [0.1, 99, 0.1, 0.1], [98, 0.1, 1, 1]])
_PLACE = np.array([[99, 0.1, 0.1, 0.5], [50, 49, 0.05, 1], [5, 8, 82, 5], [1, 5, 90, 1], [0.5, 0.5, 0.02, 99]])
_TOPPED = np.array([[0.1, 0.3, 99.6], [98, 1, 1], [97, 2.9, 0.1], [99.8, 0.1, 0.1], [99.8, 0.1, 0.1]])  # at one, two, more tops
_FIT = np.array([[98, 1, 1], [40, 59.98, 0.02], [90, 1, 9], [98, 1, 1], [40, 59.98, 0.02]])
_PRIOR = 20.0


def is_title(line: str) -> bool:
    title, numbered = without_number(line)
    ws = title.split()
    upper = sum(w[0].isupper() or not w[0].isalpha() for w in ws)
    return bool(ws) and len(ws) <= 12 and (numbered or line[-1] not in ".,;:") and upper >= len(ws) - 2 and upper * 2 >= len(ws)


def features(lines: list[str], tops: int = 0, first: int = NONE, last: int = NONE) -> np.ndarray:
    """[lines, 4]: form, place, at how many tops the line stands (0 to 2), how its number fits."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    end = filled[-1] if filled else -1
    out = np.zeros((len(lines), 4), dtype=np.int64)
    for i, x in enumerate(lines):
        s = x.strip()
        fit = NONE
        if not s:
            form = 1
        elif _NUMBER_LINE.match(s):
            form = 0
            fit = first if i == filled[0] else last if i == end else NONE
        else:
            form = 2 if is_title(s) else 3
        place = 0 if i == 0 else 3 if i == end else 1 if i == 1 else 2
        out[i] = form, place, tops if i == 0 else 0, fit
    return out


class LineModel:
    def __init__(self):
        self.counts = [_START.copy(), _MOVES.copy(), _FORM.copy(), _PLACE.copy(), _TOPPED.copy(), _FIT.copy()]
        self._tables()

    def _tables(self):
        logs = []
        for c in self.counts:
            c = np.atleast_2d(c)
            logs.append(np.log(c / c.sum(axis=1, keepdims=True)))
        self.start, self.moves, self.emit = logs[0][0], logs[1], logs[2:]

    def label(self, f: np.ndarray) -> np.ndarray:
        return self.labels([f])[0]

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The best path of each page; pages of like length are rows of one array."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            longest, n = len(pages[order[at]]), 1
            while at + n < len(order) and (n + 1) * len(pages[order[at + n]]) <= 100_000:
                longest = len(pages[order[at + n]])
                n += 1
            pick = order[at : at + n]
            at += n
            sizes = np.array([len(pages[i]) for i in pick])
            f = np.zeros((n, longest, 4), dtype=np.int64)
            for r, i in enumerate(pick):
                f[r, : len(pages[i])] = pages[i]
            emit = sum(table.T[f[:, :, k]] for k, table in enumerate(self.emit))
            score = self.start + emit[:, 0]
            back, final = np.zeros((n, longest, 5), dtype=np.int8), np.where((sizes == 1)[:, None], score, 0.0)
            for t in range(1, longest):
                step = score[:, :, None] + self.moves
                back[:, t] = step.argmax(1)
                score = step.max(1) + emit[:, t]
                final[sizes == t + 1] = score[sizes == t + 1]
            path = np.zeros((n, longest), dtype=np.int64)
            state = final.argmax(1)
            rows = np.arange(n)
            for t in range(longest - 1, -1, -1):
                inside = t < sizes
                path[inside, t] = state[inside]
                if t:
                    state = np.where(inside, back[rows, t, state], state)
            for r, i in enumerate(pick):
                out[i] = path[r, : sizes[r]]
        return out

    def train(self, pages: list[np.ndarray], rounds: int = 2) -> LineModel:
        """Viterbi training; the documented start counts as ``_PRIOR`` pages."""
        if not pages:
            return self
        prior = [_START, _MOVES, _FORM, _PLACE, _TOPPED, _FIT]
        for _ in range(rounds):
            new = [np.atleast_2d(p) / np.atleast_2d(p).sum(axis=1, keepdims=True) * _PRIOR for p in prior]
            for f, path in zip(pages, self.labels(pages)):
                if not len(f):
                    continue
                new[0][0, path[0]] += 1
                np.add.at(new[1], (path[:-1], path[1:]), 1)
                for k in range(4):
                    np.add.at(new[2 + k], (path, f[:, k]), 1)
            self.counts = [new[0][0], *new[1:]]
            self._tables()
        return self


def broken_word(left: str, right: str, lexicon: Lexicon) -> tuple[bool, str]:
    """(whether the mark is none of the word's own, the joined word) for a line that ends in ``left`` + mark."""
    a, b = left.lower(), right.lower().rstrip(".,;:!?)'\"")
    joined, compound = a + b, f"{a}-{b}"
    known, own = lexicon.known(joined), lexicon.known(compound)
    if not known and not own:
        w = lexicon.true_form(joined)
        known = lexicon.known(w) if w else 0
        parts = [lexicon.true_form(p) or p for p in compound.split("-")]
        own = lexicon.known("-".join(parts))
    if own > known:
        return False, f"{left}-{right}"
    return True, left + right


class Page:
    """Labels, defects and repaired text of one page."""

    def __init__(self, lines: list[str], path: np.ndarray, tops: int, lexicon: Lexicon, following: str | None = None):
        self.defects: set[str] = set()
        if path[0] == HEADER and (tops == 0 or tops == 1 and not is_title(lines[0].strip())):  # nor is a sentence on two pages
            path[0] = BODY
        if path[0] == HEADER:
            if tops == 2:  # by definition: three pages or more
                self.defects.add("header")
            if without_number(lines[0])[1]:
                self.defects.add("page_number")
            for w in without_number(lines[0])[0].split():
                self._word(w, lexicon)
        if (path == TOP).any() or (path == BOTTOM).any():
            self.defects.add("page_number")
        body = [lines[i] for i in range(len(lines)) if path[i] in (BODY, BREAK)]
        while body and not body[-1].strip():
            body.pop()
        while body and not body[0].strip():
            body.pop(0)
        out: list[str] = []
        carry = ""
        first = True
        for i, line in enumerate(body):
            if not line.strip():
                out.append("")
                continue
            words = line.split()
            if carry and line.strip().isdigit() and any(x.strip() and not x.strip().isdigit() for x in body[i + 1 :]):
                out[-1:] = [f"{out[-1]} {line.strip()}".strip()] if out and out[-1] else [line.strip()]
                continue  # a number between the halves of a word does not end it
            if carry:
                nxt = words[0] if words else ""
                is_broken, joined = broken_word(carry, nxt, lexicon)
                if is_broken:
                    self.defects.add("hyphenation")
                words = [joined, *words[1:]]
                carry = ""
                joined_here = True
            else:
                joined_here = False
            m = _BROKEN.search(words[-1] if words else "")
            tail = None
            if m and len(words[-1].rstrip(_MARK)) > 0 and any(c.isalpha() for c in m[1]):
                more = next((x for x in body[i + 1 :] if x.strip()), None)
                if more is not None:
                    carry = words[-1][: -1]
                    words = words[:-1]
                else:
                    tail = words[-1][:-1]
            done = []
            for k, w in enumerate(words):
                if tail is not None and k == len(words) - 1:
                    continue
                if first and k == 0 and not joined_here and w[:1].islower() and w.rstrip(".,;").isalpha() and self._may_be_rest(w.rstrip(".,;"), lexicon):
                    done.append(w)  # perhaps the rest of a word of the page before
                    continue
                done.append(self._word(w, lexicon))
            if tail is not None:
                done.append(self._page_end(tail, following, lexicon))
            first = False
            if joined_here and out and out[-1] != "":
                out[-1] = f"{out[-1]} {' '.join(done)}".strip()
            elif out and out[-1] != "":
                out[-1] = f"{out[-1]} {' '.join(done)}".strip()
            else:
                out.append(" ".join(done))
        self.text = "\n\n".join(p for p in out if p)

    @staticmethod
    def _may_be_rest(w: str, lexicon: Lexicon) -> bool:
        """Short or unknown at the start of a page, and not clearly a common word misread."""
        true = lexicon.true_form(w)
        return len(w) < 4 or not lexicon.known(w) or true is not None and lexicon.known(true) < 200 * lexicon.known(w)

    def _word(self, w: str, lexicon: Lexicon) -> str:
        lead = len(w) - len(w.lstrip("([{\"'“«"))
        end = len(w.rstrip(",;:?)]}\"”»"))
        core = w[lead:end]
        if not core:
            return w
        new = restore(core, lexicon)
        if new is None:
            return w
        self.defects.add("misread")
        return w[:lead] + new + w[end:]

    def _page_end(self, tail: str, following: str | None, lexicon: Lexicon) -> str:
        if following:
            is_broken, joined = broken_word(tail, following, lexicon)
            if is_broken:
                self.defects.add("hyphenation")
                if restore(joined.rstrip(".,;:"), lexicon) is not None and restore(following, lexicon) is None:
                    # the misread character is on this page only if the part here shows it
                    if _SYMBOL_INSIDE.search(tail) or not _agrees(tail, lexicon.true_form(joined.lower().rstrip(".,;:"))):
                        self.defects.add("misread")
            else:
                self._word(tail, lexicon)
            return f"{tail}-"
        if not lexicon.heads.get(tail.lower()):
            self.defects.add("hyphenation")
            if _SYMBOL_INSIDE.search(tail):
                self.defects.add("misread")
        return f"{tail}-"


def _agrees(tail: str, true: str | None) -> bool:
    return true is None or true.startswith(tail.lower())


def first_body_word(lines: list[str], path: np.ndarray) -> str | None:
    return next((line.split()[0] for line, state in zip(lines, path) if state == BODY and line.strip()), None)


# -- plan ---------------------------------------------------------------------------------------------------------------


def lexicon_of(contents: DataFrame, share: float = SHARE, min_count: int = MIN_COUNT) -> dict[str, int]:
    """Words that make up ``share`` of all words; at most 1 / share of them, whatever the number of rows."""

    def count(batches):
        counts: Counter = Counter()

        def flush():
            counts.pop("", None)
            words, ns = [None, *counts], [counts.total(), *counts.values()]  # the total stands under null
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words = [w.strip(".'’*") for w in _WORD.findall(t.lower().replace("_", " "))]
                    counts.update(words)
                    for w in words:
                        if "-" in w:
                            counts.update(w.split("-"))
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    words = spread(contents.toDF("content")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = checkpoint(words.where(F.col("word").isNull() | (F.col("n") >= min_count) & (F.length("word") <= LONGEST)))  # read twice
    total = words.where("word is null").agg(F.sum("n")).first()[0] or 0
    kept = words.where(F.col("word").isNotNull() & (F.col("n") >= max(min_count, int(share * total))))
    return {r["word"]: r["n"] for r in kept.collect()}


def scan_noise(
    df: DataFrame, *, id_col="id", content: Column | None = None, paper: Column | None = None, index: Column | None = None,
    is_page: Column | None = None, sample: int = SAMPLE,
) -> DataFrame:
    """(id, defects, text): the kinds of noise that each page shows, and its text in paragraphs without it."""
    content = F.col("content") if content is None else content
    lexicon = lexicon_of(df.select(content.alias("content")))
    # one shuffle of the contents, by id; the deduplication and the joins below reuse its partitioning
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = df.select(
        df[id_col].cast("string").alias("id"), content.alias("content"), paper.cast("string").alias("paper"), index.cast("int").alias("page"),
        (F.lit(True) if is_page is None else is_page).alias("is_page"),
    ).where("is_page and id is not null and content is not null and paper is not null").drop("is_page").repartition(parts, "id").dropDuplicates(["id"])

    pages = checkpoint(pages)  # read by the marks, the training, the heads and the last pass

    def marks_of(batches):
        """What counts in a paper: the folded first line, and what the numbers at either end differ from the page index."""
        for b in batches:
            out = []
            for i, paper, page, text in zip(*(b.column(n).to_pylist() for n in ("id", "paper", "page", "content"))):
                if (k := top_key(text)) is not None:
                    out.append((i, paper, "top", k))
                if page is not None:
                    filled = [x for x in text.split("\n") if x.strip()]
                    for kind, line in (("first", filled[:1]), ("last", filled[1:][-1:])):
                        if line and (v := printed_number(line[0])) is not None:
                            out.append((i, paper, kind, str(v - page)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out) if out else ((),) * 4)], names=["id", "paper", "kind", "key"])

    marks = checkpoint(pages.mapInArrow(marks_of, "id string, paper string, kind string, key string"))
    counts = marks.withColumn("what", F.when(F.col("kind") == "top", "top").otherwise("number")).groupBy("paper", "what", "key").agg(F.count("*").alias("n"))
    tops = counts.where("what = 'top' and n > 1").select("paper", "what", "key", F.when(F.col("n") >= MIN_TOPS, 2).otherwise(1).alias("value"))
    numbers = counts.where("what = 'number'")
    usual = numbers.groupBy("paper").agg(F.max(F.struct("n", F.col("key").alias("k"))).alias("u")).where(F.col("u.n") >= MIN_TOPS)
    numbers = numbers.join(usual, "paper").select("paper", "what", "key", F.when(F.col("key") == F.col("u.k"), FITS).otherwise(STRANGE).alias("value"))
    known = tops.unionByName(numbers).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    of_pages = (
        marks.withColumn("what", F.when(F.col("kind") == "top", "top").otherwise("number")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
        .join(known, ["paper", "what", "key", "salt"]).groupBy("id")
        .agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("top", "first", "last")])
    )
    marked = pages.join(of_pages, "id", "left").select(*pages.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("top", "first", "last")])

    training = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 16)) < F.lit(_share_of(pages, sample))).select("content", "top", "first", "last").limit(2 * sample)
    model = LineModel().train([features(r["content"].split("\n"), r["top"], r["first"], r["last"]) for r in training.collect()])
    shared = df.sparkSession.sparkContext.broadcast((lexicon, model))

    def labelled(b, model):
        cols = [b.column(n).to_pylist() for n in ("content", "top", "first", "last")]
        lines = [t.split("\n") for t in cols[0]]
        return lines, model.labels([features(x, *f) for x, *f in zip(lines, *cols[1:])]), cols[1]

    # the word with which the next page goes on, only for pages that end in a mark
    ends_broken = rf"[{_MARK}][ \t]*(\n+[^\n]*)?\s*\z"
    open_ended = pages.where(F.col("page").isNotNull() & F.col("content").rlike(ends_broken)).select(
        F.col("id").alias("ending"), "paper", (F.col("page") + 1).alias("page"))
    asked = marked.where("page is not null").join(open_ended.select("paper", "page").distinct(), ["paper", "page"], "left_semi")

    def heads_of(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                lines, paths, _ = labelled(b, shared.value[1])
                words = [first_body_word(x, p) for x, p in zip(lines, paths)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("paper"), b.column("page"), pa.array(words, pa.string())], names=["id", "paper", "page", "word"])

    # one row per page number, so that a number that many rows share meets each ending once
    heads = asked.mapInArrow(heads_of, "id string, paper string, page int, word string").groupBy("paper", "page").agg(F.min(F.struct("id", "word")).alias("x"))
    nexts = open_ended.join(heads, ["paper", "page"]).select(F.col("ending").alias("id"), F.col("x.word").alias("following"))
    wide = marked.join(nexts, "id", "left")

    def finish(batches):
        counts, model = shared.value
        lex = Lexicon(counts)
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                defects, texts = [], []
                for lines, path, top, word in zip(*labelled(b, model), b.column("following").to_pylist()):
                    p = Page(lines, path, top, lex, word)
                    defects.append(sorted(p.defects))
                    texts.append(p.text)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(defects, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["id", "defects", "text"])

    return wide.mapInArrow(finish, "id string, defects array<string>, text string")


def _share_of(df: DataFrame, sample: int) -> int:
    """Of 2^16 hash values, those that give about ``sample`` of all rows."""
    return int(min(1.0, sample / max(1, df.count())) * (1 << 16)) + 1
