"""Cutting oversized texts at natural boundaries, by dynamic programming over boundary positions.

A text of more than ``limit`` characters becomes pieces of at most ``limit`` characters; each piece after the first
starts exactly ``overlap`` characters before the end of the one before, so the pieces without those characters are the
text again. Candidates are ends of code blocks, places before headings, paragraph, line, sentence and clause ends, and
blanks; where none is within reach, single characters (never between a base and its combining mark, the parts of a
joined emoji, or CR and LF). The program minimises the sum of the cuts' penalties and of the squared deviation of each
piece from the mean length. It looks back over one window per candidate: time grows linearly with the text.

Defined results: null, empty and short texts give no pieces (they are not oversized); the length counts code points;
``limit`` must exceed twice the ``overlap``; null or zero start lines count as 1; the heading of a piece is the last one at or before
its first own character (after the overlap), else the record's own; equal costs: the earlier cut; repeated rows give
repeated pieces, callers that need distinct ids deduplicate; extra columns are not carried.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

LIMIT, OVERLAP = 2048, 200

# Penalties of a cut, by what stands at it.
BEFORE_HEADING, AFTER_CODE, PARAGRAPH, LINE, SENTENCE, CODE_LINE, CLAUSE, BLANK, ANYWHERE = 0, 1, 1, 3, 4, 6, 9, 16, 64
AFTER_HEADING = 40
BALANCE, PER_PIECE = 8.0, 2.0
_STEP = 64

_HEADING = re.compile(r"^(?:\#{1,6}[ \t]+(?P<md>\S.*?)[ \t#]*|={1,6}[ \t]*(?P<wiki>[^=\s].*?)[ \t]*={1,6}[ \t]*|"
                      r"<h[1-6][^>]*>(?P<html>.*?)</h[1-6]>.*|\\(?:sub)*section\*?\{(?P<tex>[^}]*)\}.*)$", re.M)
_UNDERLINED = re.compile(r"^(?P<u>\S[^\n]{0,80})\n(?:={3,}|-{3,})[ \t]*$", re.M)
_TITLE = re.compile(r"(?:\A|(?<=\n\n))(?P<t>[A-Z][\w ]{1,40})(?=\n\n)")
_FENCE = re.compile(r"^(?:```|~~~).*$", re.M)
_MARKS = (
    (SENTENCE, re.compile(r"[.!?。！？][\"')\]]*(?:[ \t]+|(?<=[。！？]))")),
    (CLAUSE, re.compile(r"[,;:][ \t]+|[，；：、]")),
    (BLANK, re.compile(r"[ \t]+")),
)
_GLUE = re.compile("[̀-ͯ᪰-᫿⃐-⃿︀-️‍\U0001f3fb-\U0001f3ff]")


def headings_of(text: str) -> list[tuple[int, str]]:
    out = []
    for m in _HEADING.finditer(text):
        out.append((m.start(), next(g for g in m.groups() if g is not None).strip()))
    out += [(m.start(), m["u"].strip()) for m in _UNDERLINED.finditer(text)]
    out += [(m.start(), m["t"].strip()) for m in _TITLE.finditer(text)]
    return sorted(out)


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Sorted positions (a cut there ends a piece just before the position), penalties, headings."""
    n = len(text)
    cost = np.full(n + 1, 255, dtype=np.int64)

    def put(at: int, c: int) -> None:
        if 0 < at < n and c < cost[at]:
            cost[at] = c

    for c, pattern in _MARKS:
        for m in pattern.finditer(text):
            put(m.end(), c)
    for m in re.finditer(r"\r?\n(?P<more>(?:[ \t]*\r?\n)+)?", text):
        put(m.end(), PARAGRAPH if m["more"] else LINE)
    heads = headings_of(text)
    fences = [m.span() for m in _FENCE.finditer(text)]
    for a, b in zip(fences[::2], fences[1::2]):
        inside = cost[a[0] + 1 : b[1]]
        inside[inside < CODE_LINE] = CODE_LINE
        put(a[0], PARAGRAPH)
        put(min(n, b[1] + 1), AFTER_CODE)
    for at, _ in heads:
        put(at, BEFORE_HEADING)
        end = text.find("\n", at)
        if 0 <= end < n:
            k = end + 1
            while k < n and text[k] in "\r\n \t":
                k += 1
            near = cost[end : k + 1]
            near[near < AFTER_HEADING] = AFTER_HEADING
    for at, _ in heads:  # a heading directly after another stays a good place
        put(at, BEFORE_HEADING)
    at = np.flatnonzero(cost < 255)
    edges = np.r_[0, at, n]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > reach // 4:
            for k in range(a + _STEP, b, _STEP):
                while k < b and (_GLUE.match(text[k]) or text[k - 1] == "‍" or text[k - 1 : k + 1] == "\r\n"):
                    k += 1
                put(k, ANYWHERE)
    at = np.flatnonzero(cost < 255)
    return at, cost[at], heads


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """The ends of all pieces, the text's length last."""
    n = len(text)
    if n <= limit:
        return [n]
    stride = limit - overlap
    at, penalty, _ = boundaries(text, stride)
    at, penalty = np.r_[at, n], np.r_[penalty, 0].astype(float)
    usable = at > overlap
    at, penalty = at[usable], penalty[usable]
    pieces = int(np.ceil((n - overlap) / stride))
    mean = (n - overlap) / pieces
    total = np.full(len(at), np.inf)
    back = np.full(len(at), -1)
    first = at <= limit
    total[first] = penalty[first] + PER_PIECE + BALANCE * ((at[first] - overlap - mean) / mean) ** 2
    lows = np.searchsorted(at, at - stride).tolist()
    weight, aim, place = BALANCE / mean**2, (at - mean).tolist(), at.astype(float)
    buffer = np.empty(len(at))
    for i, (lo, c) in enumerate(zip(lows, (penalty + PER_PIECE).tolist())):
        if lo < i:
            cost = np.subtract(aim[i], place[lo:i], out=buffer[: i - lo])  # in place: the window is short, calls are what costs
            np.multiply(cost, cost, out=cost)
            np.multiply(cost, weight, out=cost)
            np.add(cost, total[lo:i], out=cost)
            k = int(cost.argmin())
            c += cost[k]
            if c < total[i]:
                total[i], back[i] = c, lo + k
    if not np.isfinite(total[-1]):  # one glued run longer than a window: cut it by length
        return list(range(limit, n, stride)) + [n]
    out, i = [], len(at) - 1
    while i >= 0:
        out.append(int(at[i]))
        i = back[i]
    return out[::-1]


def pieces_of(text: str, start_line: int = 1, heading: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP):
    """(start, end, first line, last line, heading) of each piece; start and end in characters from 0, end exclusive."""
    ends = cuts(text, limit, overlap)
    heads = headings_of(text)
    lines = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10)
    out, own = [], 0
    for i, end in enumerate(ends):
        start = 0 if i == 0 else ends[i - 1] - overlap
        a = start_line + int(np.searchsorted(lines, start))
        b = start_line + int(np.searchsorted(lines, max(start, end - 1)))
        h = heading
        for at, title in heads:
            if at > own:
                break
            h = title
        out.append((start, end, a, b, h))
        own = end
    return out


def split_oversized(
    df: DataFrame, *, id_col="id", content_col="content", line_col: str | None = None, heading_col: str | None = None,
    limit: int = LIMIT, overlap: int = OVERLAP,
) -> DataFrame:
    """(id, piece, pieces, start_char, end_char, start_line, end_line, heading, content) of each oversized row.

    The size filter runs before any text leaves the JVM; the rest is a narrow map.
    """
    if limit <= 2 * overlap:
        raise ValueError("the limit must exceed twice the overlap")
    line = F.col(line_col) if line_col else F.lit(1)
    heading = F.col(heading_col) if heading_col else F.lit(None)
    rows = df.select(
        df[id_col].cast("string").alias("id"), df[content_col].alias("content"),
        F.greatest(F.coalesce(line.cast("int"), F.lit(1)), F.lit(1)).alias("line"), heading.cast("string").alias("heading"),
    ).where(F.length("content") > limit)

    def run(frames):
        for f in frames:
            out = []
            for key, text, at, head in f.itertuples(index=False):
                found = pieces_of(text, int(at), head, limit, overlap)
                for i, (s, e, a, b, h) in enumerate(found):
                    out.append((key, i, len(found), s, e, a, b, h, text[s:e]))
            yield pd.DataFrame(out, columns=["id", "piece", "pieces", "start_char", "end_char", "start_line", "end_line",
                                             "heading", "content"])

    return spread(rows).mapInPandas(
        run, "id string, piece int, pieces int, start_char long, end_char long, start_line int, end_line int, "
             "heading string, content string")
