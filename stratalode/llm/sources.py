"""Source files that nobody wrote by hand for their repository: generated, minified, vendored, data stored as code.

A character n-gram model of identifiers is trained per language on all files of ordinary layout (counts are combined inside each
map task; the table is bounded by the alphabet, not by the rows). Per file then: the cross-entropy of its identifiers under its
language's model, against the cross-entropy of the language's own names, decides whether names are mangled: they tell far less
by the name than written ones do, or far more by the character; mangled names in dense lines are a minified file. The diversity
of its line templates (lines with words and numbers masked) shows text written by a template; a foreign style shows a copy: attribution lines, the place in
the tree, an identifier style that the repository does not use, and above all lines that are also in files of other
repositories that carry such evidence. Lines are compared by hash, counted with map-side combine, so a repository or a
licence text that holds a third of all rows is one counter.

Defined results: of several rows of a path the one with the latest ``updated_at`` (ties: greatest sha256) is judged; null
paths, null and empty texts give no kinds; kinds other than ``code`` (case and blanks aside) take no part; byte order marks
and CR are ignored; unknown file types use the model of all languages; an empty table gives no rows; other columns are not
carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

KINDS = ("generated", "minified", "data", "vendored")

POOR, RICH = 0.72, 1.25  # of the language's bits per name, and per character, from which names count as mangled
MIN_NAMES = 20
ORDINARY = 100  # characters of a mean line of files that teach the model
DENSE_LINES, DENSE_BLANKS = 100, 0.1
TEMPLATE = 0.45  # share of the commonest line template
TEMPLATE_WITH_BANNER = 0.3
MIN_LINES = 6
MIN_TEMPLATE = 5
DIGITS, LETTERS = 0.15, 0.35
BLOB = 0.3
SHARED = 0.6
MIN_REPOS = 3
ORDER = 3

_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_SAFE = re.compile(r"[^a-z0-9_$]")
_BLOB_LINE = re.compile(r"[A-Za-z0-9+/=_-]{48,}")
_NUMBERS = re.compile(r"0x[0-9a-fA-F]+|#[0-9a-fA-F]{3,8}\b|\d+(?:\.\d+)?")
_LETTERS = re.compile(r"[A-Za-z_$][\w$]*")

_HUMP = re.compile(r"[a-z][A-Z]")

_BANNER = re.compile(
    r"code generated by|@generated|auto-?generated|automatisch erzeugt|do not (?:edit|modify)|produced automatically|"
    r"generated from \w+|machine-written|emitted by \w+|generated by \w+", re.I)
_ATTRIBUTION = re.compile(
    r"\bimported copy\b|\bsee upstream\b|\btaken from the \S+ project\b|\borigin: \S+ (?:release|version)\b|"
    r"\(c\) (?:the )?\S+ authors\b|^\s*/\*! \S+ v?\d+\.\d+|\bvendored from\b|\bcopied from https?:", re.I)
# Folder names of package managers and of the customary places for third-party code (fixed values).
_FOREIGN_DIRS = frozenset(
    "vendor third_party third-party thirdparty 3rdparty node_modules bower_components Godeps externals external extern deps contrib ext Pods"
    .split())


def language(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return {"ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "h": "c", "cc": "c", "cpp": "c", "hpp": "c"}.get(ext, ext)


def names_of(text: str) -> list[str]:
    return _NAME.findall(text)


class NameModel:
    """Interpolated character n-grams of identifiers per language; bits per character."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.grams: dict[str, dict[str, int]] = {}
        self.contexts: dict[str, dict[str, int]] = {}
        for (lang, g), n in counts.items():
            for name in (lang, ""):
                t = self.grams.setdefault(name, {})
                t[g] = t.get(g, 0) + n
                c = self.contexts.setdefault(name, {})
                c[g[:-1]] = c.get(g[:-1], 0) + n
        # what names of the language tell on average: the model's cross-entropy on the names that it was trained on
        self.reference: dict[str, tuple[float, float]] = {}
        for lang, grams in self.grams.items():
            contexts = self.contexts[lang]
            total = sum(n * self._cost(n, contexts[g[:-1]]) for g, n in grams.items())
            names, chars = sum(n for g, n in grams.items() if g[-1] == "."), sum(grams.values())
            self.reference[lang] = total / max(1, names), total / max(1, chars)
        self.memo: dict[tuple[str, str], tuple[float, int]] = {}

    @staticmethod
    def _cost(n: int, context: int) -> float:
        return -math.log2((n + 0.5) / (context + 20.0))

    def mangled(self, names: Counter, lang: str) -> bool:
        """Whether a file's identifiers are far from what those of its language tell."""
        lang = lang if lang in self.grams else ""
        total = chars = 0.0
        for x, k in names.items():
            b, n = self.bits(x, lang)
            total += b * k
            chars += n * k
        per_name, per_char = self.reference.get(lang, (0.0, 0.0))
        return total / max(1, names.total()) <= POOR * per_name or total / max(1.0, chars) >= RICH * per_char > 0

    def bits(self, name: str, lang: str) -> tuple[float, int]:
        """(total bits, characters) of an identifier."""
        lang = lang if lang in self.grams else ""
        key = (lang, name)
        if key in self.memo:
            return self.memo[key]
        if len(self.memo) > 300_000:
            self.memo.clear()
        grams, contexts = self.grams.get(lang, {}), self.contexts.get(lang, {})
        total, n = 0.0, 0
        for g in trigrams(name):
            total += self._cost(grams.get(g, 0), contexts.get(g[:-1], 0))
            n += 1
        self.memo[key] = (total, n)
        return total, n


def trigrams(name: str) -> list[str]:
    s = "^^" + _SAFE.sub("_", name.lower()) + "."
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]


def mask(text: str) -> str:
    return _LETTERS.sub("w", _NUMBERS.sub("9", text))


_FEW = np.zeros((256, 3))  # digits, letters, blanks of ASCII
for _c in range(128):
    _FEW[_c] = chr(_c).isdigit(), chr(_c).isalpha(), chr(_c).isspace()
_WIDE = re.compile(r"[^\x00-\x7f]")


def shares(text: str) -> np.ndarray:
    """Shares of digits, letters and blanks."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256) @ _FEW
    if not text.isascii():
        for c, k in Counter(_WIDE.findall(text)).items():
            counts += k * np.array([c.isdigit(), c.isalpha(), c.isspace()])
    return counts / max(1, len(text))


def line_hashes(text: str) -> list[int]:
    """Hashes of the lines that are long enough to tell one file from another, comment signs aside."""
    out = set()
    for line in text.split("\n"):
        s = line.strip(" \t/#*\"'-;")
        if len(s) >= 50 and s.count(" ") >= 3:
            out.add(xxhash.xxh64_intdigest(s) - (1 << 63))
    return sorted(out)


_COMMENT_LINE = re.compile(r"\s*(?:#|//|/\*|\*|--|<!--|\"{3}|'{3}|;|%)")


# Languages whose words are those of a standard, so that minifiers leave them as they are (fixed values).
_GIVEN_NAMES = frozenset("css scss less html xml svg".split())
_QUOTES = ('"' * 3, "'" * 3)


def leading_comment(lines: list[str]) -> str:
    """The comment block at the top, whatever its length, and at least the first six lines."""
    k = 0
    inside = False
    while k < len(lines) and (inside or _COMMENT_LINE.match(lines[k])):
        s = lines[k].strip()
        if not inside and s.startswith(("/*", "<!--")) or not inside and s[:3] in _QUOTES and s.count(s[:3]) == 1:
            inside = True
        elif inside and (s.endswith(_QUOTES) or "*/" in s or "-->" in s):
            inside = False
        if inside and ("*/" in s or "-->" in s):
            inside = False
        k += 1
    return "\n".join(lines[: max(6, k)])


def judge(text: str, path: str, model: NameModel, names: Counter | None = None) -> tuple[list[str], bool]:
    """(kinds that the file shows by itself, whether it carries evidence of foreign origin)."""
    t = text.lstrip("﻿").replace("\r", "")
    lines = [x for x in t.split("\n") if x.strip()]
    if not lines:
        return [], False
    names = Counter(names_of(text)) if names is None else names
    kinds = set()
    head = leading_comment(lines)
    lang = language(path)
    n = len(t)
    digits, letters, blanks = shares(t)
    blob = sum(len(m[0]) for m in _BLOB_LINE.finditer(t)) / n
    templates = Counter(x.strip() for x in mask("\n".join(lines)).split("\n"))
    body = len(lines)
    commonest, times = templates.most_common(1)[0]
    # a few imports or returns in a short file are no template
    top = times / body if times >= MIN_TEMPLATE and (len(commonest) > 4 or times >= 4 * MIN_TEMPLATE) else 0.0
    if blob >= BLOB:
        kinds.add("data")
    elif names.total() >= MIN_NAMES and (blanks < DENSE_BLANKS or n / body > DENSE_LINES) and (lang in _GIVEN_NAMES or model.mangled(names, lang)):
        kinds.add("minified")
    if body >= MIN_LINES and "data" not in kinds:
        if top >= TEMPLATE or top >= TEMPLATE_WITH_BANNER and _BANNER.search(head):
            kinds.add("data" if digits >= DIGITS or letters < LETTERS else "generated")
    if (digits >= DIGITS or letters < LETTERS) and n >= 200 and not kinds:
        kinds.add("data")
    folders = path.split("/")[:-1]
    foreign = bool(_ATTRIBUTION.search(head)) or any(x in _FOREIGN_DIRS for x in folders)
    if foreign:
        kinds.add("vendored")
    return sorted(kinds), foreign


def _count_names(batches):
    for b in batches:
        names: dict[str, Counter] = {}
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if len(text) <= ORDINARY * (1 + text.count("\n")):  # dense files teach nothing about how names are written
                names.setdefault(language(path), Counter()).update(names_of(text))
        counts: Counter = Counter()
        for lang, seen in names.items():
            for name, k in seen.items():
                for g in trigrams(name):
                    counts[lang, g] += k
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])


def train(code: DataFrame, max_languages: int = 64) -> NameModel:
    """From (path, text). The table has at most 38^3 grams for each of the commonest ``max_languages`` file types."""
    grams = code.select("path", "text").mapInArrow(_count_names, "lang string, gram string, n bigint")
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = checkpoint(table)
    known = [r["lang"] for r in table.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()]
    rows = (
        table.withColumn("lang", F.when(F.col("lang").isin(known), F.col("lang")).otherwise(""))
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    )
    return NameModel({(r["lang"], r["gram"]): r["n"] for r in rows})


def style_of(names: Counter) -> str:
    """The commonest way in which names of several words are written: snake, camel, pascal or none."""
    c: Counter = Counter()
    for x, k in names.items():
        if "_" in x.strip("_") or not x.islower() and _HUMP.search(x):
            c["snake" if "_" in x.strip("_") else "pascal" if x[:1].isupper() else "camel"] += k
    return c.most_common(1)[0][0] if c else "none"


def unwritten(files: DataFrame) -> DataFrame:
    """(path, kinds) of every present code file; kinds is empty for hand-written source."""
    is_code = F.coalesce(F.lower(F.trim("kind")) == "code", F.lit(False))
    # the present row of every path before anything reads its text; copies and versions meet in the map tasks first
    row = F.struct("updated_at", "sha256", is_code.alias("is_code"), "repo", F.when(is_code, F.col("text")).alias("text"))
    newest = files.where("path is not null").groupBy("path").agg(F.max(row).alias("r")).where("r.is_code and length(r.text) > 0")
    code = checkpoint(newest.select("path", "r.repo", "r.text"))  # read by the training and by the verdicts
    model = train(code)
    shared = files.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for b in batches:
            kinds, foreign, lines, styles = [], [], [], []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                names = Counter(names_of(text))
                k, f = judge(text, path, shared.value, names)
                kinds.append(k)
                foreign.append(f)
                lines.append(line_hashes(text))
                styles.append(f"{language(path)}:{style_of(names)}")
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), b.column("repo"), pa.array(kinds, pa.list_(pa.string())), pa.array(foreign), pa.array(lines, pa.list_(pa.int64())), pa.array(styles, pa.string())],
                names=["path", "repo", "kinds", "is_foreign", "lines", "style"])

    present = checkpoint(code.mapInArrow(features, "path string, repo string, kinds array<string>, is_foreign boolean, lines array<bigint>, style string"))
    lines = present.select("path", "repo", "is_foreign", F.explode("lines").alias("line"))
    # exact: the limits are small numbers; both steps combine in each task first
    by_repo = lines.groupBy("line", F.coalesce("repo", F.lit("")).alias("repo")).agg(F.max("is_foreign").alias("is_foreign"))
    stats = by_repo.groupBy("line").agg(F.max("is_foreign").alias("any_foreign"), F.count("*").alias("repos"))
    # lines of one file only tell nothing and do not come back
    stats = stats.where((F.col("repos") > 1) | F.col("any_foreign"))
    held = lines.select("path", "line").join(stats, "line").groupBy("path").agg(
        F.sum(F.when((F.col("repos") > 1) & F.col("any_foreign"), 1).otherwise(0)).alias("with_foreign"),
        F.sum(F.when(F.col("repos") >= MIN_REPOS, 1).otherwise(0)).alias("with_many"))
    # the repository's own style per language, to weigh copies that no other repository shows
    styles = present.where(~F.endswith(F.col("style"), F.lit(":none"))).groupBy("repo", "style").agg(F.count("*").alias("n"))
    styles = styles.withColumn("lang", F.substring_index("style", ":", 1))
    of_lang = styles.groupBy("repo", "lang").agg(F.sum("n").alias("of_lang"))
    rare = styles.join(of_lang, ["repo", "lang"]).where("of_lang >= 20 and n < 0.05 * of_lang").select("repo", "style", F.lit(True).alias("odd_style"))
    total = F.size("lines")
    share = F.greatest(F.coalesce("with_foreign", F.lit(0)), F.coalesce("with_many", F.lit(0))) / F.greatest(total, F.lit(1))
    needed = F.when(F.col("odd_style"), SHARED / 2).otherwise(SHARED)
    copied = (total >= 2) & (share >= needed)
    return present.join(held, "path", "left").join(rare, ["repo", "style"], "left").select(
        "path",
        F.array_sort(F.array_distinct(F.when(copied, F.concat("kinds", F.array(F.lit("vendored")))).otherwise(F.col("kinds")))).alias("kinds"),
    )
