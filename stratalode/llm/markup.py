"""Markup residue (HTML, Markdown, wiki, LaTeX) in text: found, and turned into clean text that keeps its structure.

Pages of one host are merged into a site style tree. Each HTML fragment is parsed into a DOM; an element's place is its
path of tags, its presentation style the sequence of its children's tags, its content the words of its own text. Per
(host, path) the tree holds on how many pages an element occurs, with which styles and with which contents; the entropy of
both, relative to the greatest possible, is the node's importance: a branch that looks and reads the same on many pages is
boilerplate. Branches below ``threshold`` (with no important branch inside) are removed from each page before the rest is
turned into text. The statistics are counts with map-side combine over (host, path, value), so a host that holds a third of
all pages is as many rows as it has different values, and the join back is on (host, path, page).

Conventions of clean text: headings stand alone between blank lines; list items start with a bullet character; code blocks
are indented by four blanks; table rows are lines whose cells are separated by tabs; formulas keep their symbols in linear
form, without delimiters. Applied again, the text stays as it is.

Defined results: null contents stay null, without languages; blank stays blank; rows of source type ``code`` are passed
through, they have no residue; repeated rows of one id are cleaned each for itself; a null host is a host of its own;
empty tables give no rows; extra columns are not carried. Tags are those of the HTML standard: type parameters such as
``Map<string, number>`` are no tags; a lone dash-number-dash line is a page number.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

LANGUAGES = ("html", "markdown", "wiki", "latex")
THRESHOLD = 0.2
MIN_PAGES = 5
FEW = 10_000  # pages with their noise that are sent to every task

# Element names of the HTML standard that occur in running pages (fixed values).
_TAGS = (
    "a abbr address article aside audio b blockquote body br button canvas caption center cite code col colgroup dd del details "
    "dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input "
    "ins kbd label legend li link main map mark meta nav noscript object ol optgroup option p param picture pre q s samp script "
    "section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead "
    "time title tr tt u ul var video wbr"
).split()
_T = "|".join(sorted(_TAGS, key=len, reverse=True))
_TAG = re.compile(rf"</?(?:{_T})(?:\s+[^<>]*)?\s*/?>|<!DOCTYPE[^>]*>", re.I)
_CUT = re.compile(rf"<(?:{_T})(?:\s+[\w:-]+\s*=\s*(?:\"[^\">\n]*|'[^'>\n]*|[^\s\"'>]*)\"?'?)+\s*(?=$|\n)|</?(?:{_T})\s*\Z", re.I)
_CUT_HEAD = re.compile(r"\A[\w\"'= -]*[\"'] ?/?>|\A/?(?:%s)>" % _T, re.I)
_COMMENT = re.compile(r"<!--|-->")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,24});")

_MD = {
    "fence": re.compile(r"^[ \t]{0,8}(?:`{3,}|~{3,})[\w+-]*[ \t]*$", re.M),
    "atx": re.compile(r"^ {0,3}#{1,6}[ \t]+\S", re.M),
    "setext": re.compile(r"^(?![\s|=-]).*\S.*\n(?:={3,}|-{3,})[ \t]*$", re.M),
    "strong": re.compile(r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<![\w_])__(?=[^\s_])[^\n]+?(?<=[^\s_])__(?![\w_])"),
    "strike": re.compile(r"~~(?=\S)[^~\n]+?(?<=\S)~~"),
    "code": re.compile(r"(?<!`)`[^`\n]+`(?!`)"),
    "link": re.compile(r"!?\[[^\]\[\n]*\]\((?:[^()\s]|\([^()\s]*\))+(?:[ \t]+\"[^\"\n]*\")?\)"),
    "note": re.compile(r"\[\^[\w-]+\]"),
    "reference": re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+", re.M),
    "quote": re.compile(r"^ {0,3}>[ \t]?\S", re.M),
    "table": re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?$", re.M),
    "task": re.compile(r"^[ \t]*[*+-][ \t]+\[[ xX]\][ \t]", re.M),
    "em": re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])"),
}
_BULLET = re.compile(r"^[ \t]{0,8}[*+-][ \t]+(?=\S)(?!\d{1,5}[ \t]*-[ \t]*$)", re.M)

_WIKI = {
    "heading": re.compile(r"^(={1,6})[ \t]*[^=\s\n][^=\n]*?[ \t]*\1[ \t]*$", re.M),
    "quotes": re.compile(r"'{2,5}(?=[^\s'])[^'\n]+(?:'[^'\n]+){0,4}?'{2,5}"),
    "link": re.compile(r"\[\[[^\[\]\n]+\]\]"),
    "template": re.compile(r"(?<![\\{\w}])\{\{(?=[A-Za-z#])[^{}\\\n]+\}\}|(?<=\w)\{\{(?=[A-Za-z])[^{}|\\\n]+\|[^{}\\\n]+\}\}"),
    "table": re.compile(r"^\{\|.*$|^\|\}[ \t]*$|^\|-+[ \t]*$", re.M),
    "list": re.compile(r"^(?::+[*#;:]*|;+[*#;:]*|[*#]*[*#:;]*:[*#]+|\*{2,}(?![^\n]*\*[ \t]*$))[ \t]*(?=[^\s\W])", re.M),
    "external": re.compile(r"\[https?://[^\s\]]+[ \t]+[^\]\n]+\]"),
    "magic": re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__"),
}

# Commands that need no argument to be recognised (fixed values).
_BARE = (
    "item frac log leq geq le ge neq ne sum prod int alpha beta gamma delta epsilon lambda mu sigma theta pi phi psi omega cdot "
    "times infty partial nabla rightarrow leftarrow Rightarrow to in notin subset cup cap forall exists approx equiv sim sqrt "
    "left right quad qquad ldots cdots dots textbf textit emph maketitle tableofcontents centering noindent newpage clearpage "
    "hline toprule midrule bottomrule par bigskip medskip smallskip sin cos exp ln max min"
).split()
_B = "|".join(sorted(_BARE, key=len, reverse=True))
_TEX = {
    "command": re.compile(r"(?<![\w:\\])\\[a-zA-Z]{2,30}\*?(?:\[[^\]\n]{0,100}\])?\{|(?<=\w)\\(?:footnote|cite|ref|label|textbf|emph|url)\w*\{"),
    "bare": re.compile(rf"(?<![\w:\\])\\(?:{_B})(?![a-zA-Z])"),
    "display": re.compile(r"\$\$|(?<!\\)\\\[|(?<!\\)\\\]|(?<![\\\w])\\\(|(?<!\\)\\\)"),
    "inline": re.compile(r"(?<![\\$\w])\$(?![\s$])(?:(?=[^$\n]*[\\^_{}=+*/<>-])[^$\n]+|[A-Za-z])(?<!\s)\$(?![\d$])"),
}
_BS = "\\"


def constructs(text: str) -> dict[str, list[str]]:
    """Language -> kinds of constructs that the text holds."""
    out: dict[str, list[str]] = {}
    found = []
    if "<" in text or ">" in text or "&" in text:
        if _TAG.search(text):
            found.append("tag")
        elif "<" in text and _CUT.search(text) or ">" in text and _CUT_HEAD.search(text):
            found.append("cut tag")
        if "--" in text and _COMMENT.search(text):
            found.append("comment")
        if "&" in text and any(html.unescape(m[0]) != m[0] for m in _ENTITY.finditer(text)):
            found.append("entity")
        if found:
            out["html"] = found
    wiki = []
    if "=" in text and _WIKI["heading"].search(text):
        wiki.append("heading")
    if "''" in text and _WIKI["quotes"].search(text):
        wiki.append("quotes")
    if "[[" in text and _WIKI["link"].search(text):
        wiki.append("link")
    if "{{" in text and _WIKI["template"].search(text):
        wiki.append("template")
    if ("{|" in text or "|-" in text or "|}" in text) and "---" not in text and _WIKI["table"].search(text):
        wiki.append("table")
    if (":" in text or ";" in text or "**" in text) and _WIKI["list"].search(text):
        wiki.append("list")
    if "[http" in text and _WIKI["external"].search(text):
        wiki.append("external")
    if "__" in text and _WIKI["magic"].search(text):
        wiki.append("magic")
    md = []
    for kind, mark in (("fence", ("```", "~~~")), ("atx", ("#",)), ("setext", ("===", "---")), ("strong", ("**", "__")),
                       ("strike", ("~~",)), ("code", ("`",)), ("link", ("](",)), ("note", ("[^",)), ("reference", ("]: ",)),
                       ("quote", (">",)), ("table", ("---",)), ("task", ("] ",)), ("em", ("*",))):
        if any(k in text for k in mark) and _MD[kind].search(text):
            md.append(kind)
    if "setext" in md and "heading" in wiki and len(md) == 1 and not re.search(r"^[^=\n].*\n(?:={3,}|-{3,})[ \t]*$", text, re.M):
        md.remove("setext")
    if not wiki and not md and not out and _BULLET.search(text) and "- " + text[:1] != text[:3]:
        lines = [m for m in _BULLET.finditer(text)]
        if lines:
            md.append("list")
    if md:
        out["markdown"] = md
    if wiki:
        out["wiki"] = wiki
    if _BS in text or "$" in text:
        tex = [k for k, p in _TEX.items() if p.search(text)]
        if tex:
            out["latex"] = tex
    return out


# -- HTML: a forgiving DOM --------------------------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style template noscript svg iframe object canvas".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"},
           "dd": {"dt", "dd"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "children", "label")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children = tag, label, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "#root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag not in _KNOWN:
            self.handle_data(self.get_starttag_text() or "")
            return
        gone = _CLOSES.get(tag)
        if gone and self.stack[-1].tag in gone:
            self.stack.pop()
        a = dict(attrs)
        label = tag + (f"#{a['id']}" if a.get("id") else "") + (f".{a['class']}" if a.get("class") else "")
        node = Node(tag, label)
        self.stack[-1].children.append(node)
        if tag not in _VOID and len(self.stack) < 200:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _KNOWN and tag not in _VOID and len(self.stack) > 1:
            self.stack.pop()

    def handle_endtag(self, tag):
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t == tag or heading and len(t) == 2 and t[0] == "h" and t[1].isdigit():
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


_KNOWN = frozenset(_TAGS)
# a "<" that opens no known tag is text
_LOOSE = re.compile(rf"<(?!/?(?:{_T})\b|!--|!DOCTYPE)", re.I)


def parse(text: str) -> Node:
    b = _Builder()
    b.feed(_CUT.sub("", _LOOSE.sub("&lt;", text)))
    b.close()
    return b.root


def elements_of(text: str, found: dict[str, list[str]]):
    """(path, style, content) of every element of a page; the first part of a path is the element's language.

    HTML elements stand at their place in the DOM; constructs of the languages without a document tree stand below their language.
    """
    for language, kinds in found.items():
        if language == "html" and "tag" in kinds:
            for path, style, words, _ in walk(parse(text)):
                yield f"html{path}", style, words
        for kind in kinds:
            if kind != "tag":
                yield f"{language}/#{kind}", "", kind


def walk(root: Node):
    """(path, style, content, node) of each element; equal siblings share a path, as in a merged tree."""
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        for c in node.children:
            if not isinstance(c, str):
                p = f"{path}/{c.label}"
                style = ",".join(x.label for x in c.children if not isinstance(x, str))
                yield p, style, " ".join(c.text().split()), c
                stack.append((c, p))


_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figure footer form header html main nav "
                   "ol p section summary table tbody tfoot thead ul caption figcaption".split())


def render(node: Node, noise: frozenset[str], path: str = "", inside_pre: bool = False) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c if inside_pre else re.sub(r"\s+", " ", c) if node.tag not in ("#root",) else c)
            continue
        p = f"{path}/{c.label}"
        if c.tag in _SKIP or f"html{p}" in noise:
            continue
        if c.tag == "br":
            out.append("\n")
        elif c.tag == "hr":
            out.append("\n\n")
        elif c.tag == "img":
            continue
        elif len(c.tag) == 2 and c.tag[0] == "h" and c.tag[1].isdigit() or c.tag == "title":
            out.append("\n\n" + " ".join(render(c, noise, p).split()) + "\n\n")
        elif c.tag == "pre":
            body = render(c, noise, p, True).strip("\n")
            out.append("\n\n" + "\n".join("    " + line for line in body.split("\n")) + "\n\n")
        elif c.tag == "li":
            out.append("\n• " + render(c, noise, p).strip())
        elif c.tag == "tr":
            cells = [" ".join(render(x, noise, f"{p}/{x.label}").split()) for x in c.children if not isinstance(x, str)]
            out.append("\n" + "\t".join(cells) if cells else render(c, noise, p))
        elif c.tag in _BLOCK:
            out.append("\n\n" + render(c, noise, p) + "\n\n")
        else:
            out.append(render(c, noise, p, inside_pre))
    return "".join(out)


# -- other languages ----------------------------------------------------------------------------------------------------

_SYMBOLS = {"leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "sum": "∑", "prod": "∏", "int": "∫", "alpha": "α",
            "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "lambda": "λ", "mu": "μ", "sigma": "σ", "theta": "θ", "pi": "π",
            "phi": "φ", "psi": "ψ", "omega": "ω", "cdot": "·", "times": "×", "infty": "∞", "partial": "∂", "nabla": "∇",
            "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "to": "→", "in": "∈", "notin": "∉", "subset": "⊂", "cup": "∪",
            "cap": "∩", "forall": "∀", "exists": "∃", "approx": "≈", "equiv": "≡", "sim": "∼", "sqrt": "√", "ldots": "…", "cdots": "⋯",
            "dots": "…"}


def _tex(t: str) -> str:
    t = re.sub(r"^[ \t]*%.*\n?", "", t, flags=re.M)
    t = re.sub(r"\\(?:begin|end)\{(?:verbatim|lstlisting|minted)\}(?:\{\w+\})?", "\n```\n", t)
    t = re.sub(r"\\(?:sub)*(?:section|paragraph|chapter|part|title)\*?\{([^{}]*)\}", r"\n\n\1\n\n", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?(?:\{[lcr|@ {}]*\})?", "\n", t)
    t = re.sub(r"[~ ]?\\(?:label|index|vspace|hspace|usepackage|documentclass|bibliography\w*|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"~?\\(?:cite\w*|ref|eqref|autoref|pageref)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r" [\1]", t)
    t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
    t = re.sub(r"^[ \t]*\\item(?![a-zA-Z])(?:\[[^\]]*\])?[ \t]*", "• ", t, flags=re.M)
    t = re.sub(r"\\item(?![a-zA-Z])[ \t]*", "", t)
    for _ in range(4):
        new = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", t)
        new = re.sub(r"\\(?:text\w+|emph|mathrm|mathbf|mathcal|operatorname|underline|url|href|mbox|texttt)\*?\{([^{}]*)\}", r"\1", new)
        new = re.sub(r"([\^_])\{([^{}]*)\}", lambda m: m[1] + (m[2] if len(m[2]) == 1 else f"({m[2]})"), new)
        if new == t:
            break
        t = new
    t = re.sub(r"(?<![\w:\\])\\([a-zA-Z]{2,30})\*?(?:\[[^\]\n]{0,100}\])?\{([^{}\n]*)\}", r"\2", t)
    t = re.sub(rf"(?<![\w:\\])\\({_B})(?![a-zA-Z])[ ]?", lambda m: _SYMBOLS.get(m[1], m[1] if m[1] in ("log", "sin", "cos", "exp", "ln", "max", "min") else ""), t)
    t = re.sub(r"\$\$|(?<!\\)\\[\[\]]", "\n", t)
    t = re.sub(r"(?<!\\)\\[()]", "", t)
    return _TEX["inline"].sub(lambda m: m[0][1:-1], t)


def _wiki(t: str) -> str:
    t = re.sub(r"^\{\|.*$|^\|\}[ \t]*$|^\|-+.*$|^\|\+[ \t]*", "", t, flags=re.M)
    t = re.sub(r"^[|!][ \t]*(.*(?:\|\||!!).*)$", lambda m: "\t".join(x.strip() for x in re.split(r"\|\||!!", m[1])), t, flags=re.M)
    t = _WIKI["heading"].sub(lambda m: "\n\n" + m[0].strip().strip("=").strip() + "\n\n", t)
    t = re.sub(r"\[\[(?:File|Image|Category|Datei|Kategorie)?:?([^\[\]|\n]*)(?:\|([^\[\]\n]*))?\]\]", lambda m: m[2] or m[1], t)
    t = re.sub(r"\[https?://[^\s\]]+[ \t]+([^\]\n]+)\]", r"\1", t)

    def template(m: re.Match) -> str:
        parts = [p.strip() for p in m[0][2:-2].split("|")]
        named = [p for p in parts[1:] if "=" in p]
        if named:
            return "\n" + "\n".join("\t".join(x.strip() for x in p.split("=", 1)) for p in named) + "\n"
        return " ".join(parts[1:])

    t = _WIKI["template"].sub(template, t)
    t = _WIKI["quotes"].sub(lambda m: m[0].strip("'"), t)
    t = re.sub(r"^;+[ \t]*(.*)$", r"\1", t, flags=re.M)
    t = re.sub(r"^(?:[*#:;]*[*#][*#:;]*|:+)[ \t]*(?=\w)", lambda m: "• " if "*" in m[0] or "#" in m[0] else "    ", t, flags=re.M)
    return _WIKI["magic"].sub("", t)


def _markdown(t: str) -> str:
    lines, out, fenced = t.split("\n"), [], False
    i = 0
    while i < len(lines):
        line = lines[i]
        if _MD["fence"].match(line):
            fenced = not fenced
            out.append("")
        elif fenced:
            out.append("    " + line)
        elif i + 1 < len(lines) and line.strip() and re.fullmatch(r"(?:={3,}|-{3,})[ \t]*", lines[i + 1]) and "|" not in line:
            out += ["", line.strip(), ""]
            i += 1
        elif m := re.match(r" {0,3}#{1,6}[ \t]+(.*?)[ \t#]*$", line):
            out += ["", m[1], ""]
        elif _MD["table"].match(line):
            pass
        elif line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1:
            out.append("\t".join(c.strip() for c in line.strip()[1:-1].split("|")))
        else:
            line = re.sub(r"^ {0,3}(?:>[ \t]?)+(?=\S)", "", line)
            if not re.fullmatch(r"[ \t]*-[ \t]*\d{1,5}[ \t]*-[ \t]*", line):
                line = re.sub(r"^([ \t]{0,8})[*+-][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", r"\1• ", line)
            out.append(line)
        i += 1
    t = "\n".join(out)
    t = _MD["link"].sub(lambda m: m[0].lstrip("!")[1:].split("](")[0], t)
    t = re.sub(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+.*\n?", "", t, flags=re.M)
    t = _MD["note"].sub("", t)
    for k, n in (("strong", 2), ("strike", 2), ("code", 1), ("em", 1)):
        t = _MD[k].sub(lambda m, n=n: m[0][n:-n], t)
    return t


def clean(text: str, languages, noise: frozenset[str] = frozenset()) -> str:
    t = text
    if "html" in languages:
        t = re.sub(r"<!--.*?(?:-->|\Z)|-->", "", t, flags=re.S)
        t = _CUT_HEAD.sub("", t)
        t = render(parse(t), noise) if "<" in t else html.unescape(t)
        t = t.replace("\xa0", " ")
    if "latex" in languages:
        t = _tex(t)
    if "wiki" in languages:
        t = _wiki(t)
    if "markdown" in languages or "latex" in languages and "```" in t:
        t = _markdown(t)
    t = re.sub(r"[ \t]+$", "", t, flags=re.M)
    t = re.sub(r"(?<=\S) {2,}(?=\S)", " ", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip("\n")


# -- plan ---------------------------------------------------------------------------------------------------------------


def _entropy(count: Column, total: Column) -> Column:
    p = count / total
    return -F.sum(p * F.log(p))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) from (host, page, path, style, content)."""
    once = pages.groupBy("host", "path", "style", "content").agg(F.count("*").alias("n"))  # map-side combine
    per_style = once.groupBy("host", "path", "style").agg(F.sum("n").alias("n"))
    per_content = once.groupBy("host", "path", "content").agg(F.sum("n").alias("n"))
    total = once.groupBy("host", "path").agg(F.sum("n").alias("pages"))

    def importance(values: DataFrame, name: str) -> DataFrame:
        h = values.join(total, ["host", "path"]).groupBy("host", "path", "pages").agg(_entropy(F.col("n"), F.col("pages")).alias("h"))
        return h.select("host", "path", "pages", F.when(F.col("pages") > 1, F.col("h") / F.log("pages")).otherwise(1.0).alias(name))

    both = importance(per_style, "of_style").join(importance(per_content, "of_content"), ["host", "path", "pages"])
    return both.select("host", "path", "pages", F.greatest("of_style", "of_content").alias("importance"))


def clean_markup(
    df: DataFrame, *, id_col="id", content: Column | None = None, heading: Column | None = None, host: Column | None = None,
    is_code: Column | None = None, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(id, languages, heading, text): the clean text and the languages of which residue was found."""
    content = F.col("content") if content is None else content
    rows = df.select(
        df[id_col].cast("string").alias("id"), content.cast("string").alias("content"),
        (F.lit(None) if heading is None else heading).cast("string").alias("heading"),
        F.coalesce((F.lit(None) if host is None else host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.lit(False) if is_code is None else is_code, F.lit(False)).alias("is_code"),
    )

    def elements(batches):
        for b in batches:
            hosts, pages, paths, styles, contents = [], [], [], [], []
            sign = lambda s: xxhash.xxh64_intdigest(s) - (1 << 63)
            for page, text, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                for path, style, words in elements_of(text, constructs(text)):
                    hosts.append(h)
                    pages.append(page)
                    paths.append(path)
                    styles.append(sign(style))
                    contents.append(sign(words))
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in (hosts, pages, paths)], *[pa.array(x, pa.int64()) for x in (styles, contents)]],
                                             names=["host", "page", "path", "style", "content"])

    # only elements of a document tree can be branches of a site; whole contents and styles, by their hashes
    tagged = rows.where(~F.col("is_code") & F.col("content").contains("<") & F.col("content").contains(">"))
    compact = tagged.select("id", "content", "host").mapInArrow(elements, "host string, page string, path string, style bigint, content bigint")
    compact = checkpoint(compact)  # read by the counts, by the branches to keep and by the pages that hold noise
    tree = style_tree(compact)
    low = tree.where((F.col("pages") >= min_pages) & (F.col("importance") < threshold)).select("host", "path")
    high = tree.where((F.col("pages") < min_pages) | (F.col("importance") >= threshold)).select("host", F.col("path").alias("inner"))
    # a branch with an important element inside stays: its ancestors are taken out of the list
    keep = high.select("host", F.explode(F.expr(
        "transform(sequence(1, size(split(inner, '/'))), i -> array_join(slice(split(inner, '/'), 1, i), '/'))")).alias("path")).distinct()
    noise = low.where(F.startswith("path", F.lit("html/")) & ~F.contains("path", F.lit("/#"))).join(keep, ["host", "path"], "left_anti")
    per_page = (
        compact.select("host", "page", "path").distinct().join(noise, ["host", "path"])
        .groupBy(F.col("page").alias("id")).agg(F.collect_set("path").alias("noise"))
    )
    per_page = checkpoint(per_page)
    # the pages with noise: where they are few they go to the texts, else both meet by id
    few = per_page.limit(FEW + 1).count() <= FEW
    wide = rows.join(F.broadcast(per_page) if few else per_page, "id", "left")

    def finish(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                langs, heads, texts = [], [], []
                cols = {n: b.column(n).to_pylist() for n in ("content", "heading", "is_code", "noise")}
                for text, head, code, noisy in zip(cols["content"], cols["heading"], cols["is_code"], cols["noise"]):
                    found: list[str] = []
                    if not code:
                        in_text = constructs(text) if text else {}
                        in_head = constructs(head) if head else {}
                        if in_text:
                            text = clean(text, in_text, frozenset(noisy or ()))
                        if in_head:
                            head = clean(head, in_head).strip()
                        found = [k for k in LANGUAGES if k in in_text or k in in_head]
                    langs.append(found)
                    heads.append(head)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(langs, pa.list_(pa.string())), pa.array(heads, pa.string()), pa.array(texts, pa.string())],
                    names=["id", "languages", "heading", "text"])

    return wide.mapInArrow(finish, "id string, languages array<string>, heading string, text string")
