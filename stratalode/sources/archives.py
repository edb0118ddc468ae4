"""Files inside files: archives of repositories, office documents, text of simple PDF files, result feeds of paper searches.

Each reader maps binary contents to rows in Arrow batches (a narrow map); a damaged file gives a row with its error, never a failure.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seams import register

MAX_MEMBER = 64 << 20


def archive_members(df: DataFrame, *, id_col: str = "path", content_col: str = "content", strip: int = 1, most: int = MAX_MEMBER) -> DataFrame:
    """(archive, path, bytes, text, error) of the files in zip archives; ``strip`` leading folders are left out, as hosts add one.

    Members beyond ``most`` bytes, binary ones and damaged ones have a null text and say why; paths that leave the archive are errors.
    """
    slim = df.select(df[id_col].cast("string").alias("archive"), df[content_col].alias("content")).where("content is not null")

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if info.is_dir():
                                continue
                            parts = info.filename.replace("\\", "/").split("/")[strip:]
                            path = "/".join(parts)
                            if not path or ".." in parts or info.filename.startswith("/"):
                                out.append((name, info.filename, info.file_size, None, "path"))
                            elif info.file_size > most:
                                out.append((name, path, info.file_size, None, "size"))
                            else:
                                try:
                                    data = z.read(info)
                                    out.append((name, path, len(data), data.decode("utf-8"), None))
                                except UnicodeDecodeError:
                                    out.append((name, path, info.file_size, None, "binary"))
                                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
                                    out.append((name, path, info.file_size, None, "damaged"))
                except zipfile.BadZipFile:
                    out.append((name, None, len(content), None, "no archive"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))],
                    names=["archive", "path", "bytes", "text", "error"])

    return slim.mapInArrow(run, "archive string, path string, bytes bigint, text string, error string")


def pack(df: DataFrame, *, group: str = "archive") -> DataFrame:
    """(archive, content): zip archives of rows (archive, path, text); a group is one archive, so groups must be of bounded size."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, text in sorted(zip(f["path"], f["text"])):
                z.writestr(zipfile.ZipInfo("root/" + path), text)
        return pd.DataFrame({"archive": [f[group].iloc[0]], "content": [out.getvalue()]})

    return df.groupBy(group).applyInPandas(run, "archive string, content binary")


def _words(xml: bytes, paragraph: str, run: str, breaks: tuple[str, ...] = ()) -> list[str]:
    """Texts of the paragraphs of an office part, by local names."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for p in ElementTree.fromstring(xml).iter():
        if local(p) == paragraph:
            text = "".join("\t" if local(e) == "tab" else "\n" if local(e) in breaks else e.text or "" if local(e) == run else "" for e in p.iter())
            out.append(text)
    return out


def office_text(content: bytes | None) -> str | None:
    """The text of a word-processor, slide or sheet file in the XML formats; null for anything else. Slides and sheets in their order."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            names = z.namelist()
            number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
            if "word/document.xml" in names:
                return "\n".join(_words(z.read("word/document.xml"), "p", "t", ("br",))).strip()
            slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
            if slides:
                return "\n\n".join("\n".join(x for x in _words(z.read(n), "p", "t", ("br",)) if x) for n in slides).strip()
            sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number)
            if sheets:
                shared = _words(z.read("xl/sharedStrings.xml"), "si", "t") if "xl/sharedStrings.xml" in names else []
                return "\n\n".join("\n".join(_rows(z.read(n), shared)) for n in sheets).strip()
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, zlib.error, IndexError, ValueError):
        pass
    return None


def _rows(xml: bytes, shared: list[str]) -> list[str]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for row in (e for e in ElementTree.fromstring(xml).iter() if local(e) == "row"):
        cells = []
        for c in (e for e in row if local(e) == "c"):
            v = next((e.text or "" for e in c if local(e) == "v"), "")
            inline = "".join(e.text or "" for e in c.iter() if local(e) == "t")
            cells.append(shared[int(v)] if c.get("t") == "s" and v else v or inline)
        out.append("\t".join(cells))
    return out


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ|(T\*|Td|TD|ET)", re.S)
_PART = re.compile(rb"\(((?:\\.|[^\\()])*)\)|(-?\d+(?:\.\d+)?)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _literal(raw: bytes) -> bytes:
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)


def pdf_text(content: bytes | None) -> str | None:
    """The text that the content streams of a PDF file show with simple fonts, one block per stream; null where there is none.

    Streams are plain or deflated; wide gaps inside an array are blanks. Scanned pages, encodings of composite fonts and encryption
    need a registered parser.
    """
    if not content or not content.startswith(b"%PDF"):
        return None
    pages = []
    for m in _STREAM.finditer(content):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        out = []
        for s in _SHOW.finditer(data):
            if s[3]:
                out.append(b"\n")
            elif s[2] is not None:
                for part, gap in _PART.findall(s[2]):
                    out.append(b" " if gap and float(gap) < -200 else _literal(part) if not gap else b"")
            else:
                out.append(_literal(s[1]))
        text = re.sub(r"\n{2,}", "\n", b"".join(out).decode("cp1252", "replace")).strip()
        if text:
            pages.append(text)
    return "\n\n".join(pages) or None


register("parser", "office", lambda contents: [office_text(c) for c in contents])
register("parser", "pdf", lambda contents: [pdf_text(c) for c in contents])


def parse(df: DataFrame, *, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, parser, text): each file by the parser that its ending asks for, several kinds in one pass; unknown endings are tried as text."""
    from .seams import provider

    slim = df.select(df[id_col].cast("string").alias("path"), df[content_col].alias("content"))
    kinds = {"docx": "office", "pptx": "office", "xlsx": "office", "pdf": "pdf"}
    readers = {k: provider("parser", k) for k in ("office", "pdf", "text")}

    def run(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            names = [kinds.get((p or "").rsplit(".", 1)[-1].lower(), "text") for p in paths]
            texts: list[str | None] = [None] * len(paths)
            contents = b.column(1).to_pylist()
            for kind in set(names):
                at = [i for i, n in enumerate(names) if n == kind]
                for i, t in zip(at, readers[kind]([contents[i] for i in at])):
                    texts[i] = t
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "parser", "text"])

    return slim.mapInArrow(run, "path string, parser string, text string")


def feed_entries(df: DataFrame, xml_col: str) -> DataFrame:
    """(paper, title, summary, published, authors, categories) of the entries of Atom result feeds; blanks inside texts are single."""
    one = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    entries = df.select(F.explode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    return entries.select(
        F.regexp_replace(F.regexp_replace(one("id"), r"^.*/abs/", ""), r"v\d+$", "").alias("paper"), one("title").alias("title"), one("summary").alias("summary"),
        F.try_to_timestamp(F.nullif(one("published"), F.lit(""))).alias("published"), F.regexp_extract_all("e", F.lit(r"(?s)<name>\s*(.*?)\s*</name>"), F.lit(1)).alias("authors"),
        F.regexp_extract_all("e", F.lit(r'<category[^>]*term="([^"]+)"'), F.lit(1)).alias("categories"))


def search_address(base: str, terms: str, *, categories: list[str] | None = None, since: str | None = None, until: str | None = None, start: int = 0, most: int = 10) -> str:
    """The address of a paper search: all terms, any of the categories, and a range of days (YYYYMMDD)."""
    from urllib.parse import urlencode

    parts = [f"all:{t}" for t in terms.split()]
    if categories:
        parts.append("(" + " OR ".join(f"cat:{c}" for c in categories) + ")")
    if since or until:
        parts.append(f"submittedDate:[{since or '19910101'}0000 TO {until or '99991231'}2359]")
    return f"{base}?{urlencode({'search_query': ' AND '.join(parts), 'start': start, 'max_results': most, 'sortBy': 'submittedDate', 'sortOrder': 'descending'})}"
