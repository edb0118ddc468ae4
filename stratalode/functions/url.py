"""URL scalars as Column expressions over one regular split of the string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?(#.*)?$"
# Addresses that must not be fetched (fixed values).
PRIVATE = (
    r"^10\.", r"^192\.168\.", r"^172\.(1[6-9]|2[0-9]|3[01])\.", r"^169\.254\.", r"^0\.", r"^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.",
    r"^192\.0\.0\.", r"^198\.1[89]\.",
)
INTERNAL = (r"\.local$", r"\.internal$", r"\.lan$", r"^metadata\.", r"^instance-data\.")
LOCAL = ("localhost", "127.0.0.1", "::1", "[::1]", "fd00:ec2::254", "[fd00:ec2::254]")


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _URL, i)


def host(url: Column) -> Column:
    return F.lower(part(url, 3))


def origin(url: Column) -> Column:
    scheme, port = F.lower(part(url, 1)), part(url, 4)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.concat(scheme, F.lit("://"), host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port)))


def normalise(url: Column) -> Column:
    """Without fragment, credentials and default port; lower-case host; no slash at the end of a path. Null for no URL."""
    path = part(url, 5)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    return F.when(url.rlike(_URL), F.concat(origin(url), path, part(url, 6)))


def is_safe(url: Column) -> Column:
    """http(s), without credentials, not a local, private, internal or metadata address."""
    # one pattern over the host: the expression is evaluated once, which also keeps the generated code small
    local = "|".join([*PRIVATE, *INTERNAL, *(f"^{x.replace('.', chr(92) + '.').replace('[', chr(92) + '[').replace(']', chr(92) + ']')}$" for x in LOCAL)])
    return url.rlike(r"(?i)^https?://[^/?#@]*(?:[:/?#]|$)") & ~url.rlike(r"^[^/?#]*//[^/?#]*@") & ~host(url).rlike(local)


def included(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Substrings of path and query: any of ``include`` (all, where it is empty) and none of ``exclude``."""
    p = F.concat(part(url, 5), part(url, 6))
    ok = F.lit(not include)
    for x in include:
        ok = ok | p.contains(x)
    for x in exclude:
        ok = ok & ~p.contains(x)
    return ok


def file_name(url: Column) -> Column:
    """A safe file name: at most 50 characters of the path, a hash of the query where there is one."""
    p = F.regexp_replace(F.regexp_replace(part(url, 5), "^/+|/+$", ""), "[^A-Za-z0-9._-]+", "_")
    p = F.when(p == "", "index").when(F.length(p) > 50, F.concat(F.substring(p, 1, 50), F.lit("_"), F.substring(F.sha2(url, 256), 1, 8))).otherwise(p)
    q = part(url, 6)
    return F.concat(p, F.when(q == "", "").otherwise(F.concat(F.lit("_"), F.substring(F.sha2(q, 256), 1, 8))), F.lit(".md"))


def content_gate(kind: Column) -> Column:
    """html, text, skip or other by content type."""
    low = F.lower(kind)
    skip = F.lit(False)
    for x in ("application/pdf", "application/octet-stream", "image/", "video/", "audio/", "application/zip", "application/gzip",
              "application/x-tar", "font/", "application/font"):
        skip = skip | low.contains(x)
    return F.when(low.contains("text/html") | low.contains("application/xhtml+xml"), "html").when(low.contains("text/plain"), "text").when(skip, "skip").otherwise("other")


def looks_like_app(html: Column) -> Column:
    """Whether a static page holds no content of its own (fixed values)."""
    low = F.lower(html)
    out = F.lit(False)
    for x in ('<div id="root"></div>', '<div id="app"></div>', '<div id="__nuxt">', "<app-root>", "<body></body>", "enable javascript",
              "javascript is required", "javascript must be enabled"):
        out = out | low.contains(x)
    return out


def paper_id(text: Column) -> Column:
    """arXiv id (new or old form) or DOI, prefixed by its kind; null where there is none."""
    new = F.regexp_extract(text, r"(?i)arxiv(?:\.org/(?:abs|pdf)/|[:\s]+)(\d{4}\.\d{4,5}(?:v\d+)?)", 1)
    old = F.regexp_extract(text, r"(?i)arxiv(?:\.org/(?:abs|pdf)/|[:\s]+)([a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)", 1)
    doi = F.regexp_extract(text, r"\b(10\.\d{4,9}/[^\s\"<>]+)", 1)
    return (
        F.when(new != "", F.concat(F.lit("arxiv:"), new)).when(old != "", F.concat(F.lit("arxiv:"), old))
        .when(doi != "", F.concat(F.lit("doi:"), F.regexp_replace(doi, r"[.,;)]+$", "")))
    )


def same_paper(a: Column, b: Column) -> Column:
    strip = lambda x: F.regexp_replace(F.lower(x), r"^(arxiv:.*?)v\d+$", "$1")
    return strip(a) == strip(b)
