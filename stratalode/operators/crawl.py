"""Crawling as relations: breadth-first over stored pages, explicit lists, sitemaps with their indexes, conditional fetches.

Nothing here opens a connection: pages, sitemaps and answers are tables that a fetcher (a registered provider) fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..session import checkpoint

MAX_DEPTH, MAX_PAGES, MAX_SITEMAPS = 3, 100, 10
QUICK_SAMPLE, QUICK_SAMPLE_LARGE, LARGE = 3, 5, 50


def allowed(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a page may be taken: a safe address, one of ``include`` (if any), none of ``exclude``; patterns are regular expressions."""
    ok = U.is_safe(url)
    if include:
        ok = ok & url.rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        ok = ok & ~url.rlike("|".join(f"(?:{p})" for p in exclude))
    return F.coalesce(ok, F.lit(False))


def robots_rules(df: DataFrame, origin_col: str, text: Column, agent: str = "*") -> DataFrame:
    """(origin, prefix): the disallowed path prefixes for an agent; groups of other agents do not count, an empty rule allows all."""
    lines = df.select(F.col(origin_col).alias("origin"), F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), r"\s*#.*$", ""))
    w = Window.partitionBy("origin").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("origin", "n", key.alias("k"), value.alias("v"))
    rows = rows.withColumn("agent", F.last(F.when(F.col("k") == "user-agent", F.col("v")), True).over(w))
    return rows.where((F.col("k") == "disallow") & (F.col("v") != "") & (F.lower("agent") == agent.lower())).select("origin", F.col("v").alias("prefix")).distinct()


def breadth_first(
    pages: DataFrame, starts: DataFrame, *, max_depth: int = MAX_DEPTH, max_pages: int | None = MAX_PAGES, include: list[str] | None = None,
    exclude: list[str] | None = None, robots: DataFrame | None = None,
) -> DataFrame:
    """(url, depth): stored pages (url, links) that are reached from the starts (url) within ``max_depth`` links, nearest first.

    One level is one equi-join of the frontier with the pages and one anti-join with what was seen, checkpointed; the loop ends with
    an empty frontier. ``robots`` gives (origin, prefix). The page cap is the operator's feature: the nearest pages, ties by address.
    """
    known = pages.select("url", "links").where("url is not null")

    def fit(urls: DataFrame) -> DataFrame:
        urls = urls.where(allowed(F.col("url"), include, exclude))
        if robots is None:
            return urls
        origin = U.origin(F.col("url"))
        barred = urls.withColumn("origin", origin).join(robots, "origin").where(F.startswith(F.expr("substring(url, length(origin) + 1)"), F.col("prefix"))).select("url")
        return urls.join(barred, "url", "left_anti")

    frontier = checkpoint(fit(starts.select("url").distinct()).join(known.select("url"), "url", "left_semi").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        links = known.join(frontier.select("url"), "url", "left_semi").select(F.explode("links").alias("url")).where("url is not null").distinct()
        fresh = fit(links).join(known.select("url"), "url", "left_semi").join(seen.select("url"), "url", "left_anti").distinct()
        frontier = checkpoint(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def only(pages: DataFrame, urls: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The stored pages of an explicit list (url), compared in normal form, each once."""
    wanted = urls.select(U.normalise(F.col("url")).alias("_u")).where(allowed(F.col("_u"), include, exclude)).distinct()
    return pages.withColumn("_u", U.normalise(F.col("url"))).join(wanted, "_u", "left_semi").drop("_u")


def sitemap_urls(files: DataFrame, root: str, *, most: int = MAX_SITEMAPS) -> DataFrame:
    """(url, lastmod) below a sitemap file ``root`` of stored files (url, xml): indexes are followed, at most ``most`` files in the
    order in which they are named, each once; entries of other origins leave; an invalid time is null; of several rows of one page the
    latest time counts.
    """
    loc = lambda kind: F.regexp_extract_all("xml", F.lit(rf"(?s)<{kind}>\s*(.*?)\s*</{kind}>"), F.lit(1))
    queue, order, read = [root], [], set()
    while queue and len(order) < most:  # bounded by ``most`` lookups
        url = queue.pop(0)
        if url in read:
            continue
        read.add(url)
        row = files.where(F.col("url") == url).select(F.transform(loc("sitemap"), lambda x: F.trim(F.regexp_extract(x, r"(?s)<loc>\s*(.*?)\s*</loc>", 1))).alias("subs")).first()
        if row is None:
            continue
        order.append(url)
        queue += [u for u in row["subs"] or [] if u]
    entries = files.where(F.col("url").isin(order)).select(F.explode(loc("url")).alias("e"))
    at = lambda tag: F.trim(F.regexp_extract("e", rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1))
    rows = entries.select(at("loc").alias("url"), F.try_to_timestamp(F.nullif(at("lastmod"), F.lit(""))).alias("lastmod")).where("url <> ''")
    return rows.where(U.origin(F.col("url")) == U.origin(F.lit(root))).groupBy("url").agg(F.max("lastmod").alias("lastmod"))


def conditional(state: DataFrame, answers: DataFrame) -> DataFrame:
    """(url, outcome) of a round of conditional requests.

    ``state`` gives (url, etag, modified, hash) of the stored pages, ``answers`` (url, method, status, etag, modified, hash). 304 is
    unchanged; 405 or 501 to HEAD asks again with GET; 404 and 410 are gone; other errors are failed; of a success an equal tag, else
    an equal time, else an equal hash is unchanged, and anything else changed. Pages that were never stored are new.
    """
    a, s = answers.alias("a"), state.alias("s")
    both = a.join(s, F.col("a.url") == F.col("s.url"), "left")
    same = F.coalesce(F.col("a.etag") == F.col("s.etag"), F.col("a.modified") == F.col("s.modified"), F.col("a.hash") == F.col("s.hash"), F.lit(False))
    status = F.col("a.status")
    outcome = (
        F.when((F.col("a.method") == "HEAD") & status.isin(405, 501), "ask again").when(status == 304, "unchanged").when(status.isin(404, 410), "gone")
        .when(status.isNull() | (status < 200) | (status >= 300), "failed").when(F.col("s.url").isNull(), "new").when(same, "unchanged").otherwise("changed")
    )
    return both.select(F.col("a.url").alias("url"), outcome.alias("outcome"))


def quick_sample(state: DataFrame) -> DataFrame:
    """The pages that a quick check asks about: the first three by depth and address, five of a large site."""
    n = QUICK_SAMPLE_LARGE if state.limit(LARGE + 1).count() > LARGE else QUICK_SAMPLE
    return state.orderBy("depth", "url").limit(n)


def quick_changed(sample: DataFrame, now: DataFrame) -> bool:
    """Whether any page of the sample (url, hash) is gone or has another hash now."""
    return not sample.join(now.select("url", "hash"), ["url", "hash"], "left_anti").isEmpty()


def changed_in_sitemap(sitemap: DataFrame, state: DataFrame) -> DataFrame:
    """The entries (url, lastmod) to fetch again: never fetched, without a time, or changed since (url, fetched_at)."""
    seen = state.groupBy("url").agg(F.max("fetched_at").alias("fetched_at"))
    rows = sitemap.join(seen, "url", "left")
    return rows.where(F.col("fetched_at").isNull() | F.col("lastmod").isNull() | (F.col("lastmod") > F.col("fetched_at"))).select("url", "lastmod")


def full_due(sites: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(site, due): whether a full crawl is due, from (site, full_at): never crawled or ``days`` or more days ago."""
    last = sites.groupBy("site").agg(F.max("full_at").alias("full_at"))
    return last.select("site", (F.col("full_at").isNull() | (F.col("full_at") <= as_of - F.expr(f"interval {days} days"))).alias("due"))


def best_pages(readings: DataFrame) -> DataFrame:
    """(page, reader, text, points): of several readings (page, reader, text) of a page the best one; ties: the smaller reader.

    Points: length (a hundredth, at most 50), table lines (at most 20), headings (two each, at most 10), less 100 for text of the
    instruction, 15 for signs of misreading, 20 below fifty characters. Null texts never win over others.
    """
    t = F.col("text")
    points = (
        F.least(F.length(t) / 100.0, F.lit(50.0)) + F.least(F.regexp_count(t, F.lit(r"\|.*\|")), F.lit(20)) + F.least(F.regexp_count(t, F.lit(r"(?m)^#{1,3}[ \t]+\S.*$")) * 2, F.lit(10))
        - F.when(t.rlike(LEAKED), 100).otherwise(0) - F.when(t.rlike(MISREAD), 15).otherwise(0) - F.when(F.length(t) < 50, 20).otherwise(0)
    )
    best = F.struct(F.when(t.isNull(), -1e9).otherwise(points.cast("double")).alias("points"), "reader", "text")
    rows = readings.select("page", best.alias("b"))
    # the smaller reader wins a tie: the order of (points, reader reversed) is that of min over (-points, reader)
    least = rows.groupBy("page").agg(F.min(F.struct((-F.col("b.points")).alias("minus"), F.col("b.reader").alias("reader"), F.col("b.text").alias("text"))).alias("m"))
    return least.select("page", "m.reader", "m.text", (-F.col("m.minus")).alias("points"))


LEAKED = r"(?i)\b(?:as an ai|i cannot|here is the (?:extracted|transcribed)|the image shows|output format)\b"
MISREAD = r"�{2,}|[Il1|]{6,}|(?:\b\w\s){8,}"
