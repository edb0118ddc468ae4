"""Full-text search over lines: inverted index, BM25, grouping, context, excerpts, claims.

The index is a long table (term, doc, tf) with document lengths beside it, written once, partitioned by a hash of the term so
that a query reads only its terms' files. Ranking joins the postings of the query's few terms only; document frequencies are
aggregates of the same postings.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Published BM25 constants.
K1, B = 1.2, 0.75
TERM = r"[\p{L}\p{N}]+"
BUCKETS = 64


def fold(text: Column) -> Column:
    """Lower case without combining marks of Latin letters."""
    return F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def analyse(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(0))


def glob_regex(glob: str) -> str:
    """``**`` any path, ``*`` within a folder; unanchored, case-insensitive."""
    out = "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob) if p)
    return "(?i)" + out


def query_terms(query: str, limit: int = 12) -> list[list[str]]:
    """Quoted tokens of the query, each as the phrase of its terms; at most ``limit`` tokens."""
    tokens = re.findall(r"[^\W_][\w./-]*[\w]|[\w./-]{2,}", query)[:limit]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
    phrases = [[t for t in re.findall(r"[^\W_]+", plain(tok))] for tok in tokens]
    return [p for p in phrases if p]


def parse_query(text: str):
    """The raw syntax after ``fts:`` as a tree: ("and" | "or" | "not", left, right) over phrases (lists of terms).

    Words, quoted phrases, parentheses, AND, OR and NOT in capitals; NOT binds closest, then AND (also between neighbours), then OR.
    A malformed query is a ValueError.
    """
    tokens = re.findall(r'"[^"]*"|[()]|[^\s()"]+', text)
    at = 0

    def look():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either():
        left = both()
        while look() == "OR":
            take()
            left = ("or", left, both())
        return left

    def both():
        left = without()
        while look() not in (None, ")", "OR", "NOT"):
            if look() == "AND":
                take()
            left = ("and", left, without())
        return left

    def without():
        left = unit()
        while look() == "NOT":
            take()
            left = ("not", left, unit())
        return left

    def unit():
        t = look()
        if t is None or t in ("AND", "OR", "NOT", ")"):
            raise ValueError(f"a term is missing in {text!r}")
        take()
        if t == "(":
            inner = either()
            if look() != ")":
                raise ValueError(f"a parenthesis is open in {text!r}")
            take()
            return inner
        plain = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        phrase = re.findall(r"[^\W_]+", plain)
        if not phrase:
            raise ValueError(f"no term in {t!r}")
        return phrase

    tree = either()
    if look() is not None:
        raise ValueError(f"{look()!r} is left over in {text!r}")
    return tree


def matches(terms: Column, tree) -> Column:
    """Whether the terms of a row satisfy a parsed query."""
    if isinstance(tree, tuple):
        op, a, b = tree
        left, right = matches(terms, a), matches(terms, b)
        return left & right if op == "and" else left | right if op == "or" else left & ~right
    if len(tree) == 1:
        return F.array_contains(terms, tree[0])
    # terms hold no blanks, so a phrase is a substring between blanks
    return F.contains(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")), F.lit(" " + " ".join(tree) + " "))


def raw_search(lines: DataFrame, query: str) -> DataFrame:
    """(path, line_no) of the lines that satisfy a raw query; a narrow filter."""
    tree = parse_query(query.removeprefix("fts:"))
    return lines.select("path", "line_no", analyse(F.col("content")).alias("ts")).where(matches(F.col("ts"), tree)).select("path", "line_no")


def update_index(store, files: DataFrame) -> str | None:
    """Brings a durable line index up to date: only new and changed files are analysed, removed or older states do not count.

    ``store`` is a :class:`~stratalode.core.manifest.ManifestStore`; files give (path, bytes, sha256, text), one row per path.
    """
    def process(todo: DataFrame) -> DataFrame:
        from .ingest import normal_text

        texts = files.join(todo.select("path"), "path", "left_semi")
        rows = texts.select("path", F.posexplode(F.split(normal_text(F.col("text")), "\n")).alias("at", "content")).select("path", (F.col("at") + 1).alias("line_no"), "content")
        postings, lengths = build_index(rows)
        return postings.join(lengths, ["path", "line_no"])

    return store.run(files.select("path", "bytes", F.col("sha256").alias("checksum")), process)


def indexed_terms(store) -> DataFrame:
    """(term, files, occurrences) of the present state of the index."""
    return store.output().groupBy("term").agg(F.count_distinct("path").alias("files"), F.sum("tf").alias("occurrences"))


def build_index(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings: term, path, line_no, tf), (lengths: path, line_no, dl). tf is counted inside the row: no shuffle."""
    base = lines.select("path", "line_no", analyse(F.col("content")).alias("ts"))
    lengths = base.select("path", "line_no", F.size("ts").alias("dl"))
    distinct = F.array_distinct("ts")
    postings = base.select(
        "path", "line_no",
        F.explode(F.transform(distinct, lambda t: F.struct(t.alias("term"), F.size(F.filter("ts", lambda x: x == t)).alias("tf")))).alias("p"),
    ).select("p.term", "path", "line_no", "p.tf")
    return postings, lengths


def write_index(lines: DataFrame, root: str) -> None:
    """The durable form: postings in buckets by term."""
    postings, lengths = build_index(lines)
    postings.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int")).repartition(BUCKETS, "bucket").sortWithinPartitions(
        "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
    lengths.write.mode("overwrite").parquet(f"{root}/lengths")
    lengths.sparkSession.read.parquet(f"{root}/lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{root}/stats")


def read_postings(spark: SparkSession, root: str, terms: list[str]) -> DataFrame:
    """Only the buckets of the terms (partition pruning), only their rows (pushed filter)."""
    import zlib

    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    return spark.read.parquet(f"{root}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def bm25(lines: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(path, line_no, score): every line that holds one of the query's tokens; lower is better (negated sum).

    One pass over the lines finds the query's frequencies inside each row, so only matching rows go on; the totals
    (N, average length, document frequencies: a handful of numbers) come from one aggregate.
    """
    phrases = query_terms(query)
    if not phrases:
        return lines.select("path", "line_no", F.lit(0.0).alias("score")).limit(0)
    base = lines.select("path", "line_no", analyse(F.col("content")).alias("ts"))

    def tf(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.size(F.filter("ts", lambda x: x == phrase[0]))
        n = len(phrase)
        starts = F.when(F.size("ts") >= n, F.sequence(F.lit(1), F.size("ts") - n + 1)).otherwise(F.array().cast("array<int>"))
        want = F.array(*[F.lit(p) for p in phrase])
        return F.size(F.filter(starts, lambda i: F.slice(F.col("ts"), i, F.lit(n)) == want))

    freq = base.select("path", "line_no", F.size("ts").alias("dl"), *[tf(p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    stats = freq.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df = stats[f"df{i}"]
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        t = F.col(f"tf{i}")
        score = score + F.lit(idf) * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / avgdl))
    hit = None
    for i in range(len(phrases)):
        x = F.col(f"tf{i}") > 0
        hit = x if hit is None else hit | x
    return freq.where(hit).select("path", "line_no", (-score).alias("score"))


def bm25_indexed(spark: SparkSession, root: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """As :func:`bm25` for single-term tokens, from the durable index: only the buckets of the query's terms are read.

    Document frequencies are aggregates of the postings read; N and the average length are written with the index.
    """
    terms = sorted({t for p in query_terms(query) for t in p})
    if not terms:
        return spark.createDataFrame([], "path string, line_no int, score double")
    postings, lengths = read_postings(spark, root, terms), spark.read.parquet(f"{root}/lengths")
    stats = spark.read.parquet(f"{root}/stats").first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    df = {r["term"]: r["n"] for r in postings.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row per query term
    if not df:
        return spark.createDataFrame([], "path string, line_no int, score double")
    idf = F.element_at(F.create_map(*[F.lit(x) for t, c in df.items() for x in (t, math.log(1 + (n - c + 0.5) / (c + 0.5)))]), F.col("term"))
    rows = postings.join(lengths, ["path", "line_no"])
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return rows.groupBy("path", "line_no").agg((-F.sum(part)).alias("score"))


def top(hits: DataFrame, k: int) -> DataFrame:
    """The best k lines, ties by path and line."""
    return hits.orderBy("score", "path", "line_no").limit(k)


def group_by_file(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, hit_count, hit_lines, best_score, best_line, best_content)."""
    best = F.min(F.struct("score", "line_no", "content"))
    return (
        hits.join(lines.select("path", "line_no", "content"), ["path", "line_no"]).groupBy("path")
        .agg(F.count("*").alias("hit_count"), F.array_sort(F.collect_set("line_no")).alias("hit_lines"), best.alias("b"))
        .select("path", "hit_count", "hit_lines", F.col("b.score").alias("best_score"), F.col("b.line_no").alias("best_line"), F.col("b.content").alias("best_content"))
    )


def token_saving(grouped: DataFrame) -> DataFrame:
    """The share of tokens that grouping saves, in per cent: 80 tokens per group against 100 per hit."""
    g = grouped.agg(F.count("*").alias("groups"), F.sum("hit_count").alias("hits"))
    return g.select("groups", "hits", F.round((1 - 80 * F.col("groups") / (100 * F.col("hits"))) * 100).cast("long").alias("saving"))


def surrounding(lines: DataFrame, hits: DataFrame, reach: int = 3) -> DataFrame:
    """(path, line_no, context): each hit with ``reach`` lines on either side.

    Each hit asks for its 2 * reach + 1 lines by equality on (path, line): a bounded fan-out and an equi-join, no range join.
    """
    wanted = hits.select("path", "line_no", F.explode(F.sequence(F.col("line_no") - reach, F.col("line_no") + reach)).alias("at"))
    rows = wanted.join(lines.select("path", F.col("line_no").alias("at"), "content"), ["path", "at"])
    return rows.groupBy("path", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n").alias("context"))


_FUNCTION = r"^\s*(?:export\s+)?(?:async\s+)?(?:pub\s+)?(?:public\s+|private\s+|protected\s+|static\s+)*(?:def|function|func|fn)\s+(?:\([^)]*\)\s*)?(\w+)"
_CLASS = r"^\s*(?:export\s+)?(?:public\s+|final\s+|abstract\s+)*(?:class|interface|struct|type)\s+(\w+)"


def enclosing(lines: DataFrame, reach: int = 50) -> DataFrame:
    """(path, line_no, function, class): the nearest definition at most ``reach`` lines above."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(-reach, 0)
    f, c = F.nullif(F.regexp_extract("content", _FUNCTION, 1), F.lit("")), F.nullif(F.regexp_extract("content", _CLASS, 1), F.lit(""))
    return lines.select("path", "line_no", F.last(f, True).over(w).alias("function"), F.last(c, True).over(w).alias("class"))


def block_ends(files: DataFrame, reach: int = 100) -> DataFrame:
    """(path, line_no, end_line): for lines that open more brace blocks than they close, the first line within ``reach`` at which
    the balance is back, null where there is none. From (path, text): a fold per file, a narrow map without any shuffle.
    """
    from .ingest import normal_text

    rows = files.where("path is not null and text is not null").select("path", normal_text(F.col("text")).alias("t"))

    def run(batches):
        for batch in batches:
            paths, numbers, ends = [], [], []
            for path, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                depth, level = [], 0
                deltas = [x.count("{") - x.count("}") for x in t.split("\n")]
                for d in deltas:
                    level += d
                    depth.append(level)
                for i, d in enumerate(deltas):
                    if d > 0:
                        before = depth[i] - d
                        paths.append(path)
                        numbers.append(i + 1)
                        ends.append(next((k + 1 for k in range(i + 1, min(len(depth), i + 1 + reach)) if depth[k] <= before), None))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int32()), pa.array(ends, pa.int32())], names=["path", "line_no", "end_line"])

    return rows.mapInArrow(run, "path string, line_no int, end_line int")


# Negation and affirmation words (fixed values).
NEGATION = (
    r"(?i)\b(not|no|never|cannot|can't|won't|doesn't|don't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't)\b",
    r"(?i)\b(deprecated|removed|obsolete|discontinued|unsupported|disabled)\b",
    r"(?i)\b(instead of|rather than|unlike|contrary to|in contrast)\b",
)
AFFIRMATION = (
    r"(?i)\b(is|are|was|were|has|have|does|do|can|will|should|must)\b", r"(?i)\b(supports?|enables?|provides?|allows?|includes?)\b",
    r"(?i)\b(recommended|required|default|standard|official)\b",
)


def evidence(snippet: Column, claim_tokens: list[str]) -> tuple[Column, Column]:
    """(type, score) of a snippet against a claim."""
    low = F.lower(snippet)
    matched = sum((low.contains(t.lower()).cast("int") for t in claim_tokens), F.lit(0))
    ratio = matched / F.lit(float(max(1, len(claim_tokens))))
    neg = aff = F.lit(False)
    for p in NEGATION:
        neg = neg | snippet.rlike(p)
    for p in AFFIRMATION:
        aff = aff | snippet.rlike(p)
    kind = F.when(ratio >= 0.5, F.when(neg & ~aff, "contradicting").otherwise("supporting")).otherwise("related")
    factor = F.when(ratio >= 0.5, F.when(neg & ~aff, 0.9).otherwise(1.0)).when(ratio >= 0.25, 0.7).otherwise(0.5)
    return kind, F.least(F.lit(1.0), (ratio * 0.7 + 0.3) * factor)


def verdict(rows: DataFrame) -> DataFrame:
    """One row (supporting, contradicting, related, confidence, label) from (type, score) rows."""
    w = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("score"))), F.lit(0.0))
    n = lambda t: F.count_if(F.col("type") == t)
    agg = rows.agg(n("supporting").alias("supporting"), n("contradicting").alias("contradicting"), n("related").alias("related"),
                   w("supporting").alias("s"), (w("contradicting") * 0.8).alias("c"), (w("related") * 0.3).alias("r"), F.count("*").alias("n"))
    total = F.col("s") + F.col("c") + F.col("r")
    conf = F.when(total == 0, 0.0).when(F.col("c") > F.col("s"), 0.2 * F.col("s") / total).otherwise((F.col("s") - 0.5 * F.col("c")) / total)
    conf = F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(1.0), conf + F.least(F.lit(0.2), F.col("n") * 0.02)))
    return agg.select("supporting", "contradicting", "related", F.round(conf, 6).alias("confidence"),
                      F.when(conf >= 0.7, "high").when(conf >= 0.4, "medium").when(conf > 0, "low").otherwise("none").alias("label"))
