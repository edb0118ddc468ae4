"""Vector scalars: cosine, hashed character n-grams, scores of retrieval and memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 8192
# n-gram length -> weight (fixed values)
WEIGHTS = {3: 1, 4: 5, 5: 10}
DENSE_SHARE = 0.7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0; null where a side is null or the lengths differ."""
    n = norm(a) * norm(b)
    value = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    return F.when(F.size(a) == F.size(b), value)


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ngram_rows(df: DataFrame, id_col: str, text_col: str, dims: int = DIMENSIONS, lower: bool = True) -> DataFrame:
    """Sparse long form (id, idx, weight) of unit n-gram vectors, in built-in expressions.

    The CRC is over UTF-8 bytes. Texts of fewer than three characters and null texts have no rows.
    Counts of one text are combined in one shuffle by (id, idx); the norm reuses its partitioning.
    """
    text = F.lower(F.col(text_col)) if lower else F.col(text_col)
    base = df.select(F.col(id_col).alias("id"), text.alias("t")).where(F.length("t") >= 3)

    def cells(n: int, w: int) -> Column:
        starts = F.when(F.length("t") >= n, F.sequence(F.lit(1), F.length("t") - n + 1)).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.substr(F.col("t"), i, F.lit(n)))
        return F.transform(grams, lambda g: F.struct((F.crc32(g.cast("binary")) % dims).cast("int").alias("idx"), F.lit(float(w)).alias("w")))

    parts = [cells(n, w) for n, w in WEIGHTS.items()]
    rows = base.select("id", F.explode(F.concat(*parts)).alias("g")).select("id", "g.idx", "g.w")
    summed = rows.repartition("id").groupBy("id", "idx").agg(F.log1p(F.sum("w")).alias("v"))
    size = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    return summed.join(size, "id").select("id", "idx", (F.col("v") / F.col("size")).alias("weight"))


def ngram_similarity(rows: DataFrame, query: str, dims: int = DIMENSIONS) -> DataFrame:
    """(id, sparse): dot product of each text with the query, whose vector is a bounded literal map."""
    q = hash_ngrams(query, dims)
    if not q:
        return rows.select("id").distinct().withColumn("sparse", F.lit(0.0))
    # a map of the query's few cells; the join side is as small as the query is long
    table = F.create_map(*[x for k, v in sorted(q.items()) for x in (F.lit(int(k)), F.lit(float(v)))])
    hit = rows.where(F.col("idx").isin([int(k) for k in q])).withColumn("p", F.col("weight") * F.element_at(table, F.col("idx")))
    return rows.select("id").distinct().join(hit.groupBy("id").agg(F.sum("p").alias("s")), "id", "left").select(
        "id", F.coalesce("s", F.lit(0.0)).alias("sparse"))


def hash_ngrams(text: str | None, dims: int = DIMENSIONS, lower: bool = True) -> dict[int, float]:
    """The same vector on the driver, for one query."""
    import zlib

    if not text:
        return {}
    t = text.lower() if lower else text
    out: dict[int, float] = {}
    for n, w in WEIGHTS.items():
        for i in range(len(t) - n + 1):
            k = zlib.crc32(t[i : i + n].encode()) % dims
            out[k] = out.get(k, 0.0) + w
    out = {k: float(np.log1p(v)) for k, v in out.items()}
    size = float(np.sqrt(sum(v * v for v in out.values())))
    return {k: v / size for k, v in out.items()} if size else {}


def hybrid_score(dense: Column, sparse: Column, share: float = DENSE_SHARE) -> Column:
    return dense * share + sparse * (1 - share)


def softmax_entropy(logprobs: Column) -> Column:
    """Entropy (natural log) of a renormalised distribution given as log probabilities."""
    p = F.transform(logprobs, lambda x: F.exp(x))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(p, lambda x: x / total), F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def token_uncertainty(tokens: Column, logprobs: Column) -> Column:
    """Mean over the tokens of the entropy of their alternatives, over that of an even choice, without special tokens (``<...>``).

    ``tokens`` is an array of strings, ``logprobs`` one array of log probabilities for each; a token with one alternative counts zero;
    null where no token is left."""
    both = F.filter(F.arrays_zip(tokens.alias("t"), logprobs.alias("l")), lambda z: ~z["t"].rlike(r"^<[^<>]*>$") & (F.size(z["l"]) > 0))
    each = F.transform(both, lambda z: F.when(F.size(z["l"]) > 1, softmax_entropy(z["l"]) / F.log(F.size(z["l"]).cast("double"))).otherwise(0.0))
    return F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each))


def heuristic_uncertainty(prompt: Column) -> Column:
    """Offline stand-in for a model's normalised uncertainty, keyed on words of the prompt (fixed values)."""
    low = F.lower(prompt)
    high = [low.contains(w) for w in ("random", "creative", "guess", "story")]
    sure = [low.contains(w) for w in ("1+1", "capital of france", 'say "yes" or "no"', "exact sequence")]
    h, s = high[0], sure[0]
    for x in high[1:]:
        h = h | x
    for x in sure[1:]:
        s = s | x
    return F.when(h, 0.8).when(s, 0.12).otherwise(0.45)


def lexical_gain(query_terms: Column, content_terms: Column, score: Column) -> Column:
    """0.7 share of the query's terms that the content holds + 0.3 retrieval score, clamped to [0, 1]."""
    overlap = F.when(F.size(query_terms) > 0, F.size(F.array_intersect(query_terms, content_terms)) / F.size(F.array_distinct(query_terms))).otherwise(0.0)
    return overlap * 0.7 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 0.3


def recency(as_of_ms: Column, last_ms: Column) -> Column:
    return F.exp(-0.1 * (as_of_ms - last_ms) / 86_400_000.0)


def frequency(count: Column) -> Column:
    return 1 + F.log1p(count.cast("double")) * 0.2


def byte_entropy(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bytes, entropy): Shannon entropy of UTF-8 bytes per row, vectorised over Arrow buffers; a narrow map."""
    slim = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")

    def run(batches):
        for b in batches:
            sizes, out = [], []
            for t in b.column(1):
                raw = np.frombuffer(t.as_buffer(), dtype=np.uint8)
                sizes.append(len(raw))
                if not len(raw):
                    out.append(0.0)
                    continue
                p = np.bincount(raw, minlength=256) / len(raw)
                p = p[p > 0]
                out.append(float(-(p * np.log2(p)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(out)], names=["id", "bytes", "entropy"])

    return slim.mapInArrow(run, "id string, bytes bigint, entropy double")
