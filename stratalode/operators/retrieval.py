"""Vector retrieval: brute-force and hierarchical top-k, hybrid reranking, expansion, information gain, pruning."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..session import checkpoint

PARENT, SIBLING, HOP = 0.7, 0.6, 0.5
DIMS = 64


def where_all(conditions: list[Column]) -> Column:
    """The conjunction, true where there is none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def scope(m: Column, *, bundle_ids=None, bundle_id=None, paper_ids=None, source_types=None) -> Column:
    """A filter on chunk metadata; a list of bundles beats a single one."""
    c = []
    if bundle_ids:
        c.append(m["bundle_id"].isin(list(bundle_ids)))
    elif bundle_id:
        c.append(m["bundle_id"] == bundle_id)
    if paper_ids:
        c.append(m["paper_id"].isin(list(paper_ids)))
    if source_types:
        c.append(m["source_type"].isin(list(source_types)))
    return where_all(c)


def usable(v: Column, dims: int = DIMS) -> Column:
    return v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def scored(df: DataFrame, vector: Column, query) -> DataFrame:
    """Rows with their cosine to a query vector, rounded to a fixed precision so that ties are ties; unusable vectors leave."""
    q = V.literal_vector(query)  # a constant: its norm is folded once, not for each row
    return df.where(usable(vector, len(query))).withColumn("score", F.round(V.cosine(vector, q), 6))


def top_k(df: DataFrame, k: int, *tie: str) -> DataFrame:
    return df.orderBy(F.desc("score"), *tie).limit(k)


def quota_top(df: DataFrame, group: str, quotas: dict[str, int], tie: str = "id") -> DataFrame:
    """The best of each group up to its own quota; each task keeps at most the largest quota per group before the shuffle."""
    if not quotas:
        return df.limit(0)
    w = Window.partitionBy(group).orderBy(F.desc("score"), tie)
    limit = reduce(lambda c, kv: F.when(F.col(group) == kv[0], kv[1]).otherwise(c), quotas.items(), F.lit(0))
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(quotas.values()))
    return ranked.where(F.col("_rn") <= limit).drop("_rn")


def raw_quotas(k: int) -> dict[str, int]:
    """20 % coarse, 50 % fine, the rest sections."""
    a, c = math.ceil(k * 0.2), math.ceil(k * 0.5)
    return {"l1": a, "l3": c, "l2": max(0, k - a - c)}


def fine_quotas(k: int) -> dict[str, int]:
    """60 % fine, the rest sections."""
    c = math.ceil(k * 0.6)
    return {"l3": c, "l2": max(0, k - c)}


def merge_by_id(parts: list[DataFrame]) -> DataFrame:
    """Union in order of priority; the first part that holds an id keeps it."""
    both = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy("id").orderBy("_p", F.desc("score"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def expand(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, score, via): the seeds, their parents and their siblings, each id once, seeds first, then parents.

    ``chunks`` gives (id, parent). The seeds are a top-k result, so Catalyst may broadcast them; the joins are equi-joins.
    """
    own = seeds.select("id", "score", F.lit("seed").alias("via"))
    linked = seeds.select("id").join(chunks, "id").where("parent is not null").select("parent").distinct()
    parents = chunks.join(linked.withColumnRenamed("parent", "id"), "id", "left_semi").select("id", F.lit(PARENT).alias("score"), F.lit("parent").alias("via"))
    siblings = chunks.join(linked, "parent", "left_semi").select("id", F.lit(SIBLING).alias("score"), F.lit("sibling").alias("via"))
    return merge_by_id([own, parents, siblings])


def hierarchical(chunks: DataFrame, k1: int, k2: int) -> DataFrame:
    """Coarse search picks contents (paper, else bundle), fine search is restricted to them by a semi join."""
    l1 = quota_top(chunks, "level", {"l1": k1})
    picked = l1.select("content_key").where("content_key is not null").distinct()
    fine = chunks.where(F.col("level").isin("l2", "l3")).join(picked, "content_key", "left_semi")
    return merge_by_id([quota_top(fine, "level", fine_quotas(k2))])


def list_content(chunks: DataFrame) -> DataFrame:
    """(content_key, l1, l2, l3): counts of each level per content."""
    return chunks.where("content_key is not null").groupBy("content_key").agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("l1", "l2", "l3")])


def hybrid(df: DataFrame, query_text: str, query_vector, k: int, share: float = V.DENSE_SHARE) -> DataFrame:
    """(id, dense, sparse, score): the best min(2k, 50) by cosine, reranked with character n-grams.

    n-grams are hashed for the candidates only.
    """
    candidates = top_k(scored(df, F.col("v"), query_vector), min(2 * k, 50), "id").select("id", "content", F.col("score").alias("dense"))
    sparse = V.ngram_similarity(V.ngram_rows(candidates, "id", "content"), query_text)
    both = candidates.join(sparse, "id", "left").withColumn("sparse", F.coalesce("sparse", F.lit(0.0)))
    return top_k(both.select("id", "dense", F.round("sparse", 6).alias("sparse"), F.round(V.hybrid_score(F.col("dense"), F.col("sparse"), share), 6).alias("score")), k, "id")


def information_gain(candidates: DataFrame, query: str) -> DataFrame:
    """(id, gain): lexical gain of each candidate (id, content, score) against a query."""
    q = sorted({t for t in __import__("re").findall(r"[^\W_]+", query.lower()) if len(t) > 1})
    terms = F.array(*[F.lit(x) for x in q]) if q else F.array().cast("array<string>")
    return candidates.select("id", F.round(V.lexical_gain(terms, F.array_distinct(T.terms(F.col("content"))), F.col("score")), 6).alias("gain"))


def normalise_scores(df: DataFrame, col: str) -> DataFrame:
    """Min-max over all rows; the extremes are one aggregate, not a window over one partition."""
    df = checkpoint(df)  # two passes over what may be a costly plan
    s = df.agg(F.min(col).alias("a"), F.max(col).alias("b")).first()
    a, b = s["a"], s["b"]
    value = F.lit(1.0) if a is None or a == b else (F.col(col) - a) / (b - a)
    return df.withColumn("normal", F.round(value, 6))


def local(df: DataFrame, vector: Column, query, k: int, bundle_ids: list[str]) -> DataFrame:
    """The best k of the given bundles only; the scope is a filter that is applied before anything is scored."""
    return top_k(scored(df.where(F.col("bundle_id").isin(list(bundle_ids))), vector, query), k, "id")


MODES = ("naive", "local", "global", "hybrid", "hierarchical")


def retrieve(df: DataFrame, mode: str, query_text: str, query_vector, k: int, bundle_ids: list[str] | None = None) -> DataFrame:
    """(id, score) of chunks (id, content, v, level, content_key, bundle_id) by one of the modes.

    naive: quotas per level; local: the same within bundles; global: quotas on the coarse level only; hybrid: twice as many by
    cosine, reranked with character n-grams; hierarchical: coarse search picks contents, fine search stays inside them.
    """
    if mode not in MODES:
        raise ValueError(f"modes are {', '.join(MODES)}")
    if mode == "local" and not bundle_ids:
        raise ValueError("local retrieval needs bundles")
    if mode == "hybrid":
        return hybrid(df.where("content is not null"), query_text, query_vector, k).select("id", "score")
    rows = df.where(F.col("bundle_id").isin(list(bundle_ids))) if bundle_ids else df
    s = scored(rows, F.col("v"), query_vector)
    if mode == "hierarchical":
        return hierarchical(s, k, k).select("id", "score")
    return quota_top(s, "level", {"l1": k} if mode == "global" else raw_quotas(k)).select("id", "score")


def complete(seeds: DataFrame, chunks: DataFrame, needs_more: Column, hops: int = 2) -> DataFrame:
    """(id, score, hop): the seeds, and for as many hops the neighbours by position of every chunk that points elsewhere.

    ``chunks`` gives (id, content, content_key, chunk_index). Each hop starts from what the hop before added.
    """
    found = seeds.select("id", "score", F.lit(0).alias("hop"))
    last = chunks.join(seeds.select("id"), "id", "left_semi")
    for hop in range(1, hops + 1):
        ask = last.where(needs_more).select("content_key", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")).distinct()
        near = chunks.join(ask, ["content_key", "chunk_index"], "left_semi").join(found.select("id"), "id", "left_anti")
        found = found.unionByName(near.select("id", F.lit(HOP).alias("score"), F.lit(hop).alias("hop")))
        last = near
    return found


def answer(ranked: DataFrame, query: str, k: int = 5, enough: float = 0.7, step: int = 5, most: int = 20) -> tuple[str, float, int]:
    """(answer, support, chunks used) without a model: the sentence of the best chunks that shares most terms with the question.

    ``ranked`` gives (id, content, score). Support is the share of the question's terms that the chunks used hold; below ``enough`` the
    answer is tried again with ``step`` chunks more, up to ``most``: a handful of rows, so the driver decides."""
    import re

    rows = [r["content"] for r in top_k(ranked.where("content is not null"), most, "id").collect()]
    want = {t for t in re.findall(r"[^\W_]+", query.lower()) if len(t) > 2}
    has = lambda text: {t for t in re.findall(r"[^\W_]+", text.lower())}
    n = min(k, len(rows))
    while True:
        used = rows[:n]
        support = len(want & has(" ".join(used))) / len(want) if want else 1.0
        if support >= enough or n >= min(most, len(rows)):
            break
        n = min(n + step, len(rows), most)
    sentences = [s.strip() for t in used for s in re.split(r"(?<=[.!?])\s+|\n+", t) if s.strip()]
    best = max(sentences, key=lambda s: (len(want & has(s)), -len(s)), default="")
    return best, round(support, 6), n


def list_by_keys(chunks: DataFrame) -> DataFrame:
    """(key, l1, l2, l3): finer chunks counted under the content that the first of their candidate keys names.

    ``chunks`` gives (id, level, content_hash, repo_id, bundle_id, paper_id). A coarse chunk is listed under its hash, else repository,
    bundle or paper; a finer one tries hash, repository at hash, repository, bundle, paper, in this order. One equi-join on the key;
    the first rank that met anything wins by an aggregate.
    """
    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(name + ":"), c))
    h, r = F.col("content_hash"), F.col("repo_id")
    at = F.when(r.isNotNull() & h.isNotNull(), F.concat(F.lit("repo:"), r, F.lit("@"), F.substring(h, 1, 12)))
    keys = F.array(part("hash", h), at, part("repo", r), part("bundle", F.col("bundle_id")), part("paper", F.col("paper_id")))
    listed = chunks.where("level = 'l1'").select(F.coalesce(part("hash", h), part("repo", r), part("bundle", F.col("bundle_id")), part("paper", F.col("paper_id"))).alias("key")).where("key is not null")
    listed = listed.groupBy("key").agg(F.count("*").alias("l1"))
    tries = chunks.where("level in ('l2', 'l3')").select("id", "level", F.posexplode(keys).alias("rank", "key")).where("key is not null")
    met = tries.join(listed.select("key"), "key").groupBy("id", "level").agg(F.min_by("key", "rank").alias("key"))
    finer = met.groupBy("key").agg(F.count_if(F.col("level") == "l2").alias("l2"), F.count_if(F.col("level") == "l3").alias("l3"))
    return listed.join(finer, "key", "left").select("key", "l1", F.coalesce("l2", F.lit(0)).alias("l2"), F.coalesce("l3", F.lit(0)).alias("l3"))


def prune_until(df: DataFrame, most: int, share: float = 0.5, gain: str = "gain", tie: str = "id") -> DataFrame:
    """Ratio pruning repeated until at most ``most`` rows are left or nothing changes; the rounds are numbers, the rows are cut once."""
    df = checkpoint(df)
    n = df.count()
    while n > most:
        fewer = max(1, math.ceil(n * share))
        if fewer == n:
            break
        n = fewer
    return df.orderBy(F.desc(gain), tie).limit(n)


def prune(df: DataFrame, strategy: str, value: float, gain: str = "gain", tie: str = "id") -> DataFrame:
    """threshold: gain >= value, may be empty; topk: at most value; ratio: the best ceil(n * value), one at least."""
    if strategy == "threshold":
        return df.where(F.col(gain) >= value)
    if strategy == "ratio":
        df = checkpoint(df)  # counted and ranked
    n = int(value) if strategy == "topk" else max(1, math.ceil(df.count() * value))
    return df.orderBy(F.desc(gain), tie).limit(n)
