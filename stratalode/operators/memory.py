"""A decaying memory table of three layers: write gates, identity, conflicts, search, upkeep, reflection.

One superset table: (id, layer, user_id, content, type, subject, predicate, object, category, confidence, strength, occurrences,
created_ms, last_ms, accesses, status). Every scope filters by user. Time is an explicit ``as_of`` in milliseconds, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..session import checkpoint

DAY = 86_400_000
# Thresholds and weights per layer (fixed values).
SIMILARITY = {"episodic": 0.35, "semantic": 0.35, "procedural": 0.30}
LAYER_WEIGHTS = {"procedural": 3, "semantic": 2, "episodic": 1}
MIN_CONFIDENCE, MIN_STRENGTH, MIN_OCCURRENCES = 0.6, 0.8, 2
EPISODIC_CAP = 1000
GC_DAYS, GC_ACCESSES = 90, 1


def memory_id(layer: Column, user: Column, content: Column, session: Column, created: Column, kind: Column, subject: Column, predicate: Column,
              obj: Column, category: Column) -> Column:
    n = T.normalise_memory
    rel = subject.isNotNull() & predicate.isNotNull() & obj.isNotNull() & (kind == "relation")
    text = (
        F.when(layer == "episodic", F.concat(user, session, created.cast("string"), F.substring(F.sha2(content, 256), 1, 16)))
        .when((layer == "semantic") & rel, F.concat(user, F.lit("relation"), n(subject), n(predicate), n(obj)))
        .when((layer == "semantic") & (kind == "entity") & subject.isNotNull(), F.concat(user, F.lit("entity"), n(subject)))
        .when(layer == "semantic", F.concat(user, F.lit("fact"), n(content))).otherwise(F.concat(user, category, n(content)))
    )
    return F.concat(F.lit("mem_"), F.substring(layer, 1, 3), F.lit("_"), F.substring(F.sha2(text, 256), 1, 16))


def gate(m: DataFrame) -> DataFrame:
    """With the reason why a row may not be written, null where it may."""
    low_conf = (F.col("layer") == "semantic") & (F.coalesce("confidence", F.lit(0.0)) < MIN_CONFIDENCE)
    weak = (F.col("layer") == "procedural") & ((F.coalesce("occurrences", F.lit(0)) < MIN_OCCURRENCES) | (F.coalesce("strength", F.lit(0.0)) < MIN_STRENGTH))
    return m.withColumn("rejected", F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty").when(T.has_secret(F.col("content")), "secret")
                        .when(low_conf, "confidence").when(weak, "strength"))


def write(m: DataFrame) -> DataFrame:
    """Accepted rows, one per id (the newest), conflicting relations marked as disputed, the episodic layer capped per user.

    Keeping the newest of an id or of a user is a limit per key that each task applies before the shuffle.
    """
    ok = gate(m).where("rejected is null").drop("rejected")
    newest = Window.partitionBy("id").orderBy(F.desc("created_ms"), "content")
    one = checkpoint(ok.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn"))  # gated once, read by four branches
    # only the capped layer is ranked: a limit per user that each task applies before the shuffle; the others are not sorted
    per_user = Window.partitionBy("user_id").orderBy(F.desc("created_ms"), "id")
    episodic = one.where("layer = 'episodic'").withColumn("_rn", F.row_number().over(per_user)).where(F.col("_rn") <= EPISODIC_CAP).drop("_rn")
    capped = one.where("layer <> 'episodic' or layer is null").unionByName(episodic)
    bad = conflicts(capped).select("id", F.lit("disputed").alias("_s")).distinct()
    return capped.join(bad, "id", "left").withColumn("status", F.coalesce("_s", F.col("status"))).drop("_s")


def conflicts(m: DataFrame) -> DataFrame:
    """(id, user_id, subject, predicate, objects): relations whose user, subject and predicate have several objects.

    Counted per key with partial aggregation instead of pairing the rows of a key.
    """
    rel = m.where("type = 'relation' and subject is not null and predicate is not null and object is not null")
    keys = rel.groupBy("user_id", "subject", "predicate").agg(F.count_distinct("object").alias("objects")).where("objects > 1")
    return rel.join(keys, ["user_id", "subject", "predicate"]).select("id", "user_id", "subject", "predicate", "objects")


def search(m: DataFrame, similarity: Column, as_of_ms: int, k: int) -> DataFrame:
    """(id, layer, similarity, score): the best ceil(k * weight / sum) of each layer above its threshold, decayed and boosted."""
    total = sum(LAYER_WEIGHTS.values())
    base = m.withColumn("similarity", similarity)
    floor = F.when(F.col("layer") == "procedural", SIMILARITY["procedural"]).otherwise(SIMILARITY["semantic"])
    hit = base.where(F.col("similarity") >= floor)
    score = F.col("similarity") * V.recency(F.lit(float(as_of_ms)), F.col("last_ms")) * V.frequency(F.col("accesses"))
    w = Window.partitionBy("layer").orderBy(F.desc("score"), "id")
    quota = F.lit(0)
    biggest = 0
    for layer, x in LAYER_WEIGHTS.items():
        n = -(-k * x // total)
        biggest = max(biggest, n)
        quota = F.when(F.col("layer") == layer, n).otherwise(quota)
    ranked = hit.withColumn("score", F.round(score, 6)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= biggest)
    return ranked.where(F.col("_rn") <= quota).select("id", "layer", "similarity", "score")


def near_existing(new: DataFrame, m: DataFrame, *, threshold: float = 0.9, k: int = 5, block: int = 4096) -> DataFrame:
    """(id, existing, similarity): for each new row (id, layer, user_id, vector) up to ``k`` rows of the table in the same layer and
    scope whose cosine is at least ``threshold``; what a write looks at before it adds a memory.

    The new rows are a write batch. They are cut into blocks of ``block``, each sent once over the table as one matrix: the table is
    never shuffled, each task keeps its best k per new row, and only those meet. Null and zero vectors have no neighbours.
    """
    import numpy as np
    import pyarrow as pa

    spark = m.sparkSession
    rows = m.select(F.concat_ws("\0", "layer", "user_id").alias("scope"), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("v is not null")
    found = []
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    held: list[tuple[str, str, list[float]]] = []

    def scan(block_rows):
        shared = spark.sparkContext.broadcast(block_rows)

        def run(batches):
            names, scopes = [r[0] for r in shared.value], np.array([r[1] for r in shared.value])
            q = unit(np.array([r[2] for r in shared.value], dtype=np.float64))
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.array(b.column(2).to_pylist(), dtype=object)
                good = [i for i, v in enumerate(x) if v is not None and len(v) == q.shape[1]]
                if not good:
                    continue
                data = unit(np.array([list(x[i]) for i in good], dtype=np.float64))
                ids, own = [b.column(1)[i].as_py() for i in good], np.array([b.column(0)[i].as_py() for i in good])
                sims = np.round(q @ data.T, 6)
                i, j = np.nonzero((sims >= threshold) & (scopes[:, None] == own[None, :]))
                keep = [(names[a], ids[c], float(sims[a, c])) for a, c in zip(i.tolist(), j.tolist()) if names[a] != ids[c]]
                yield pa.RecordBatch.from_arrays([pa.array([t[n] for t in keep], kind) for n, kind in enumerate((pa.string(), pa.string(), pa.float64()))],
                                                 names=["id", "existing", "similarity"])

        found.append(rows.mapInArrow(run, "id string, existing string, similarity double"))

    for r in new.select(F.col("id").cast("string"), F.concat_ws("\0", "layer", "user_id"), F.col("vector").cast("array<double>")).where("vector is not null").toLocalIterator():
        held.append((r[0], r[1], list(r[2])))
        if len(held) == block:
            scan(held)
            held = []
    if held:
        scan(held)
    if not found:
        return spark.createDataFrame([], "id string, existing string, similarity double")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "existing")
    return every.distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def collectable(m: DataFrame, as_of_ms: int, days: int = GC_DAYS, accesses: int = GC_ACCESSES, need_both: bool = False) -> DataFrame:
    """Rows that upkeep deletes: old or little used; with ``need_both`` old and little used."""
    old = F.col("last_ms") < as_of_ms - days * DAY
    idle = F.col("accesses") < accesses
    return m.where(old & idle if need_both else old | idle)


def stats(m: DataFrame) -> DataFrame:
    return m.groupBy("user_id", "layer").agg(F.count("*").alias("memories"), F.sum("accesses").alias("accesses"), F.max("created_ms").alias("newest_ms"),
                                             (F.count("*") >= 10).alias("should_reflect"))


def scope_stats(m: DataFrame, enough: int = 10) -> DataFrame:
    """(user_id, layer, memories, models, mixed, should_reflect): several embedding models in one scope are a warning, since their
    similarities do not compare; a reflection is due once ``enough`` rows are newer than the last one (``reflected_ms``, null: never)."""
    fresh = F.col("reflected_ms").isNull() | (F.col("created_ms") > F.col("reflected_ms"))
    models = F.count_distinct("model")
    return m.groupBy("user_id", "layer").agg(F.count("*").alias("memories"), models.alias("models"), (models > 1).alias("mixed"), (F.count_if(fresh) >= enough).alias("should_reflect"))


def apply_access(m: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds buffered access deltas (id, n, last_ms); a left join on the id."""
    d = deltas.groupBy("id").agg(F.sum("n").alias("_n"), F.max("last_ms").alias("_l"))
    return m.join(d, "id", "left").withColumn("accesses", F.col("accesses") + F.coalesce("_n", F.lit(0))).withColumn("last_ms", F.greatest("last_ms", "_l")).drop("_n", "_l")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Update by id: a non-null new value replaces the old one."""
    cols = [c for c in old.columns if c != "id"]
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in cols if c in new.columns])
    return old.join(n, "id", "left").select("id", *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in cols])


def patterns(m: DataFrame) -> DataFrame:
    """(user_id, category, occurrences, confidence): categories seen twice or more."""
    g = m.where("category is not null").groupBy("user_id", "category").agg(F.count("*").alias("occurrences"))
    return g.where("occurrences >= 2").withColumn("confidence", F.round(F.least(F.lit(0.7), 0.4 + 0.1 * F.col("occurrences")), 6))


def compress(m: DataFrame, chars: int = 500) -> DataFrame:
    """(user_id, layer, summary, confidence): the newest contents joined and cut.

    Only the first ``chars`` rows of a layer can reach the cut, so no more than that are ever gathered.
    """
    w = Window.partitionBy("user_id", "layer").orderBy(F.desc("created_ms"), "id")
    first = m.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= chars)
    counts = m.groupBy("user_id", "layer").agg(F.count("*").alias("n"))
    texts = first.groupBy("user_id", "layer").agg(F.array_sort(F.collect_list(F.struct("_rn", F.substring("content", 1, chars).alias("t")))).alias("xs"))
    joined = F.substring(F.array_join(F.transform("xs", lambda x: x["t"]), " | "), 1, chars)
    return texts.join(counts, ["user_id", "layer"]).select("user_id", "layer", joined.alias("summary"), F.round(F.least(F.lit(0.6), 0.3 + 0.05 * F.col("n")), 6).alias("confidence"))


# Forms of preferences and definitions (fixed values).
PREFERENCES = (
    r"(?i)\bI (?:prefer|like|love|want) ([^.!?\n]{2,80})", r"(?i)\bI (?:don't like|dislike|hate|avoid) ([^.!?\n]{2,80})", r"(?i)\bI (?:always|usually|often) ([^.!?\n]{2,80})",
    r"(?i)\bI never ([^.!?\n]{2,80})", r"(?i)\bmy favou?rite \w+ is ([^.!?\n]{2,80})", r"(?i)\bI (?:use|work with) ([^.!?\n]{2,80})",
    r"(?i)\b(?:user )?(?:prefers|likes to use|likes|enjoys) ([^.,;!?\n]{2,80})",
)
DEFINITION = r"\b([A-Z]?[a-z]+ [a-z]+) (?:is|are) ([a-z][^.!?,;\n]{1,60})"


def facts(df: DataFrame, id_col: str, text: Column, confidence: float = 0.5) -> DataFrame:
    """(id, kind, subject, object, confidence) of stated preferences and definitions; texts with secrets give none."""
    base = df.select(F.col(id_col).alias("id"), text.alias("t")).where(F.col("t").isNotNull() & ~T.has_secret(F.col("t")))
    prefs = F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in PREFERENCES])
    one = base.select("id", F.explode(prefs).alias("object")).select(
        "id", F.lit("preference").alias("kind"), F.lit("user").alias("subject"), F.trim("object").alias("object"), F.lit(min(0.7, confidence + 0.2)).alias("confidence"))
    subjects, objects = F.regexp_extract_all("t", F.lit(DEFINITION), F.lit(1)), F.regexp_extract_all("t", F.lit(DEFINITION), F.lit(2))
    two = base.select("id", F.explode(F.arrays_zip(subjects.alias("s"), objects.alias("o"))).alias("z")).select(
        "id", F.lit("definition").alias("kind"), F.col("z.s").alias("subject"), F.trim("z.o").alias("object"), F.lit(min(0.6, confidence + 0.1)).alias("confidence"))
    return one.unionByName(two).distinct()


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """One page of an ordered list, with ``has_more`` on each row: one row beyond the page is looked at, nothing is counted."""
    ranked = rows.orderBy(*order).limit(offset + size + 1).withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    more = F.max("_rn").over(Window.partitionBy(F.lit(0))) > offset + size  # over the looked-at rows only
    return ranked.withColumn("has_more", more).where((F.col("_rn") > offset) & (F.col("_rn") <= offset + size)).drop("_rn")
