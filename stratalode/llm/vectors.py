"""The k most similar vectors of every vector: a forest of random-projection trees, one shared priority queue per
query over the leaves of all trees, and exact cosines of the candidates in the leaves that the queue yields.

Queue: a leaf costs the sum of the squared margins by which the query is on the wrong side of the splits above it. The
leaves of all trees come out in order of cost until the next one costs more than ``budget``; branches dearer than that are
cut on the way down, so no list of all leaves is ever made. A query's own leaves cost nothing.

Trees: the split of a node is the difference of two sampled vectors, its threshold the median. A leaf holds about ``leaf``
vectors at every number of rows; only the depth follows it, at least ``LEAST`` levels. It is reached in stages of at most
``STAGE`` levels: the first is fitted on a bounded, documented sample (``sample`` vectors, chosen by a hash of the id) and
sent to the workers; each further stage fits one tree per cell of the stage before, on ``PER_LEAF`` vectors per new leaf, in
the cluster, and meets its cell's rows in one sorted stream (tree first), so a cell is never held in memory and no model
grows with the rows. The budget runs on through the stages: a forest in stages asks the same as one deep forest.

Plan: one shuffle of (cell, id, vector) per stage, into partitions of bounded size; one group per leaf compares exactly, in
blocks, and keeps the best k of each id above ``floor``; one shuffle by id keeps the best k over all leaves.

Recall and copies against the depth, measured by brute force: see the README. Neighbours are lost only where the budget
stops the queue; a greater ``budget`` is the way to any recall.

Exact copies: of vectors with equal values only the ``k + 1`` smallest ids are indexed, since by the tie rule no
other copy can be among anyone's k nearest; the other copies get their k smallest fellows (cosine 1) by a join.

Defined results: null vectors, of another length, all zero, or with NaN or infinite values take no part; repeated
rows of one id count once; equal cosines: the smaller id first; an empty table gives no rows; other columns are
neither read nor carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8192
PER_LEAF = 16
LEAF = 8192
LEAST, STAGE = 5, 9
TREES = 3
BUDGET = 0.002
_BLOCK = 1024
_PARTITION = 96 << 20  # bytes of routed rows


# -- trees ------------------------------------------------------------------------------------------------------------

Tree = list[tuple[np.ndarray, np.ndarray]]  # levels of (directions [2^d, dims], thresholds [2^d])


def fit_tree(points: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Of 16 random pairs of a node the widest direction is taken."""
    levels, nodes = [], [np.arange(len(points))]
    dims = points.shape[1]
    for _ in range(depth):
        directions, cuts, below = [], [], []
        for idx in nodes:
            some = idx if len(idx) <= 1024 else rng.choice(idx, 1024, replace=False)
            w = np.zeros((0, dims), np.float32)
            if len(some) > 1:
                i, j = rng.integers(0, len(some), (2, 16))
                w = points[some[i]] - points[some[j]]
                size = np.linalg.norm(w, axis=1)
                w = w[size > 1e-6] / size[size > 1e-6][:, None]
            if not len(w):
                w = rng.standard_normal((1, dims)).astype(np.float32)
                w /= np.linalg.norm(w)
            seen = points[some] @ w.T
            best = seen.std(axis=0).argmax() if len(some) else 0
            cut = float(np.median(seen[:, best])) if len(some) else 0.0
            right = points[idx] @ w[best] >= cut
            directions.append(w[best])
            cuts.append(cut)
            below += [idx[~right], idx[right]]
        levels.append((np.stack(directions).astype(np.float32), np.array(cuts, dtype=np.float32)))
        nodes = below
    return levels


def pack(tree: Tree) -> bytes:
    return b"".join(np.concatenate([w, c[:, None]], axis=1).tobytes() for w, c in tree)


def unpack(blob: bytes, dims: int) -> Tree:
    rows, levels, at = np.frombuffer(blob, dtype=np.float32).reshape(-1, dims + 1), [], 0
    while at < len(rows):
        n = 1 << len(levels)
        levels.append((rows[at : at + n, :dims], rows[at : at + n, dims]))
        at += n
    return levels


def leaves_within(x: np.ndarray, tree: Tree, spent: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, cost) of every leaf whose cost, with what the row has spent before, is at most the budget.

    The row's own leaf is the one that adds nothing.
    """
    row, node, cost = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), spent.astype(np.float32)
    for directions, cuts in tree:
        if len(directions) * len(x) <= 2 * len(row):  # few nodes: all margins at once
            margin = (x @ directions.T - cuts)[row, node]
        else:
            margin = np.einsum("nd,nd->n", x[row], directions[node]) - cuts[node]
        far = cost + margin * margin
        go = far <= budget
        right = (margin >= 0).astype(np.int64)
        node = np.concatenate([2 * node + right, 2 * node[go] + 1 - right[go]])
        row, cost = np.concatenate([row, row[go]]), np.concatenate([cost, far[go]])
    return row, node, cost


def route(x: np.ndarray, forest: list[Tree], budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf over the whole forest, cost, whether it is the row's own leaf), all trees in one queue."""
    parts = []
    for t, tree in enumerate(forest):
        row, leaf, cost = leaves_within(x, tree, np.zeros(len(x), np.float32), budget)
        parts.append((row, leaf + (t << len(tree)), cost, np.arange(len(row)) < len(x)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def stages(rows: int, leaf: int, stage: int = STAGE, least: int = LEAST) -> list[int]:
    """Levels of each stage, about equal."""
    depth = max(least, math.ceil(math.log2(max(1, rows) / leaf)))
    n = math.ceil(depth / stage)
    return [depth * (i + 1) // n - depth * i // n for i in range(n)]


# -- exact comparison inside a leaf -------------------------------------------------------------------------------------


def _close(data: np.ndarray, queries: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i into data ++ queries, j into data, i != j) of cosines at or above floor, less a rounding margin."""
    n = len(data)
    out_i, out_j = [], []
    low = np.float32(floor - 1e-5)
    for s in range(0, n, _BLOCK):  # upper triangle, by blocks
        m = data[s : s + _BLOCK] @ data[s:].T
        flat = np.flatnonzero(m.ravel() >= low)
        i, j = np.divmod(flat, m.shape[1])
        keep = i < j
        out_i.append(i[keep] + s)
        out_j.append(j[keep] + s)
    for s in range(0, len(queries), _BLOCK):
        m = queries[s : s + _BLOCK] @ data.T
        flat = np.flatnonzero(m.ravel() >= low)
        i, j = np.divmod(flat, n)
        out_i.append(i + s + n)
        out_j.append(j)
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


# -- plan -----------------------------------------------------------------------------------------------------------------


def usable(vector: Column, dims: int) -> Column:
    """True for vectors that take part."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & ~bad & F.exists(vector, lambda v: v != 0)


def _as_arrays(batch: pa.RecordBatch, col: int, dims: int) -> np.ndarray:
    a = batch.column(col)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


_ROUTED = "cell bigint, kind int, cost float, id string, x binary"


def _batch(cell, own, cost, ids: pa.Array, x: pa.Array, row) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(cell, pa.int64()), pa.array(np.where(own, 1, 2).astype(np.int32)), pa.array(cost, pa.float32()), ids.take(take), x.take(take)],
        names=["cell", "kind", "cost", "id", "x"])


def _binary(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _next_stage(routed: DataFrame, depth: int, held: float, parts: int, dims: int, budget: float, seed: int) -> DataFrame:
    """Routed rows (kind 1: data, 2: queries) of cells that hold about ``held`` data rows, routed through a tree per cell."""
    share = min(1.0, PER_LEAF * (1 << depth) / max(1.0, held))
    picked = routed.where((F.col("kind") == 1) & (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))

    def fit(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float32).reshape(-1, dims)
        cell = table.column("cell")[0].as_py()
        x = x[np.lexsort(x.T[:4])]  # the order of arrival decides nothing
        tree = fit_tree(x, depth, np.random.default_rng([seed, cell]))
        return pa.table({"cell": pa.array([cell], pa.int64()), "kind": pa.array([0], pa.int32()), "cost": pa.array([0.0], pa.float32()),
                         "id": pa.array([""], pa.string()), "x": pa.array([pack(tree)], pa.binary())})

    trees = picked.groupBy("cell").applyInArrow(fit, _ROUTED)

    def descend(batches):
        cell, tree = None, []
        for b in batches:
            cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(cells)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                if cells[a] != cell:
                    cell, tree = cells[a], []  # a cell without sampled rows stays one leaf
                if kinds[a] == 0:
                    tree = unpack(b.column(4)[int(a)].as_py(), dims)
                    continue
                for s in range(a, z, 4096):
                    part = b.slice(s, min(4096, z - s))
                    x = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.float32).reshape(-1, dims)
                    row, leaf, cost = leaves_within(x, tree, part.column(2).to_numpy(), budget)
                    own = (np.arange(len(row)) < len(x)) & (kinds[a] == 1)
                    yield _batch((cell << depth) + leaf, own, cost, part.column(3), part.column(4), row)

    return (
        routed.unionByName(trees).repartition(parts, "cell").sortWithinPartitions("cell", "kind").mapInArrow(descend, _ROUTED)
    )


def nearest(
    df: DataFrame,
    *,
    id_col: str = "id",
    vector_col: str = "vector",
    dims: int = 64,
    k: int = 5,
    floor: float = -1.0,
    trees: int = TREES,
    budget: float = BUDGET,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    stage: int = STAGE,
    least: int = LEAST,
    seed: int = 7,
) -> DataFrame:
    """(id, neighbour, cosine, place): up to k neighbours of cosine >= floor for every usable vector."""
    base = df.select(df[id_col].cast("string").alias("id"), df[vector_col].cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v"), dims)
    )
    rows = df.count()  # answered from file footers; an upper bound is all that the depth needs
    # Copies of one vector beyond the first k + 1 ids can be in nobody's list.
    hashed = base.select("id", F.xxhash64("v").alias("h"))
    hot = hashed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 2 * (k + 1))
    crowded = not hot.isEmpty()
    if crowded:
        inside = base.withColumn("h", F.xxhash64("v")).join(hot.select("h"), "h", "left_semi").select("h", "id", "v")
        # the hash only picks the candidates; equality is that of the values
        first = (
            inside.select("h", "v", "id").withColumn("r", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id")))
            .where(F.col("r") <= k + 1).dropDuplicates(["h", "v", "id"])
        )
        rest = base.withColumn("h", F.xxhash64("v")).join(hot.select("h"), "h", "left_anti")
        indexed = rest.select("id", "v").unionByName(first.select("id", "v"))
    else:
        indexed = base
    levels = stages(rows, leaf, stage, least)
    share = min(1.0, sample / max(1, rows))
    picked = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    drawn = [_as_arrays(b, 0, dims) for b in picked.orderBy("id").select("v").toArrow().to_batches()]
    points = _unit(np.concatenate(drawn)) if drawn else np.zeros((0, dims), np.float32)
    rng = np.random.default_rng(seed)
    forest = [fit_tree(points, levels[0], rng) for _ in range(trees)]
    copies = len(route(points, forest, budget)[0]) / max(1, len(points))  # leaves that a vector visits
    per_row = 4 * dims + 48
    spark = df.sparkSession
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least_parts, math.ceil(rows * copies * per_row / _PARTITION))
    shared = spark.sparkContext.broadcast(forest)

    def enter(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                b = whole.slice(s, 4096)
                if b.num_rows:
                    x = _unit(_as_arrays(b, 1, dims))
                    row, cell, cost, own = route(x, shared.value, budget)
                    yield _batch(cell, own, cost, b.column(0), _binary(x), row)

    routed = indexed.mapInArrow(enter, _ROUTED)
    cells = 1 << levels[0]
    for n, depth in enumerate(levels[1:]):
        routed = _next_stage(routed, depth, rows / cells, parts, dims, budget, seed + n + 1)
        cells <<= depth
        parts = max(parts, math.ceil(rows * copies ** (n + 2) * per_row / _PARTITION))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy(zero_copy_only=False).astype(str)
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float32).reshape(-1, dims)
        is_data = table.column("kind").to_numpy() == 1
        order = np.lexsort((~is_data, ids))
        ids, x, is_data = ids[order], x[order], is_data[order]
        once = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
        ids, x, is_data = ids[once], x[once], is_data[once]
        place = np.concatenate([np.flatnonzero(is_data), np.flatnonzero(~is_data)])
        ids, x, n = ids[place], x[place], int(is_data.sum())
        i, j = _close(x[:n], x[n:], floor)
        sims = np.empty(len(i))
        for s in range(0, len(i), 65536):
            a, b = x[i[s : s + 65536]].astype(np.float64), x[j[s : s + 65536]].astype(np.float64)
            sims[s : s + 65536] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        left, right, sims = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([sims, sims])
        keep = sims >= floor
        left, right, sims = left[keep], right[keep], sims[keep]
        rank_of = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        if len(left):
            order = np.lexsort((rank_of[right], -sims, left))
            left, right, sims = left[order], right[order], sims[order]
            fresh = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
            left, right, sims = left[fresh], right[fresh], sims[fresh]
            start = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
            rank = np.arange(len(left)) - np.repeat(start, np.diff(np.r_[start, len(left)]))
            best = rank < k
            left, right, sims = left[best], right[best], sims[best]
        return pa.table({"id": pa.array(ids[left], pa.string()), "neighbour": pa.array(ids[right], pa.string()),
                         "cosine": pa.array(sims, pa.float64())})

    found = routed.repartition(parts, "cell").groupBy("cell").applyInArrow(compare, "id string, neighbour string, cosine double")
    if crowded:
        # every member of a crowded group gets its first fellows; the group side has one row per group
        fellows = first.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("fellows"))
        members = inside.join(fellows, ["h", "v"]).select(
            "id", F.explode(F.slice(F.array_except("fellows", F.array("id")), 1, k)).alias("neighbour"),
            F.lit(1.0).alias("cosine"),
        )
        found = found.unionByName(members)
    best = (
        found.repartition("id").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
        .withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
        .where(F.col("place") <= k)
    )
    return best


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b) of which at least one is in the other's list; id_a is the smaller string."""
    return neighbours.select(
        F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    ).distinct()
