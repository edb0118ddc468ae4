"""Near-duplicate records with small edits: Order MinHash sketches, exact verification, classes.

A record's words give occurrence-labelled k-mers (the second occurrence of a k-mer is another element than the
first). One sketch entry takes the ``ell`` k-mers of least hash and keeps them in the order in which they stand in
the text, so that it is sensitive to edits and order, not only to the set. Two records are candidates if any entry
agrees. A text that repeats k-mers gives a second sketch over their first occurrences only: similarity is one of sets, and
for a text without repeats both sketches are the same. Three families cover all lengths (sizes are numbers of different
shingles of three words):

* long  (more than 24):  k = 5, ell = 2, 36 entries;
* short (up to 48):      k = 3, ell = 3, 36 entries; the families overlap by the factor that a similarity of one half
  allows between two sizes, so that a pair always has a family in common;
* tiny  (up to 6):       every shingle is a key;
* free  (3 and more):    k = 3, ell = 3, 16 entries of which the order does not count, for records that were reordered.

Plan: equal contents are one node (``h0``, a hash of the content; copies meet before any comparison, first inside each
map task; where two contents share a hash, which a second hash tells, they get hashes of their own); keys are shuffled once
as (key, node), sorted, and runs of one key give candidate pairs; candidates are joined with the contents and verified exactly.
A run longer than ``RUN`` nodes gives no pairs there: its nodes meet again by the rarest shingles of each (of n shingles the
n - ceil(t n) + 1 least frequent ones among these nodes: two sets of similarity t always share one, so nothing is lost), so
that a phrase that stands in a million records brings together only what is alike beyond it. Runs that are long even then hold
records that are alike indeed: their nodes are cut into blocks, and each pair of blocks is compared exactly in a task of its own.

Defined results: null contents and contents of fewer than three words never count; repeated rows of one id count
once; classes of more than ``EXPAND`` equal contents are given as a star around their smallest id, smaller ones as all
pairs; empty tables give no rows; other columns are neither read nor carried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, spread

K_LONG, ELL_LONG, ENTRIES_LONG = 5, 2, 36
K_SHORT, ELL_SHORT, ENTRIES_SHORT = 3, 3, 36
K_FREE, ELL_FREE, ENTRIES_FREE = 3, 3, 16
SHORT, LONG, TINY = 48, 24, 6
RUN, BLOCK = 128, 512
EXPAND = 64

_WORDS = re.compile(r"\w+").findall
_POS = 26
_TOP = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (fixed constants)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)  # in place from here on: x is this function's own
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _seed(n: int) -> np.uint64:
    return mix(np.array([n], dtype=np.uint64))[0]


class Words:
    """Hashes of the words of texts; the memory of seen words is bounded and never changes a result."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        known, words = self.known, _WORDS(text.lower())
        try:
            out = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            out = [known[w] for w in words]
        return np.array(out, dtype=np.uint64)


def shingle_set(words: np.ndarray, n: int = 3) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(_kmers(words, n)[: len(words) - n + 1])


def _kmers(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places of each text are not k-mers."""
    padded = np.concatenate([flat, np.zeros(k, dtype=np.uint64)])
    out = np.zeros(len(flat), dtype=np.uint64)
    for i in range(k):
        out = mix(out + padded[i : i + len(flat)] + np.uint64(i + 1))
    return out


def _sketch(flat: np.ndarray, sizes: np.ndarray, k: int, ell: int, entries: int, family: int, ordered: bool = True):
    """(text, key) of texts that have at least ell different k-mers each; flat holds their words.

    Every text has one key per entry; one that repeats k-mers has also those keys of its first occurrences that differ.
    """
    if len(flat) >= 1 << _POS:
        raise ValueError(f"texts of {len(flat)} words together: positions have {_POS} bits")
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    kmer = _kmers(flat, k)
    real = place < np.repeat(sizes - k + 1, sizes)
    kmer, text, place = kmer[real], text[real], place[real]
    counts = sizes - k + 1
    # occurrence labels
    order = np.lexsort((place, kmer, text))
    same = np.r_[False, (kmer[order][1:] == kmer[order][:-1]) & (text[order][1:] == text[order][:-1])]
    heads = np.flatnonzero(~same)
    nth = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
    label = np.empty(len(order), dtype=np.uint64)
    label[order] = nth.astype(np.uint64)
    kmer = mix(kmer + label * np.uint64(0x9E3779B97F4A7C15))
    out = _entries(kmer, counts, ell, entries, family, ordered)
    who, keys = np.repeat(np.arange(len(sizes)), entries), out.ravel()
    firsts = np.bincount(text[label == 0], minlength=len(sizes))
    again = np.flatnonzero(firsts < counts)
    if len(again):
        kept = (label == 0) & (firsts < counts)[text]
        more = _entries(kmer[kept], firsts[again], ell, entries, family, ordered)
        row, entry = np.nonzero(more != out[again])
        who, keys = np.r_[who, again[row]], np.r_[keys, more[row, entry]]
    return who, keys


def _entries(kmer: np.ndarray, counts: np.ndarray, ell: int, entries: int, family: int, ordered: bool = True) -> np.ndarray:
    """[texts, entries] keys; kmer holds the labelled k-mers of each text in text order."""
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    low = np.uint64((1 << _POS) - 1)
    at = (np.arange(len(kmer)) - np.repeat(starts, counts)).astype(np.uint64) & low
    out = np.empty((len(counts), entries), dtype=np.uint64)
    for t in range(entries):
        v = mix(kmer ^ _seed(family * 1000 + t + 1))
        v &= ~low
        v |= at
        chosen = np.empty((len(counts), ell), dtype=np.int64)
        for i in range(ell):
            least = np.minimum.reduceat(v, starts)
            chosen[:, i] = starts + (least & low).astype(np.int64)
            v[chosen[:, i]] = _TOP
        if ordered:
            chosen.sort(axis=1)  # text order; else the order of the hashes
        key = np.full(len(counts), _seed(family * 1000 + 500 + t), dtype=np.uint64)
        for i in range(ell):
            key = mix(key + kmer[chosen[:, i]])
        out[:, t] = key
    return out


def _different(hashed: list[np.ndarray], sizes: np.ndarray, n: int = 3) -> np.ndarray:
    """Number of different shingles of each text."""
    out = np.zeros(len(sizes), dtype=np.int64)
    if not len(sizes):
        return out
    kmer = _kmers(np.concatenate(hashed), n)
    for i, end in enumerate(np.cumsum(sizes)):
        s = kmer[end - sizes[i] : end - n + 1] if sizes[i] >= n else kmer[:0]
        if len(s):
            s.sort()
            out[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
    return out


def keys_of(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, key) of every sketch entry."""
    hashed = [words.hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashed], dtype=np.int64)
    shingles = _different(hashed, sizes)
    who, keys = [], []
    for family, (k, ell, entries, pick, ordered) in enumerate(
        ((K_LONG, ELL_LONG, ENTRIES_LONG, shingles > LONG, True),
         (K_SHORT, ELL_SHORT, ENTRIES_SHORT, (shingles >= ELL_SHORT) & (shingles <= SHORT), True),
         (K_FREE, ELL_FREE, ENTRIES_FREE, shingles >= ELL_FREE, False))
    ):
        idx = np.flatnonzero(pick)
        if len(idx):
            text, key = _sketch(np.concatenate([hashed[i] for i in idx]), sizes[idx], k, ell, entries, family, ordered)
            who.append(idx[text])
            keys.append(key)
    for i in np.flatnonzero((shingles >= 1) & (shingles <= TINY)):
        s = mix(shingle_set(hashed[i]) ^ _seed(3))
        who.append(np.full(len(s), i))
        keys.append(s)
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(who), np.concatenate(keys)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def banded_alignment(a: np.ndarray, b: np.ndarray, band: int = 32) -> float:
    """Edit similarity of two word sequences, 1 - distance / longer length, by a dynamic program over a band.

    The band is widened by the difference in length; outside of it costs are infinite, so the similarity is exact
    if the best alignment stays inside and a lower bound otherwise.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    half = band + abs(n - m)
    offsets = np.arange(-half, half + 1)
    far = n + m + 1
    row = np.where((offsets >= 0) & (offsets <= m), offsets, far).astype(np.int64)
    steps = np.arange(len(offsets))
    for i in range(1, n + 1):
        j = offsets + i
        inside = (j >= 0) & (j <= m)
        other = b[np.clip(j - 1, 0, m - 1)]
        swap = row + np.where((j >= 1) & (other == a[i - 1]), 0, 1)
        swap[j < 1] = far
        drop = np.r_[row[1:], far] + 1
        best = np.where(inside, np.minimum(swap, drop), far)
        best[j == 0] = i
        # insertions run along the row: a running minimum of (cost - place)
        row = np.where(inside, np.minimum.accumulate(best - steps) + steps, far)
    d = row[half + m - n]
    return 1.0 - min(int(d), max(n, m)) / max(n, m)


def banded_alignments(pairs: list[tuple[np.ndarray, np.ndarray]], band: int = 32) -> np.ndarray:
    """As banded_alignment for many pairs: pairs of like sizes are rows of one array, one step per word of the longest."""
    out = np.zeros(len(pairs))
    sizes = np.array([(len(a), len(b)) for a, b in pairs]).reshape(-1, 2)
    empty = sizes.min(axis=1) == 0
    out[empty] = (sizes[empty, 0] == sizes[empty, 1]).astype(float)
    todo = np.flatnonzero(~empty)
    half_of = band + np.abs(sizes[:, 0] - sizes[:, 1])
    order = todo[np.lexsort((sizes[todo, 0], half_of[todo] // 16))]
    at = 0
    while at < len(order):
        pick = order[at : at + 256]
        pick = pick[half_of[pick] // 16 == half_of[pick[0]] // 16]
        at += len(pick)
        n, m = sizes[pick, 0], sizes[pick, 1]
        half = int(half_of[pick].max())
        rows, width, far = len(pick), int(m.max()), int((n + m).max()) + 1
        other = np.zeros((rows, width + 1), dtype=np.uint64)
        own = np.zeros((rows, int(n.max())), dtype=np.uint64)
        for k, p in enumerate(pick):
            own[k, : n[k]], other[k, 1 : m[k] + 1] = pairs[p][0], pairs[p][1]
        offsets = np.arange(-half, half + 1)
        steps = np.arange(len(offsets))
        row = np.where((offsets >= 0) & (offsets <= m[:, None]), offsets, far).astype(np.int64)
        last = np.full(rows, far)
        for i in range(1, int(n.max()) + 1):
            j = offsets + i
            inside = (j >= 0) & (j <= m[:, None])
            same = other[:, np.clip(j, 0, width)] == own[:, i - 1 : i]
            swap = row + ~(same & (j >= 1))
            swap[:, j < 1] = far
            drop = np.concatenate([row[:, 1:], np.full((rows, 1), far)], axis=1) + 1
            best = np.where(inside, np.minimum(swap, drop), far)
            best[:, j == 0] = i
            row = np.where(inside, np.minimum.accumulate(best - steps, axis=1) + steps, far)
            ends = n == i
            if ends.any():
                last[ends] = row[ends, half + m[ends] - n[ends]]
        longest = np.maximum(n, m)
        out[pick] = 1.0 - np.minimum(last, longest) / longest
    return out


def _enough_words(content: Column) -> Column:
    w, g = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    return content.rlike(f"{w}{g}+{w}+{g}+{w}")


def content_hash(content: Column) -> Column:
    return F.xxhash64(content)


def _nodes(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, content, h0): one h0 for each content, and another for every other content."""
    nodes = df.select(df[id_col].cast("string").alias("id"), df[content_col].alias("content")).where(
        F.col("id").isNotNull() & F.col("content").isNotNull() & _enough_words(F.col("content"))
    ).withColumn("h0", content_hash(F.col("content")))
    second = nodes.select("h0", F.md5("content").alias("m")).groupBy("h0").agg(F.min("m").alias("low"), F.max("m").alias("high"))
    clash = second.where("low < high").select("h0", "low")
    if clash.isEmpty():
        return nodes
    own = F.when(F.col("low").isNull() | (F.md5("content") == F.col("low")), F.col("h0")).otherwise(F.xxhash64(F.md5("content"), F.lit(1)))
    return nodes.join(clash, "h0", "left").select("id", "content", own.alias("h0"))


def _keys(batches):
    words, seen = Words(), set()
    for whole in batches:
        for s in range(0, whole.num_rows, 4096):
            b = whole.slice(s, 4096)
            nodes = b.column(0).to_pylist()
            pick = []
            for i, h in enumerate(nodes):  # copies inside one task meet here
                if h not in seen:
                    seen.add(h)
                    pick.append(i)
            if not pick:
                continue
            texts = b.column(1).take(pa.array(pick)).to_pylist()
            who, keys = keys_of(texts, words)
            if len(who):
                node = np.array([nodes[i] for i in pick], dtype=np.int64)[who]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node)], names=["key", "h0"])


def _runs(batches):
    """Candidate pairs of runs of equal keys in sorted input; members of long runs come out with their number."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("nth", pa.int64())])
    run_key, run, count = None, [], 0
    a, b, ks, ns = [], [], [], []

    def close():
        nonlocal run, count
        if count > RUN:
            spill()
        else:
            for i in range(len(run)):
                for j in range(i + 1, len(run)):
                    a.append(run[i])
                    b.append(run[j])
                    ks.append(None)
                    ns.append(None)
        run, count = [], 0

    def spill():
        for i, h in enumerate(run):
            a.append(h)
            b.append(None)
            ks.append(run_key)
            ns.append(count - len(run) + i)

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip((a, b, ks, ns), (pa.int64(),) * 4)], schema=schema)
        for x in (a, b, ks, ns):
            x.clear()
        return out

    last = None
    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in (0, 1))
        n = len(key)
        if not n:
            continue
        # rows that neither continue nor start a run of two are alone
        nxt = np.r_[key[1:] == key[:-1], True]
        prv = np.r_[True, key[1:] == key[:-1]]
        for i in np.flatnonzero(nxt | prv).tolist():
            k, h = int(key[i]), int(node[i])
            if k != run_key:
                close()
                run_key, last = k, None
            if h == last:
                continue
            last = h
            run.append(h)
            count += 1
            if count > RUN and len(run) >= 4096:  # a long run never waits in memory
                spill()
                run = []
        if len(a) > 100_000:
            yield flush()
    close()
    yield flush()


def _columns(rows: list[tuple], alignment: bool) -> list:
    a, b, j, words = list(zip(*rows)) or [(), (), (), ()]
    return [a, b, j, banded_alignments(list(words)).tolist() if alignment else [None] * len(a)]


def _verify_pairs(threshold: float, alignment: bool):
    def run(batches):
        words = Words()
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                b = batch.slice(s, 2000)
                memory: dict[int, tuple] = {}
                rows = []
                for x, y, t, u in zip(*(b.column(i).to_pylist() for i in range(4))):
                    for h, text in ((x, t), (y, u)):
                        if h not in memory:
                            w = words.hashes(text)
                            memory[h] = (w, shingle_set(w))
                    (wa, sa), (wb, sb) = memory[x], memory[y]
                    if min(len(sa), len(sb)) < threshold * max(len(sa), len(sb)):
                        continue
                    j = jaccard(sa, sb)
                    if j >= threshold:
                        rows.append((x, y, j, (wa, wb)))
                cols = _columns(rows, alignment)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.float64())], names=["a", "b", "similarity", "edit_similarity"])

    return run


def _verify_blocks(threshold: float, alignment: bool):
    def run(t: pa.Table) -> pa.Table:
        words = Words()
        side, node, text = (t.column(c).to_pylist() for c in ("side", "h0", "content"))
        first, second = t.column("first")[0].as_py(), t.column("second")[0].as_py()
        left, right = {}, {}
        for s, h, x in zip(side, node, text):
            w = words.hashes(x)
            (left if s == 0 else right)[h] = (w, shingle_set(w))
        rows = []
        items = sorted((left if first == second else right).items(), key=lambda p: len(p[1][1]))
        for h, (wa, sa) in left.items():
            for g, (wb, sb) in items:
                if first == second and g <= h:
                    continue
                if h == g or min(len(sa), len(sb)) < threshold * max(len(sa), len(sb)):
                    continue
                j = jaccard(sa, sb)
                if j >= threshold:
                    rows.append((min(h, g), max(h, g), j, (wa, wb)))
        cols = _columns(rows, alignment)
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()),
                         "similarity": pa.array(cols[2], pa.float64()),
                         "edit_similarity": pa.array(cols[3], pa.float64())})

    return run


_PAIRS = "a bigint, b bigint, similarity double, edit_similarity double"


def _shingles(batches):
    words = Words()
    for whole in batches:
        for s in range(0, whole.num_rows, 500):
            b = whole.slice(s, 500)
            sets = [shingle_set(words.hashes(t)) for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            node = np.repeat(b.column(0).to_numpy(), sizes)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(node), pa.array(np.repeat(sizes, sizes))], names=["key", "h0", "n"])


def rare_keys(texts: DataFrame, threshold: float) -> DataFrame:
    """(key, h0): of each text (h0, content) the rarest shingles, so many that texts of the given similarity share one."""
    shingles = checkpoint(texts.select("h0", "content").mapInArrow(_shingles, "key bigint, h0 bigint, n bigint"))
    often = shingles.groupBy("key").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("h0").orderBy("often", "key"))
    prefix = shingles.join(often.where("often > 1"), "key").withColumn("place", place)
    # a shingle of one text alone joins nothing but takes its place among the rarest
    alone = shingles.join(often.where("often = 1"), "key", "left_semi").groupBy("h0").agg(F.count("*").alias("alone"))
    kept = F.col("place") + F.coalesce("alone", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * threshold) + 1
    return prefix.join(alone, "h0", "left").where(kept).select("key", "h0")


def _candidates(keys: DataFrame) -> DataFrame:
    """Pairs (key null) of runs up to ``RUN`` nodes, and the members of longer runs (a, key, nth)."""
    runs = keys.repartition("key").sortWithinPartitions("key", "h0").mapInArrow(_runs, "a bigint, b bigint, key bigint, nth bigint")
    return checkpoint(runs)  # small: candidates only; several readers follow


def _pairs_of(runs: DataFrame) -> DataFrame:
    return runs.where("key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def content_pairs(df: DataFrame, *, id_col="id", content_col="content", threshold=0.5, alignment=False) -> DataFrame:
    """(a, b, similarity, edit_similarity) between different contents, by their hashes; a < b."""
    return _content_pairs(_nodes(df, id_col, content_col), threshold, alignment)


def _content_pairs(nodes: DataFrame, threshold: float, alignment: bool) -> DataFrame:
    runs = _candidates(spread(nodes.select("h0", "content")).mapInArrow(_keys, "key bigint, h0 bigint"))
    pairs = _pairs_of(runs)
    texts = nodes.select("h0", "content").dropDuplicates(["h0"])
    crowd = runs.where("key is not null").select(F.col("a").alias("h0")).distinct()
    blocks = None
    if not crowd.isEmpty():
        again = _candidates(rare_keys(texts.join(crowd, "h0", "left_semi"), threshold))
        pairs = pairs.unionByName(_pairs_of(again))
        hot = again.where("key is not null").select("key", F.col("a").alias("h0"), F.floor(F.col("nth") / BLOCK).alias("block"))
        blocks = None if hot.isEmpty() else hot
    at_a, at_b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    wide = pairs.distinct().join(at_a, "a").join(at_b, "b").select("a", "b", "text_a", "text_b")
    found = wide.mapInArrow(_verify_pairs(threshold, alignment), _PAIRS)
    if blocks is not None:
        last = blocks.groupBy("key").agg(F.max("block").alias("last"))
        tasks = (
            blocks.join(last, "key")
            .withColumn("other", F.explode(F.expr("sequence(0, last)")))
            .select(
                "key", "h0", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
                F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
            )
        )
        wide = tasks.join(texts, "h0").select("key", "first", "second", "side", "h0", "content")
        more = wide.groupBy("key", "first", "second").applyInArrow(_verify_blocks(threshold, alignment), _PAIRS)
        found = found.unionByName(more).dropDuplicates(["a", "b"])
    return found


def near_duplicates(df: DataFrame, *, id_col="id", content_col="content", threshold=0.5, alignment=False) -> DataFrame:
    """(id_a, id_b, similarity[, edit_similarity]) of different ids; id_a is the smaller string."""
    nodes = _nodes(df, id_col, content_col)
    pairs = checkpoint(_content_pairs(nodes, threshold, alignment))  # the true pairs of different contents
    # The first ids of each content; the limit is applied in each task before the shuffle.
    ids = nodes.select("h0", "id").distinct()
    ranked = ids.withColumn("n", F.row_number().over(Window.partitionBy("h0").orderBy("id"))).where(F.col("n") <= EXPAND + 1)
    shared = checkpoint(ranked.groupBy("h0").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # at most EXPAND + 1 ids a content
    crowded = shared.where(F.size("ids") > EXPAND)
    # a crowded content stands for itself with its smallest id; its other ids hang on that one
    members = shared.select("h0", F.explode(F.when(F.size("ids") > EXPAND, F.slice("ids", 1, 1)).otherwise(F.col("ids"))).alias("id"))
    stars = crowded.select("h0", F.col("ids")[0].alias("id_a"))
    left, right = members.toDF("a", "x"), members.toDF("b", "y")
    cross = pairs.join(left, "a").join(right, "b").select("x", "y", "similarity", "edit_similarity")
    few = shared.where((F.size("ids") > 1) & (F.size("ids") <= EXPAND))
    same = few.select(F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y")).where("x < y").select(
        "x", "y", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("edit_similarity"))
    star = ids.join(stars, "h0").where("id <> id_a").select(
        F.col("id_a").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("edit_similarity"))
    every = cross.unionByName(same).unionByName(star)
    out = every.where("x <> y").select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity", "edit_similarity")
    return out if alignment else out.drop("edit_similarity")


def classes(df: DataFrame, pairs: DataFrame, *, id_col="id") -> DataFrame:
    """(id, class_id, links): connected components over the pairs; class_id is the smallest id of the class.

    Labels travel over links and are then shortened by pointer jumping, so that the number of rounds grows with the
    logarithm of a component's diameter; each round is two keyed joins, its result is checkpointed.
    """
    edges = pairs.select("id_a", "id_b").distinct()
    both = checkpoint(edges.select(F.col("id_a").alias("id"), F.col("id_b").alias("to")).unionByName(
        edges.select(F.col("id_b").alias("id"), F.col("id_a").alias("to"))))
    label = checkpoint(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("label"), F.count("*").alias("links")))
    while True:
        near = both.join(label.select(F.col("id").alias("to"), F.col("label").alias("other")), "to")
        low = near.groupBy("id").agg(F.min("other").alias("other"))
        moved = label.join(low, "id").select("id", "links", "label", F.least("label", "other").alias("new"))
        jump = moved.join(moved.select(F.col("id").alias("new"), F.col("new").alias("far")), "new", "left").select(
            "id", "links", "label", F.least("new", "far").alias("new"))
        jump = checkpoint(jump)
        changed = jump.where("new < label").limit(1).count()
        label = jump.select("id", F.col("new").alias("label"), "links")
        if not changed:
            break
    ids = df.select(df[id_col].cast("string").alias("id")).where("id is not null").distinct()
    return ids.join(label, "id", "left").select(
        "id", F.coalesce("label", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
