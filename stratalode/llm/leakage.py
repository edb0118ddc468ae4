"""Evaluation texts inside training texts, by an FM-index per shard of the corpus.

A shard is a bounded number of words of consecutive documents. Its words become symbols: 0 ends a document, 1 is any
word that no evaluation text holds, the others are the evaluation vocabulary. The shard's suffixes are sorted by prefix doubling,
their Burrows-Wheeler transform goes into a wavelet matrix, and all windows of ``window`` consecutive words of the
evaluation texts are searched backwards at once through its ranks. Occurrences are located by walking to the next
sampled suffix position; overlapping occurrences of one item merge into spans that can be removed.

The evaluation side is a stated, small set: it is collected in blocks of at most ``block_chars`` characters of text, and the
corpus is read once per block, so neither the broadcast nor a worker's memory grows with it. The corpus side is a narrow map:
no shuffle. A document longer than a shard is cut into parts that share ``window - 1`` words.

Defined results: words are the longest runs of letters and digits, in lower case; null, empty and blank texts and items
hold no window; texts of fewer than ``window`` words never match; repeated documents are reported under each id;
items that share a passage are all reported; spans count characters of the text from 1, the end inclusive; extra columns
are not carried.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

WINDOW = 12
SHARD_WORDS = 400_000
SAMPLE_RATE = 8
BLOCK_CHARS = 8_000_000

_WORDS = re.compile(r"[^\W_]+")
_LOWER_LONGER = re.compile("[İ]")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)] if _LOWER_LONGER.search(text) else _WORDS.findall(text.lower())


class Phrases:
    """All windows of the evaluation texts, as symbol rows, with the items that hold them."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        self.symbol: dict[str, int] = {}
        grams: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            s = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words_of(text)]
            for i in range(len(s) - window + 1):
                grams.setdefault(tuple(s[i : i + window]), set()).add(item)
        self.rows = np.array(list(grams), dtype=np.int32).reshape(-1, window)
        self.items = [sorted(v) for v in grams.values()]
        self.size = len(self.symbol) + 2


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Positions of the suffixes in order; prefix doubling, from the second round on only where ranks are not unique."""
    n = len(s)
    bits = max(1, int(size).bit_length())
    first = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(first, dtype=np.int64)])
    bits = max(bits, int(size + 1).bit_length())
    first = max(1, 62 // bits)
    for i in range(first):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # rank = place of the group's head
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    step = first
    while True:
        alone = fresh & np.r_[fresh[1:], True]
        todo = np.flatnonzero(~alone)
        if not len(todo):
            return order
        pos = order[todo]
        nxt = pos + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        head = rank[pos]
        o = np.argsort(head * (n + 1) + second, kind="stable")
        pos, head, second = pos[o], head[o], second[o]
        order[todo] = pos
        new = np.r_[True, (head[1:] != head[:-1]) | (second[1:] != second[:-1])]
        heads = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
        fresh[todo] = new
        rank[pos] = heads
        step *= 2


class WaveletMatrix:
    """Rank of a symbol in a prefix, for many symbols and prefixes at once."""

    def __init__(self, s: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.zeros, self.ones_before, self.starts = [], [], None
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            count = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones_before.append(count)
            self.zeros.append(len(s) - int(count[-1]))
            s = np.concatenate([s[~bit], s[bit]])
        # after the last level equal symbols stand together
        heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        self.start = np.full(size, 0, dtype=np.int64)
        if len(s):
            self.start[s[heads]] = heads

    def rank(self, symbol: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        at = prefix
        for depth in range(self.levels):
            bit = (symbol >> (self.levels - 1 - depth) & 1).astype(bool)
            ones = self.ones_before[depth][at]
            at = np.where(bit, self.zeros[depth] + ones, at - ones)
        return at - self.start[symbol]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its rank before the place) at each place."""
        at, symbol = place, np.zeros(len(place), dtype=np.int64)
        for depth in range(self.levels):
            count = self.ones_before[depth]
            ones = count[at]
            bit = (count[at + 1] - ones).astype(bool)
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[depth] + ones, at - ones)
        return symbol, at - self.start[symbol]


class FmIndex:
    def __init__(self, text: np.ndarray, size: int, rate: int = SAMPLE_RATE):
        """text ends with its only symbol of least order among suffixes: the end counts as less than any symbol."""
        n = len(text)
        sa = suffix_array(text, size)
        # the empty suffix comes first; the row of the whole text has the end mark before it
        sa = np.r_[n, sa]
        self.end_row = int(np.flatnonzero(sa == 0)[0])
        bwt = np.where(sa > 0, text[np.maximum(sa - 1, 0)], 0).astype(np.int64) + 1
        bwt[self.end_row] = 0  # the end mark
        self.matrix = WaveletMatrix(bwt, size + 1)
        counts = np.bincount(bwt, minlength=size + 1)
        self.before = np.r_[0, np.cumsum(counts)]
        self.is_sampled = sa % rate == 0
        self.sample_rank = np.cumsum(self.is_sampled) - 1
        self.samples = sa[self.is_sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase numbers, low, high) of the phrases that occur: rows [low, high) of the suffix order."""
        who = np.arange(len(phrases))
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.is_sampled), dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[who, k].astype(np.int64) + 1
            low = self.before[c] + self.matrix.rank(c, low)
            high = self.before[c] + self.matrix.rank(c, high)
            live = low < high
            who, low, high = who[live], low[live], high[live]
            if not len(who):
                break
        return who, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the next sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.is_sampled[at]
            out[todo[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, rank = self.matrix.access(at)
                at = self.before[symbol] + rank
                steps += 1
        return out


def search_shard(parts: list[tuple[int, np.ndarray]], phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """(part's index, item, first word, last word) of merged spans; parts are symbol arrays of documents."""
    ends = np.cumsum([len(p) + 1 for _, p in parts])
    text = np.zeros(int(ends[-1]), dtype=np.int64)
    at = 0
    for _, p in parts:
        text[at : at + len(p)] = p
        at += len(p) + 1
    index = FmIndex(text, phrases.size)
    who, low, high = index.search(phrases.rows)
    if not len(who):
        return []
    count = high - low
    rows = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
    where = index.locate(rows)
    which = np.repeat(who, count)
    doc = np.searchsorted(ends, where, side="right")
    starts = np.r_[0, ends[:-1]]
    hits = []
    for d, w, p in zip(doc.tolist(), (where - starts[doc]).tolist(), which.tolist()):
        hits += [(d, item, w) for item in phrases.items[p]]
    hits.sort()
    out: list[list[int]] = []
    for d, item, w in hits:
        if out and out[-1][0] == d and out[-1][1] == item and w <= out[-1][3] + 1:
            out[-1][3] = w + phrases.window - 1
        else:
            out.append([d, item, w, w + phrases.window - 1])
    return [tuple(o) for o in out]


def leaks(
    docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id",
    fields: tuple[str, ...] = ("question", "passage"), window: int = WINDOW, shard_words: int = SHARD_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, spans): the documents that hold ``window`` consecutive words of an item's fields.

    spans: array of (start, end) characters of the text, merged per item, from 1, the end inclusive.
    """
    spark = docs.sparkSession
    long = items.select(
        F.col(item_col).cast("long").alias("item"), F.explode(F.array(*[F.col(f) for f in fields])).alias("text")
    ).where("item is not null and text is not null")
    out, now, size = [], [], 0
    for r in long.orderBy("item").toLocalIterator():  # streams; a block leaves the driver's memory as soon as it is broadcast
        now.append((r["item"], r["text"]))
        size += len(r["text"])
        if size >= block_chars:
            out.append(_block(spark, docs, now, id_col, text_col, window, shard_words))
            now, size = [], 0
    if now or not out:
        out.append(_block(spark, docs, now, id_col, text_col, window, shard_words))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    if len(out) > 1:
        found = found.groupBy("doc_id", "item_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return found


_BUILT: dict[str, Phrases] = {}


def _phrases(key: str, items, window: int) -> Phrases:
    """The phrases of a block, built once in each worker process; only the latest block is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Phrases(items(), window)
    return _BUILT[key]


def _block(spark, docs, items, id_col, text_col, window, shard_words) -> DataFrame:
    shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        phrases = _phrases(key, lambda: shared.value, window)
        symbol, known = phrases.symbol.get, phrases.symbol
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()),
                            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        parts, ids, texts, first_word, held = [], [], [], [], 0

        def close():
            nonlocal held
            if not parts:
                return None
            spans: dict[tuple[int, int], list] = {}
            for part, item, a, b in search_shard(parts, phrases):
                d = parts[part][0]
                spans.setdefault((d, item), []).append((a + first_word[part], b + first_word[part]))
            rows = []
            for (d, item), found in spans.items():
                places = [m.span() for m in _WORDS.finditer(texts[d])]
                merged: list[list[int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                rows.append((ids[d], item, [{"start": places[a][0] + 1, "end": places[b][1]} for a, b in merged]))
            parts.clear(), ids.clear(), texts.clear(), first_word.clear()
            held = 0
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        if not len(phrases.rows):
            return
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or doc is None:
                    continue
                words = words_of(text)
                if len(words) < window:
                    continue
                s = np.array([symbol(w, 1) for w in words], dtype=np.int64)
                ids.append(doc)
                texts.append(text)
                for a in range(0, max(1, len(s) - window + 1), shard_words):
                    piece = s[a : a + shard_words + window - 1]
                    parts.append((len(ids) - 1, piece))
                    first_word.append(a)
                    held += len(piece) + 1
                if held >= shard_words:
                    out = close()
                    if out is not None and out.num_rows:
                        yield out
        out = close()
        if out is not None and out.num_rows:
            yield out

    slim = spread(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")))
    return slim.mapInArrow(run, "doc_id bigint, item_id bigint, spans array<struct<start: int, end: int>>")


def without_leaks(docs: DataFrame, found: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, text) with all leaked spans taken out; documents without leaks as they are."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(spans, "doc_id", "left")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] > s["at"], F.concat(s["out"], F.substring(F.col("text"), s["at"], x["start"] - s["at"])))
            .otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"] + 1).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"], F.length(F.col("text")))),
    )
    return rows.select(F.col("doc_id").alias(id_col), F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut).alias(text_col))
