"""Encoding of text by a public byte-level BPE vocabulary (rank file), by segment trees over adjacent pairs.

Every word's merges run on a segment tree whose leaves hold, for each position, ``rank << SHIFT | position`` of the
pair that starts there. The root is therefore the leftmost lowest-rank merge; a merge changes three leaves, each
update walks one path to the root, and the word is done once the root holds no pair: O(n log n) for any length.
Words of one batch are encoded together: trees of one size class are rows of one array, and each round performs one
merge in every unfinished word. Few, long words take the same tree in scalar form.

Two exact caches make repeated text cheap: blank-delimited stretches -> ids and words -> ids. They are bounded in
memory (emptied when full), which never changes a result.

Defined results: null and empty text give an empty list; special tokens' strings are ordinary text;
lone surrogates cannot occur in Spark strings; repeated rows are encoded each for itself.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from ..session import spread

#: Where the public rank files lie; a parameter, the files are never copied.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of this vocabulary family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SHIFT = 42  # rank and position in one number: 20 and 42 bits, more than any text has bytes
_MASK = (1 << _SHIFT) - 1
_INF = np.iinfo(np.int64).max
_CACHE_LIMIT = 400_000
#: From this number of words of one size class on the array form is used.
_ARRAY_FROM = 48

# A blank-delimited stretch: one optional blank and non-space characters, or a run of spaces that leaves the last one
# to the next stretch. Each word of PATTERN lies inside one stretch, since a word holds a space only at its start.
_STRETCH = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Characters on which the two regex modules do not agree whether they are spaces.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85᠎​]")


class Bpe:
    """A vocabulary with its pair table; one per worker process."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if len(self.ranks) >= 1 << 20:
            raise ValueError("ids beyond 20 bits")
        get = self.ranks.get
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        self.byte_array = np.array(self.byte, dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}

    # -- one word, scalar tree ------------------------------------------------------------------------------------

    def encode_word(self, data: bytes) -> tuple[int, ...]:
        n = len(data)
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if n < 2:
            return tuple(self.byte[b] for b in data)
        token = [self.byte[b] for b in data]
        pair = self.pairs.get
        size = 1 << (n - 1).bit_length()
        none = 1 << 60
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = pair(token[i] << 20 | token[i + 1])
            if r is not None:
                tree[size + i] = r << _SHIFT | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        while (root := tree[1]) < none:
            i = root & _MASK
            token[i] = root >> _SHIFT
            gone = after[i]
            right = after[gone]
            after[i] = right
            put(gone, none)
            value = none
            if right < n:
                before[right] = i
                r = pair(token[i] << 20 | token[right])
                if r is not None:
                    value = r << _SHIFT | i
            put(i, value)
            left = before[i]
            if left >= 0:
                r = pair(token[left] << 20 | token[i])
                put(left, none if r is None else r << _SHIFT | left)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return tuple(out)

    # -- many words of one size class, one tree per row -----------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_class(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """All words have at least 2 bytes and fit one power of two of leaves."""
        count = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=count)
        size = 1 << int(lengths.max() - 1).bit_length()
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        col = np.arange(size)
        inside = col < lengths[:, None]
        token = np.zeros((count, size), dtype=np.int64)
        token[inside] = self.byte_array[flat]
        after = np.tile(np.arange(1, size + 1), (count, 1))
        before = np.tile(np.arange(-1, size - 1), (count, 1))
        tree = np.full((count, 2 * size), _INF)
        leaf = np.full((count, size), _INF)
        r = self._rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(count, size - 1)
        usable = (r >= 0) & inside[:, 1:]
        leaf[:, :-1][usable] = (r << _SHIFT | col[:-1])[usable]
        tree[:, size:] = leaf
        width = size
        while width > 1:
            half = width // 2
            tree[:, half:width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width = half

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            at = at + size
            tree[rows, at] = value
            at = at >> 1
            while at[0] > 0:
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                at = at >> 1

        rows = np.flatnonzero(tree[:, 1] < _INF)
        while len(rows):
            root = tree[rows, 1]
            i = root & _MASK
            token[rows, i] = root >> _SHIFT
            gone = after[rows, i]
            right = after[rows, gone]
            after[rows, i] = right
            put(rows, gone, _INF)
            has = right < lengths[rows]
            rr, ir, rt = rows[has], i[has], right[has]
            before[rr, rt] = i[has]
            value = np.full(len(rows), _INF)
            if len(rr):
                r = self._rank(token[rr, ir], token[rr, rt])
                value[has] = np.where(r >= 0, r << _SHIFT | ir, _INF)
            put(rows, i, value)
            left = before[rows, i]
            has = left >= 0
            if has.any():
                rl, ll = rows[has], left[has]
                r = self._rank(token[rl, ll], token[rl, i[has]])
                put(rl, ll, np.where(r >= 0, r << _SHIFT | ll, _INF))
            rows = rows[tree[rows, 1] < _INF]
        alive = np.zeros((count, size + 1), dtype=bool)
        alive[:, 0] = True
        # a position is alive if the list reaches it: it is the successor of an alive one
        at, live = np.zeros(count, dtype=np.int64), np.arange(count)
        while len(live):
            at = after[live, at]
            keep = at < lengths[live]
            live, at = live[keep], at[keep]
            alive[live, at] = True
        kept = token[alive[:, :size]].tolist()
        ends = np.cumsum(alive[:, :size].sum(1)).tolist()
        out, start = [], 0
        for end in ends:
            out.append(tuple(kept[start:end]))
            start = end
        return out

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of all words into the cache."""
        if len(self.words) + len(words) > _CACHE_LIMIT:
            self.words.clear()
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                self.words[w] = (whole,)
            elif len(data) < 2:
                self.words[w] = (self.byte[data[0]],)
            else:
                classes.setdefault((len(data) - 1).bit_length(), []).append((w, data))
        for k, group in classes.items():
            if len(group) < _ARRAY_FROM or k > 12:
                for w, data in group:
                    self.words[w] = self.encode_word(data)
                continue
            step = max(_ARRAY_FROM, (1 << 21) >> k)  # bounds the arrays to some ten MB each
            for s in range(0, len(group), step):
                part = group[s : s + step]
                for (w, _), ids in zip(part, self.encode_class([x for _, x in part])):
                    self.words[w] = ids

    # -- texts ----------------------------------------------------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.stretches) > _CACHE_LIMIT:
            self.stretches.clear()
        known = self.stretches
        parts, new = [], set()
        for t in texts:
            if not t:
                parts.append(())
                continue
            p = self.split(t) if _ODD_SPACE.search(t) else _STRETCH.findall(t)
            parts.append(p)
            for s in p:
                if s not in known:
                    new.add(s)
        if new:
            split = self.split
            cut = {s: split(s) for s in new}
            words = {w for ws in cut.values() for w in ws}
            missing = [w for w in words if w not in self.words]
            if len(self.words) + len(missing) > _CACHE_LIMIT:
                missing = list(words)
            self.encode_words(missing)
            get = self.words
            for s, ws in cut.items():
                known[s] = get[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable([get[w] for w in ws]))
        return [list(chain.from_iterable([known[s] for s in p])) for p in parts]


_LOADED: dict[str, Bpe] = {}


def tokenizer(ranks_path: str = DEFAULT_RANKS) -> Bpe:
    if ranks_path not in _LOADED:
        _LOADED[ranks_path] = Bpe(ranks_path)
    return _LOADED[ranks_path]


def _near(ranks_path: str) -> str:
    """The rank file on this machine: at its path, or where the job's own copy was put."""
    return ranks_path if os.path.exists(ranks_path) else SparkFiles.get(os.path.basename(ranks_path))


def encode(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str = "ids", ranks_path: str = DEFAULT_RANKS
) -> DataFrame:
    """(id, ids) of every row; a narrow map over the two columns it reads, no shuffle."""
    slim = spread(df.select(df[id_col], df[text_col]))
    kind = slim.schema[id_col].dataType.simpleString()
    if os.path.exists(ranks_path):  # goes with the job to workers that do not have it
        df.sparkSession.sparkContext.addFile(ranks_path)

    def run(batches):
        bpe = tokenizer(_near(ranks_path))
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, out])

    return slim.mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>")
