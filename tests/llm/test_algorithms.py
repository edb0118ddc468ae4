"""Vectors, near-duplicates, splitting, tokenising, leaks: against brute force, exact round trips and dirty input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import leakage, neardup, split, tokenize, vectors


# -- vectors ------------------------------------------------------------------------------------------------------------


def vec_frame(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<float>").withColumn("v", F.lit(1)).withColumn("cell", F.lit(1)).withColumn("x", F.lit("y"))


def brute(ids, x, k, floor):
    x = x.astype(np.float64)
    s = (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    out = set()
    for i in range(len(ids)):
        near = sorted((-round(s[i, j], 9), ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= floor)[:k]
        out |= {(ids[i], n) for _, n in near}
    return out


def clustered(seed, n, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dims)) * 0.25
    return (x * rng.uniform(0.2, 5, (n, 1))).astype(np.float32)


def near_of(spark, ids, x, **more):
    df = vec_frame(spark, [(i, v.tolist()) for i, v in zip(ids, x)])
    return {(r["id"], r["neighbour"]) for r in vectors.nearest(df, k=5, floor=0.85, **more).collect()}


def test_a_budget_without_limit_is_exact(spark):
    x = clustered(1, 300)
    ids = [f"v{i:04d}" for i in range(len(x))]
    assert near_of(spark, ids, x, budget=1e9) == brute(ids, x, 5, 0.85)
    assert vectors.stages(300, vectors.LEAF) == [5]  # the forest is used at every size


def test_forest_recall(spark):
    x = clustered(2, 3000)
    ids = [f"v{i:05d}" for i in range(len(x))]
    want = brute(ids, x, 5, 0.85)
    got = near_of(spark, ids, x)
    assert got <= want | {p for p in got if p[1] not in {q for i, q in want if i == p[0]}}
    assert len(got & want) / len(want) >= 0.99
    # without the queue and the other trees only one leaf is left
    assert len(near_of(spark, ids, x, trees=1, budget=0.0) & want) / len(want) < 0.9


def test_forest_in_stages_is_as_good_as_a_deep_one(spark):
    assert vectors.stages(1 << 30, 8192) == [8, 9] and sum(vectors.stages(10**12, 8192)) == 27
    x = clustered(3, 4000)
    ids = [f"v{i:05d}" for i in range(len(x))]
    want = brute(ids, x, 5, 0.85)
    deep, staged = (near_of(spark, ids, x, leaf=64, stage=n, sample=4000) for n in (6, 3))
    for got in (deep, staged):
        assert len(got & want) / len(want) >= 0.98


def test_leaves_within_a_budget():
    x = clustered(4, 500)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = vectors.unpack(vectors.pack(vectors.fit_tree(x, 4, np.random.default_rng(1))), 64)
    row, leaf, cost = vectors.leaves_within(x, tree, np.zeros(500, np.float32), 0.01)
    costs = np.zeros((500, 1), np.float32)  # every leaf's cost, by plain expansion
    for w, c in tree:
        m = x @ w.T - c
        costs = np.stack([costs + np.where(m >= 0, m * m, 0), costs + np.where(m < 0, m * m, 0)], axis=2).reshape(500, -1)
    assert {(r, n) for r, n in zip(row.tolist(), leaf.tolist())} == {(r, n) for r, n in zip(*map(list, np.nonzero(costs <= 0.01)))}
    assert (costs[np.arange(500), leaf[:500]] == 0).all() and np.allclose(costs[row, leaf], cost, atol=1e-6)


def test_vector_dirt_ties_and_crowded_copies(spark):
    one = [1.0] + [0.0] * 63
    rows = [(f"c{i:03d}", one) for i in range(40)] + [("c000", one), ("n", None), ("z", [0.0] * 64), ("s", [1.0] * 63), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [0.0] * 63),
                                                     (None, one), ("o", [0.0, 1.0] + [0.0] * 62), ("e", [])]
    got = {}
    for r in vectors.nearest(vec_frame(spark, rows), k=5, floor=0.85).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert set(got) == {f"c{i:03d}" for i in range(40)}
    assert sorted(got["c000"]) == [f"c{i:03d}" for i in range(1, 6)] and sorted(got["c039"]) == [f"c{i:03d}" for i in range(5)]
    assert vectors.nearest(vec_frame(spark, rows).limit(0)).count() == 0


# -- near-duplicates ------------------------------------------------------------------------------------------------------


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(9999)}" for w in words]


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    rows = []
    for g in range(60):
        n = rng.choice([3, 4, 6, 12, 20, 30, 60, 150])
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        for k in range(4):
            words = edited(rng, base, rng.choice([0, 0.02, 0.06, 0.12]))
            if k == 3 and n > 40:
                words = words[n // 2 :] + words[: n // 2]
            rows.append((f"g{g}_{k}", " ".join(words)))
    return rows


def jaccard_pairs(rows, threshold=0.5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        if i is not None and len(w) >= 3:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def near_frame(spark, rows):
    return spark.createDataFrame(rows, "id string, content string").withColumn("h0", F.lit(1)).withColumn("key", F.lit("k")).withColumn("a", F.lit(2))


def test_near_duplicates_against_brute_force(spark, near_rows):
    rows = near_rows + [("g0_0", near_rows[0][1]), ("null", None), ("blank", "  "), ("two", "one two"), (None, near_rows[0][1]), ("long", "alpha beta " * 20_000), ("long2", "alpha beta " * 20_001)]
    want = jaccard_pairs(rows)
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(near_frame(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_keys_do_not_depend_on_the_batch(near_rows):
    words = neardup.Words()
    texts = [t for _, t in near_rows] + ["again and again and again and again and again and again and so on to the end of it " * 3]
    who, keys = neardup.keys_of(texts, words)
    for i, t in enumerate(texts):
        assert sorted(keys[who == i].tolist()) == sorted(neardup.keys_of([t], words)[1].tolist())


@pytest.mark.parametrize("words,times", [(20, 3), (40, 2), (60, 5), (150, 3)])
def test_a_paragraph_and_its_copies_share_a_key(words, times):
    rng = random.Random(words)
    for _ in range(20):
        text = " ".join(f"w{rng.randrange(4000)}" for _ in range(words))
        who, keys = neardup.keys_of([text, " ".join([text] * times)], neardup.Words())
        assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_equal_words_share_a_key():
    who, keys = neardup.keys_of(["so " * 4, "so " * 10, "so " * 100], neardup.Words())
    assert all(set(keys[who == i].tolist()) == set(keys[who == 0].tolist()) for i in (1, 2))


def test_hot_keys_are_compared_in_blocks(spark, near_rows, monkeypatch):
    rng = random.Random(6)
    base = [f"h{i}" for i in range(60)]
    rows = [(f"x{i:03d}", " ".join(edited(rng, base, 0.03))) for i in range(150)]
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(near_frame(spark, rows)).collect()}
    want = jaccard_pairs(rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_copies_star_and_classes(spark):
    text = "the same five words again and again"
    rows = [(f"k{i:03d}", text) for i in range(neardup.EXPAND + 20)] + [("other", "nothing in common with that one here"), ("null", None)]
    pairs = neardup.near_duplicates(near_frame(spark, rows))
    got = {(r["id_a"], r["id_b"]) for r in pairs.collect()}
    assert got == {("k000", f"k{i:03d}") for i in range(1, neardup.EXPAND + 20)}
    cls = {r["id"]: (r["class_id"], r["links"]) for r in neardup.classes(near_frame(spark, rows), pairs).collect()}
    assert cls["k050"] == ("k000", 1) and cls["other"] == ("other", 0) and cls["null"] == ("null", 0)
    assert neardup.near_duplicates(near_frame(spark, rows).limit(0)).count() == 0


def test_chain_is_one_class(spark):
    pairs = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)], "id_a string, id_b string")
    ids = spark.createDataFrame([(f"n{i:02d}",) for i in range(21)] + [("z",)], "id string")
    assert {r["class_id"] for r in neardup.classes(ids, pairs).collect()} == {"n00", "z"}


def test_a_phrase_in_many_records_brings_together_only_what_is_alike(spark, monkeypatch):
    rng = random.Random(8)
    licence = " ".join(f"clause{i}" for i in range(30))
    body = lambda n: " ".join(f"b{rng.randrange(10**6)}" for _ in range(n))
    rows = [(f"l{i:03d}", f"{licence} {body(60)}") for i in range(200)]
    twins = [(f"t{i}", rows[i][1] + " and a few words more") for i in range(0, 40, 4)]
    seen = []
    real = neardup._candidates
    monkeypatch.setattr(neardup, "_candidates", lambda keys: seen.append(real(keys)) or seen[-1])
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(near_frame(spark, rows + twins)).collect()}
    assert got == jaccard_pairs(rows + twins) and len(got) == 10
    assert seen[0].where("key is not null").count() > 0 and len(seen) == 2  # the licence is a hot key
    assert seen[1].where("key is not null").count() == 0 and neardup._pairs_of(seen[1]).distinct().count() < 100


def test_rare_keys_lose_no_pair(spark, near_rows):
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(near_rows)], "h0 bigint, content string")
    keys = {}
    for r in neardup.rare_keys(frame, 0.5).collect():
        keys.setdefault(r["key"], set()).add(r["h0"])
    at = {i: n for n, (i, _) in enumerate(near_rows)}
    for a, b in jaccard_pairs(near_rows):
        assert any({at[a], at[b]} <= m for m in keys.values())


def test_contents_that_share_a_hash(spark, near_rows, monkeypatch):
    monkeypatch.setattr(neardup, "content_hash", lambda c: F.length(c).cast("bigint"))
    rows = near_rows[:60]
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(near_frame(spark, rows)).collect()}
    assert len({len(t) for _, t in rows}) < len({t for _, t in rows})
    lost = jaccard_pairs(rows) - got
    assert got <= jaccard_pairs(rows) and all(len(dict(rows)[x]) for p in lost for x in p)


def test_reordered_records_meet(spark):
    rng = random.Random(9)
    rows = []
    for g in range(30):
        parts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(8)) for _ in range(8)]
        rows += [(f"a{g:02d}", " ".join(parts)), (f"b{g:02d}", " ".join(parts[::-1]))]
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(near_frame(spark, rows)).collect()}
    assert got == jaccard_pairs(rows) and len(got) == 30


def test_banded_alignment():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    rng = random.Random(3)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        want = 1 - distance(a, b) / max(len(a), len(b), 1) if a and b else float(len(a) == len(b))
        assert neardup.banded_alignment(np.array(a), np.array(b)) == pytest.approx(want)


def test_alignments_of_many_pairs(spark, near_rows):
    rng = random.Random(13)
    pairs = []
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 70))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 70))] if rng.random() < 0.5 else [x if rng.random() < 0.8 else 9 for x in a]
        pairs.append((np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)))
    assert neardup.banded_alignments(pairs) == pytest.approx([neardup.banded_alignment(a, b) for a, b in pairs])
    got = neardup.near_duplicates(near_frame(spark, near_rows), alignment=True).collect()
    assert got and all(0 <= r["edit_similarity"] <= 1 and r["similarity"] >= 0.5 for r in got)


# -- splitting --------------------------------------------------------------------------------------------------------------

TEXTS = ["a" * 10_000, "x y " * 3000, "e\u0301" * 4000, "\r\n" * 5000, "中文。" * 3000, ("para one. " * 30 + "\n\n") * 60, "# H\n\n" + "word " * 900 + "\n\n## K\n\n" + "line\n" * 900, "\u200d" * 6000]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_cover_and_overlap(text):
    p = split.pieces_of(text, 3, "head")
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(0 < e - s <= split.LIMIT for s, e, *_ in p)
    assert all(b[0] == a[1] - split.OVERLAP for a, b in zip(p, p[1:]))
    assert text[: p[0][1]] + "".join(text[s + split.OVERLAP : e] for s, e, *_ in p[1:]) == text
    assert all(a == 3 + text[:s].count("\n") for s, e, a, *_ in p)


def test_program_is_optimal_on_small_texts():
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice(["ab ", "cd. ", "e, ", "\n", "\n\n"]) for _ in range(14))
        limit, overlap = 16, 3
        if len(text) <= limit:
            continue
        at, cost, _ = split.boundaries(text, limit - overlap)
        at, cost = [*at.tolist(), len(text)], [*cost.tolist(), 0]
        n = -(-(len(text) - overlap) // (limit - overlap))
        mean = (len(text) - overlap) / n

        def total(ends):
            prev, c = overlap, 0.0
            for e in ends:
                c += cost[at.index(e)] + split.PER_PIECE + split.BALANCE * ((e - prev - mean) / mean) ** 2
                prev = e
            return c

        best = [float("inf")]

        def walk(ends, prev, first):
            if ends and ends[-1] == len(text):
                best[0] = min(best[0], total(ends))
                return
            for e in at:
                if e > prev and (e <= limit and e > overlap if first else e - prev <= limit - overlap):
                    walk([*ends, e], e, False)

        walk([], 0, True)
        if best[0] < float("inf"):
            assert total(split.cuts(text, limit, overlap)) == pytest.approx(best[0])


def test_split_prefers_headings_and_dirt(spark):
    text = "intro " * 200 + "\n\n## Next\n\n" + "body " * 200
    assert text[split.cuts(text)[0] :].startswith("## Next")
    rows = [("a", text, 5), ("b", None, 1), ("c", "", None), ("d", "short", 0), ("e", text, None), ("a", text, 5), (None, text, 1)]
    df = spark.createDataFrame(rows, "id string, content string, start_line int").withColumn("piece", F.lit(1)).withColumn("heading", F.lit("h")).withColumn("line", F.lit("x"))
    got = split.split_oversized(df, line_col="start_line", heading_col="heading").collect()
    assert {r["id"] for r in got} == {"a", "e", None} and len(got) == 8
    assert [r["heading"] for r in got if r["id"] == "e"] == ["h", "Next"]
    assert split.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(df, limit=300)


# -- tokenising -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_tokenizer():
    import os

    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.join(os.path.dirname(tokenize.DEFAULT_RANKS), "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


HARD = ["", " ", "a", "a" * 5000, " " * 4097, "\n\n\t x", "it's  ''s don't I'LL", "<|endoftext|> hi", "x\x85y\x1cz", "中文没有空格" * 50, "é e\u0301 ﬁ", "👩\u200d💻" * 40, "  lead", "trail  ", "１２３ ①②", "a\u00a0b\u3000c", "़ि", "0" * 64]


def test_encoding_equals_the_reference(reference_tokenizer):
    rng = random.Random(8)
    texts = HARD + ["".join(rng.choice("ab cdé中\n \t'.,0🙂") for _ in range(rng.randrange(200))) for _ in range(300)]
    want = [e.ids for e in reference_tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokenize.tokenizer().encode_batch(texts) == want


def test_array_trees_equal_scalar_trees(reference_tokenizer):
    rng = random.Random(9)
    b = tokenize.tokenizer()
    words = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(9, 16))).encode() for _ in range(200)]
    assert b.encode_class(words) == [b.encode_word(w) for w in words]
    inverse = {v: k for k, v in b.ranks.items()}
    assert [b"".join(inverse[i] for i in ids) for ids in b.encode_class(words)] == words


def test_encode_frame(spark, reference_tokenizer):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (4, "w" * 300_000)], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = [(r["doc_id"], list(r["ids"])) for r in tokenize.encode(df).collect()]
    assert (1, []) in got and (2, []) in got and got.count((3, [31373, 995])) == 2 and len(got) == 6
    assert tokenize.encode(df.limit(0)).count() == 0


# -- leaks ------------------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, window=12):
    w = lambda t: [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
    grams = {}
    for i, *texts in items:
        for t in texts:
            ws = w(t)
            for k in range(len(ws) - window + 1):
                grams.setdefault(tuple(ws[k : k + window]), set()).add(i)
    out = set()
    for d, t in docs:
        ws = w(t)
        for k in range(len(ws) - window + 1):
            out |= {(d, i) for i in grams.get(tuple(ws[k : k + window]), ())}
    return out


def leak_frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("spans", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, question string, passage string").withColumn("text", F.lit("t")).withColumn("doc_id", F.lit(1))
    return d, i


@pytest.fixture(scope="module")
def leak_data():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(40)]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(22)), " ".join(rng.choice(vocab) for _ in range(60)) if n % 5 else None) for n in range(30)]
    docs = []
    for n in range(300):
        words = [rng.choice(vocab + ["Other", "x_y"]) for _ in range(rng.randrange(0, 80))]
        if n % 3 == 0:
            it = items[rng.randrange(30)]
            src = (it[2] or it[1]).split()
            a = rng.randrange(0, len(src) - 11)
            words[10:10] = [s.upper() + rng.choice(["", ",", " -"]) for s in src[a : a + rng.randrange(10, 16)]]
        docs.append((n, " ".join(words)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[0][1]), (903, "z " * 5000 + items[1][1])]
    items += [(77, None, None), (None, items[2][1], None), (78, items[3][1], ""), (79, "too short", " ")]
    return docs, items


@pytest.mark.parametrize("shard,block", [(400_000, 8_000_000), (300, 500)])
def test_leaks_against_brute_force(spark, leak_data, shard, block):
    docs, items = leak_data
    d, i = leak_frames(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i, shard_words=shard, block_chars=block).select("doc_id", "item_id").collect()}
    want = brute_leaks([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None])
    assert got == want and len(want) > 50


def test_spans_are_removed(spark, leak_data):
    docs, items = leak_data
    d, i = leak_frames(spark, [x for x in docs if x[0] is not None and x[0] != 902], items)
    clean = leakage.without_leaks(d, leakage.leaks(d, i))
    assert clean.count() == d.count()
    left = brute_leaks([(r["doc_id"], r["text"]) for r in clean.collect()], [x for x in items if x[0] is not None])
    assert not left
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(0, 5, 500), 0]
    fm = leakage.FmIndex(text, 5)
    for n in (1, 2, 4):
        phrases = np.array([rng.integers(0, 5, n) for _ in range(30)])
        who, low, high = fm.search(phrases)
        hits = dict(zip(who.tolist(), zip(low.tolist(), high.tolist())))
        for k, p in enumerate(phrases):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            a, b = hits.get(k, (0, 0))
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want
