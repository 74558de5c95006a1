"""The grid against a plain quadtree, the ranking against brute force, and defined results."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from lakebuild.llm import k2treap_rank as k2

from .conftest import DOCS, ODD

TERM = __import__("re").compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(items, docs, k=20):
    """[(item, rank, doc_id, score)] with scores as the contract defines them."""
    tf = [(i, Counter(terms(t))) for i, t, *_ in docs if i is not None]
    n_docs, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    texts = {}
    for i, t in items:
        if i is not None:
            texts.setdefault(i, []).append(t)
    out = []
    for i, ts in texts.items():
        asked = Counter(terms(min((t for t in ts if t is not None), default=None)))
        scored = []
        for d, c in tf:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(1, total)
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scored.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "ÜBER", "naïve", "日本", "x9", "a\x7fb", "a_b", "a-b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "\n", ", ", "\x00"]).join(rng.choices(words, weights, k=rng.randint(0, 60))), "s") for i in range(1000, 1000 + n)]
    docs += [(2000 + i, docs[3][1], "s") for i in range(30)]  # copies: ties
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 15)))) for i in range(12)]
    return items, docs + ODD


def test_terms_match_the_pattern():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice([chr(rng.randrange(0, 128)), rng.choice("éß日🙂\x80  "), "A", "z"]) for _ in range(30))
        assert [x.decode() for x in k2.terms_of(t.encode())] == terms(t)
    assert k2.terms_of(None) == k2.terms_of(b"") == []


@pytest.mark.parametrize("depth", [1, 3, 9, 17])
def test_cells_hold_the_maxima(depth):
    """Every pointer path meets the largest value of its square, and empty squares are absent."""
    rng = np.random.default_rng(depth)
    side = 1 << depth
    points = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, side, 200), rng.integers(0, side, 200), rng.integers(1, 1000, 200))}
    row, col = (np.array(x) for x in zip(*points))
    best, bits = k2.build_cells(row, col, np.array(list(points.values())), depth)
    shard = k2.Shard(np.arange(side), [], best, bits, depth)
    seen = 0
    for (r, c), v in points.items():
        at = 1
        for level in range(depth):
            width = side >> level
            inside = [x for (a, b), x in points.items() if a // width == r // width and b // width == c // width]
            assert shard.best[at] == max(inside)
            slot = 2 * (r >> (depth - 1 - level) & 1) + (c >> (depth - 1 - level) & 1)
            assert bits[at] >> slot & 1
            at = shard.first[at] + k2._BEFORE[bits[at], slot]
        assert shard.best[at] == v
        seen += 1
    assert seen == len(points) == int((bits[1:] == 0).sum())


@pytest.mark.parametrize("seed", range(4))
def test_search_of_one_shard(seed):
    rng = random.Random(seed)
    items, docs = corpus(seed)
    docs = [(i, t) for i, t, _ in docs if i is not None]
    packed = k2.Shard.packed(np.array([i for i, _ in docs]), [None if t is None else t.encode() for _, t in docs], len(docs), 5000)
    shard = k2.Shard.unpacked(*packed)
    for _, text in items:
        w = {t.encode(): rng.randint(0, 9) for t in terms(text)}
        full = shard.search(w, len(docs))
        ids, scores, opened = shard.search(w, 5)
        assert ids.tolist() == full[0][:5].tolist() and scores.tolist() == full[1][:5].tolist()
        assert opened <= full[2]
        if len(scores) == 5:  # a threshold from elsewhere loses none that reach it
            again = shard.search(w, 5, int(scores[2]))
            assert again[0].tolist()[:3] == ids.tolist()[:3]


@pytest.mark.parametrize("how", ["broadcast", "shuffle"])
def test_ranking_brute_force(spark, make_docs, monkeypatch, how):
    items, docs = corpus(7)
    items += [(3, "w1 w2 w2"), (None, "w1"), (50, None), (51, ""), (52, "unknown terms only")]
    if how == "shuffle":
        monkeypatch.setattr(k2, "SHARD_DOCS", 16)
        monkeypatch.setattr(k2, "SALT_DOCS", 40)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = k2.rank(table, make_docs(docs), item_block=256 if how == "broadcast" else 3, broadcast_terms=10 ** 6 if how == "broadcast" else 0)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(items, docs)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert k2.rank(none, make_docs([(1, "w1", "s")])).count() == 0
    assert k2.rank(some, spark.createDataFrame([], DOCS)).count() == 0
    assert k2.rank(some, make_docs([(1, None, "s"), (2, "--", "s")])).count() == 0
    assert [tuple(r) for r in k2.rank(some, make_docs([(5, "W1", "s")])).collect()] == brute([(1, "w1")], [(5, "W1")])


def test_long_texts_and_shards_by_size(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(k2, "SHARD_BYTES", 50)
    texts = ["a" * 10, "b" * 200, None, "c" * 30, "d" * 30, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([None if t is None else t.encode() for t in texts], pa.binary())], ["id", "text"])
    blocks = list(k2._blocks([batch.slice(0, 0), batch, batch.slice(3)]))
    assert [x.tolist() for x, _ in blocks] == [[0], [1], [2, 3], [4, 5], [3], [4, 5]]
    assert b"".join(x or b"" for _, t in blocks[:4] for x in t).decode() == "".join(t or "" for t in texts)
