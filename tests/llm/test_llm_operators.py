"""Brute-force checks and defined results of the operators (nulls, empty and long texts, ties, repeats, empty tables)."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakebuild.llm import (chat_format, html_extract, line_dedup, maxent_lm, maxscore_topk, quality_rules, simhash_dedup,
                           source_mix, substring_dedup, vector_packing)
from lakebuild.llm.components import connected_components
from lakebuild.llm.queries import tokenizer_path

from .conftest import DOCS, LONG, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASES = ODD + [(10 + i, " ".join(random.Random(i % 4).choices("ab cd ef gh ij kl".split(), k=60)) + f" x{i}", "b") for i in range(12)]


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


WANT = sorted((i is None, i or 0) for i, _, _ in CASES)


def test_components_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(300, i) for i in range(301, 400)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ------------------------------------------------------------------ op1

def test_line_distance_and_links(spark):
    rng = random.Random(3)

    def mutate(s, k):
        s = list(s)
        for _ in range(k):
            i, what = rng.randint(0, max(0, len(s) - 1)), rng.randint(0, 2)
            if what == 0 or not s:
                s.insert(i, rng.choice("abé🙂"))
            elif what == 1:
                s.pop(i)
            else:
                s[i] = rng.choice("abé🙂")
        return "".join(s)
    pairs = [(a := "".join(rng.choices("abé🙂", k=rng.randint(0, 25))), mutate(a, rng.randint(0, 4))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2):
        wrong = df.withColumn("g", line_dedup.banded_distance(F.col("a"), F.col("b"), t)).where(
            F.expr(f"not (g <=> case when levenshtein(a, b) <= {t} then levenshtein(a, b) end)"))
        assert wrong.count() == 0
    base = ["".join(rng.choices("ab ", k=rng.randint(24, 40))) for _ in range(15)]
    lines = spark.createDataFrame([(x,) for x in sorted({mutate(rng.choice(base), rng.randint(0, 3)) for _ in range(90)})], "line string") \
        .withColumn("id", F.xxhash64("line"))
    got = {tuple(r) for r in line_dedup.edit_links(lines.select("id", "line")).collect()}
    a, b = lines.alias("a"), lines.alias("b")
    want = {tuple(r) for r in a.crossJoin(b).where("a.id < b.id and levenshtein(a.line, b.line) <= 2").select("a.id", "b.id").collect()}
    assert got == want and want


def test_line_dedup_removes_later_copies(make_docs):
    line = "this is a long enough line to compare"
    docs = make_docs(ODD + [(20, f"{line}\nshort", "a"), (21, f"keep this other long line please\n{line}s\nshort", "a"), (22, line, "b")])
    got = {r["doc_id"]: r for r in line_dedup.drop_duplicate_lines(docs, min_chars=24).collect()}
    assert got[20]["text"] == f"{line}\nshort" and got[22]["text"] == "" and got[22]["n_chars"] == 0
    assert got[21]["text"] == "keep this other long line please\nshort"
    assert got[1]["text"] is None and got[5]["text"] == LONG and got[20]["row_key"] == "clash"


def test_short_lines_are_deduplicated(spark, make_docs, tmp_path):
    import corpus_pipeline
    from lakebuild.llm.queries import QUERIES

    rng = random.Random(6)
    pool = sorted({"".join(rng.choices("ab é", k=rng.randint(1, 18))) for _ in range(150)}) + ["Ietzte.", "Ietzta.", "ok", "ok.", "今日は雨です。"]
    rows = [(i, "\n".join(rng.choices(pool, k=12)), "a") for i in range(40)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_no"]): r for r in QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()}
    places = {(i, k): x for i, t, _ in rows for k, x in enumerate(t.split("\n")) if x.strip()}
    assert set(got) == set(places)
    seen = sorted(set(places.values()))
    pairs = spark.createDataFrame([(a, b) for a in seen for b in seen if a < b], "a string, b string")
    allowed = "case when least(length(a), length(b)) >= 15 then 2 when least(length(a), length(b)) >= 6 then 1 else 0 end"
    links = [tuple(r) for r in pairs.where(f"levenshtein(a, b) <= {allowed}").collect()]
    parent = {x: x for x in seen}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    first = {}
    for place in sorted(places):
        first.setdefault(find(places[place]), place)
    for place, x in places.items():
        r = got[place]
        assert (r["class_doc"], r["class_line"]) == first[find(x)] and r["kept"] == (place == first[find(x)])
        assert r["n_links"] == sum(x in p for p in links)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, make_docs(rows), "").collect()}
    for i, t, _ in rows:
        assert kept[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got or got[i, k]["kept"])


# ------------------------------------------------------------------ op2

def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["</s>", "[INST]", "\\", "<|turn|>", "<|", "|>", "<\\s>", "[\\INST]", "ok", " ", "\n", "é🙂", "<|end|>"]
    rows = [(c, t, "system" if t == 0 and c % 2 else "user" if t % 2 else "assistant", "".join(rng.choices(bits, k=rng.randint(0, 30))))
            for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, None, None), (50, 0, None, None), (None, None, "user", "x"), (51, 0, "assistant", "w " * 3000), (51, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    made = chat_format.windows(turns, budget=40, history=10)
    got = {r["conv_id"]: r for r in chat_format.digests(made).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert made.where("conv_id <> 51 and n_tokens > 80").count() == 0
    assert chat_format.digests(chat_format.windows(turns.limit(0))).count() == 0


# ------------------------------------------------------------------ op3

def test_mix_targets_and_draws(make_docs):
    assert source_mix.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])  # 5, 2, 1 with a stop at 200
    assert source_mix.targets([]) == [] and source_mix.targets([0, 0]) == [0, 0]
    for n in (1, 2, 7, 1000):
        assert sorted(source_mix.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    totals = np.array([5000, 0, 300])
    shards = list(source_mix.shard_counts(totals, 0, 53, 53, 100))
    assert np.array_equal(sum(c for _, c, _ in shards), totals) and all(c.sum() == 100 for _, c, _ in shards)
    again = list(source_mix.shard_counts(totals, 20, 30, 53, 100))
    assert all(np.array_equal(a[1], b[1]) for a, b in zip(again, shards[20:30]))

    docs = make_docs(CASES)
    got = source_mix.taken(docs, block_words=8).collect()
    assert ids(got) == WANT and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.taken(docs, block_words=8).collect()))
    for target in {r["target"] for r in got}:
        assert abs(sum(r["taken"] for r in got if r["target"] == target) - target) <= 16
    mixed = source_mix.mixed_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in mixed.collect())
    assert words == sum(r["taken"] for r in got)
    assert source_mix.taken(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ op4

def test_simhash_brute_force(make_docs):
    docs = make_docs(CASES)
    got = simhash_dedup.simhash_groups(docs).collect()
    assert ids(got) == WANT
    prints = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got if r["doc_id"] is not None}
    for i, a in prints.items():
        near = [j for j, b in prints.items() if (a ^ b).bit_count() <= 4]
        assert {r["component_id"] for r in got if r["doc_id"] in near} == {r["component_id"] for r in got if r["doc_id"] == i}
    assert prints[1] == prints[2] == prints[3] == 0
    assert simhash_dedup.simhash_groups(docs.limit(0)).count() == 0


def test_simhash_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([base ^ sum((np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(k)) for k in range(4)])
    fps = np.unique(near)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r[0]: r[1] for r in connected_components(simhash_dedup.links(df, shard_points=40, sample_size=400)).collect()}
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    signed = fps.view(np.int64).tolist()
    assert set(found) == {signed[i] for i in np.nonzero(linked.sum(axis=1) > 1)[0]}
    for i, j in np.argwhere(linked):
        if i != j:
            assert found[signed[i]] == found[signed[j]]


def test_shard_links_span_every_component():
    rng = np.random.default_rng(8)
    flip = lambda x, *bits: x ^ sum(1 << b for b in bits)
    far = [int(x) for x in rng.integers(0, 1 << 63, 600, dtype=np.uint64)]
    star = [flip(far[0], *range(4 * k, 4 * k + 4)) for k in range(6)]  # ends 8 bits apart, near the centre only
    chain = [flip(far[1], *range(3 * k)) for k in range(20)]
    bridge = [far[2], flip(far[2], *range(8))], [flip(far[2], *range(4))]  # joined by a guest only
    cases = [([star[0], star[1], *far[3:65], far[0]], []), (star + far[3:300] + [far[0]], []),
             (far[3:400] + chain[::2] + far[400:500] + chain[1::2], []), (bridge[0] + far[3:200], bridge[1] + far[200:300]),
             (chain[::2] + far[3:200] + bridge[0], chain[1::2] + star + bridge[1]), (far[:70], []), ([], far[:3])]
    for own, guests in cases:
        own, guests = np.array(own, np.uint64), np.array(guests, np.uint64)
        a, b = simhash_dedup.shard_links(own, guests, 4)
        assert (np.bitwise_count(a ^ b) <= 4).all()
        whole = np.concatenate([own, guests])
        near = np.argwhere(np.bitwise_count(own[:, None] ^ whole[None, :]) <= 4)
        want, got = ({x: x for x in whole.tolist()} for _ in range(2))

        def root(of, x):
            while of[x] != x:
                x = of[x]
            return x
        for i, j in near.tolist():
            want[root(want, int(own[i]))] = root(want, int(whole[j]))
        for x, y in zip(a.tolist(), b.tolist()):
            assert root(got, x) != root(got, y)  # a forest
            got[root(got, x)] = root(got, y)
        for i, j in near.tolist():
            assert root(got, int(own[i])) == root(got, int(whole[j]))


# ------------------------------------------------------------------ op5

def test_language_model(make_docs):
    texts = CASES + [(100 + i, "the cat sat on the mat and the dog sat on the rug " * 6, "a") for i in range(30)]
    got = [r for r in maxent_lm.scores(make_docs(texts)).collect()]
    assert len(got) == len(texts)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in texts if i is not None}
    rows = [([*(t or "").encode().lower().split(), None], held(i)) for i, t, _ in texts]
    count = {}
    for ws, h in rows:
        for w in ws:
            count[w] = count.get(w, 0) + (not h)
    n, v = sum(count.values()), sum(c > 0 for c in count.values())
    for r in got:
        assert r["train_tokens"] == n
        if r["doc_id"] is not None:
            ws = tokens[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"]) == (held(r["doc_id"]), len(ws), sum(count[w] > 0 for w in ws))
            assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    fresh = [r for r in got if r["held_out"] and r["doc_id"] >= 100]
    assert fresh and all(r["score"] > r["base_score"] for r in fresh)
    assert maxent_lm.scores(make_docs([])).count() == 0


def test_language_model_is_a_distribution():
    model = maxent_lm.Model(np.arange(50, dtype=np.uint64), np.arange(50, 0, -1), 40, 20)
    model.weights += np.random.default_rng(0).normal(0, 1, model.weights.shape).astype(np.float32)
    total = 0.0
    for t in range(51):
        total += np.exp(model.log_probability(np.array([3, t]), np.array([2]))[1])
    assert total == pytest.approx(1, abs=1e-4)


# ------------------------------------------------------------------ op6

def test_topk_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 6 if i % 9 else 4)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(20)] + [(None, [1.0] * 6), (300, None), (301, [float("nan")] * 6), (302, [None] * 6),
                                                       (303, [float("inf")] * 6), (304, []), (50, [0.1] * 6)]
    v = maxscore_topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(0)))
    got = maxscore_topk.topk(v.where("vec_id % 50 = 0"), v, candidate_block=32, query_block=3).collect()
    good = [(i, np.floor(256 * np.array(e, float))) for i, e in rows if i is not None and e is not None
            and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        a = min(e for i, e in rows if i == q)
        a = np.floor(256 * np.array(a, float))
        scored = sorted((-int((a[:min(len(a), len(e))] * e[:min(len(a), len(e))]).sum()), i) for i, e in good if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == want
    assert maxscore_topk.topk(v.limit(0), v).count() == 0


# ------------------------------------------------------------------ op7

def test_substring_brute_force(make_docs):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    rows = list(ODD)
    for i in range(30, 60):
        w = [f"v{rng.randint(0, 9)}" for _ in range(rng.randint(0, 40))]
        a, n = rng.randint(0, 25), rng.randint(0, 30)
        rows.append((i, " ".join(w[:10] + passage[a:a + n] + w[10:]), "a"))
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.removed(make_docs(rows)).collect())
    first = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12) if i is not None else ():
            first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    want = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = {p for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i for p in range(k, k + 13)}
        want.append((i or -1, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert got == sorted(want) and any(r[2] for r in want)
    assert substring_dedup.removed(make_docs([])).count() == 0


# ------------------------------------------------------------------ op8

def test_quality_rules(make_docs):
    junk = [(70 + i, "#a %b " * 40 + " ".join(f"j{i}x{k}" for k in range(90)), "a") for i in range(3)]
    clean = [(100 + i, "\n".join(" ".join(f"c{i}w{k}l{n}" for k in range(12)) for n in range(8)), "a") for i in range(60)]
    docs = make_docs(ODD + junk + clean + [(90, "a a a a b c d\nx\nx\n\n", "a")])
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert got[90]["n_repeat_words"] == 4 and got[90]["n_dup_lines"] == 1 and got[90]["n_words"] == 9 and got[90]["base_failed"]
    assert not any(got[70 + i]["kept"] for i in range(3)) and all(got[100 + i]["kept"] for i in range(60)) and got[5]["kept"]
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {5, *range(100, 160)}
    assert quality_rules.judge(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ op9

def test_packing_round_trip(spark, make_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    rows = CASES + [(500 + i, t, "a") for i, t in enumerate(["a  b \n\n c", "<|endoftext|> x", "'ll  don't\x1c\x85y", "🙂é中文"])]
    docs = make_docs(rows)
    got = vector_packing.pack(vector_packing.pieces(docs, tokenizer_path(), with_ids=True, special=False), docs.count()).collect()
    want = sorted(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0]) for _, t, _ in rows)
    whole = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    assert sorted(map(len, want)) == sorted(n for (i, n), x in whole.items() for _ in range(len(x) // n))
    assert {tuple(x[:n]) for (i, n), x in whole.items() if len(x) == n} <= set(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
    assert vector_packing.pack(vector_packing.pieces(docs.limit(0), tokenizer_path()), 0).count() == 0


def test_special_tokens_are_one_id(spark, make_docs, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from lakebuild.llm.queries import QUERIES

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n\n x", "<|endoftext| > y", "é<|endoftext|>  ", "plain text", "<|END|>", ""]
    docs = make_docs([(i, t, "a") for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op9_vector_packing"](spark, str(tmp_path)).collect()}
    packed = {r["doc_id"]: r for r in corpus_pipeline.pack_sequences(spark, docs, "").collect()}
    for i, t in enumerate(texts):
        want = [*tok.encode(t, add_special_tokens=False).ids, 0]
        assert np.frombuffer(bytes(packed[i]["ids"]), "<u4").tolist() == want
        assert (got[i]["doc_tokens"], got[i]["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    assert got[0]["doc_tokens"] == 2


def test_bins_keep_every_limit():
    rng = np.random.default_rng(1)
    demand = np.column_stack([rng.integers(1, 1025, 3000), np.ones(3000, int), rng.integers(0, 600, 3000)])
    limits = np.array([1024, 3, 700])
    bins, _ = vector_packing.pack_bins(demand, limits)
    used = np.zeros((bins.max() + 1, 3), int)
    np.add.at(used, bins, demand)
    assert (used <= limits).all() and len(bins) == 3000
    with pytest.raises(ValueError):
        vector_packing.pack_bins(np.array([[2000, 1, 0]]), limits)


# ------------------------------------------------------------------ op10

def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies on this page and many more words follow here now</div>
    <article><h1>My title</h1><p>Short.<p>Hel<b>lo</b> &lt;x&gt; &amp;&eacute;<br>new <a href=z>link</a></p><aside>Aside text</aside>
    <form><label>Name</label></form><script>var t="</p>";</script><!-- <p>no</p> --></article>
    <section id="comments"><p>Nice post, I like this one a lot and say so</p></section><footer>&copy; foot</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 50_000), (3, "w", "<p>" + "word " * 50_000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 5 and text[1] == "My title Short. Hello <x> &é new link" and text[2] == text[None] == ""
    assert len(text[3].split()) == 50_000
    tree = html_extract.grow(html_extract.labelled())
    assert all(html_extract.is_main(tree, tuple(r[:-1])) == bool(r[-1]) for r in html_extract.labelled())


def test_html_unclosed_elements_and_layout_names():
    tree = html_extract.grow(html_extract.labelled())
    text = " ".join(f"word{i}" for i in range(60))
    plain = f"<article><p>{text}</p></article>"
    for page in (f"<html><head><title>T</title><meta charset=x><body>{plain}", f"<head><title>T</title>{plain}",
                 *(f"<article><p>{text[:200]}<{e} id=x/>{text[200:]}</p></article>" for e in ("svg", "iframe", "object")),
                 *(f"<article><{e}><p>{text}</p></article>" for e in ("noscript", "iframe", "object", "select", "svg", "textarea")),
                 f"<article><noscript><p>{text}</p><noscript>gone</noscript></article>",
                 f"<div class='layout with-sidebar'><main>{plain}</main><div class=sidebar>{text}</div></div>",
                 f"<main><div class=no-sidebar>{plain}</div></main>", f"<body class=has-banner>{plain}",
                 f"<article class='post with-sidebar'><p>{text}</p></article>",
                 f"{plain}<div class=related><article><p>{text}</p></article></div>"):
        assert "".join(html_extract.main_text(page, tree).split()) == "".join(text.split()), page[:80]
    assert html_extract.main_text(f"{plain}<script>var x = '<p>{text}</p>'", tree) == text


# -------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path, make_docs):
    import corpus_pipeline

    base = [(1000 + i, "\n".join(" ".join(f"c{i}w{k}l{n}" for k in range(12)) for n in range(8)), f"s{i % 3}") for i in range(40)]
    docs = make_docs(ODD + base + [(2000 + i, base[i][1], "s0") for i in range(5)])
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = {r[0] for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == before.columns
    assert seen["quality_rules"] == {5, *range(1000, 1040), *range(2000, 2005)}
    # line dedup empties the copies; of the empty texts the smallest id stays
    assert not seen["simhash_dedup"] & set(range(2001, 2005)) and seen["packing"] <= seen["simhash_dedup"]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
