"""Cases that once went wrong."""
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakebuild.llm import html_extract, line_dedup, maxent_lm, maxscore_topk, simhash_dedup, source_mix, vector_packing
from lakebuild.llm.queries import tokenizer_path

from .conftest import LONG

A = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood again"
B = "completely different words stand here so that nothing at all is shared with another text"


def test_keep_first_judges_each_text_under_an_id(make_docs):
    docs = make_docs([(3, A, "s"), (7, A, "s"), (7, B, "s"), (9, B, "t"), (7, None, "s"), (2, "", "s"), (None, A, "s")])
    got = simhash_dedup.keep_first(docs)
    assert got.columns == docs.columns
    # (7, A) copies (3, A); (7, B) is the first of its text; (7, null) and (2, "") both have fingerprint zero
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, A), (2, ""), (3, A), (7, B)]


def test_known_tokens_of_many_equal_rows(make_docs):
    """Equal rows share their sums; each gets its whole count back."""
    for n in (49, 98):
        got = maxent_lm.scores(make_docs([(3, "the cat", "s")] * n + [(4, "the dog", "s")]), head=16, rounds=1).collect()
        assert {(r.n_tokens, r.n_known) for r in got if r.doc_id == 3} == {(3, 3)}


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 1_200_000, " " * 99_999, "\t" * 100_000, "\u3000" * 100_000])
def test_long_white_space_is_tokenized(run):
    from tokenizers import Tokenizer

    text = "one" + run + "two <|endoftext|>"
    plain = Tokenizer.from_file(tokenizer_path())
    assert vector_packing.Encoder.of(tokenizer_path()).ids(text, True).tolist() == plain.encode(text, add_special_tokens=False).ids
    plain.encode_special_tokens = True
    assert vector_packing.Encoder.of(tokenizer_path()).ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_mixed_documents_keep_columns_of_any_name(make_docs):
    docs = make_docs([(i, f"w{i} " * 300, "ab"[i % 2]) for i in range(8)] + [(20, LONG, "a"), (21, None, "b"), (None, "x y", "a")])
    clash = {"drawn_id": 777, "drawn_key": 778, "drawn_copy": 779, "drawn_ranges": 780, "row": 781, "time": 782, "start": 783}
    wide = docs.withColumns({k: F.lit(v) for k, v in clash.items()})
    got = source_mix.mixed_documents(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert {tuple(r[k] for k in clash) for r in rows} == {tuple(clash.values())}
    plain = source_mix.mixed_documents(docs).collect()
    assert sorted(map(repr, (r[:6] for r in rows))) == sorted(map(repr, (r[:] for r in plain)))


# The elements that are skipped, as one pattern that looks ahead for each: slow on many unclosed ones, plain to read.
OLD = html_extract
SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(OLD.TO_THE_END) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
                  r"|<(?:" + "|".join(OLD.NESTING + OLD.FLAT) + r")\b[^>]*/>"
                  r"|<(" + "|".join(OLD.NESTING) + r")\b[^>]*>.*?</\2\s*>"
                  r"|<(" + "|".join(OLD.FLAT) + r")\b[^>]*>(?:(?!<\3\b).)*?</\3\s*>|<[!?][^>]*>", re.S | re.I)


def test_skipping_equals_the_pattern():
    rng = random.Random(3)
    bits = ["<svg>", "</svg>", "<svg a='1'/>", "<SCRIPT>", "</script >", "<script/>", "<!-- c -->", "<!--", "-->", "<!doctype html>", "<?x?>", "<title>",
            "</title>", "<textarea b>", "</textarea>", "<object>", "</object>", "<p>", "</p>", "text ", "a < b ", "> ", "<style>", "</style>", "<svgx>", "<iframe>", "</iframe>"]
    for _ in range(3000):
        page = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert html_extract.skipped(page) == SKIP.sub(" ", page), page


@pytest.mark.parametrize("unit", ["<object a>x ", "<title>x ", "<svg x", "<script>", "<!-- ", "<iframe></object>"])
def test_many_unclosed_elements_take_linear_time(unit):
    def seconds(n):
        start = time.perf_counter()
        html_extract.blocks("<p>one</p>" + unit * n)
        return time.perf_counter() - start
    seconds(100)
    assert seconds(40_000) < 5


def test_products_that_may_be_inexact_are_an_error(spark):
    rows = maxscore_topk.usable(spark.createDataFrame([(0, [1e20, 1.0]), (1, [1e20, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="exact in doubles"):
        maxscore_topk.topk(rows, rows).collect()


def test_topk_over_many_tiles_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.5, -0.5, rng.uniform(-1, 1)]) for _ in range(5)]) for i in range(300)] + [(i, [0.5] * 5) for i in range(300, 400)] + [(400, [0.5] * 3), (401, [])]
    use = maxscore_topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = maxscore_topk.topk(use.where("vec_id % 7 = 0"), use, query_block=9, candidate_shard=50, candidate_block=16).collect()
    whole = {i: np.floor(256 * np.array(v)).astype(int).tolist() for i, v in rows}
    want = []
    for q in whole:
        if q % 7 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_loss_limit_binds_on_instruction_data(spark):
    """Prompts carry no loss: a sequence may be full of tokens long before it is full of loss, or the other way round."""
    docs = spark.createDataFrame([(i, "question " * 40, "answer " * (60 if i % 2 else 10)) for i in range(60)] + [(99, None, "no prompt")],
                                 "doc_id long, prompt string, text string")
    parts = vector_packing.pieces(docs, tokenizer_path(), prompt_col="prompt", with_ids=True)
    plain = {r.doc_id: (r.doc_tokens, r.loss) for r in parts.collect()}
    enc = vector_packing.Encoder.of(tokenizer_path())
    for i, (n, loss) in plain.items():
        prompt, answer = len(enc.ids("question " * 40 if i != 99 else "")), len(enc.ids(("answer " * (60 if i % 2 else 10)) if i != 99 else "no prompt"))
        assert (n, loss) == (prompt + answer + 1, answer)
    by_bin = {}
    for r in vector_packing.pack(parts, 61, max_loss=150).collect():
        by_bin.setdefault(r.sequence_id, []).append(r.doc_id)
    totals = [(sum(plain[i][0] for i in b), sum(plain[i][1] for i in b)) for b in by_bin.values()]
    assert sum(len(b) for b in by_bin.values()) == 61
    assert all(n <= 1024 and loss <= 150 for n, loss in totals) and any(n < 512 and loss > 100 for n, loss in totals)


@pytest.mark.parametrize("head", [1, 5, 7, 60, 500, 2000, 5000])
def test_head_is_filled_by_count_then_token(spark, head):
    rng = random.Random(head)
    rows = [(rng.randint(-2 ** 63, 2 ** 63 - 1), rng.choice([1, 1, 1, 1, 2, 3, 40, 41, 1000])) for _ in range(2000)]
    got = maxent_lm._most_frequent(spark.createDataFrame(rows, "token long, count long"), head)
    assert [tuple(r) for r in got] == sorted(rows, key=lambda r: (-r[1], r[0]))[:head]


def test_flat_vocabularies_are_trained(make_docs):
    """Every token as frequent as every other: the head is filled and the model learns what follows what."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    docs = make_docs([(i, " ".join(words[k:] + words[:k]), "s") for i, k in enumerate(rng.choices(range(120), k=150))])
    got = maxent_lm.scores(docs, head=64).collect()
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_sums_in_levels_equal_one_sum(make_docs, monkeypatch):
    docs = make_docs([(i, f"the cat {i % 7} sat on the mat {i % 3}", "s") for i in range(80)]).repartition(9)
    want = {r.doc_id: r.score for r in maxent_lm.scores(docs, head=8).collect()}
    monkeypatch.setattr(maxent_lm, "FAN_IN", 2)
    monkeypatch.setattr(maxent_lm, "LEVELS", 4)
    got = {r.doc_id: r.score for r in maxent_lm.scores(docs, head=8).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_small_sources_meet_their_targets(make_docs):
    docs = make_docs([(i, " ".join(f"{s}{i}{k}" for k in range(20)), s) for s in "abc" for i in range(5)])
    got = source_mix.taken(docs).collect()
    by_source = {}
    for r in got:
        by_source[r.doc_id, r.target] = by_source.get((r.doc_id, r.target), 0) + r.taken
        assert r.taken <= 2 * r.size
    totals = {}
    for (_, target), n in by_source.items():
        totals[round(target)] = totals.get(round(target), 0) + n
    assert totals == {200: 200, 167: 167, 83: 83}


def test_removed_lines_reach_their_documents(make_docs, monkeypatch):
    """Documents that lose nothing pass by the join; a bitmap that lets all through gives the same rows."""
    line = "a line that is long enough to be compared with others"
    rows = [(i, f"own {i} text of this document only, number {i * 7919}\n{line}{'s' * (i % 2)}", "s") for i in range(30)] + [(40, None, "s"), (41, "", "s"), (None, line, "s"), (7, line, "t")]
    docs = make_docs(rows).withColumns({c: F.lit(c) for c in ("d", "slot", "bucket", "bitmap", "own_id", "gone", "size")})
    got = line_dedup.drop_duplicate_lines(docs)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    first = got.collect()
    assert len(first) == len(rows) and all(r.slot == "slot" and r.d == "d" for r in first)
    assert [r.text for r in first if r.doc_id == 0] == [rows[0][1]] and [r.text for r in first if r.doc_id is None] == [""]
    assert all(line not in r.text and r.n_chars == len(r.text) for r in first if r.doc_id and 0 < r.doc_id < 30)
    monkeypatch.setattr(line_dedup, "_slot", lambda size, head, bits: F.lit(1).cast("long") + 0 * F.coalesce(head, F.lit(0)))
    monkeypatch.setattr(line_dedup, "_bit", lambda bitmap, at: F.lit(True) | (at < 0))
    assert sorted(map(repr, line_dedup.drop_duplicate_lines(docs).collect())) == sorted(map(repr, first))


def test_line_dedup_brings_lines_together_by_keys_not_by_their_texts(spark):
    rows = [(i, f"line {i} of a text that is like no other, {i * 7919 % 1000}") for i in range(20)] + [(99, "line 3 of a text that is like no other, 757!")]
    texts = spark.createDataFrame(rows, "id long, line string")
    shared = line_dedup.shared_segments(texts)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert all("line" not in x for x in plan.splitlines() if "HashAggregate" in x or "Sort " in x)
    found = {r["id"] for r in shared.collect()}
    assert {3, 99} <= found
    lonely = spark.createDataFrame([(1, "nothing here is near"), (2, "quite another sentence")], "id long, line string")
    assert line_dedup.shared_segments(lonely).count() == 0


def test_line_keys_are_cut_in_code_that_the_jvm_compiles(spark, make_docs, tmp_path):
    """HotSpot interprets methods of 8,000 bytes and more for good."""
    make_docs([(1, A, "s"), (2, B, "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    lines = line_dedup.lines(spark.read.parquet(str(tmp_path / "documents.parquet")))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the code is made as the stages run
    try:
        made = line_dedup.shared_segments(lines.select(F.xxhash64("line").alias("id"), "line"))._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    assert sizes and 0 < max(sizes) < 8000


def test_a_text_is_hashed_once_and_not_once_per_line(spark, make_docs, tmp_path):
    make_docs([(1, A + "\n" + B, "s"), (2, None, "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    lines = line_dedup.lines(docs)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("xxhash64(text")
    key = docs.where("doc_id = 1").select(F.xxhash64("text")).first()[0]
    assert [tuple(r) for r in lines.orderBy("line_no").collect()] == [(1, key, 0, A), (1, key, 1, B)]


def test_lines_of_wide_characters_meet_by_their_code_points(spark):
    """Code points of one to four bytes against a brute force; bytes that are no UTF-8 fail nothing."""
    rng = random.Random(8)
    seen = set()
    for n in [6, 14, 15, 16, 17, 18, 30, 31, 32] * 3:
        base = rng.choices("aé今🙂", k=n)
        for _ in range(5):
            s = base[:]
            for _ in range(rng.randint(0, 3)):
                at, what = rng.randrange(len(s)), rng.randint(0, 2)
                s[at:at + (what > 0)] = [rng.choice("aé今🙂")] if what < 2 else []
            seen.add("".join(s))
    lines = spark.createDataFrame(list(enumerate(sorted(seen))), "id long, line string")
    allowed = "case when least(length(a.line), length(b.line)) >= 15 then 2 when least(length(a.line), length(b.line)) >= 6 then 1 else 0 end"
    pairs = lines.alias("a").crossJoin(lines.alias("b")).where(f"a.id < b.id and levenshtein(a.line, b.line) <= {allowed}")
    want = {tuple(r) for r in pairs.select("a.id", "b.id").collect()}
    assert {tuple(r) for r in line_dedup.edit_links(lines).collect()} == want and len(want) > 30
    broken = "select 1L as id, cast(X'FF61FE{0}61' as string) as line union all select 2L, cast(X'FF61FE{0}62' as string)".format("61" * 20)
    assert [tuple(r) for r in line_dedup.edit_links(spark.sql(broken)).collect()] == [(1, 2)]


def test_first_round_of_maxent_needs_no_pass_for_expected_counts(spark, monkeypatch):
    import numpy as np

    from lakebuild.llm import maxent_lm

    rng = np.random.default_rng(5)
    head = np.arange(1, 301, dtype=np.uint64)
    model = maxent_lm.Model(head, np.arange(600, 300, -1), 50, 20)
    size = rng.integers(1, 60, 80)
    tokens = rng.integers(0, 301, size.sum()).astype("<u2")
    sums = model.zero_sums()
    model.statistics(tokens, size, sums)
    assert np.allclose(model.expected_at_start(sums["observed"]), sums["expected"], rtol=1e-4, atol=1e-3)

    asked = []
    one = maxent_lm._sums
    monkeypatch.setattr(maxent_lm, "_sums", lambda places, model, counts: (asked.append(tuple(counts)), one(places, model, counts))[1])
    docs = spark.createDataFrame([(i, f"a b c d{i % 3} a b") for i in range(40)], "doc_id long, text string")
    assert maxent_lm.scores(docs).count() == 40
    assert asked == [("observed", "word"), ("expected",)]
