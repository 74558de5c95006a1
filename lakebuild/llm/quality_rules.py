"""Quality rules with adaptive thresholds, in DataFrame functions only.

Measures per text: words, code points in words, symbols, repeated lines, words in
repeated 3-word windows. Repeated windows are found inside the row: the window
hashes, each packed with its position, are sorted, so equal windows are neighbours
(neighbours are compared by their words as well). No word leaves its row.

Adaptive thresholds: four rates (thousandths: symbols per word character, repeated
lines per line, repeated words per word; and ten times the mean word length) are
summarized per language and source in quantile sketches: counts on a grid of 1,001
integer buckets. Sketches merge by adding, partially on the map side, so a source
that holds a third of all rows costs nothing extra, and equal inputs give equal
sketches in any order. A rate's error is at most one bucket. A group's threshold is
Q3 + ``reach`` x max(Q3 - Q1, least spread). Groups of under ``min_docs`` documents
take the sketch of their language, and languages of under ``min_docs`` that of all.

Verdict: kept if it passes the base rule (``n_words >= 50`` and at most half of the
words repeated) and no rate exceeds its group's threshold.

Defined results: null and empty texts have no words and fail the base rule; null
languages and sources are groups of their own; repeated rows count and are judged
like any others; an empty table gives no rows; further columns are kept by
``filter_documents`` and otherwise ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, let, spaced, text_of, word_array

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
REACH, MIN_DOCS, GRID = 3, 100, 1000
#: Least spread (Q3 - Q1) assumed of a rate, in its own unit.
LEAST_SPREAD = {"symbol_rate": 15, "line_rate": 130, "repeat_rate": 130, "word_len": 30}
SYMBOLS = "#*$%&|<>"
BROADCAST_GROUPS = 20_000


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window found at least twice."""
    def windows(w: Column) -> Column:
        last = F.size(w) - 3
        bits = F.length(F.bin(F.size(w)))

        def packed(b: Column) -> Column:
            keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.call_function(
                "shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), b).bitwiseOR(i.cast("long")))
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1

            def same(x: Column, y: Column) -> Column:
                i, j = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
                return (F.call_function("shiftrightunsigned", x, b) == F.call_function("shiftrightunsigned", y, b)) & \
                    (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])

            def found(s: Column) -> Column:
                twice = F.filter(s, lambda x, k: F.when(k > 0, same(x, F.get(s, k - 1))).otherwise(False)
                                 | F.when(k < last, same(x, F.get(s, k + 1))).otherwise(False))
                at = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))
                return let(at, lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                    F.lit(0).cast("long"), lambda a, x: a + x))

            return let(F.sort_array(keys), found)

        return F.when(last >= 1, let(bits, packed)).otherwise(F.lit(0).cast("long"))

    return let(words, windows)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_key and the measures of every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), text_of().alias("t"),
                      F.xxhash64("text").alias("row_key"))
    bare = F.col("t")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(spaced(x)) != "")
    counted = let(word_array(F.col("t")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    split = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                          F.size(F.array_distinct(x)).cast("long").alias("d")))
    out = src.select("doc_id", "lang", "source", "row_key", counted.alias("c"), split.alias("l"),
                     F.length(F.replace(spaced(F.col("t")), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
                     (F.length("t") - F.length(bare)).cast("long").alias("n_symbols"))
    return out.select("doc_id", "lang", "source", "row_key", "c.n_words", "word_chars", "n_symbols",
                      F.col("l.n").alias("n_lines"), (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), "c.n_repeat_words")


def with_rates(m: DataFrame) -> DataFrame:
    def rate(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.least(F.lit(GRID), F.expr(f"({scale} * {part}) div {whole}"))) \
            .otherwise(0).cast("int")

    return m.withColumns({
        "symbol_rate": rate("n_symbols", "word_chars", 1000), "line_rate": rate("n_dup_lines", "n_lines", 1000),
        "repeat_rate": rate("n_repeat_words", "n_words", 1000), "word_len": rate("word_chars", "n_words", 10),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def thresholds(rated: DataFrame, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, one limit per rate) from the merged sketches of every group."""
    names = list(LEAST_SPREAD)
    long = rated.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("bucket")) for n in names])).alias("x")).select("lang", "source", "x.*")
    sketch = cut(long.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")))
    levels = None
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        group = [*keys, "metric"]
        merged = sketch.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*group)
        run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
        q = run.groupBy(*group).agg(F.max("all").alias(f"n{level}"),
                                    F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
                                    F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"))
        least = F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv])[F.col("metric")]
        q = q.select(*keys, "metric", f"n{level}",
                     (F.col("q3") + reach * F.greatest(F.col("q3") - F.col("q1"), least)).alias(f"limit{level}"))
        if levels is None:
            levels = q
        else:
            on = levels["metric"] == q["metric"]
            for k in keys:
                on &= levels[k].eqNullSafe(q[k])
            levels = levels.join(q, on).select(levels["*"], f"n{level}", f"limit{level}")
    limit = F.when(F.col("n0") >= min_docs, F.col("limit0")).when(F.col("n1") >= min_docs, F.col("limit1")).otherwise(F.col("limit2"))
    return levels.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("metric") == n, limit)).alias(f"max_{n}") for n in names])


def judge(docs: DataFrame, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """The measures of every row with base_failed and kept."""
    rated = cut(with_rates(measures(docs)))
    limits = cut(thresholds(rated, reach, min_docs))
    few = limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS  # the join is a shuffle join beyond
    on = rated["lang"].eqNullSafe(limits["lang"]) & rated["source"].eqNullSafe(limits["source"])
    joined = rated.join(F.broadcast(limits) if few else limits, on, "left").drop(limits["lang"]).drop(limits["source"])
    inside = F.lit(True)
    for n in LEAST_SPREAD:
        inside &= F.col(n) <= F.col(f"max_{n}")
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def filter_documents(docs: DataFrame, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    bad = judge(docs, reach, min_docs).where(~F.col("kept")).select("doc_id", "row_key").distinct().alias("bad")
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64("d.text") == F.col("bad.row_key"))
    return docs.alias("d").join(bad, on, "left_anti")


BASE_SQL = r"""
d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, unnest(generate_series(1, len(ws) - 2)) as i, ws from w where len(ws) >= 3),
k as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i+1], ws[i+2]) as c from g),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i+1, i+2]) as p from k where c > 1) group by doc_id),
m as (select w.doc_id, lang, source, len(ws)::bigint as n_words,
        len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ls) as n_lines,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join r using (doc_id))"""

SQL = "with " + BASE_SQL + f""",
x as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed,
        case when word_chars > 0 then least({GRID}, 1000 * n_symbols // word_chars) else 0 end as symbol_rate,
        case when n_lines > 0 then least({GRID}, 1000 * n_dup_lines // n_lines) else 0 end as line_rate,
        case when n_words > 0 then least({GRID}, 1000 * n_repeat_words // n_words) else 0 end as repeat_rate,
        case when n_words > 0 then least({GRID}, 10 * word_chars // n_words) else 0 end as word_len from m),
""" + ",\n".join(
    f"q{lv} as (select {keys}{', ' if keys else ''}count(*) as n, " + ", ".join(
        f"quantile_disc({m}, 0.75) + {REACH} * greatest(quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25), {s}) as {m}"
        for m, s in LEAST_SPREAD.items()) + f" from x{' group by ' + keys if keys else ''})"
    for lv, keys in enumerate(("lang, source", "lang", ""))) + """
select x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed,
  not x.base_failed and """ + " and ".join(
    f"x.{m} <= case when q0.n >= {MIN_DOCS} then q0.{m} when q1.n >= {MIN_DOCS} then q1.{m} else q2.{m} end" for m in LEAST_SPREAD) + """ as kept
from x join q0 on x.lang is not distinct from q0.lang and x.source is not distinct from q0.source
  join q1 on x.lang is not distinct from q1.lang cross join q2"""
