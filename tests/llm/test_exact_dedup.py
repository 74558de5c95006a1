"""Exact dedup against brute force, and its defined results."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakebuild.llm import exact_dedup

from .conftest import DOCS, LONG, ODD


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    """(doc_id, keep_id, group_size) per row."""
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return [(i, best[norm(t)], len(groups[norm(t)])) for i, t, *_ in rows]


def cases():
    rng = random.Random(5)
    rows = [(100 + i, rng.choice(["Ärger Über", "ärger über", "ÄRGER", "ärger ", "aB\tc", "Ab\tC", "x" * 130 + "y", "x" * 130 + "z", "K", "K", "🙂a", "🙂A"]), "s")
            for i in range(120)]
    return ODD + rows + [(900, LONG + "!", "a"), (901, LONG.upper() + "!", "a"), (902, LONG + "?", "a"), (7, "twice", "a"), (7, "twice", "b"), (7, "other", "a")]


def test_groups_brute_force(make_docs):
    rows = cases()
    got = exact_dedup.decisions(make_docs(rows), carry=["row_key"]).collect()
    key = repr
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted(brute(rows), key=key)
    assert {r.row_key for r in got} == {"clash"}
    # exactly one row of each group stays, and it bears the largest id
    assert sum(r.kept for r in got) == len({norm(t) for _, t, _ in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_digest_is_of_the_normalised_text(make_docs):
    rows = cases()
    got = make_docs(rows).select("text", exact_dedup.text_hash(F.coalesce("text", F.lit(""))).alias("h")).collect()
    assert all(r.h == hashlib.sha256(norm(r.text).encode()).hexdigest() for r in got)


def test_a_full_bitmap_changes_nothing(make_docs, monkeypatch):
    """Bits that other pairs have set only send more rows to the full hash."""
    rows = cases()
    want = sorted(map(repr, exact_dedup.decisions(make_docs(rows)).collect()))
    monkeypatch.setattr(exact_dedup, "_slot", lambda size, head, bits: F.lit(1).cast("long") + 0 * size)
    got = exact_dedup.decisions(make_docs(rows)).collect()
    assert sorted(map(repr, (r[:3] for r in got))) == sorted(map(repr, (tuple(r) for r in brute(rows))))
    assert len(got) == len(want)


def test_full_text_is_hashed_for_survivors_only(make_docs):
    docs = make_docs([(1, "alone", "a"), (2, "same length x", "a"), (3, "same length y", "a"), (4, "twin", "a"), (5, "TWIN", "a")])
    pairs = exact_dedup.surviving_pairs(docs).collect()
    assert [p["size"] for p in pairs] == [4]


def test_drop_copies_keeps_columns_and_empty_tables(make_docs, spark):
    docs = make_docs([(1, "a b", "x"), (2, "A B", "y"), (3, None, "z"), (4, "", "z"), (None, "q", "z")])
    docs = docs.withColumn("kept", F.lit("mine")).withColumn("__size", F.lit(1))
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.kept) for r in got.collect()) == [(0, "mine"), (2, "mine"), (4, "mine")]
    assert exact_dedup.decisions(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_group(spark):
    """A third of all rows in one group."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.decisions(docs)
    assert got.where("group_size > 1").agg(F.min("keep_id"), F.count("*"), F.sum(F.col("kept").cast("int"))).first()[:] == (8997, 3000, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Window" not in plan


def test_a_hot_group_is_split_in_the_join(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(0, 30_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 5000))).alias("text"))
        got = exact_dedup.decisions(docs)
        rows = got.collect()
        assert sum(r.kept for r in rows) == len({"hot" if r.doc_id % 3 == 0 else r.doc_id % 5000 for r in rows})
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("text", ["", "A", "Zebra ÀÉ", "ß" * 3])
def test_ascii_lower(spark, text):
    assert spark.range(1).select(exact_dedup.ascii_lower(F.lit(text)).alias("x")).first().x == norm(text)
