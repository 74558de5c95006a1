"""Mixing sources to target weights with fixed-length token blocks.

Targets. A mix of ``share`` times all words is divided by weight; no source gives more
than ``max_repeat`` times its size, and what it cannot take is divided again by weight
among the others until none is above.

Blocks. The documents of a source, in a pseudorandom order, are one stream of words cut
into blocks of one length (the last may be shorter): ``block_words``, or less for a source
too small to have ``FINEST`` blocks of that, so that its share is met to a thousandth. Stream positions are prefix sums
in two levels, by source and hash chunk, so a source that holds most rows is spread.

Draws. The mix is a list of output shards of ``shard_slots`` slots each. The counts of the
sources in a shard are multinomial, conditioned on the sources' totals over all shards, so
that the totals meet the targets: the shards are the leaves of a binary tree, a node
divides its counts between its halves by a multivariate hypergeometric draw seeded by its
range, and any task can walk from the root to its shards without a loop over all shards.

Blocks of slots. The j-th slot of a source takes block ``perm(j mod blocks)`` under a
pseudorandom permutation (a Feistel network over indices, a new one for each pass over the
source), so each block is taken floor or ceil of draws / blocks times. Slots and the pieces
of documents in blocks are joined by source and block index.

Everything follows from the seed and the rows, so reruns agree.

Defined results: null and empty texts have size zero and are not taken; a null source is
the last source; null ids are ids like any other; rows equal in id, source and text are
copies, each taken on its own; an empty table gives no rows; further columns are ignored
by ``mix`` and kept by ``mixed_documents``. Weights are given per source, so the list of
sources goes through the driver: more than ``MAX_SOURCES`` raise an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, group_count, text_of, word_count

WEIGHTS = (5, 2, 1)
SHARE, MAX_REPEAT = 1.5, 2.0
BLOCK_WORDS, SHARD_SLOTS, SEED = 128, 4096, 17
MAX_SOURCES = 50_000
FINEST = 1024
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> list[float]:
    """Words to take from each source; ``sizes`` in the order in which the weights repeat."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    got = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if weight[i] * unit > max_repeat * sizes[i]]
        if not over:
            for i in open_:
                got[i] = weight[i] * unit
            break
        for i in over:
            got[i] = max_repeat * sizes[i]
            left -= got[i]
        open_ = [i for i in open_ if i not in set(over)]
    return got


# ------------------------------------------------------------------ the draws

def divide(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` random slots fall to each source, of ``counts`` slots in all (multivariate hypergeometric)."""
    out = np.zeros_like(counts)
    rest = int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        rest -= n
        if not take:
            break
        if n + rest <= 900_000_000:
            x = int(rng.hypergeometric(n, rest, take)) if n and rest else min(n, take) if not rest else 0
        else:  # beyond the generator's range: the normal limit, within the possible range
            p, m = n / (n + rest), n + rest
            sd = (take * p * (1 - p) * (m - take) / max(1, m - 1)) ** 0.5
            x = min(n, take, max(0, take - rest, round(rng.normal(take * p, sd))))
        out[i] = x
        take -= x
    return out


def shard_counts(totals: np.ndarray, first: int, last: int, n_shards: int, slots: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts, earlier counts) per source for the shards first..last-1."""
    def walk(lo: int, hi: int, counts: np.ndarray, before: np.ndarray):
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        low = divide(np.random.default_rng([seed, lo, hi]), counts, min(int(counts.sum()), (mid - lo) * slots))
        yield from walk(lo, mid, low, before)
        yield from walk(mid, hi, counts - low, before + low)

    if n_shards:
        yield from walk(0, n_shards, totals, np.zeros_like(totals))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``index``: a Feistel network, walked until it lands in range."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (b + np.uint64((key * 4 + r) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def slots(spark: SparkSession, draws: list[int], blocks: list[int], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source_no, block): the block that each slot of the mix takes."""
    totals, n_blocks = np.array(draws, np.int64), np.array(blocks, np.int64)
    n_shards = -(-int(totals.sum()) // shard_slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            for shard, counts, before in shard_counts(totals, int(ids[0]), int(ids[-1]) + 1, n_shards, shard_slots, seed):
                used = np.nonzero(counts)[0]
                source = np.repeat(used, counts[used])
                block = np.empty(len(source), np.int64)
                at = 0
                for s in used.tolist():
                    n = int(counts[s])
                    j = np.arange(before[s], before[s] + n)
                    turn, index = j // n_blocks[s], j % n_blocks[s]
                    for t in np.unique(turn).tolist():
                        m = turn == t
                        block[at:at + n][m] = permute(index[m], int(n_blocks[s]), (seed * 1_000_003 + s) * 7 + t)
                    at += n
                order = np.random.default_rng([seed, shard]).permutation(len(source))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(np.arange(len(source))),
                                                  pa.array(source[order].astype(np.int32)), pa.array(block[order])],
                                                 ["shard", "slot", "source_no", "block"])

    spread = max(1, min(n_shards, group_count(n_shards, 16)))
    return spark.range(0, n_shards, 1, spread).mapInArrow(run, "shard long, slot long, source_no int, block long")


# ------------------------------------------------------------------- the mix

def _row_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _rows(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, row_key, copy, size."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       _row_key().alias("row_key"), word_count(text_of()).alias("size"))
    same = each.groupBy("doc_id", "source", "row_key", "size").agg(F.count("*").alias("n"))
    return same.select("doc_id", "source", "row_key", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"), "size")


class Mix:
    """The parts of one mix: ``rows`` (documents with size, source_no, source_size, target) and ``pieces``
    (shard, slot, doc_id, row_key, copy, block, start, length: word ranges of documents, one per draw)."""

    def __init__(self, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT,
                 block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        spark = docs.sparkSession
        rows = cut(_rows(docs))
        found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in found]
        goal = targets(sizes, weights, share, max_repeat)
        units = [max(1, min(block_words, s // FINEST)) for s in sizes]
        blocks = [-(-s // u) for s, u in zip(sizes, units)]
        draws = [round(g * b / s) if s else 0 for g, b, s in zip(goal, blocks, sizes)]
        known = spark.createDataFrame([(i, r["source"], s, g, u) for i, (r, s, g, u) in enumerate(zip(found, sizes, goal, units))],
                                      "source_no int, source string, source_size long, target double, unit long")
        on = rows["source"].eqNullSafe(known["source"])
        self.rows = rows.join(F.broadcast(known), on).drop(known["source"])  # at most MAX_SOURCES small rows
        self.pieces = self._stream(sum(r["n"] for r in found)).join(
            slots(spark, draws, blocks, shard_slots, seed).hint("merge"), ["source_no", "block"])  # estimated by its shards, it would be broadcast

    def _stream(self, n_rows: int) -> DataFrame:
        chunk = F.pmod(F.xxhash64("doc_id", "row_key", F.lit("order")), F.lit(group_count(n_rows, 4096)))
        rows = self.rows.where("size > 0").withColumn("chunk", chunk)
        sums = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("total"))
        upto = Window.partitionBy("source_no").orderBy("chunk")  # a few thousand documents per row
        base = sums.select("source_no", "chunk", (F.sum("total").over(upto) - F.col("total")).alias("base"))
        within = Window.partitionBy("source_no", "chunk").orderBy(F.xxhash64("row_key", "doc_id", "copy"), "doc_id", "row_key", "copy")
        at = rows.withColumn("upto", F.sum("size").over(within)).join(base, ["source_no", "chunk"]) \
            .withColumn("begin", F.col("base") + F.col("upto") - F.col("size")).withColumn("end", F.col("base") + F.col("upto"))
        each = at.withColumn("block", F.explode(F.sequence(F.expr("begin div unit"), F.expr("(end - 1) div unit"))))
        low, high = F.greatest("begin", F.col("block") * F.col("unit")), F.least("end", (F.col("block") + 1) * F.col("unit"))
        return each.select("source_no", "block", "doc_id", "row_key", "copy", (low - F.col("begin")).alias("start"), (high - low).alias("length"))


KEY = ["doc_id", "source_no", "row_key", "copy"]


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document, from the drawn pieces."""
    mix = Mix(docs, **options)
    got = mix.pieces.groupBy(*KEY).agg(F.sum("length").alias("got"))
    a, b = mix.rows.alias("a"), got.alias("b")
    on = F.lit(True)
    for k in KEY:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on, "left").select("a.doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).alias("taken"))


def _cut_text(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words in the given ranges with the white space between them; ranges apart are joined by a line end."""
    spans: list[list[int]] = []
    for s, n in sorted(ranges):
        if spans and spans[-1][1] == s:
            spans[-1][1] = s + n
        else:
            spans.append([s, s + n])
    at = [m.span() for m in _WORD.finditer(text)]
    if spans == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in spans)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per document and time it is drawn, with the words drawn that time
    (a document drawn whole is unchanged); n_chars follows the text."""
    mix = Mix(docs, **options)
    again = Window.partitionBy(*KEY, "start").orderBy("shard", "slot")  # at most ceil(max_repeat) draws of a piece
    drawn = mix.pieces.withColumn("time", F.row_number().over(again)).groupBy(*KEY, "time").agg(
        F.collect_list(F.struct("start", "length")).alias("drawn_ranges")).drop("source_no", "time")
    # a plain key on both sides, so that numbering the copies and the join share one shuffle of the texts
    no_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), no_id.alias("drawn_id"), _row_key().alias("drawn_key"))
    keyed = keyed.withColumn("drawn_copy", F.row_number().over(Window.partitionBy("drawn_id", "drawn_key").orderBy("drawn_key")))
    drawn = drawn.select(no_id.alias("drawn_id"), F.col("row_key").alias("drawn_key"), F.col("copy").alias("drawn_copy"), "drawn_ranges")
    joined = keyed.join(drawn, ["drawn_id", "drawn_key", "drawn_copy"]).select("row", "drawn_ranges")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, ranges = b.column(0).flatten(), b.column(1).to_pylist()
            at = names.index("text")
            text = [_cut_text(t, [(r["start"], r["length"]) for r in rs]) for t, rs in zip(cols[at].to_pylist(), ranges)]
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
