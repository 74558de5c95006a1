"""Ranked lexical search with a K2-treap over the term-document grid.

A shard of documents is a grid of terms (rows, most frequent first) by documents (columns);
a point is a term's impact in a document, ``(1000000000*tf) div (1000*tf + 12*m)`` with the
document's length norm ``m``. The grid is a quadtree in compressed form: every non-empty
cell keeps the largest impact inside it and four bits for its non-empty quarters; cells lie
level by level, so a cell's children are found by counting bits before it. A term's weight
depends on the whole collection and is multiplied in by the query, so an index stands as
long as the collection's document and term totals do.

A query item holds one pointer per term into the grid: the term's row path. The item's
paths descend jointly over ranges of documents: a range's bound is the sum of weight times
cell maximum over the paths, the ranges of highest bound are halved first (some dozens at a
time), and at a single document the bound is the score itself. The search ends when no
range's bound reaches the item's k-th best score. Ranges that tie with it are still opened,
so ties are exact, and a task takes an item's threshold from one shard to the next.

Spark: one pass counts documents, terms and document frequencies (of the terms that items
hold; reduced to one row per task and term first), one pass builds and searches the shards
where the documents lie, so neither texts nor postings are shuffled. Items meet the shards in
blocks of bounded size; the blocks are broadcast up to a checked number of terms and joined
by shuffle beyond. Each shard returns at most k rows per item, merged by rank.

Defined results: rows with a null id take no part, on either side; a null or empty text has
no terms; rows that repeat a document's id are documents of their own; of several texts
under one item id the smallest is the item; items without a scoring document get no row;
ties go to the smaller document id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, group_count

K = 20
#: A shard ends at this many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 2048, 8 << 20
ITEM_BLOCK, BROADCAST_TERMS = 256, 200_000
SALT_DOCS = 1 << 16
OPENED = 96  # ranges halved at a time

#: Bytes of a term stay (A-Z in lower case), all others part terms.
_PART = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TOTALS = b""  # the term under which the collection's totals are counted; no term is empty


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PART).split() if text else []


def length_norm(n, docs: int, terms: int):
    """A document's ``m`` from its number of terms; ``n`` may be an array of 64-bit integers."""
    return 75 + (25 * n * docs) // terms


# ------------------------------------------------------------------ the grid

_SPREAD = np.zeros(1 << 16, np.int64)
for _b in range(16):
    _SPREAD |= ((np.arange(1 << 16) >> _b) & 1) << (2 * _b)
#: Of a cell's four bits: how many are set, and how many are set before one of them.
_SET = np.array([m.bit_count() for m in range(16)], np.uint8)
_BEFORE = np.array([[(m & ((1 << s) - 1)).bit_count() for s in range(4)] for m in range(16)], np.int64)


def _code(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The cell number that takes one bit of the row, one of the column, from the top down."""
    def spread(x):
        return _SPREAD[x & 0xFFFF] | _SPREAD[x >> 16] << 32
    return spread(row) << 1 | spread(col)


def build_cells(row: np.ndarray, col: np.ndarray, value: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest value, quarter bits) of all cells, level by level; cell 0 stands for every empty one."""
    order = np.argsort(code := _code(row, col))
    cell, best = code[order], value[order].astype(np.int32)
    levels = [(best, np.zeros(len(best), np.uint8))]
    for _ in range(depth):
        start = np.nonzero(np.diff(cell >> 2, prepend=-1))[0]
        bits = np.bitwise_or.reduceat(np.left_shift(1, cell & 3).astype(np.uint8), start)
        cell, best = cell[start] >> 2, np.maximum.reduceat(best, start)
        levels.append((best, bits))
    levels.append((np.zeros(1, np.int32), np.zeros(1, np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*reversed(levels)))


def count_terms(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, then (term number, document, tf) of every posting, and each document's length."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    found = []
    for t in texts:
        words = terms_of(t)
        found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    n = np.array([len(x) for x in found], np.int64)
    col = np.repeat(np.arange(len(texts)), n)
    pair, tf = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64) * len(texts) + col, return_counts=True)
    return list(numbers), pair // max(1, len(texts)), pair % max(1, len(texts)), tf, n


class Shard:
    """The searchable grid of one block of documents."""

    def __init__(self, ids: np.ndarray, words: list[bytes], best: np.ndarray, bits: np.ndarray, depth: int):
        self.ids, self.best, self.bits, self.depth = ids, best, bits, depth
        self.rows = {w: i for i, w in enumerate(words)}
        children = _SET[bits]
        self.first = np.cumsum(children, dtype=np.int32)
        self.first -= children
        self.first += 2  # the root is cell 1

    @staticmethod
    def packed(ids: np.ndarray, texts: list[bytes | None], docs: int, terms: int) -> tuple | None:
        """The fields of a shard as bytes; none if no text holds a term."""
        words, term, col, tf, n = count_terms(texts)
        if not words:
            return None
        df = np.bincount(term, minlength=len(words))
        by_df = np.argsort(-df, kind="stable")
        row = np.empty(len(words), np.int64)
        row[by_df] = np.arange(len(words))
        m = length_norm(n, docs, terms) if 25 * int(n.max()) * docs < 1 << 62 else np.array([length_norm(x, docs, terms) for x in n.tolist()])
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[col])
        depth = max(1, (max(len(words), len(texts)) - 1).bit_length())
        best, bits = build_cells(row[term], col, impact, depth)
        return ids.tobytes(), b" ".join(words[i] for i in by_df.tolist()), best.tobytes(), bits.tobytes(), depth

    @classmethod
    def unpacked(cls, ids: bytes, words: bytes, best: bytes, bits: bytes, depth: int) -> Shard:
        return cls(np.frombuffer(ids, np.int64), words.split(b" "), np.frombuffer(best, np.int32), np.frombuffer(bits, np.uint8), depth)

    def search(self, weights: dict[bytes, int], k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best documents scoring ``floor`` or more, and how many ranges were opened."""
        known = [(self.rows[t], w) for t, w in weights.items() if w > 0 and t in self.rows]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not known:
            return ids, scores, 0
        path, weight = (np.array(x, np.int64) for x in zip(*known))
        bound, level, col = np.array([int(self.best[1]) * weight.sum()]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells, opened = np.ones((1, len(path)), np.int64), 0
        while len(bound):
            keep = bound >= floor
            if not keep.any():
                break
            top = np.nonzero(keep)[0]
            if len(top) > OPENED:
                top = top[np.argpartition(bound[top], -OPENED)[-OPENED:]]
            keep[top] = False
            opened += len(top)
            at, lv, c = cells[top], level[top], col[top]
            row_bit = path >> (self.depth - 1 - lv)[:, None] & 1
            bits, first = self.bits[at], self.first[at]
            halves = []
            for half in (0, 1):
                slot = 2 * row_bit + half
                child = np.where(bits >> slot & 1, first + _BEFORE[bits, slot], 0)
                b = self.best[child].astype(np.int64) @ weight
                live = b >= floor
                halves.append((b[live], lv[live] + 1, 2 * c[live] + half, child[live]))
            b, lv, c, at = (np.concatenate(x) for x in zip(*halves))
            done = lv == self.depth
            if done.any():
                ids, scores = np.concatenate([ids, self.ids[c[done]]]), np.concatenate([scores, b[done]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(scores) == k:
                    floor = max(floor, int(scores[-1]))
            bound, level, col = (np.concatenate([old[keep], new[~done]]) for old, new in ((bound, b), (level, lv), (col, c)))
            cells = np.concatenate([cells[keep], at[~done]])
        return ids, scores, opened


# ------------------------------------------------------------------ in Spark

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """The documents of a task in shards: (ids, texts)."""
    for b in batches:
        ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        start, size = 0, 0
        lengths = texts.fill_null(b"")
        lengths = np.diff(np.frombuffer(lengths.buffers()[1], np.int32)[lengths.offset:lengths.offset + len(b) + 1]) if len(b) else []
        for i, n in enumerate(lengths):
            if i > start and (i - start >= SHARD_DOCS or size + n > SHARD_BYTES):
                yield ids[start:i], texts.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += int(n)
        if len(b):
            yield ids[start:], texts.slice(start).to_pylist()


def _read(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def statistics(docs: DataFrame, wanted: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(term, df, docs, terms) of each wanted term; the row of the empty term has the totals."""
    def run(batches):
        for _, texts in _blocks(batches):
            words, term, _, _, n = count_terms(texts)
            df = np.bincount(term, minlength=len(words))
            yield pa.RecordBatch.from_pydict({
                "term": pa.array([*words, _TOTALS], pa.binary()), "df": pa.array([*df.tolist(), 0], pa.int64()),
                "docs": pa.array([0] * len(words) + [int((n > 0).sum())], pa.int64()), "terms": pa.array([0] * len(words) + [int(n.sum())], pa.int64())})
    counted = docs.mapInArrow(run, "term binary, df long, docs long, terms long")
    if wanted is not None:
        counted = counted.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "terms")])


def item_terms(items: DataFrame) -> DataFrame:
    """(id, term, n): each item's terms with their repeats."""
    def run(batches):
        for b in batches:
            rows = [(i, t, n) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t, n in Counter(terms_of(text)).items()]
            i, t, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.binary()), pa.array(n, pa.int64())], ["id", "term", "n"])
    return items.groupBy("id").agg(F.min("text").alias("text")).mapInArrow(run, "id long, term binary, n long")


def weight(df: Column, docs: int) -> Column:
    return F.floor(1000 * F.log((2.0 * docs + 2) / (2.0 * df + 1))).cast("long")


def build(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index: one row per shard."""
    def run(batches):
        for ids, texts in _blocks(batches):
            got = Shard.packed(ids, texts, n_docs, n_terms)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(got, (pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()))],
                                                 ["ids", "words", "best", "bits", "depth"])
    return docs.mapInArrow(run, "ids binary, words binary, best binary, bits binary, depth int")


def rank(items: DataFrame, docs: DataFrame, k: int = K, item_id: str = "item_id", doc_id: str = "doc_id", text_col: str = "text",
         item_block: int = ITEM_BLOCK, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    asked, docs = _read(items, item_id, text_col), _read(docs, doc_id, text_col)
    terms = cut(item_terms(asked))
    few = terms.count() <= broadcast_terms
    totals = docs.sparkSession.createDataFrame([(bytearray(_TOTALS),)], "term binary")
    counted = cut(statistics(docs, terms.select("term").distinct().union(totals), few))
    n_docs, n_terms = counted.where(F.col("term") == F.lit(_TOTALS)).select("docs", "terms").first() or (0, 0)
    weighted = terms.join(counted, "term").select("id", "term", (F.col("n") * weight(F.col("df"), n_docs)).alias("w"))
    n_blocks = group_count(asked.select("id").distinct().count(), item_block)
    salts = 1 if few else group_count(n_docs, SALT_DOCS)
    held = weighted.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
    blocks = held.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("id", "terms", "ws")).alias("items"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    index = build(docs, n_docs, max(1, n_terms)).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    pairs = index.join(F.broadcast(blocks) if few else blocks, ["block", "salt"]).select("ids", "words", "best", "bits", "depth", "items")

    def run(batches):
        floors: dict[int, int] = {}
        for b in batches:
            for r in range(len(b)):
                shard = Shard.unpacked(*(b.column(i)[r].as_py() for i in range(5)))
                out = []
                for item in b.column(5)[r].as_py():
                    ids, scores, _ = shard.search(dict(zip(item["terms"], item["ws"])), k, floors.get(item["id"], 1))
                    if len(ids) == k:
                        floors[item["id"]] = int(scores[-1])
                    out.append((np.full(len(ids), item["id"]), ids, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["item_id", "doc_id", "score"])

    found = pairs.mapInArrow(run, "item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents where doc_id is not null),
c as (select count(*) as n_docs, sum(len(ws))::bigint as n_terms from d where len(ws) > 0),
p as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(ws) as n, unnest(ws) as term from d) group by all),
t as (select term, count(*) as df from p group by term),
b as (select item_id, min(text) as text from benchmark where item_id is not null group by item_id),
i as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from b),
q as (select item_id, term, count(*) as reps from i group by all),
s as (select item_id, r, doc_id, sum(reps * floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * df + 1)))::bigint
        * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
      from q join t using (term) join p using (term) cross join c group by item_id, r, doc_id),
o as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from o where rank <= {K}"""
