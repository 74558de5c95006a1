"""Hard negatives by exact inner products in a residue number system.

Vectors become integer vectors, ``floor(scale * x)``. Their inner products are taken by
residue-number-system matrix products: both component matrices are reduced modulo several
small primes to residues of at most half the prime, multiplied in float32 over runs of
dimensions so short that every sum stays below 2**24 and is exact, reduced again, and the
signed scores are put together by the Chinese remainder theorem. The number of primes comes
from a proven bound, the largest anchor norm times the largest candidate norm of the tile.

Anchors are a stated set of rows; they meet all rows in tiles (anchor block x candidate
block, both of bounded size, dealt by a hash of id and vector), in two passes:

1. each tile returns an anchor's best rows of its own label; ranked over all tiles they are
   its positives;
2. each tile returns, for each anchor and positive, the best rows of other labels whose
   score lies in the window given by the positive's score; ranked again over all tiles.

Only the few best of each tile are shuffled, never a score matrix.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part; rows equal in id, label and vector count once; vectors of different
length are compared over their common dimensions; of several rows with an anchor's id the
one with the smallest label, then vector, is the anchor, and none of them is its candidate;
ties go to the smaller id; an empty table gives no rows; further columns are ignored. A
score of 62 bits or more is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, group_count
from lakebuild.llm.tiles import longest, matrix, tiles

POSITIVES, NEGATIVES, SCALE, ANCHOR_EVERY = 5, 3, 256, 50
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
ANCHOR_TILE, CANDIDATE_TILE, CHUNK = 2048, 8192, 256
KEY = ["vec_id", "label", "v"]
LARGEST_PRIME = 251
EXACT = 1 << 24  # float32 holds every integer up to here


def primes_below(n: int) -> list[int]:
    """The primes up to n, largest first."""
    sieve = np.ones(n + 1, bool)
    sieve[:2] = False
    for i in range(2, int(n ** 0.5) + 1):
        if sieve[i]:
            sieve[i * i::i] = False
    return np.nonzero(sieve)[0][::-1].tolist()


def enough_primes(bound: float) -> list[int]:
    """The fewest of the largest primes whose product exceeds every span of -bound to bound."""
    if not bound < float(1 << 62):
        raise OverflowError("an inner product may not fit 62 bits; use a smaller scale")
    out, product = [], 1
    for p in primes_below(LARGEST_PRIME):
        if product > 2 * int(bound) + 2:
            break
        out.append(p)
        product *= p
    return out


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Integer-valued doubles modulo p, at most p // 2 in size, as float32. ``fmod`` is exact."""
    r = np.fmod(m, p)
    return (r - p * np.rint(r / p)).astype(np.float32)


def exact_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``a @ c.T`` of integer-valued doubles, exactly, as int64."""
    if not len(a) or not len(c) or not a.shape[1]:
        return np.zeros((len(a), len(c)), np.int64)
    with np.errstate(over="ignore"):
        longest = [float(np.sqrt((m * m).sum(axis=1).max())) for m in (a, c)]
    primes = enough_primes(longest[0] * longest[1] * (1 + 1e-9) + 1)
    whole = int(np.prod(np.array(primes, object)))
    wide = object if whole >= 1 << 50 else np.int64  # remainders times weights stay below 2**62
    total = np.zeros((len(a), len(c)), wide)
    for p in primes:
        ra, rc = residues(a, p), residues(c, p)
        run = (EXACT - 1) // (p // 2) ** 2
        rest = np.zeros((len(a), len(c)), np.int64)
        for k in range(0, a.shape[1], run):
            rest += (ra[:, k:k + run] @ rc[:, k:k + run].T).astype(np.int64)
        share = whole // p
        total += (rest % p).astype(wide) * (share * pow(share, -1, p))
    total %= whole
    return np.where(total > whole // 2, total - whole, total).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, live: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best live scores, ties to the smaller id."""
    at = np.nonzero(live)[0]
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, -k)[-k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _tile(anchors: pa.Table, rows: pa.Table, scale: float) -> tuple[np.ndarray, ...]:
    """Ids, labels and components of both sides."""
    width = min(longest(anchors), longest(rows))
    out = []
    for t in (anchors, rows):
        out += [t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"], width, scale)]
    return tuple(out)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): the rows that take part, once each."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.col(label_col).isNotNull() & finite)
    return part.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                       v.cast("array<double>").alias("v")).distinct()


def _ranked(found: DataFrame, keys: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), vec_id))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(anchors: DataFrame, rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, scale: float = SCALE, anchor_tile: int = ANCHOR_TILE, candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); both inputs as given by ``usable``."""
    rows = cut(rows)
    first = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    asked = cut(first.select("vec_id", "x.label", "x.v"))
    n_a, n_c = group_count(asked.count(), anchor_tile), group_count(rows.count(), candidate_tile)

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):  # a tile without one of the sides; it comes without columns
            return _table([], ["anchor_id", "positive_id", "positive_score"])
        a_id, a_label, a, c_id, c_label, c = _tile(left, right, scale)
        out = []
        for label in np.unique(a_label):
            mine_, theirs = np.nonzero(a_label == label)[0], np.nonzero(c_label == label)[0]
            for i in range(0, len(mine_), CHUNK):
                part = mine_[i:i + CHUNK]
                scores = exact_products(a[part], c[theirs])
                for j, s in zip(part, scores):
                    top = best(s, c_id[theirs], c_id[theirs] != a_id[j], positives)
                    out.append((np.full(len(top), a_id[j]), c_id[theirs[top]], s[top]))
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    near = tiles(asked, rows, n_a, n_c, KEY).applyInArrow(same, "anchor_id long, positive_id long, positive_score long")
    near = _ranked(near, ["anchor_id"], "positive_score", "positive_id", positives)
    held = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("near"))
    armed = cut(asked.join(held, asked["vec_id"] == held["anchor_id"])
                .select("vec_id", "label", "v", F.col("near.positive_id").alias("p_id"), F.col("near.positive_score").alias("p_score")))

    def windowed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):  # a tile without one of the sides; it comes without columns
            return _table([], ["anchor_id", "p", "positive_id", "positive_score", "negative_id", "negative_score"])
        a_id, a_label, a, c_id, c_label, c = _tile(left, right, scale)
        p_id, p_score = left["p_id"].to_pylist(), left["p_score"].to_pylist()
        out = []
        for i in range(0, len(a), CHUNK):
            scores = exact_products(a[i:i + CHUNK], c)
            for j, s in enumerate(scores, i):
                other = (c_label != a_label[j]) & (c_id != a_id[j])
                for k, (pid, ps) in enumerate(zip(p_id[j], p_score[j])):
                    inside = other & (s >= -(-low * ps // 100)) & (s <= high * ps // 100)
                    top = best(s, c_id, inside, negatives)
                    n = len(top)
                    out.append((np.full(n, a_id[j]), np.full(n, k), np.full(n, pid), np.full(n, ps), c_id[top], s[top]))
        return _table(out, ["anchor_id", "p", "positive_id", "positive_score", "negative_id", "negative_score"])

    far = tiles(armed, rows, n_a, n_c, KEY).applyInArrow(
        windowed, "anchor_id long, p long, positive_id long, positive_score long, negative_id long, negative_score long")
    far = _ranked(far, ["anchor_id", "p"], "negative_score", "negative_id", negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(x.astype(np.int64)) for n, x in zip(names, columns)})


SQL = f"""
with r as (select distinct vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, embedding
    from embeddings where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from r),
a as (select vec_id as anchor_id, min({{'label': label, 'v': v}}) as x from u where vec_id % {ANCHOR_EVERY} = 0 group by vec_id),
s as (select anchor_id, vec_id, (a.x.label = u.label) as same,
        coalesce(list_sum(list_transform(generate_series(1, least(len(a.x.v), len(u.v))), lambda i: a.x.v[i] * u.v[i])), 0)::bigint as score
      from a join u on vec_id <> anchor_id),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as p from s where same) where p <= {POSITIVES}),
n as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.p order by s.score desc, s.vec_id)::int as rank
      from p join s on p.anchor_id = s.anchor_id and not s.same
        and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
