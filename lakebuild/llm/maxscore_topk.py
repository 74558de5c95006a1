"""Exact top-k inner products by MaxScore over shards of posting blocks.

Vectors become integer term weights, ``floor(scale * x)``; a dimension is a term, a
shard of candidates holds the term's postings as a column. Within a shard each term's
contribution to a query is shifted by its least value there, so contributions are never
negative and the shifts add up to a constant per query.

MaxScore: the shifted terms of a query are sorted by their upper bounds in the shard.
The largest set of low-bound terms whose bounds sum below the query's current k-th best
score is non-essential: no candidate can compete on them alone. The postings of the
essential terms are traversed; then the non-essential terms are probed, highest bound
first, and only for candidates whose partial score plus the bounds left is still
competitive. Survivors have exact scores. Equal scores stay competitive, so ties are exact.

Queries are a stated set; they meet the candidates in tiles (query block x candidate
shard), each of bounded size and a group of its own, so that even one query block is
searched by as many tasks as there are shards. A shard is searched block by block, with
each query's threshold carried on. Each tile returns at most k rows per query and block;
tiles are merged by rank.

Defined results: rows with a null id, a null vector, or a null or non-finite component
take no part; vectors of different length are compared over their common dimensions;
a query's own id is never its candidate, in whatever row; of rows that repeat a query's
id the smallest vector is the query, all are candidates of others; ties go to the smaller
id, then to equal rows; an empty table gives no rows; further columns are ignored. Scores
are added up in doubles, which is exact below 2**53; where a tile's norms do not rule out
a larger one, that is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, group_count
from lakebuild.llm.tiles import longest, matrix, tiles

K, SCALE, QUERY_EVERY = 5, 256, 50
QUERY_BLOCK, CANDIDATE_SHARD, CANDIDATE_BLOCK = 1024, 8192, 4096
EXACT = float(1 << 53)
PROBE = 8


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def best_in_block(q: np.ndarray, own: int, ids: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray,
                  k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one query in a candidate block, by MaxScore; scores below ``floor`` may be left out."""
    up = q >= 0
    bound = np.abs(q) * (high - low)
    shift = float(np.where(up, q * low, q * high).sum())
    order = np.argsort(bound)
    reach = np.cumsum(bound[order])  # what the lowest-bound terms add up to at most
    free = ids != own
    sample = np.nonzero(free)[0][:4 * k]
    if len(sample) >= k:  # a first threshold: exact scores of a few candidates
        floor = max(floor, float(np.partition(c[sample] @ q, -k)[-k]))
    n_low = int(np.searchsorted(reach, floor - shift, side="left"))  # bounds of non-essential terms stay below
    essential, low_terms = order[n_low:], order[:n_low]
    live = np.nonzero(free)[0]
    part = (c[:, essential] @ q[essential])[live]
    part -= float(np.where(up, q * low, q * high)[essential].sum()) - shift  # shifted, plus the constant
    while len(low_terms):
        keep = part + reach[len(low_terms) - 1] >= floor
        live, part = live[keep], part[keep]
        probe, low_terms = low_terms[-PROBE:], low_terms[:-PROBE]
        part = part + c[np.ix_(live, probe)] @ q[probe] - float(np.where(up, q * low, q * high)[probe].sum())
        if len(part) > k:
            floor = max(floor, float(np.partition(part, -k)[-k]))  # partial scores are lower bounds
    keep = part >= floor
    live, part = live[keep], part[keep]
    top = np.lexsort((ids[live], -part))[:k]
    return ids[live[top]], part[top]


def check_exact(q: np.ndarray, c: np.ndarray) -> None:
    """Raise unless the norms of both sides keep every sum below 2**53."""
    with np.errstate(over="ignore"):
        bound = [float(np.sqrt((m * m).sum(axis=1).max(initial=0.0))) for m in (q, c)]
    if not bound[0] * bound[1] < EXACT:
        raise OverflowError("an inner product may not be exact in doubles; use a smaller scale")


def topk(queries: DataFrame, candidates: DataFrame, k: int = K, scale: float = SCALE,
         query_block: int = QUERY_BLOCK, candidate_shard: int = CANDIDATE_SHARD, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs as given by ``usable``."""
    asked = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    n_q, n_c = group_count(asked.count(), query_block), group_count(candidates.count(), candidate_shard)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(left) and len(right):  # a group without one side comes without its columns
            width = min(longest(left), longest(right))
            q_ids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            q, c = matrix(left["v"], width, scale), matrix(right["v"], width, scale)
            check_exact(q, c)
            floors = np.full(len(q), -np.inf)
            for at in range(0, len(c), candidate_block):
                part, part_ids = c[at:at + candidate_block], ids[at:at + candidate_block]
                low, high = part.min(axis=0), part.max(axis=0)
                for i in range(len(q)):
                    got, score = best_in_block(q[i], int(q_ids[i]), part_ids, part, low, high, k, float(floors[i]))
                    if len(got) == k:
                        floors[i] = max(floors[i], score[-1])
                    out.append((np.full(len(got), q_ids[i]), got, score.astype(np.int64)))
        return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(("query_id", "vec_id", "score"), zip(*out))})

    found = tiles(asked, candidates, n_q, n_c, ["vec_id", "v"]).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
with u as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, min(v) as qv from u where vec_id % {QUERY_EVERY} = 0 group by vec_id),
s as (select query_id, vec_id, coalesce(list_sum(list_transform(generate_series(1, least(len(qv), len(v))), lambda i: qv[i] * v[i])), 0)::bigint as score
    from q join u on vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}"""
