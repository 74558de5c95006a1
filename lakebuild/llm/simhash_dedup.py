"""SimHash near-duplicates, linked exactly through vantage-point trees.

Fingerprints. Texts are lower-cased in A-Z, cut into words, and every run of
``shingle`` words (joined by a space, repeats counted) is hashed with XXH64;
a bit is set if it is set in more than half of the hashes.

Links. Two fingerprints link if they differ in at most ``max_bits`` bits. They
are cut into ``max_bits // 2 + 1`` slices; linked fingerprints differ in at most
one bit on some slice. Each slice has a vantage-point tree: a node splits its
points by their Hamming distance to a vantage point. By the triangle inequality
a point one bit away lies in a neighbouring shell, so a fingerprint is stored in
the one shard (leaf) of its own shells and queries only the shards whose
boundary it overlaps; all others are pruned. Within a shard the full 64 bits are
compared. On the whole 64 bits at once a radius of 4 overlaps most boundaries
(the distances of unrelated fingerprints spread by only 4), hence the slices.

Only a spanning forest of a shard's links leaves it, never all pairs of a group.

The trees are grown on a bounded sample (``sample_size``); every fingerprint is
routed, so the sample affects only the shards' balance, not the result.

Defined results: null and empty texts have fingerprint zero, which links like
any other; equal fingerprints share one component; a null id takes part but
never becomes a component id unless its whole component has null ids (then
null); repeated rows give repeated rows; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, group_count, text_of
from lakebuild.llm.components import connected_components

SHINGLE, MAX_BITS, SEED = 4, 4, 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), end[shingle - 1:].tolist())),
                         np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """(doc_id, fp[, text_key]): one row per document, fp as a signed long; ``text_key`` tells texts under one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names)

    names = ["doc_id", "fp"] + ["text_key"] * with_key
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"), *[F.xxhash64(text_col).alias("text_key")] * with_key)
    return src.mapInArrow(run, ", ".join(f"{n} long" for n in names))


# ---------------------------------------------------------------- the trees

def slices(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the slices on one of which linked fingerprints differ in at most one bit."""
    n = max_bits // 2 + 1
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _part(fps: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def _dist(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def grow(points: np.ndarray, leaf: float, rng: np.random.Generator, depth: int = 0) -> dict | None:
    """A tree over slice values: {"at": vantage point, "shells": {distance: subtree}}; None is a shard.

    Splitting stops at ``leaf`` sample points or where all points are equal. The vantage
    point is, of a few candidates, the one whose shells come out smallest."""
    if len(points) <= leaf or depth == 12 or not (points != points[0]).any():
        return None
    tried = rng.choice(points, size=min(8, len(points)), replace=False)
    cost = [np.square(np.bincount(_dist(points, int(p)))).sum() for p in tried]
    at = int(tried[int(np.argmin(cost))])
    d = _dist(points, at)
    if (d == d[0]).all():
        return None
    return {"at": at, "shells": {int(k): sub for k in np.unique(d) if (sub := grow(points[d == k], leaf, rng, depth + 1))}}


def route(tree: dict | None, points: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each shard touched: its name, the indices stored there, the indices that query it.

    A query crosses the first boundary outwards only: of two points one bit apart one lies
    one shell further out at the root, so each pair meets in the outer one's shard."""
    def walk(node, name, own, guests, top):
        if node is None:
            if len(own) or len(guests):
                yield name, own, guests
            return
        do, dg = _dist(points[own], node["at"]).astype(np.int16), _dist(points[guests], node["at"]).astype(np.int16)
        shells = np.unique(np.concatenate([do, do + 1, dg - 1, dg + 1] if top else [do, dg - 1, dg + 1]))
        for k in shells[shells >= 0].tolist():
            visit = own[do == k - 1] if top else guests[abs(dg - k) == 1]
            yield from walk(node["shells"].get(k), f"{name}.{k}", own[do == k], visit, False)

    everyone = np.arange(len(points))
    yield from walk(tree, "", everyone, everyone[:0], True)


def shard_links(own: np.ndarray, guests: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``own`` and between ``own`` and ``guests``.

    Breadth-first, one component after another: reached points are compared only with points not
    reached yet, so a large group of near copies costs about its size, not its square. All points
    of a frontier are of one component, so one link to each new point is enough."""
    points, n = np.concatenate([own, guests]), len(own)
    left, right, reached = [], [], np.zeros(len(points), bool)

    def near(f: np.ndarray, pool: np.ndarray) -> np.ndarray:
        return np.bitwise_count(points[f][:, None] ^ points[pool][None, :]) <= max_bits

    rest, free = np.arange(n), np.arange(n, len(points))  # not reached yet
    while len(rest):
        seeds = rest[:64]
        linked = (near(seeds, rest).sum(axis=1) > 1) | near(seeds, free).any(axis=1)  # one is the seed itself
        rest = np.concatenate([seeds[linked], rest[64:]])
        for seed in seeds[linked]:
            if reached[seed]:
                continue
            reached[seed] = True
            rest = rest[rest != seed]
            frontier = np.array([seed])
            while len(frontier):
                new = []
                for i in range(0, len(frontier), 64):
                    f = frontier[i:i + 64]
                    # guests do not query each other: they are compared with what is left of ``own`` only
                    for kind, f in enumerate((f, f[f < n])):
                        pool = free if kind else rest
                        if not len(pool) or not len(f):
                            continue
                        hits = near(f, pool)
                        hit = hits.any(axis=0)
                        if hit.any():
                            left.append(f[hits[:, hit].argmax(axis=0)])
                            right.append(pool[hit])
                            new.append(pool[hit])
                            reached[pool[hit]] = True
                            if kind:
                                free = pool[~hit]
                            else:
                                rest = pool[~hit]
                frontier = np.concatenate(new) if new else rest[:0]
    none = np.zeros(0, np.int64)
    return points[np.concatenate([none, *left])], points[np.concatenate([none, *right])]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, shard_points: int = 512, sample_size: int = 20_000) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span every component."""
    n = distinct.count()
    rate = min(1.0, sample_size / max(1, n))
    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < int(rate * (1 << 30))) \
        .limit(2 * sample_size).toArrow()["fp"].to_numpy().view(np.uint64)
    sample = np.sort(sample)
    leaf = shard_points * len(sample) / max(1, n)
    cuts = slices(max_bits)
    trees = [grow(_part(sample, *c), leaf, np.random.default_rng(i)) if len(sample) else None for i, c in enumerate(cuts)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts):
            fps = np.concatenate(parts).view(np.uint64)
            for i, c in enumerate(cuts):
                rows = [(f"{i}{name}", fps[own].tobytes(), fps[guests].tobytes())
                        for name, own, guests in route(trees[i], _part(fps, *c))]
                yield pd.DataFrame(rows, columns=["shard", "own", "guests"])

        held, size = [], 0
        for b in batches:
            held.append(b["fp"].to_numpy())
            size += len(b)
            if size >= 100_000:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(pdf["own"]), np.uint64)
        guests = np.frombuffer(b"".join(pdf["guests"]), np.uint64)
        a, b = shard_links(own, guests, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.repartition(group_count(n, 50_000), "fp")
    shards = dealt.mapInPandas(send, "shard string, own binary, guests binary")
    return shards.groupBy("shard").applyInPandas(meet, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                   id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """(doc_id, fp, component_id[, text_key]) per document; the component id is the smallest id reachable."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col, with_key))
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(first.select("fp"), max_bits))
    named = first.join(found, first["fp"] == found["node"], "left") \
        .select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id", *["text_key"] * with_key)


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without those whose group has a smaller id. A document is a row's id and text: rows that share
    an id are judged each by its own text; of repeated rows with the kept id all stay, as do rows with a null id."""
    groups = simhash_groups(docs.select("doc_id", "text"), shingle, max_bits, with_key=True)
    gone = groups.where("doc_id <> component_id").select("doc_id", "text_key").distinct().alias("gone")
    on = (F.col("d.doc_id").cast("long") == F.col("gone.doc_id")) & (F.xxhash64("d.text") == F.col("gone.text_key"))
    return docs.alias("d").join(gone, on, "left_anti")
