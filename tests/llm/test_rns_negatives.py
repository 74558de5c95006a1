"""Residue-number products against Python integers, hard negatives against brute force."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakebuild.llm import rns_negatives as rns

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_id string"


def floors(v):
    return [math.floor(256 * x) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(rows, every=50):
    use = {(i, lab, tuple(v)) for i, v, lab, *_ in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    use = [(i, lab, floors(v), v) for i, lab, v in use]
    out = []
    for a in sorted({i for i, *_ in use if i % every == 0}):
        _, lab, av = min((lab, v, f) for i, lab, f, v in use if i == a)[0], *min((lab, v, f) for i, lab, f, v in use if i == a)[::2]
        near = sorted((-product(av, f), i) for i, l2, f, _ in use if i != a and l2 == lab)[:rns.POSITIVES]
        for s, pid in near:
            s = -s
            far = sorted((-n, i) for i, l2, f, _ in use for n in [product(av, f)]
                         if i != a and l2 != lab and 50 * s <= 100 * n <= 95 * s)[:rns.NEGATIVES]
            out += [(a, pid, k, i, s, -n) for k, (n, i) in enumerate(far, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [0, 1, 3, 300, 5_000, 1 << 20, 1 << 25])
@pytest.mark.parametrize("width", [1, 64, 2_500])
def test_products_are_exact(size, width):
    rng = np.random.default_rng(size + width)
    a, c = (rng.integers(-size, size + 1, (n, width)) for n in (7, 9))
    a[0], c[0], c[1] = size, size, -size
    want = np.array([[product(map(int, x), map(int, y)) for y in c] for x in a])
    got = rns.exact_products(a.astype(float), c.astype(float))
    assert got.dtype == np.int64 and (got == want).all()


def test_primes_and_residues():
    primes = rns.primes_below(rns.LARGEST_PRIME)
    assert primes[0] == 251 and primes[-1] == 2 and len(primes) == 54
    x = np.array([-1e20, -252.0, -1, 0, 125, 126, 2.0 ** 60])
    for p in (251, 7):
        r = rns.residues(x, p)
        assert r.dtype == np.float32 and (np.abs(r) <= p // 2 + 0.5).all()
        assert [int(i - v) % p for i, v in zip(r.astype(int).tolist(), map(int, x))] == [0] * len(x)
    # every float32 sum of a run stays where integers are exact
    assert all(((rns.EXACT - 1) // (p // 2) ** 2) * (p // 2) ** 2 < rns.EXACT for p in primes[:-2])
    assert rns.enough_primes(65_536) == [251, 241, 239]


def test_a_score_beyond_the_range_is_an_error():
    with pytest.raises(OverflowError):
        rns.exact_products(np.array([[1e20]]), np.array([[1e20]]))


def rows_of(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 0, 1, rng.uniform(-1, 1)]) * 0.5 for _ in range(6)], rng.randrange(3), "clash") for i in range(n)]
    rows += [(i, [0.5] * 6, 0, "hot") for i in range(n, n + 120)]  # ties: a third of a label has one vector
    rows += [(50, [0.25] * 6, 2, "second row of an anchor's id"), rows[3], rows[3], (7, [0.4, 0.4], 1, "short"), (8, [0.3] * 9, 1, "long"), (9, [], 1, "empty"),
             (None, [0.1] * 6, 1, "x"), (600, None, 1, "x"), (601, [None, 0.1], 1, "x"), (602, [float("nan")] * 6, 1, "x"), (603, [float("inf")] * 6, 1, "x"), (650, [0.1] * 6, None, "x")]
    return rows


@pytest.mark.parametrize("tiles", [(2048, 8192), (3, 60)])
def test_negatives_brute_force(spark, tiles):
    rows = rows_of()
    use = rns.usable(spark.createDataFrame(rows, SCHEMA))
    got = rns.mine(use.where("vec_id % 50 = 0"), use, anchor_tile=tiles[0], candidate_tile=tiles[1]).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert len(got) > 50


def test_empty_and_single(spark):
    assert rns.mine(*[rns.usable(spark.createDataFrame([], SCHEMA))] * 2).count() == 0
    one = rns.usable(spark.createDataFrame([(0, [1.0], 1, "x")], SCHEMA))
    assert rns.mine(one, one).count() == 0


def test_rows_are_dealt_in_bounded_tiles(spark):
    """No group of the cogroup holds all rows once there are more than a tile of them."""
    rows = rns.usable(spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.rand(3), F.rand(4)).alias("embedding"), (F.col("id") % 5).alias("label")))
    sizes = rows.groupBy(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(8))).count().agg(F.max("count")).first()[0]
    assert sizes < 2 * 4000 / 8
