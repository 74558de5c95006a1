"""Dual-key reference lookup (JO3, FI5).

A text reference holds either an entity id or an entity name. Resolution is a
left join on the id, a left join on the name, and ``coalesce(id hit, name
hit)``; unresolved references give NULL.

``versions`` picks which dimension rows take part:

* ``"all"`` - every history version (the reference behaviour; a hit on an
  entity with k versions yields k rows),
* ``"current"`` - the current version only (one row per entity),
* ``"as_of"`` - the version valid at the fact's own instant ``at``.

Plans. What a fact gets depends only on its reference value (and, for
``"as_of"``, its instant), so the answer is worked out on the dimension side
first and the facts take ONE left join to it, sitting directly on two
shuffles, so that AQE can split a hot reference value.

* ``"all"`` / ``"current"``: a *resolution table* - per value either the id
  hit with multiplicity ``k_id * max(k_name, 1)`` (the row product of the two
  left joins), or each name hit with its count. Counts are two-stage
  aggregates; nothing is gathered per value, so a name borne by very many
  entities costs no more than its distinct (name, entity) pairs, spread over
  tasks.
* ``"as_of"``: a *resolution timeline* - the id intervals and name intervals
  of a value are cut against each other in a sweep over their boundaries into
  rows (value, start, end, hit, multiplicity), disjoint per (value, hit); the
  facts then take the period-segmented interval join of ``temporal``.
  Boundaries where nothing changes (one version ends as the next begins)
  cancel out in the aggregation before any sweep, so an unbroken history of
  any length is two boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import point_in_time_join

_COPY_BLOCK = 1 << 16  # rows are multiplied in two steps, so no array exceeds this many entries


def resolution_table(dim: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(value, hit, multiplicity) for every reference value that resolves.

    Same rows as the two left joins + ``coalesce`` would give a fact whose
    reference is ``value``. An id's multiplicity is multiplied by the rows
    that bear the same value as their name; a name counts only where no id
    has that value.
    """
    ids = dim.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    names = dim.filter(F.col(name_col).isNotNull()) \
               .groupBy(F.col(name_col).alias("__v"), F.col(id_col).alias("__hit")).agg(F.count(F.lit(1)).alias("__k"))
    named = names.groupBy("__v").agg(F.sum("__k").alias("__k_name"))
    by_id = ids.join(named, "__v", "left") \
               .select("__v", F.col("__v").alias("__hit"), (F.col("__k") * F.coalesce("__k_name", F.lit(1))).alias("__mult"))
    by_name = names.join(ids.select("__v"), "__v", "left_anti").select("__v", "__hit", F.col("__k").alias("__mult"))
    return by_id.unionByName(by_name)


def _boundaries(live: DataFrame, key: dict[str, Column], start: str, end: str, delta: str) -> DataFrame:
    """(key, __t, delta): by how much the number of open intervals changes at each instant."""
    ends = F.explode(F.array(F.struct(F.col(start).alias("__t"), F.lit(1).cast("long").alias(delta)),
                             F.struct(F.col(end).alias("__t"), F.lit(-1).cast("long").alias(delta))))
    return (live.select(*[c.alias(n) for n, c in key.items()], ends.alias("__x")).select(*key, "__x.*")
                .groupBy(*key, "__t").agg(F.sum(delta).alias(delta)).filter(F.col(delta) != 0))


def _sweep(changes: DataFrame, key: list[str], deltas: dict[str, str]) -> DataFrame:
    """(key, __s, __e, counts): running totals of the changes between neighbouring boundaries."""
    w = Window.partitionBy(*key).orderBy("__t")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.select(*key, F.col("__t").alias("__s"), F.lead("__t").over(w).alias("__e"),
                          *[F.sum(d).over(run).alias(n) for d, n in deltas.items()])


def resolution_timeline(dim: DataFrame, id_col: str, name_col: str, start: str = "effective_timestamp",
                        end: str = "end_timestamp") -> DataFrame:
    """(__v, __s, __e, __hit, __mult): what a reference ``__v`` resolves to at each instant of ``[__s, __e)``.

    While a version with that id is alive the hit is the id, as often as
    id versions x name versions (at least one) are alive; else the hits are
    the entities alive under that name.
    """
    live = dim.filter(F.col(start) < F.col(end))
    of_id = live.filter(F.col(id_col).isNotNull())
    of_name = live.filter(F.col(name_col).isNotNull())
    id_steps = _boundaries(of_id, {"__v": F.col(id_col)}, start, end, "__di")
    name_steps = _boundaries(of_name, {"__v": F.col(name_col), "__hit": F.col(id_col)}, start, end, "__dn")

    # values that are an id: id and name boundaries in one sweep
    ids = id_steps.select("__v").distinct()
    shared = name_steps.join(ids, "__v", "left_semi").groupBy("__v", "__t").agg(F.sum("__dn").alias("__dn"))
    both = id_steps.withColumn("__dn", F.lit(0).cast("long")) \
                   .unionByName(shared.withColumn("__di", F.lit(0).cast("long"))) \
                   .groupBy("__v", "__t").agg(F.sum("__di").alias("__di"), F.sum("__dn").alias("__dn"))
    by_id = _sweep(both, ["__v"], {"__di": "__ki", "__dn": "__kn"}).filter("__ki > 0") \
        .select("__v", "__s", "__e", F.col("__v").alias("__hit"), (F.col("__ki") * F.greatest("__kn", F.lit(1))).alias("__mult"))

    # values that are a name: cut to the gaps in which no version with that id is alive (none: whole)
    spans = _sweep(id_steps, ["__v"], {"__di": "__ki"}).filter("__ki > 0")
    order = Window.partitionBy("__v").orderBy("__s")
    walled = spans.select("__v", "__s", "__e", F.lag("__e").over(order).alias("__before"), F.lead("__s").over(order).isNull().alias("__last"))
    gap_before = F.struct(F.col("__before").alias("__gs"), F.col("__s").alias("__ge"))
    gap_after = F.struct(F.col("__e").alias("__gs"), F.nullif("__s", "__s").alias("__ge"))
    gaps = walled.select("__v", F.explode(F.when(F.col("__last"), F.array(gap_before, gap_after)).otherwise(F.array(gap_before))).alias("__g")) \
                 .select("__v", "__g.*")
    named = _sweep(name_steps, ["__v", "__hit"], {"__dn": "__mult"}).filter("__mult > 0")
    by_name = named.join(gaps, "__v", "left") \
        .select("__v", F.greatest("__s", "__gs").alias("__s"), F.least("__e", "__ge").alias("__e"), "__hit", "__mult") \
        .filter("__s < __e")  # greatest and least pass over the NULL of an open side
    return by_id.unionByName(by_name)


def explode_copies(df: DataFrame, copies: str, number: str = "__copy") -> DataFrame:
    """Turn a row with ``copies = n`` (64-bit) into n rows numbered 1 to n in ``number`` (none for n < 1); ``copies`` stays."""
    # (a row of no copies goes last, by its number: a test on the count alone would move below a join of the caller's and
    # part its shuffle from one that it could share)
    n, block = F.greatest(F.col(copies).cast("long"), F.lit(1).cast("long")), F.col("__block")
    out = df.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / _COPY_BLOCK))))
    here = F.sequence(block * _COPY_BLOCK + 1, F.least(n, (block + 1) * _COPY_BLOCK))
    return out.withColumn(number, F.explode(here)).drop("__block").filter(F.coalesce(F.col(number) <= F.col(copies).cast("long"), F.lit(False)))


def expand_copies(df: DataFrame, copies: str) -> DataFrame:
    """Turn a row with ``copies = n`` into n identical rows (column dropped)."""
    return explode_copies(df, copies).drop("__copy", copies)


def resolve_reference(facts: DataFrame, ref: str, dim: DataFrame, id_col: str, name_col: str,
                      out: str = "resolved_id", versions: str = "all", at: Column | None = None,
                      start: str = "effective_timestamp", end: str = "end_timestamp",
                      current: str = "iscurrent", copies: str | None = None,
                      period: str | None = "year") -> DataFrame:
    """Resolve ``facts[ref]`` to ``out``.

    With ``copies`` the repeated rows are not materialised: each distinct
    result row carries its repeat count in that column (see ``expand_copies``;
    ``with_validity`` accepts it directly), so later stages handle fewer rows.
    ``period`` is that of ``point_in_time_join`` (``versions="as_of"`` only).
    """
    if versions not in ("all", "current", "as_of"):
        raise ValueError("versions must be all|current|as_of")
    if versions == "as_of" and at is None:
        raise ValueError("versions='as_of' needs the fact instant `at`")
    if versions == "current":
        dim = dim.filter(F.col(current))
    if versions == "as_of":
        r = resolution_timeline(dim, id_col, name_col, start, end)
        j = point_in_time_join(facts, r, ref, "__v", at, ["__hit", "__mult"], "__s", "__e", how="left", period=period)
    else:
        r = resolution_table(dim, id_col, name_col)
        j = facts.join(r, facts[ref] == r["__v"], "left").drop("__v")
    j = j.withColumn("__n", F.coalesce("__mult", F.lit(1).cast("long"))).withColumn(out, F.col("__hit")).drop("__hit", "__mult")
    return j.withColumnRenamed("__n", copies) if copies else expand_copies(j, "__n")
