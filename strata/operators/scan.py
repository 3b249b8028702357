"""Ordered scans that stay parallel when one group holds a large share of the rows.

A plain ``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task. Here the
rows are range-partitioned on ``(g, o)`` instead, so a hot group is cut into consecutive slices
that run in different tasks; each slice scans locally. Only the first and the last group of a
slice can continue into a neighbouring slice, so the state carried across slices fits in an edge
table of at most 2 rows per slice — a proven bound, joined back by broadcast. Work per task is
bounded by the slice size, never by the group size.

* ``prefix_sum``   — inclusive/exclusive running sums and group totals (CDFs, ordinals).
* ``with_ordinal`` — dense 0-based row ordinal in a total order (slices, splits).
* ``inverse_cdf``  — for each point ``c`` the CDF row with ``lo < c <= hi`` (as-of lookup:
  points and CDF rows are merged in one sort; no pairs are formed).

``bounded=True`` is for callers that know every group is small (e.g. after a top-k): one window
per group, one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import settle

UNB = Window.unboundedPreceding

def _pinned(df: DataFrame) -> DataFrame:
    """Write the sliced frame that both branches of a scan read to the checkpoint folder.

    The range partitioner samples its input to pick bounds; two independently planned copies of
    the same exchange (e.g. pruned to different columns) may sample differently and number the
    slices differently. A file there fixes one physical result for both branches: it does
    not depend on a cache being held, and a lost executor does not change a slice id.
    """
    return settle(df)


def _slices(df: DataFrame, slices: int | None) -> int:
    if slices:
        return slices
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    ren = {k: f"_r_{k}" for k in keys}
    r = right.select(*[F.col(c).alias(ren.get(c, c)) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[ren[k]])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*ren.values())


def _sliced(df: DataFrame, by: Sequence[str], order: Sequence[Column], slices: int | None) -> DataFrame:
    """Range-partition on (by, order); ``_slice`` numbers the consecutive slices.

    A fixed partition count keeps AQE from coalescing this exchange, so slice ids are stable.
    """
    n = _slices(df, slices)
    return df.repartitionByRange(n, *[F.col(b) for b in by], *order).withColumn("_slice", F.spark_partition_id())


def prefix_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    value: Column,
    *,
    incl: str = "cum_incl",
    excl: str = "cum_excl",
    total: str = "cum_total",
    bounded: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Running sums of a non-negative ``value`` within ``by`` in ``order`` (a total order).

    Adds ``incl`` (rows up to and including this one), ``excl`` (rows before it) and ``total``.
    Values are bit-consistent: ``excl`` of a row equals ``incl`` of its predecessor and the last
    ``incl`` equals ``total``, so CDF intervals tile without gaps.
    """
    v = "_ps_v"
    d = df.withColumn(v, value)
    zero = F.lit(0)
    if bounded:
        w = Window.partitionBy(*by).orderBy(*order)
        d = d.withColumn(incl, F.sum(v).over(w.rowsBetween(UNB, 0)))
        d = d.withColumn(excl, F.coalesce(F.sum(v).over(w.rowsBetween(UNB, -1)), zero))
        d = d.withColumn(total, F.max(incl).over(Window.partitionBy(*by)))
        return d.drop(v)

    ranged = _sliced(d, by, order, slices).withColumn("_gk", _group_key(by))
    w = Window.partitionBy("_slice", "_gk").orderBy(*order)
    local = _pinned(
        ranged.withColumn("_li", F.sum(v).over(w.rowsBetween(UNB, 0)))
        .withColumn("_le", F.coalesce(F.sum(v).over(w.rowsBetween(UNB, -1)), zero))
        .withColumn("_st", F.max("_li").over(Window.partitionBy("_slice", "_gk")))
    )
    # Only the first and the last group of a slice can continue in a neighbouring slice, so the
    # offsets table has at most 2 rows per slice: a proven bound, hence a broadcast join.
    edge = F.struct("_gk", "_st")
    # one row in a group has nothing before it; the others need not be looked at
    heads = local.where(F.col("_le") == 0)
    per_slice = settle(heads.groupBy("_slice").agg(F.min_by(edge, "_gk").alias("f"), F.max_by(edge, "_gk").alias("l")))
    edges = (
        per_slice.select("_slice", "f._gk", "f._st")
        .unionByName(per_slice.select("_slice", "l._gk", "l._st"))
        .distinct()
    )
    ws = Window.partitionBy("_gk").orderBy("_slice")
    off = edges.withColumn("_off", F.coalesce(F.sum("_st").over(ws.rowsBetween(UNB, -1)), zero))
    off = off.withColumn("_tot", F.max(F.col("_off") + F.col("_st")).over(Window.partitionBy("_gk")))
    out = _null_safe_join(local, F.broadcast(off.select("_slice", "_gk", "_off", "_tot")), ["_slice", "_gk"], "left")
    o = F.coalesce(F.col("_off"), zero)
    return (
        out.withColumn(incl, o + F.col("_li"))
        .withColumn(excl, o + F.col("_le"))
        .withColumn(total, F.coalesce(F.col("_tot"), F.col("_st")))
        .drop(v, "_li", "_le", "_st", "_off", "_tot", "_slice", "_gk")
    )


def _group_key(by: Sequence[str]) -> Column:
    """One orderable value per group (a struct of the group columns; a constant when global)."""
    return F.struct(*[F.col(b) for b in by]) if by else F.lit(0)


def with_ordinal(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    out: str = "ordinal",
    count_col: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Dense 0-based ordinal of each row in ``order`` (must be a total order) within ``by``.

    Two passes, no single-partition window: range slices, per-slice counts, offsets.
    ``count_col`` optionally keeps the group size (the dataset length for slicing).
    """
    res = prefix_sum(df, by, order, F.lit(1).cast("long"), incl="_oi", excl=out, total="_ot", slices=slices)
    if count_col:
        res = res.withColumnRenamed("_ot", count_col)
    else:
        res = res.drop("_ot")
    return res.drop("_oi")


def inverse_cdf(
    points: DataFrame,
    dist: DataFrame,
    by: Sequence[str],
    *,
    c: str = "c",
    lo: str = "lo",
    hi: str = "hi",
    take: Sequence[str] = ("token",),
    bounded: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Attach to each point the ``dist`` row of the same ``by`` group whose interval holds it.

    Intervals are ``(lo, hi]`` per group, tiling ``[0, 1]`` in the group's order with the last
    ``hi`` equal to 1; the first interval is closed at 0. ``take`` names the ``dist`` columns to
    copy (``lo`` and ``hi`` are always copied). Implementation: points and dist rows are merged
    and ordered by (key desc, dist-before-point, lo desc); the answer of a point is the last dist row
    seen, i.e. the row with the smallest ``hi >= c`` and of these the one with the smallest ``lo``, so
    an interval of width zero is never chosen. Linear after the sort; no pairs are formed.
    """
    carry_cols = list(dict.fromkeys([*take, lo, hi]))
    pay = F.struct(*[F.col(x) for x in carry_cols])
    pcols = [x for x in points.columns if x not in by]
    d = dist.select(
        *by,
        F.col(hi).cast("double").alias("_key"),
        F.lit(1).alias("_kind"),
        F.col(lo).cast("double").alias("_lo"),
        pay.alias("_pay"),
        F.lit(None).cast(points.select(F.struct(*pcols)).schema[0].dataType).alias("_pt"),
    )
    p = points.select(
        *by,
        F.col(c).cast("double").alias("_key"),
        F.lit(0).alias("_kind"),
        F.lit(0.0).alias("_lo"),
        F.lit(None).cast(dist.select(pay).schema[0].dataType).alias("_pay"),
        F.struct(*pcols).alias("_pt"),
    )
    u = d.unionByName(p)
    order = [F.col("_key").desc(), F.col("_kind").desc(), F.col("_lo").desc()]
    if bounded:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(UNB, 0)
        m = u.withColumn("_hit", F.last("_pay", ignorenulls=True).over(w))
    else:
        s = _sliced(u, by, order, slices).withColumn("_gk", _group_key(by))
        w = Window.partitionBy("_slice", "_gk").orderBy(*order).rowsBetween(UNB, 0)
        local = _pinned(s.withColumn("_loc", F.last("_pay", ignorenulls=True).over(w)))
        # A point can miss its row inside its slice only if its group started in an earlier
        # slice, i.e. it is the slice's first group. Per slice: the first group, the last group
        # and the last dist row seen at the slice's end (the tail). At most 2 rows per slice.
        pos = F.struct("_gk", (-F.col("_key")).alias("k"), (-F.col("_kind")).alias("d"), (-F.col("_lo")).alias("l"))
        per_slice = local.groupBy("_slice").agg(
            F.min("_gk").alias("first_gk"), F.max("_gk").alias("last_gk"), F.max_by("_loc", pos).alias("tail")
        )
        marks = per_slice.select("_slice", F.col("first_gk").alias("_gk"), F.lit(0).alias("_m"), F.lit(None).cast(
            per_slice.schema["tail"].dataType).alias("tail"))
        tails = per_slice.select("_slice", F.col("last_gk").alias("_gk"), F.lit(1).alias("_m"), "tail")
        ws = Window.partitionBy("_gk").orderBy("_slice", "_m").rowsBetween(UNB, -1)
        carry = (
            marks.unionByName(tails)
            .withColumn("_carry", F.last("tail", ignorenulls=True).over(ws))
            .filter(F.col("_m") == 0)
            .select("_slice", "_gk", "_carry")
        )
        pts = local.filter(F.col("_kind") == 0)
        m = _null_safe_join(pts, F.broadcast(carry), ["_slice", "_gk"], "left").withColumn(
            "_hit", F.coalesce(F.col("_loc"), F.col("_carry"))
        )
    m = m.filter(F.col("_kind") == 0)
    return m.select(*by, *[F.col(f"_pt.{x}").alias(x) for x in pcols], *[F.col(f"_hit.{x}").alias(x) for x in carry_cols])
