"""Top-p (W3) without a sort: the cut of each context is found by radix histograms.

``distribution.apply_top_p`` orders all rows of a context (a range exchange and a checkpoint).
Here a row's place in the order, weight descending, then token id ascending, is written as six
digits of 16 bits. One aggregation per digit sums the weights of each value the digit takes, finds the
last value whose rows still begin within the share, and goes on inside that value. What remains
is one (weight, token) per context, against which every row is held.

Rows are never sorted or moved, whatever a context holds: each pass is a partial aggregate, and the
running sum of a context goes over at most 65,536 histogram values. Contexts are counted first; up to
``BROADCAST_CONTEXTS`` (a parameter) the cuts, one row a context, are broadcast, beyond it joined. The input
is read once per digit, so hand in a table or a cheap projection of one; with many small contexts the
sliced scan of ``apply_top_p`` is the better choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.scan import _null_safe_join

BROADCAST_CONTEXTS = 100_000
ONE = 1 << 30
_CUT = ["_limit", "_before"]


def whole_weight(logit: Column, largest: Column) -> Column:
    """exp(logit - largest) in whole units of 2^-30; the largest logit weighs 2^30 even if infinite."""
    return F.when(logit == largest, F.lit(ONE)).otherwise(F.floor(F.exp(logit - largest) * float(ONE) + 0.5)).cast("long")


def _digits(weight: Column, token: Column) -> list[Column]:
    """The place of a row in the order (weight descending, token ascending), 16 bits at a time."""
    w, low = F.lit(ONE).cast("long") - weight, F.lit(65_535).cast("long")
    head = [F.shiftright(w, 16), w.bitwiseAND(low), F.shiftright(token, 48)]
    return head + [F.shiftright(token, s).bitwiseAND(low) for s in (32, 16, 0)]


def _attach(rows: DataFrame, stats: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """``rows`` with the one row of ``stats`` of their context; one row of literals without contexts."""
    if by:
        return _null_safe_join(rows, F.broadcast(stats) if small else stats, by)
    one = stats.first()
    return rows.withColumns({f.name: F.lit(one[f.name] if one else None).cast(f.dataType) for f in stats.schema.fields})


def select_top_p(
    df: DataFrame, by: Sequence[str], top_p: float | None, logit: str = "logit", token: str = "token",
    weight: str = "weight", broadcast_contexts: int = BROADCAST_CONTEXTS,
) -> DataFrame:
    """Rows of ``df`` before which, in their context, at most ``top_p`` of the weight lies, with their
    whole ``weight`` (2^30 for the largest logit); the most likely token always stays.

    Off unless 0 < top_p < 1 (then only the weight is added). Tokens are integral ids. Logits within
    2^-30 of the largest probability count as tied; ties go by token, and rows that agree in both stay
    or go together. Sums are of integers, so the result depends on no order. Rows whose logit is null or
    NaN, or whose token is null, are left out; null contexts are a context; an empty table gives an
    empty result. Columns other than ``weight`` are kept as they are."""
    by = list(by)
    good = df.where(F.col(logit).isNotNull() & ~F.isnan(F.col(logit).cast("double")) & F.col(token).isNotNull())
    x = F.col(logit).cast("double")
    largest = good.groupBy(*by).agg(F.max(x).alias("_largest"))
    small = bool(by) and largest.limit(broadcast_contexts + 1).count() <= broadcast_contexts
    rows = _attach(good, largest, by, small).withColumn(weight, whole_weight(x, F.col("_largest"))).drop("_largest")
    if top_p is None or not (0.0 < top_p < 1.0):
        return rows

    digits = _digits(F.col(weight), F.col(token).cast("long"))
    narrow = rows.select(*by, F.col(weight), F.col(token))
    context = Window.partitionBy(*by)
    earlier = context.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    cut = None
    for k, digit in enumerate(digits):
        found = [f"_c{j}" for j in range(k)]
        inside = narrow
        if cut is not None:
            inside = _attach(narrow, cut, by, small)
            for name, d in zip(found, digits, strict=False):
                inside = inside.where(d == F.col(name))
        known = [] if cut is None else [*_CUT, *found]
        hist = inside.groupBy(*by, *known, digit.alias("_d")).agg(F.sum(weight).alias("_m"))
        if cut is None:
            limit = F.floor(F.lit(float(top_p)) * F.sum("_m").over(context).cast("double")).cast("long")
            hist = hist.withColumns({"_limit": limit, "_before": F.lit(0).cast("long")})
        start = F.col("_before") + F.coalesce(F.sum("_m").over(earlier), F.lit(0))
        reached = hist.withColumn("_start", start).where(F.col("_start") <= F.col("_limit"))
        cut = reached.groupBy(*by, "_limit", *found).agg(F.max("_start").alias("_before"), F.max("_d").alias(f"_c{k}"))
    names = [f"_c{j}" for j in range(len(digits))]
    place = F.struct(*[d.cast("long").alias(n) for d, n in zip(digits, names, strict=True)])
    last = F.struct(*[F.col(n).cast("long").alias(n) for n in names])
    return _attach(rows, cut, by, small).where(place <= last).drop(*_CUT, *names)
