"""Generation batches and throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.tokens import left_pad, left_pad_mask, pad_id, right_pad, right_pad_mask
from strata.operators.evaluate import MIN_WALL_SEC
from strata.operators.scan import with_ordinal


def batch_ids(df: DataFrame, order: Sequence[Column], batch_size: int, by: Sequence[str] = (), out: str = "batch_id") -> DataFrame:
    """Consecutive rows (in ``order`` within ``by``) form batches of ``batch_size``."""
    d = with_ordinal(df, order, by=by, out="_bord")
    return d.withColumn(out, F.floor(F.col("_bord") / F.lit(int(batch_size))).cast("long")).drop("_bord")


def pad_batches(
    df: DataFrame, ids: str, batch: Sequence[str], pad: int | None = 0, *, side: str = "left", eos: int | None = None
) -> DataFrame:
    """P13 + A15: pad every row to the longest row of its batch; add ``padded``, ``mask`` and
    ``padded_len``. Left padding is the generation side, right padding the evaluation side; the
    pad id falls back to ``eos`` when ``pad`` is None. A batch holds at most ``batch_size`` rows,
    so its window is small."""
    p = pad_id(pad, eos)
    m = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    d = df.withColumn("padded_len", m.cast("int"))
    if side == "left":
        padded, mask = left_pad(F.col(ids), F.col("padded_len"), p), left_pad_mask(F.col(ids), F.col("padded_len"))
    elif side == "right":
        padded, mask = right_pad(F.col(ids), F.col("padded_len"), p), right_pad_mask(F.col(ids), F.col("padded_len"))
    else:
        raise ValueError("side must be 'left' or 'right'")
    return d.withColumn("padded", padded).withColumn("mask", mask)


def batch_token_counts(df: DataFrame, arm: str, ids: str, order: Sequence[Column], batch_size: int) -> DataFrame:
    """Per arm the padded new-token count (per batch: longest row x rows, summed) and the
    effective count (sum of row lengths). Columns: arm, num_rows, num_batches, total_new_tokens,
    effective_new_tokens."""
    lengths = df.withColumn("_len", F.size(ids)).drop(ids)  # the arrays themselves are not moved
    b = batch_ids(lengths, order, batch_size, by=[arm])
    per_batch = b.groupBy(arm, "batch_id").agg(
        (F.max("_len").cast("long") * F.count(F.lit(1))).alias("_padded"),
        F.sum("_len").cast("long").alias("_eff"),
        F.count(F.lit(1)).alias("_n"),
    )
    return per_batch.groupBy(arm).agg(
        F.sum("_n").cast("long").alias("num_rows"),
        F.count(F.lit(1)).cast("long").alias("num_batches"),
        F.sum("_padded").cast("long").alias("total_new_tokens"),
        F.sum("_eff").cast("long").alias("effective_new_tokens"),
    )


def throughput(run_log: DataFrame, arm: str, ts: str, tokens: Column) -> DataFrame:
    """Per arm, wall time = span of ``ts`` in seconds (floored at 1e-9), token and row rates."""
    agg = run_log.groupBy(arm).agg(
        F.count(F.lit(1)).cast("long").alias("num_events"),
        F.sum(tokens).cast("long").alias("total_new_tokens"),
        F.min(ts).alias("_t0"),
        F.max(ts).alias("_t1"),
    )
    wall = F.greatest((F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("_t1")) / F.lit(1e6)).cast("double"), F.lit(MIN_WALL_SEC))
    return agg.select(
        arm,
        "num_events",
        "total_new_tokens",
        wall.alias("wall_time_sec"),
        (F.col("total_new_tokens") / wall).alias("new_tokens_per_sec"),
        (F.col("num_events") / wall).alias("prompts_per_sec"),
    )
