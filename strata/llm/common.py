"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import cut_lineage

__all__ = ["cut_lineage", "hash_sample", "id_remainder", "keep_rows", "one_per_group", "read_table", "sample_rows", "with_row_key"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by the path that Spark's readers resolve (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32(id as text) mod ``divisor``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(divisor)


def hash_sample(df: DataFrame, id_col: str, class_col: str, per_class: int, seed: int = 11) -> DataFrame:
    """About ``per_class`` rows of each value of ``class_col`` (all of a smaller class), chosen by a
    hash of the id, so that retries and other partitionings choose the same rows. One narrow count
    per class; no row is sorted or moved. The share per class is a literal map over the classes."""
    counts = {r[0]: r[1] for r in df.groupBy(class_col).count().collect() if r[0] is not None}
    if not counts:
        return df.where(F.lit(False))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_class / n)))])
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(F.col(class_col).isNotNull() & (u < share[F.col(class_col)]))


def sample_rows(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(id, ``value``) of at most ``n`` ids of ``rows``, those with the smallest hashes, with one row
    each (the one whose value has the smallest hash), however often an id is repeated."""
    ids = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.lit(1).alias("one")).select("id")
    chosen = F.broadcast(ids.orderBy(F.xxhash64("id"), "id").limit(n))
    return rows.join(chosen, "id", "left_semi").groupBy("id").agg(F.min_by(value, F.xxhash64(value)).alias(value))


ROW_KEY = "__row"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row, unique whatever the ids are, in ``ROW_KEY``. A table read from
    files is dealt out to tasks in the same way each time, so its rows keep their numbers when a task
    is repeated; anything else is written first."""
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    keyed = docs.withColumn(ROW_KEY, F.monotonically_increasing_id())
    return keyed if plain else cut_lineage(keyed)


def one_per_group(keyed: DataFrame, groups: DataFrame, *first: Column, id_col: str = "doc_id") -> DataFrame:
    """(ROW_KEY): the row of each group that stays, the least by ``first``, then by id (null ids last),
    then by number. ``groups``: (ROW_KEY, group). Only numbers are moved, and reduced in each task."""
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(first)], F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(ROW_KEY).alias("row"))
    ranked = keyed.select(ROW_KEY, rank.alias("rank")).join(groups, ROW_KEY)
    return ranked.groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(ROW_KEY))


def keep_rows(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``with_row_key`` whose number is in the one column of ``keys``, without the number."""
    return keyed.join(keys.toDF(ROW_KEY), ROW_KEY, "left_semi").drop(ROW_KEY)
