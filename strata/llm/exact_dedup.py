"""Exact deduplication by 128-bit content hash with byte comparison inside each hash group.

Texts are compared after deleting every ASCII white-space character. The rows are grouped by
(md5 of the normalised text, the normalised text): the hash spreads the groups, the text in the key
makes Spark compare bytes, so two different texts never share a group even if their hashes collide.
The aggregation is hash-based and partial per task, so a group of copies that holds a third of all
rows leaves each task as one row, and each distinct text moves once. Afterwards only (id, hash)
moves: documents find their group by hash, except the documents of hashes with several texts, which
find it by (hash, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage

SPACE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _groups(base: DataFrame) -> DataFrame:
    """One row per distinct text: its size and the row that stays (most code points, then smallest
    id). (n_cp, id) is packed into one decimal, n_cp * 2^64 - id, so the aggregate needs no sort."""
    two64 = F.expr("cast(18446744073709551616 as decimal(20,0))")
    has_id = F.col("id").isNotNull()
    packed = F.col("n_cp").cast("decimal(10,0)") * two64 - F.col("id").cast("decimal(20,0)")
    g = base.groupBy("h", "norm").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.when(has_id, F.col("n_cp"))).alias("most"),
        F.max(packed).alias("packed"),
    )
    keep = (F.col("most").cast("decimal(10,0)") * two64 - F.col("packed")).cast("long")
    return g.select("h", "norm", keep.alias("keep_id"), "group_size", F.sha2("norm", 256).alias("text_sha256"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_fn: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. Of equal texts the row with the
    most code points in its original text stays, then the one with the smallest id. A row with a
    null id is counted and stays only if no equal row has an id. Rows that repeat an id with an
    equal text are returned as often as they occur, with equal values. An empty table gives an
    empty result; other columns are ignored. ``hash_fn`` may be any hash, even a weak one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), F.length(text).alias("n_cp"), normalised(F.col(text_col)).alias("norm")
    ).withColumn("h", hash_fn(F.col("norm")))
    groups = cut_lineage(_groups(base).drop("norm"))  # per distinct text: hash, id, size, digest
    clash = groups.groupBy("h").count().where("count > 1").select("h")
    cols = ["id", "keep_id", "group_size", "text_sha256"]
    if clash.isEmpty():
        out = base.select("id", "h").join(groups, "h").select(*cols)
    else:
        clash = cut_lineage(clash)
        sole = base.select("id", "h").join(groups.join(clash, "h", "left_anti"), "h").select(*cols)
        mixed = base.join(clash, "h", "left_semi")
        out = sole.unionByName(mixed.select("id", "h", "norm").join(_groups(mixed), ["h", "norm"]).select(*cols))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
