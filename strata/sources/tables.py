"""Dataset scan. Tables are parquet files ``{dir}/{name}.parquet``; ``split`` selects a
sub-folder or a partition value so the filter reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        jvm = spark._jvm
    except Exception:  # noqa: BLE001 - Spark Connect has no JVM gateway: take the usual name
        return True
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_table(spark: SparkSession, base: str, name: str, split: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read one table. Column pruning and filter pushdown happen in the scan. The file or folder is
    ``name`` with or without the format's ending; Spark's file system decides which exists, so any
    store that Spark can read will do."""
    ending = f".{fmt}"
    path = f"{base.rstrip('/')}/{name.removesuffix(ending)}{ending}"
    if not _exists(spark, path):
        path = path.removesuffix(ending)
    if split is None:
        return spark.read.format(fmt).load(path)
    try:
        df = spark.read.format(fmt).load(path)
    except AnalysisException:  # only split sub-folders below the table folder
        df = None
    if df is not None and "split" in df.columns:  # partition column: pruned at the scan
        return df.filter(F.col("split") == split)
    return spark.read.format(fmt).load(f"{path.rstrip('/')}/{split}")  # one sub-folder per split


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an input with fewer partitions than task slots before CPU-heavy per-row work
    (text splitting). Large inputs already have many file splits and pass through unchanged."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without the RDD API (Spark Connect): leave as is
        return df
    if parts < slots:
        return df.repartition(slots)
    return df
