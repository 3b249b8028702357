"""Spark session defaults and reliable checkpointing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes (a small side is only
# broadcast when its measured size is under the threshold) and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "strata") -> SparkSession:
    """Return the active session or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app).master(master or os.environ.get("STRATA_MASTER", "local[8]"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("STRATA_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names the folder; it is only invented here when the setting is absent and the
    master is local (tests). A cluster without the setting is an error, because a machine-local
    folder does not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this job")
        conf_dir = tempfile.mkdtemp(prefix="strata-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: With it, Spark deletes the shuffle files of an execution when that has ended; else they stay until the
#: driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """``cut_lineage`` through a compressed columnar file in the checkpoint folder: computed once (a
    checkpoint computes its last stage twice) and several times smaller, but read back in splits of its
    own, so only for frames whose partitions mean nothing. What a file cannot hold is checkpointed. The
    shuffles that made the file are deleted with its last row written: nothing reads them again."""
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    names = {c.lower() for c in df.columns}
    if not folder or len(names) < len(df.columns) or any("void" in k or "interval" in k for _, k in df.dtypes):
        return cut_lineage(df)
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*settled: DataFrame) -> None:
    """Delete the files of frames that ``settle`` returned and that nothing reads any more. Others are
    left alone, and all are on sessions without a JVM gateway (Spark Connect)."""
    for df in settled:
        try:
            jvm = df.sparkSession._jvm
        except Exception:  # noqa: BLE001
            return
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("settled-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``strata`` importable in the Python workers (pandas UDFs, ``mapInPandas``), the way
    ``spark-submit --py-files`` does: zip the package once and add it to the context. Idempotent
    per application; sessions without a SparkContext (Spark Connect) are left alone. The zip is
    written on the driver and served to executors by Spark itself (as ``--py-files`` is); no
    executor reads the driver's disk, and no job data goes there."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="strata-pkg-"), "strata.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
