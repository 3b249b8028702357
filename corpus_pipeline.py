"""A training-corpus pipeline: five stages over ``documents``, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last keep the columns of ``docs``. ``run`` chains them through Parquet in the shared
folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor never costs more than
the stage at hand.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from strata.llm.common import ROW_KEY, cut_lineage, keep_rows, one_per_group, read_table, with_row_key
from strata.session import ensure_checkpoint_dir, ship_package


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score >= 0.5) go."""
    ship_package(spark)
    labels = toxicity.training_rows(read_table(spark, sf_dir, "labels"))
    model = toxicity.train_toxicity(docs, labels)
    return docs.where(toxicity.toxicity_score(model, docs["text"]) < 0.5)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, whatever the ids are: the one with the most code points, then the
    smallest id (null ids last). Rows that repeat an id, or have none, are rows of their own."""
    ship_package(spark)
    keyed = with_row_key(docs)
    found = exact_dedup.exact_dedup(keyed, id_col=ROW_KEY).select(ROW_KEY, F.col("keep_id").alias("group"))
    return keep_rows(keyed, one_per_group(keyed, found, -F.length(F.coalesce("text", F.lit("")))))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest id (null ids last)."""
    ship_package(spark)
    keyed = with_row_key(docs)
    found = simhash.simhash_near_dedup(keyed, id_col=ROW_KEY).select(ROW_KEY, F.col("component_id").alias("group"))
    return keep_rows(keyed, one_per_group(keyed, found))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities stay. The draw is by the id; a document
    without one is drawn by a hash of its text, lest all of them go the same way."""
    ship_package(spark)
    cols = {f"__{n}": c for n, c in mixing.cell_columns().items()}
    rows = cut_lineage(docs.select(*[c.alias(n) for n, c in mixing.cell_columns().items()]))
    odds = mixing.sampling_odds(rows).toDF(*[f"__{d}" for d in mixing.DIMENSIONS], "__probability")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    drawn = docs.withColumns({**cols, "__key": key}).join(odds, [f"__{d}" for d in mixing.DIMENSIONS])
    return drawn.where(mixing.uniform(mixing.SEED, F.col("__key")) < F.col("__probability")).select(docs.columns)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256."""
    ship_package(spark)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = byte_bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, decode=True)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The toxicity and SimHash stages cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    shared = f"{ensure_checkpoint_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}-{name}")
        docs = spark.read.parquet(f"{shared}/{k}-{name}")
    return docs
