"""Inputs of the registered queries, derived from the driver's tables (FIXTURES.md §3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.evaluate import first_k_samples
from strata.sources.tables import read_table

# Arms of the comparison, baseline first.
ARMS = ("baseline", "arithmetic")
# lineitem status that stands for each arm.
ARM_OF_STATUS = {"F": "baseline", "O": "arithmetic"}
# Samples per prompt and prompts per generation batch (the reference's defaults).
K = 8
BATCH_SIZE = 8
# Total order of samples inside a (arm, prompt) group; (l_orderkey, l_linenumber) is not unique.
SAMPLE_ORDER = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")


def eval_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, prompt, answer) from ``part``: the part key is the slice ordinal."""
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("prompt_id"),
        F.col("p_name").alias("prompt"),
        F.col("p_size").cast("string").alias("answer"),
    )


def arm_of(status):
    expr = None
    for s, a in ARM_OF_STATUS.items():
        expr = F.when(status == s, F.lit(a)) if expr is None else expr.when(status == s, F.lit(a))
    return expr.otherwise(status)


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, prompt_id, sample_idx) of every line with a part, the order key as sample index."""
    li = read_table(spark, sf_dir, "lineitem").where("l_partkey IS NOT NULL")
    return li.select(
        arm_of(F.col("l_linestatus")).alias("arm"), F.col("l_partkey").alias("prompt_id"), F.col("l_orderkey").alias("sample_idx")
    )


def eval_completions(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(arm, prompt_id, sample_idx, completion, new_tokens, ts) from ``lineitem``.

    The completion is ``'  The answer is \\boxed{<int quantity>} '``; new tokens are its
    whitespace-separated words; ``ts`` is the ship date. The first k lines per (arm, part) in
    ``SAMPLE_ORDER`` are the samples.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        arm_of(F.col("l_linestatus")).alias("arm"),
        F.col("l_partkey").alias("prompt_id"),
        *SAMPLE_ORDER,
    )
    top = first_k_samples(li, k, ["arm", "prompt_id"], list(SAMPLE_ORDER))
    completion = F.concat(
        F.lit("  The answer is \\boxed{"), F.col("l_quantity").cast("int").cast("string"), F.lit("} ")
    )
    return top.select(
        "arm",
        "prompt_id",
        "sample_idx",
        completion.alias("completion"),
        F.col("l_shipdate").alias("ts"),
    ).withColumn("new_tokens", F.size(F.split(F.trim(F.col("completion")), " +")).cast("long"))
