"""The stateless scorer on streaming DataFrames.

Scoring (P3) and normalisation (T1-T10) are row expressions, so a stream of completions is scored
by the same columns as a batch: a stream-static join brings the answer, ``score_expr`` scores.
``running_arm_totals`` keeps the algebraic per-arm counters (completions, reward sum, correct
samples) as a streaming aggregate; per-prompt metrics such as pass@k need the whole group and
stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.scoring import is_correct, score_expr


def score_stream(completions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Stream of (arm, prompt_id, sample_idx, completion) -> the same rows with ``score``."""
    answers = prompts.select("prompt_id", "answer")
    return completions.join(answers, "prompt_id", "inner").withColumn(
        "score", score_expr(F.col("completion"), F.col("answer"))
    )


def running_arm_totals(scored: DataFrame) -> DataFrame:
    """Per-arm running totals of a scored stream (use output mode ``complete`` or ``update``)."""
    return scored.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_scores"),
        F.sum("score").alias("score_sum"),
        F.sum(F.when(is_correct(F.col("score")), 1).otherwise(0)).alias("n_correct"),
    )
