"""Plug-ins that fail, generation by whole batches with a log, slices by position."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions.scoring import isolating, score
from strata.operators import decode as dec
from strata.operators.evaluate import scorer_failures
from strata.sources.dataset import positional_slice


def _picky(prompt, completion, answer):
    if completion.str.contains("bad").any():
        raise ValueError("cannot read it")
    return [None if c == "none" else 0.25 for c in completion]


def test_isolated_rows_only_lose_their_score(spark):
    rows = [(i, "a", 0, i, {3: "bad", 40: "bad", 41: "none"}.get(i, "7")) for i in range(100)]
    comps = spark.createDataFrame([(r[1], r[0], r[2], r[4]) for r in rows], "arm string, prompt_id long, sample_idx int, completion string")
    df = comps.withColumn("answer", F.lit("7")).withColumn("prompt", F.lit("p")).repartition(3)
    got, backend = score(df, scorer=isolating(_picky))
    assert backend == "_picky"
    out = {r.prompt_id: (r.score, r.scorer_error) for r in got.collect()}
    assert out[3] == out[40] == (0.0, "ValueError: cannot read it")  # the built-in score of "bad"
    assert out[41] == (0.0, None) and out[5] == (0.25, None) and len(out) == 100
    short, _ = score(df.limit(3), scorer=isolating(lambda p, c, a: [1.0] * (len(c) + 1)))
    assert {r.scorer_error for r in short.collect()} == {"ValueError: 2 scores for 1 rows"}
    prompts = spark.createDataFrame([(i, "p", "7") for i in range(100)], "prompt_id long, prompt string, answer string")
    told = {r.arm: (r.num_scored, r.num_failed, r.num_reasons) for r in scorer_failures(prompts, comps, 1, ["a", "b"], isolating(_picky)).collect()}
    assert told == {"a": (100, 2, 1), "b": (0, 0, 0)}


def _stamp(batch):
    return batch[["prompt_id"]].assign(n=len(batch), first=int(batch["prompt_id"].iloc[0]))


def test_batches_are_whole_and_resume_from_their_log(spark, tmp_path):
    prompts = spark.range(10, 47).select(F.col("id").alias("prompt_id"), F.lit("x").alias("prompt")).repartition(5)
    schema = "prompt_id long, n long, first long"
    got = {r.prompt_id: (r.batch_id, r.n, r.first) for r in dec.generate_batches(prompts, _stamp, schema, batch_size=8, slice_start=10).collect()}
    assert got == {i: ((i - 10) // 8, min(8, 37 - (i - 10) // 8 * 8), 10 + (i - 10) // 8 * 8) for i in range(10, 47)}

    log = str(tmp_path / "log")

    def breaks(batch):
        if batch["prompt_id"].iloc[0] >= 34:
            raise RuntimeError("model gone")
        return _stamp(batch)

    with pytest.raises(Exception, match="model gone"):
        dec.generate_batches(prompts, breaks, schema, batch_size=8, slice_start=10, log=log, batches_per_commit=2)
    assert {r.batch_id for r in spark.read.parquet(log).collect()} == {0, 1}

    def only_new(batch):
        assert batch["prompt_id"].iloc[0] >= 26  # finished batches are not asked for again
        return _stamp(batch)

    for _ in range(2):
        again = dec.generate_batches(prompts, only_new, schema, batch_size=8, slice_start=10, log=log, batches_per_commit=2)
        assert {r.prompt_id: (r.batch_id, r.n, r.first) for r in again.collect()} == got and again.count() == 37


def test_positional_slice_reads_only_the_files_it_needs(spark, tmp_path):
    for k, n in enumerate((5, 0, 7, 4)):
        pd.DataFrame({"v": [100 * k + i for i in range(n)]}, dtype="int64").to_parquet(tmp_path / f"part-{k}.parquet", index=False)
    df = spark.read.parquet(str(tmp_path))
    every = [0, 1, 2, 3, 4] + [200 + i for i in range(7)] + [300 + i for i in range(4)]
    for start, count in ((0, 16), (3, 4), (5, 7), (12, 100), (15, 1)):
        part = positional_slice(df, start, count)
        assert sorted((r.ordinal, r.v) for r in part.collect()) == list(enumerate(every))[start : start + count]
    plan = positional_slice(df, 6, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    for bad in ((16, 1), (-1, 2), (0, -1), (0, 0)):
        with pytest.raises(ValueError):
            positional_slice(df, *bad)
