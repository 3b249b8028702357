"""What the findings of round 3 were about: work and memory that grew faster than the input."""

import pytest
from pyspark.sql import functions as F

from strata.functions import tokens as tk
from strata.functions.scoring import isolating
from strata.operators import decode as dec
from strata.operators import evaluate as ev
from strata.operators import lookup, ngram
from strata.session import settle


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell_rows", [1, 4096])
def test_parts_keep_repeated_groups_apart(spark, monkeypatch, cell_rows):
    """A table in parts decodes as a broadcast one, hot contexts cut into cells or not."""
    monkeypatch.setattr(dec, "CELL_ROWS", cell_rows)
    docs = spark.createDataFrame([(0, "the cat sat on the mat the dog"), (1, "the end"), (2, "a the b")], "doc_id long, text string")
    prompts = spark.createDataFrame([(7, "the"), (7, "cat"), (7, "cat"), (None, "the")], "group_id long, context string")
    table = dec.bigram_table(docs)
    rows = [sorted(dec.decode_arms(prompts, table, num_samples=2, max_steps=5, seed=3, local_rows=n).collect(), key=str) for n in (0, 100)]
    assert rows[0] == rows[1] and len(rows[0]) == 16
    gaps = spark.createDataFrame([("x", "x", 0.0, 0.25), ("x", "y", 0.5, 1.0)], "context string, token string, lo double, hi double")
    start = spark.createDataFrame([(i, "x") for i in range(9)], "group_id long, context string")
    rows = [sorted(dec.decode_arms(start, gaps, num_samples=2, max_steps=4, local_rows=n).collect(), key=str) for n in (0, 100)]
    assert rows[0] == rows[1]


def test_the_parts_are_not_moved_again(spark):
    table = dec._placed_once(spark.range(20).selectExpr("cast(id % 5 as int) AS part", "id AS v"), 8, "part")
    assert "Exchange" not in _plan(table.groupBy("part").applyInArrow(lambda t: t, "part int, v long"))


def test_a_text_is_split_once(spark):
    """F3, F9, F10, F18."""
    docs = spark.createDataFrame([(0, "A b a"), (1, ""), (2, None), (3, " \x1c ")], "doc_id long, text string")
    assert _plan(dec.bigram_counts(docs)).count("split(") == 1
    got = {(r.context, r.token): r.cnt for r in dec.bigram_counts(docs).collect()}
    assert got == {("a", "b"): 1, ("b", "a"): 1, ("a", dec.END_TOKEN): 1}


def test_tables_are_written_once_to_files(spark):
    """a checkpoint computes its last stage twice and is not compressed."""
    docs = spark.createDataFrame([(0, "a b a c"), (1, "b a")], "doc_id long, text string")
    for made in (ngram.ngram_counts(docs, 3), lookup.interval_table(dec.bigram_table(docs)).rows, dec.bigram_table(docs)):
        assert any("settled-" in f for f in made.inputFiles())
    kept = settle(spark.sql("SELECT 1 AS a, NULL AS b"))  # no file holds a void column
    assert [tuple(r) for r in kept.collect()] == [(1, None)]


def test_a_scorer_is_asked_once_a_sample(spark, tmp_path):
    """the record and the failures come from one call."""
    log = str(tmp_path / "asked")

    def scorer(prompts, completions, answers):
        with open(log, "a") as out:
            out.write("".join(f"{c}\n" for c in completions))
        return [True if c == "c0" else 0.25 if c == "c1" else None for c in completions]

    prompts = spark.createDataFrame([(i, "p", "1") for i in range(3)], "prompt_id long, prompt string, answer string")
    comps = spark.createDataFrame([("a", i, j, f"c{j}") for i in range(3) for j in range(3)], "arm string, prompt_id long, sample_idx int, completion string")
    fn = isolating(scorer)
    scored = ev.settled_scores(prompts, comps, 3, fn)
    row = ev.evaluate(prompts, comps, 3, ["a"], scorer=fn, scored=scored).first()
    bad = ev.scorer_failures(prompts, comps, 3, ["a"], fn, scored).first()
    assert (row.pass_at_1, row.reward_mean, bad.num_scored, bad.num_failed) == (1.0, 3.75 / 9, 9, 0)
    assert sorted(open(log).read().split()) == ["c0"] * 3 + ["c1"] * 3 + ["c2"] * 3


def test_tasks_of_an_evaluation_are_counted(spark, monkeypatch):
    """The samples of a task are bounded, whatever the partitions of a shuffle."""
    prompts = spark.createDataFrame([(i, "p", str(i)) for i in range(20)], "prompt_id long, prompt string, answer string")
    comps = spark.createDataFrame([("a", i, 0, str(i % 3)) for i in range(20)], "arm string, prompt_id long, sample_idx int, completion string")
    whole = ev.evaluate(prompts, comps, 1, ["a"]).collect()
    monkeypatch.setattr(ev, "SCORED_PER_TASK", 2)
    cut = ev.evaluate(prompts, comps, 1, ["a"])
    assert cut.collect() == whole and "prompt_id#" in _plan(cut) and ", 10), REPARTITION_BY_NUM" in _plan(cut)


def test_a_mask_searches_once(spark):
    """not once an element."""
    rows = spark.createDataFrame([([3, 1, 4],), ([7],), ([2, 2],), ([],), (None,)], "ids array<int>")
    made = rows.select(tk.completion_mask("ids", (1, 7)).alias("m"))
    assert "lambda" not in _plan(made)
    assert [r.m for r in made.collect()] == [[1, 1, 0], [1], [1, 1], [], None]


def _whole(batch):
    return batch[["prompt_id"]].assign(n=len(batch), first=int(batch["prompt_id"].iloc[0]))


def test_batches_share_a_group(spark, monkeypatch):
    """a group of Arrow's holds many generation batches, ``fn`` still sees one at a time."""
    prompts = spark.range(37).select(F.col("id").alias("prompt_id")).repartition(5)
    for size in (3, 64):
        monkeypatch.setattr(dec, "BATCHES_PER_GROUP", size)
        made = dec.generate_batches(prompts, _whole, "prompt_id long, n long, first long", batch_size=8)
        assert "_group" in _plan(made)
        assert {r.prompt_id: (r.batch_id, r.n, r.first) for r in made.collect()} == {i: (i // 8, min(8, 37 - i // 8 * 8), i // 8 * 8) for i in range(37)}
