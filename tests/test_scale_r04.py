"""What the findings of round 4 were about: decodes that took a shuffle a step, and files kept for nothing."""

import os

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from strata.operators import decode as dec
from strata.operators import ngram, shared_table
from strata.session import ensure_checkpoint_dir, release, settle


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _rows(df):
    return sorted(df.collect(), key=str)


def test_a_table_of_a_tenth_of_a_gigabyte_takes_no_step_by_step_shuffle(spark, monkeypatch):
    """12 million rows (the bigrams of 0.1 GB) were decoded part by part, in up to 256 rounds."""
    docs = _docs(spark, ["the cat sat on the mat", "a the b"])
    table, prompts = dec.bigram_table(docs), dec.document_prompts(docs)
    want = _rows(dec.decode_arms(prompts, table, num_samples=2, max_steps=6, local_rows=0))
    monkeypatch.setattr(DataFrame, "count", lambda self: 12_095_322 if "hi" in self.columns else len(self.collect()))
    monkeypatch.setattr(dec, "_decode_by_parts", None)
    assert _rows(dec.decode_arms(prompts, table, num_samples=2, max_steps=6)) == want


@pytest.mark.parametrize("rows", [1, 3])
def test_pieces_of_a_shared_table_agree_with_parts(spark, monkeypatch, rows):
    """Contexts that go on in the next part, several pieces, gaps between rows, unknown and null contexts."""
    monkeypatch.setattr(shared_table, "PART_ROWS", rows)
    monkeypatch.setattr(shared_table, "PIECE_ROWS", rows)
    monkeypatch.setattr(dec, "TASK_SEQUENCES", 3)
    monkeypatch.setattr(dec, "OUT_SEQUENCES", 2)
    docs = _docs(spark, ["the cat sat on the mat the dog", "the end", "a the b the c", None, "é the ż"])
    gaps = [("x", "x", 0.1, 0.25), ("x", "y", 0.5, 0.75), ("x", "the", 0.75, 1.0), (None, "x", 0.0, 1.0), ("z", None, 0.0, 1.0), ("w", "w", 0.0, 0.0)]
    gaps = spark.createDataFrame(gaps, "context string, token string, lo double, hi double")
    prompts = spark.createDataFrame([(1, "the"), (1, "x"), (2, "x"), (3, None), (None, "a"), (4, "nowhere"), (5, "w"), (6, "z")], "group_id long, context string")
    for table in (gaps.unionByName(dec.bigram_table(docs).drop("cnt")), gaps.limit(0)):
        shared, parts = (_rows(dec.decode_arms(prompts, table, num_samples=3, max_steps=5, seed=3, local_rows=n)) for n in (1000, 0))
        assert shared == parts and len(shared) == 48
    counts = ngram.ngram_counts(docs, 3)
    table, prompts = ngram.ngram_table(counts, 3), ngram.ngram_prompts(docs, counts, 3)
    shared, parts = (_rows(dec.decode_arms(prompts, table, num_samples=3, max_steps=5, seed=3, local_rows=n)) for n in (1000, 0))
    assert shared == parts


def test_too_many_names_stay_distributed(spark, monkeypatch):
    """The names pass through the driver, so they are counted as well."""
    docs = _docs(spark, ["the cat sat on the mat", "a the b"])
    table, prompts = dec.bigram_table(docs), dec.document_prompts(docs)
    want = _rows(dec.decode(prompts, table, num_samples=2, max_steps=6))
    monkeypatch.setattr(dec, "LOCAL_NAMES", 3)
    monkeypatch.setattr(dec, "_decode_in_tasks", None)
    assert _rows(dec.decode(prompts, table, num_samples=2, max_steps=6)) == want


def test_counts_are_made_once_for_a_shaped_table(spark, monkeypatch):
    """every scan of the shaping counted the whole corpus again."""
    made = []
    monkeypatch.setattr(dec, "settle", lambda df: made.append(settle(df)) or made[-1])
    table = dec.shaped_bigram_table(_docs(spark, ["a b a c a b", "b a"]), 0.8, 2, 0.9)
    assert [set(df.columns) for df in made] == [{"context", "token", "cnt"}]
    assert "split(" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_what_made_a_settled_frame_is_deleted(spark):
    """files that nothing reads any more stayed until the end of the job."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")

    def settled():
        return {f for d, names, _ in os.walk(folder) for f in names if f.startswith("settled-")}

    before = settled()
    counts = ngram.ngram_counts(_docs(spark, ["a b a c a b a", "b a b"]), 3, min_count=2)
    assert len(settled() - before) == 1 and counts.count() > 0
    kept = settle(spark.range(9).repartition(3, "id").groupBy("id").count())
    assert kept.count() == 9 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    release(kept, spark.range(3))
    assert len(settled() - before) == 1


def test_the_next_context_is_found_after_the_intervals(spark, monkeypatch):
    """the scan of the intervals made the joined table twice, dealt it out twice and kept it."""
    scanned = []
    monkeypatch.setattr(ngram, "cdf", lambda df, *a, _cdf=ngram.cdf, **b: scanned.append(df.columns) or _cdf(df, *a, **b))
    counts = ngram.ngram_counts(_docs(spark, ["a b a c a b a", "b a b"]), 3, min_count=2)
    got = {(r.context, r.token): r.next for r in ngram.ngram_table(counts, 3, 2).collect()}
    assert scanned == [["context", "token", "cnt"]]
    assert got[("a", "b")] == "a b" and got[("c", "a")] == "a" and all(n == dec.END_TOKEN for (_, t), n in got.items() if t == dec.END_TOKEN)
