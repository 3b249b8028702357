import tempfile

from strata.streaming.scoring import running_arm_totals, score_stream


def test_score_stream_memory_sink(spark):
    src = tempfile.mkdtemp(prefix="strata-stream-")
    rows = [("baseline", 0, 0, "\\boxed{5}"), ("baseline", 0, 1, "4"), ("arithmetic", 0, 0, "5")]
    spark.createDataFrame(rows, "arm string, prompt_id long, sample_idx int, completion string").write.mode(
        "overwrite"
    ).parquet(src + "/in")
    prompts = spark.createDataFrame([(0, "p", "5")], "prompt_id long, prompt string, answer string")
    stream = spark.readStream.schema("arm string, prompt_id long, sample_idx int, completion string").parquet(src + "/in")
    q = (
        running_arm_totals(score_stream(stream, prompts))
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("arm_totals")
        .option("checkpointLocation", src + "/ckpt")
        .start()
    )
    q.processAllAvailable()
    q.stop()
    got = {r.arm: (r.n_scores, r.score_sum, r.n_correct) for r in spark.sql("SELECT * FROM arm_totals").collect()}
    assert got == {"baseline": (2, 1.0, 1), "arithmetic": (1, 1.0, 1)}
