import pytest
from pyspark.sql import functions as F

from strata.operators import report
from strata.operators.evaluate import alignment_violations, evaluate, merge_sketches, paired_outcomes, per_prompt_outcomes, sketch_error, unique_sketches

ARMS = ["baseline", "arithmetic"]


@pytest.fixture()
def data(spark):
    prompts = spark.createDataFrame(
        [(0, "p0", "5"), (1, "p1", "7"), (2, "p2", "9")], "prompt_id long, prompt string, answer string"
    )
    rows = [
        ("baseline", 0, 0, "\\boxed{5}"), ("baseline", 0, 1, "5"), ("baseline", 1, 0, "no"), ("baseline", 1, 1, "7"),
        ("arithmetic", 0, 0, "4"), ("arithmetic", 0, 1, "4"), ("arithmetic", 1, 0, "7"), ("arithmetic", 1, 1, "x 7"),
    ]
    comps = spark.createDataFrame(rows, "arm string, prompt_id long, sample_idx int, completion string")
    return prompts, comps


def test_metrics_left_join(spark, data):
    prompts, comps = data
    res = {r.label: r for r in evaluate(prompts, comps, 2, ARMS, batch_size=None).collect()}
    b, a = res["baseline"], res["arithmetic"]
    # prompt 2 has no completions: counted in the denominator, adds 0 unique
    assert b.num_prompts == 3 and a.num_prompts == 3
    assert b.pass_at_1 == pytest.approx(1 / 3) and b.pass_at_k == pytest.approx(2 / 3)
    assert a.pass_at_1 == pytest.approx(1 / 3) and a.pass_at_k == pytest.approx(1 / 3)
    assert b.reward_mean == pytest.approx(3 / 4)
    assert b.reward_std == pytest.approx((3 / 4 * 1 / 4) ** 0.5)
    # baseline prompt 0: "\boxed{5}" and "5" normalise equal -> 1 unique; prompt 1: 2
    assert b.avg_unique_completions == pytest.approx(3 / 3)
    assert b.duplicate_rate == pytest.approx(1 - 1 / 2)
    assert a.avg_unique_completions == pytest.approx(3 / 3)


def test_invariants_and_delta(spark, data):
    prompts, comps = data
    s = evaluate(prompts, comps, 2, ARMS, batch_size=None)
    for r in s.collect():
        assert r.pass_at_k >= r.pass_at_1
        assert r.duplicate_rate == pytest.approx(1 - r.avg_unique_completions / 2)
    k1 = evaluate(prompts, comps, 1, ARMS, batch_size=None).collect()
    for r in k1:
        assert r.pass_at_k == r.pass_at_1
    d1 = {r.metric: r.delta for r in report.compare_arms(s, "baseline", "arithmetic").collect()}
    d2 = {r.metric: r.delta for r in report.compare_arms(s, "arithmetic", "baseline").collect() if r.delta is not None}
    for m, v in d2.items():
        assert d1[m] == pytest.approx(-v)


def test_reports(spark, data):
    prompts, comps = data
    s = evaluate(prompts, comps, 2, ARMS, batch_size=None)
    log = report.metric_log(s, "baseline", "arithmetic")
    keys = {r.metric for r in log.collect()}
    assert "eval/baseline/pass_at_1" in keys and "eval/delta/new_tokens_per_sec" in keys
    assert "eval/delta/wall_time_sec" not in keys
    lines = report.summary_lines(report.compare_arms(s, "baseline", "arithmetic")).orderBy("pos").collect()
    assert lines[0].line.startswith("pass@1 | 0.333333 | 0.333333 | +0.000000")
    meta = report.RunMeta("d", "train", 0, "prompt", "answer", 2)
    js = report.report_json(s, prompts, meta, "baseline", "arithmetic").first().report
    assert '"delta"' in js and '"count" : 3' in js


def test_alignment_and_pairs(spark, data):
    prompts, comps = data
    extra = spark.createDataFrame([("baseline", 9, 0, "x")], comps.schema)
    v = {(r.arm, r.prompt_id, r.kind) for r in alignment_violations(prompts, comps.unionByName(extra), 2, ARMS).collect()}
    assert ("baseline", 2, "missing") in v and ("baseline", 9, "orphan") in v
    pp = per_prompt_outcomes(prompts, comps, 2, ARMS)
    r = paired_outcomes(pp, "baseline", "arithmetic").first()
    assert r.n_pairs == 3 and r.wins + r.losses + r.ties == 3 and r.losses == 1


def test_custom_scorer_fallback(spark):
    from strata.functions.scoring import score

    df = spark.createDataFrame([("p", "5", "5"), ("p", "", "")], "prompt string, completion string, answer string")

    def plug(p, c, a):
        return F.when(c == F.lit(""), F.lit(None)).otherwise(F.lit(0.25))

    out, name = score(df, scorer=plug)
    assert [r.score for r in out.collect()] == [0.25, 0.0] and name == "plug"


def test_fixed6_matches_python_formatting(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    vals = st.one_of(
        st.floats(min_value=-1e9, max_value=1e9, allow_nan=False),
        st.integers(min_value=-10**9, max_value=10**9).map(lambda i: i / 10**7),  # ties at the 7th digit
    )

    @settings(max_examples=25, deadline=None)
    @given(st.lists(vals, min_size=1, max_size=200))
    def check(xs):
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        got = df.select(report.fixed6(F.col("x")).alias("a"), report.signed_fixed6(F.col("x")).alias("b")).collect()
        for x, r in zip(xs, got):
            assert r.a == "%.6f" % x
            if x != 0 or str(x)[0] != "-":
                assert r.b == "%+.6f" % x

    check()


def test_sinks_and_console(spark, data, tmp_path):
    prompts, comps = data
    s = evaluate(prompts, comps, 2, ARMS, batch_size=None)
    cmp = report.compare_arms(s, "baseline", "arithmetic")
    text = report.console_text(cmp).first().text.split("\n")
    assert text[0] == report.SUMMARY_TITLE and text[2].startswith("metric | baseline") and len(text) == 4 + 9
    meta = report.RunMeta("d", "train", 0, "prompt", "answer", 2)
    report.write_report(report.report_json(s, prompts, meta, "baseline", "arithmetic"), str(tmp_path / "rep"))
    assert '"meta"' in "".join(spark.read.text(str(tmp_path / "rep")).toPandas()["value"])
    cfg = report.RunConfig("d", "train", 0, 3, 2, 256, 0.8, 1.0, 0, "b", "m0", "m1")
    assert report.write_metric_log(report.metric_log(s, "baseline", "arithmetic"), str(tmp_path / "log"), "r1", cfg)
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 31 and "config_top_p" in back.columns


def test_group_samples(spark, data):
    from strata.operators.evaluate import group_samples

    _, comps = data
    g = {(r.arm, r.prompt_id): r.samples for r in group_samples(comps).collect()}
    assert g[("baseline", 1)] == ["no", "7"]


def test_assert_aligned(spark, data):
    from strata.operators.evaluate import assert_aligned

    prompts, comps = data
    with pytest.raises(ValueError, match="missing=2"):
        assert_aligned(prompts, comps, 2, ARMS)
    assert_aligned(prompts.filter("prompt_id < 2"), comps, 2, ARMS)


def _two_prompts(spark, scores, start=0, n=2):
    """``n`` prompts from ordinal ``start`` on; the scorer below reads the score from the completion."""
    prompts = spark.createDataFrame([(start + i, "p", "-") for i in range(n)], "prompt_id long, prompt string, answer string")
    rows = [(a, start + i, g, str(s), 1 + i) for a in ARMS for i in range(n) for g, s in enumerate(scores)]
    return prompts, spark.createDataFrame(rows, "arm string, prompt_id long, sample_idx int, completion string, new_tokens long")


def _as_score(prompt, completion, answer):
    return completion.cast("double")


def test_reward_std_keeps_its_digits(spark):
    import statistics

    from strata.operators.evaluate import evaluate

    values = [0.9999999, 0.99999991]
    prompts, comps = _two_prompts(spark, values)
    r = evaluate(prompts, comps, 2, ARMS, scorer=_as_score).first()
    assert r.reward_std == pytest.approx(statistics.pstdev(values), rel=1e-6)


def test_batches_start_with_the_slice(spark):
    from strata.operators.evaluate import evaluate

    prompts, comps = _two_prompts(spark, [1.0], start=100, n=8)
    r = evaluate(prompts, comps, 1, ARMS, slice_start=100, scorer=_as_score).first()
    assert r.total_new_tokens == 8 * 8  # one batch of eight, the longest row has eight tokens


def test_strict_raises_on_surplus_and_duplicates(spark):
    from strata.operators.evaluate import evaluate

    prompts, comps = _two_prompts(spark, [1.0, 0.0])
    evaluate(prompts, comps, 2, ARMS, strict=True, scorer=_as_score)
    with pytest.raises(ValueError, match="long=4"):
        evaluate(prompts, comps, 1, ARMS, strict=True, scorer=_as_score)
    with pytest.raises(ValueError, match="dup_index=4"):
        evaluate(prompts, comps.withColumn("sample_idx", F.lit(0)), 2, ARMS, strict=True, scorer=_as_score)


def test_absent_arm_is_null_in_the_reports(spark):
    from strata.operators.evaluate import evaluate

    prompts, comps = _two_prompts(spark, [1.0])
    s = evaluate(prompts, comps, 1, ["baseline"], scorer=_as_score)
    meta = report.RunMeta("d", "s", 0, "prompt", "answer", 1)
    rep = report.report_struct(s, meta, *ARMS).first().report
    assert rep.arithmetic is None and rep.delta.pass_at_1 is None and rep.baseline.pass_at_1 == 1.0
    log = {r.metric: r.value for r in report.metric_log(s, *ARMS).collect()}
    assert log["eval/delta/pass_at_1"] is None and log["eval/baseline/pass_at_1"] == 1.0


def test_fixed6_of_large_values(spark):
    xs = [1e9 + 0.1, -123456789012.34567, 4e15 + 0.5, 2.0**62, 1e9, 1234567890.9999999]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r.s for r in df.select(report.fixed6(F.col("x")).alias("s")).collect()] == ["%.6f" % x for x in xs]


def test_a_repeated_run_is_logged_once(spark, tmp_path):
    """Run names that look like numbers, a run without a configuration, and one logged again with fewer rows."""
    path = str(tmp_path / "log")
    cfg = report.RunConfig("d", "train", 0, 3, 2, 256, 0.8, 1.0, 0, "b", "m0", "m1")

    def log(n):
        return spark.range(n).selectExpr("concat('m', id) AS metric", "CAST(id AS DOUBLE) AS value")

    for run, n, config in (("007", 4, None), ("7", 3, cfg), ("7", 2, cfg), ("a b/c=é", 5, None)):
        assert report.write_metric_log(log(n), path, run, config)
    back = report.read_metric_log(spark, path)
    assert {r.run: r.n for r in back.groupBy("run").agg(F.count("*").alias("n")).collect()} == {"007": 4, "7": 2, "a b/c=é": 5}
    assert {r.config_top_p for r in report.read_metric_log(spark, path, ["7"]).collect()} == {1.0}
    assert report.read_metric_log(spark, path, ["none"]).count() == 0
    (tmp_path / "file").write_text("x")
    assert report.write_metric_log(log(1), str(tmp_path / "file" / "log"), "r") is False  # warns only


def test_sketches_merge_to_the_estimate_of_all_rows(spark, tmp_path):
    """Stored per (arm, prompt), merged per arm: within three standard errors, and the same whatever the
    grouping they came from. Null texts, repeated rows, an empty table."""
    rows = spark.range(60_000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('arm', id % 2)) AS arm", "id % 100 AS prompt_id", "IF(id % 50 = 0, NULL, concat(' Text  ', id % 20011)) AS completion"
    )
    stored = unique_sketches(rows, ["arm", "prompt_id"])
    stored.write.parquet(str(tmp_path / "sketches"))
    got = {r.arm: r for r in merge_sketches(spark.read.parquet(str(tmp_path / "sketches")), ["arm"]).collect()}
    want = rows.groupBy("arm").agg(F.count("*").alias("n"), F.count_distinct("completion").alias("d")).collect()
    assert len(got) == 3
    for r in want:
        assert got[r.arm].num_rows == r.n
        assert abs(got[r.arm].num_unique - r.d) <= 3 * sketch_error() * r.d
    both = merge_sketches(merge_sketches(stored, ["arm"]).drop("num_unique"), []).first()
    assert both.num_unique == merge_sketches(stored, []).first().num_unique and both.num_rows == 60_000
    assert merge_sketches(unique_sketches(rows.limit(0), ["arm"]), ["arm"]).count() == 0
