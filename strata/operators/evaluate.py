"""Evaluation of k sampled completions per prompt for several arms.

Shape of the flagship computation (``evaluate``):

1. ``first_k_samples`` keeps the first k completions of each (arm, prompt). ``row_number() <= k``
   plans a ``WindowGroupLimit`` that cuts every map partition to k rows per key *before* the
   exchange, so a prompt that owns a third of all rows still ships only k rows per task.
2. completions are joined with the prompts' answers (one row per prompt; AQE broadcasts it when the
   measured size is small, otherwise a sort-merge join) and scored with JVM expressions.
3. ``groupBy(arm, prompt_id)`` gives per-prompt hits, distinct normalised completions (a distinct
   aggregate, no collected list), exact score moments (integer digit sums) and tokens.
4. ``groupBy(arm, batch)`` then ``groupBy(arm)`` reduce algebraic sums (partial aggregation).
   Prompts without completions only enter the denominators, which come from one prompt count per
   arm — no (arm x prompt) grid is materialised. Per-prompt outputs (``per_prompt_outcomes``,
   ``alignment_violations``) do use the grid, since prompts without completions are rows there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.exact import LIMBS, limbs, spread_digits, square_limbs, summable, sums, to_double
from strata.functions.scoring import ScorerFn, is_correct, score, score_normalized
from strata.functions.text import normalize
from strata.session import settle

# Fields of the per-arm result record, in order (fixed schema of the reference's result).
RESULT_FIELDS = (
    "label",
    "model_path",
    "num_prompts",
    "num_samples",
    "pass_at_1",
    "pass_at_k",
    "reward_mean",
    "reward_std",
    "avg_unique_completions",
    "duplicate_rate",
    "total_new_tokens",
    "wall_time_sec",
    "new_tokens_per_sec",
    "prompts_per_sec",
)
# Floor for elapsed time, seconds.
MIN_WALL_SEC = 1e-9
# Scored samples that one task groups by prompt.
SCORED_PER_TASK = 1 << 18
# What the metrics need of a scored sample.
SCORED_FIELDS = ("arm", "prompt_id", "sample_idx", "norm", "score", "scorer_error", "new_tokens", "ts")
# Digit sums of the scores and of their squares (``functions.exact``).
SUM_COLS = [f"_s{i}" for i in range(LIMBS)]
SQUARE_COLS = [f"_q{i}" for i in range(2 * LIMBS - 1)]


def first_k_samples(
    df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column | str], out: str = "sample_idx"
) -> DataFrame:
    """W7 + W8: number samples 0..k-1 per group in a total order and keep the first k.

    Uses ``row_number() <= k`` so Spark inserts a partial ``WindowGroupLimit`` before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rn = "_rn"
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k).withColumn(
        out, (F.col(rn) - 1).cast("int")
    ).drop(rn)


def arm_grid(prompts: DataFrame, arms: Sequence[str], prompt_id: str = "prompt_id") -> DataFrame:
    """Every prompt once per arm (U2): the denominator of every per-arm ratio."""
    return prompts.select(prompt_id).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))


def score_completions(
    prompts: DataFrame,
    completions: DataFrame,
    k: int,
    scorer: ScorerFn | None = None,
) -> tuple[DataFrame, str]:
    """J1 (inner part) + X1: attach the answer to each of the first k samples and score it. The
    answer's normal form is built once per prompt, the completion's once per sample (``norm``)."""
    answers = prompts.select("prompt_id", "prompt", "answer", normalize(F.col("answer")).alias("answer_norm"))
    kept = completions.filter(F.col("sample_idx") < k).withColumn("norm", normalize(F.col("completion")))
    joined = kept.join(answers, "prompt_id", "inner")
    return score(joined, scorer=scorer, builtin=score_normalized(F.col("norm"), F.col("answer_norm")))


def settled_scores(prompts: DataFrame, completions: DataFrame, k: int, scorer: ScorerFn | None = None) -> DataFrame:
    """``score_completions`` without the texts, written once, so that several results can be taken from
    one call of the scorer."""
    scored, _backend = score_completions(prompts, completions, k, scorer)
    return settle(scored.select(*[c for c in SCORED_FIELDS if c in scored.columns]))


def scorer_failures(
    prompts: DataFrame, completions: DataFrame, k: int, arms: Sequence[str], scorer: ScorerFn, scored: DataFrame | None = None
) -> DataFrame:
    """Per arm, how many of the first k samples a scorer made by ``isolating`` was asked for, on how
    many it raised, and the different reasons. Columns: arm, num_scored, num_failed, num_reasons.
    ``scored``: the ``settled_scores`` of these arguments, if they are at hand."""
    if scored is None:
        scored, _ = score_completions(prompts, completions, k, scorer)
    per = scored.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count("scorer_error").alias("bad"), F.count_distinct("scorer_error").alias("kinds")
    )
    every = prompts.sparkSession.createDataFrame([(a,) for a in arms], "arm string").join(per, "arm", "left")
    return every.select("arm", *[F.coalesce(c, F.lit(0)).cast("long").alias(o) for c, o in (("n", "num_scored"), ("bad", "num_failed"), ("kinds", "num_reasons"))])


#: Logarithm of the registers of a distinct-count sketch (4,096: at most 2.5 KB a stored sketch).
SKETCH_LG_K = 12


def unique_sketches(rows: DataFrame, by: Sequence[str], text: str = "completion", lg_k: int = SKETCH_LG_K) -> DataFrame:
    """A5, mergeable: per group, the number of rows and a HyperLogLog sketch of the normalised texts
    (columns num_rows, unique_sketch). Sketches are combined in each task before the shuffle. The table can
    be stored and merged later, over any coarser grouping, without the texts."""
    normal = rows.withColumn("_norm", normalize(F.col(text)))
    return normal.groupBy(*by).agg(F.count(F.lit(1)).alias("num_rows"), F.hll_sketch_agg("_norm", lg_k).alias("unique_sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The union of stored sketches per group of ``by``: num_rows, unique_sketch (again mergeable) and
    num_unique, the estimate. Its relative standard error is ``sketch_error(lg_k)``."""
    merged = sketches.groupBy(*by).agg(F.sum("num_rows").alias("num_rows"), F.hll_union_agg("unique_sketch").alias("unique_sketch"))
    return merged.withColumn("num_unique", F.hll_sketch_estimate("unique_sketch"))


def sketch_error(lg_k: int = SKETCH_LG_K) -> float:
    """Relative standard error of a merged estimate: 1.04 / sqrt(registers)."""
    return 1.04 / (1 << lg_k) ** 0.5


def per_prompt_stats(scored: DataFrame) -> DataFrame:
    """A1, A2, A5 and moments for A3/A4/A8/A9 per (arm, prompt_id). The moments are integer digit
    sums of the scores and their squares, so they do not depend on the order of the samples."""
    hit = is_correct(F.col("score"))
    if "norm" not in scored.columns:
        scored = scored.withColumn("norm", normalize(F.col("completion")))
    scored = scored.withColumn("_d", limbs(F.col("score").cast("double"))).withColumn("_dd", square_limbs(F.col("_d")))
    aggs = [
        F.max(F.when((F.col("sample_idx") == 0) & hit, 1).otherwise(0)).alias("first_hit"),
        F.max(F.when(hit, 1).otherwise(0)).alias("any_hit"),
        F.count_distinct("norm").alias("n_unique"),
        *sums("_d", LIMBS, "_s"),
        *sums("_dd", 2 * LIMBS - 1, "_q"),
        F.sum(F.when(summable(F.col("score")), 0).otherwise(1)).alias("_odd"),
        F.count(F.lit(1)).alias("n_scores"),
    ]
    cols = set(scored.columns)
    if "new_tokens" in cols:
        aggs.append(F.max("new_tokens").alias("max_new_tokens"))
    if "ts" in cols:
        aggs += [F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max")]
    return scored.groupBy("arm", "prompt_id").agg(*aggs)


def evaluate(
    prompts: DataFrame,
    completions: DataFrame,
    k: int,
    arms: Sequence[str],
    *,
    batch_size: int | None = 8,
    slice_start: int = 0,
    strict: bool = False,
    scorer: ScorerFn | None = None,
    model_paths: dict[str, str] | None = None,
    scored: DataFrame | None = None,
) -> DataFrame:
    """One result row per arm with the 14 fields of ``RESULT_FIELDS``.

    ``prompts``: (prompt_id, prompt, answer) — prompt_id is the ordinal in the dataset and the slice
    begins at ``slice_start``, where the first batch begins too.
    ``completions``: (arm, prompt_id, sample_idx, completion[, new_tokens][, ts]).
    ``total_new_tokens`` follows the padded-batch definition: per (arm, batch) the longest
    completion times the number of completions; wall time is the span of ``ts`` per arm.
    ``strict`` runs ``assert_aligned`` first (one job). Otherwise samples from index k on and
    completions without a prompt do not count; ``alignment_violations`` reports them.
    ``scored``: the ``settled_scores`` of these arguments, if they are at hand. The scored samples are
    counted, and dealt to tasks of ``SCORED_PER_TASK``: what a task holds does not grow with the input.
    """
    if strict:
        assert_aligned(prompts, completions, k, arms)
    if scored is None:
        scored = settled_scores(prompts, completions, k, scorer)
    pp = per_prompt_stats(scored.repartition(-(-scored.count() // SCORED_PER_TASK) or 1, "arm", "prompt_id"))
    has_tokens = "max_new_tokens" in pp.columns and bool(batch_size)
    has_ts = "ts_min" in pp.columns
    # One chain over prompts that have completions: (arm, prompt) -> (arm, batch) -> arm. The
    # batch level carries the padded token count (longest completion x completions). Prompts
    # without completions only add to the denominator, which comes from the prompt count.
    names = ["_h1", "_hk", "_uniq", *SUM_COLS, *SQUARE_COLS, "_odd", "_n"]
    totals = [
        F.sum("first_hit").alias("_h1"),
        F.sum("any_hit").alias("_hk"),
        F.sum("n_unique").alias("_uniq"),
        *[F.sum(c).alias(c) for c in (*SUM_COLS, *SQUARE_COLS, "_odd")],
        F.sum("n_scores").alias("_n"),
    ]
    extra_b, extra_a = [], []
    if has_tokens:
        extra_b.append((F.max("max_new_tokens") * F.sum("n_scores")).alias("_bt"))
        extra_a.append(F.sum("_bt").cast("long").alias("total_new_tokens"))
    if has_ts:
        extra_b += [F.min("ts_min").alias("_t0"), F.max("ts_max").alias("_t1")]
        extra_a += [F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1")]
    if batch_size:
        # Consecutive prompts, counted from the start of the slice, form a generation batch.
        batch = F.floor((F.col("prompt_id") - F.lit(slice_start)) / F.lit(batch_size)).cast("long")
        per_batch = pp.withColumn("batch_id", batch).groupBy("arm", "batch_id").agg(*totals, *extra_b)
        per_arm = per_batch.groupBy("arm").agg(*[F.sum(c).alias(c) for c in names], *extra_a)
    else:
        per_arm = pp.groupBy("arm").agg(*totals, *extra_b)
    # |arms| rows: the slice size once per arm (prompts without completions count as misses)
    counts = prompts.agg(F.count(F.lit(1)).alias("num_prompts")).withColumn(
        "arm", F.explode(F.array(*[F.lit(a) for a in arms]))
    )
    per_arm = counts.join(per_arm, "arm", "left")
    per_arm = per_arm.select(
        "arm", "num_prompts", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names],
        *[c for c in per_arm.columns if c not in ("arm", "num_prompts", *names)],
    )
    if not has_tokens:
        per_arm = per_arm.withColumn("total_new_tokens", F.lit(None).cast("long"))
    elif "total_new_tokens" in per_arm.columns:
        per_arm = per_arm.withColumn("total_new_tokens", F.coalesce("total_new_tokens", F.lit(0).cast("long")))

    n = F.col("_n")
    # One division of exact sums. A score that is not finite, or 2^31 and more, makes both NaN.
    nan = F.lit(float("nan"))
    digits = [F.col(c) for c in SUM_COLS]
    mean = F.when(F.col("_odd") > 0, nan).otherwise(to_double(digits) / n)
    spread = to_double(spread_digits(digits, [F.col(c) for c in SQUARE_COLS], n))
    std = F.when(F.col("_odd") > 0, nan).otherwise(F.sqrt(spread) / n)
    if has_ts:
        span = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("_t1")) / F.lit(1e6)
        wall = F.greatest(span.cast("double"), F.lit(MIN_WALL_SEC))
    else:
        wall = F.lit(None).cast("double")
    paths = model_paths or {}
    path_expr = F.col("arm")
    if paths:
        m = F.create_map(*[x for kv in paths.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        path_expr = F.coalesce(F.try_element_at(m, F.col("arm")), F.col("arm"))
    num_prompts = F.col("num_prompts")
    avg_unique = F.col("_uniq") / num_prompts
    return per_arm.select(
        F.col("arm").alias("label"),
        path_expr.alias("model_path"),
        num_prompts.cast("long").alias("num_prompts"),
        F.lit(k).cast("int").alias("num_samples"),
        (F.col("_h1") / num_prompts).alias("pass_at_1"),
        (F.col("_hk") / num_prompts).alias("pass_at_k"),
        F.when(n > 0, mean).otherwise(F.lit(0.0)).alias("reward_mean"),
        F.when(n > 1, std).otherwise(F.lit(0.0)).alias("reward_std"),
        avg_unique.alias("avg_unique_completions"),
        (F.lit(1.0) - avg_unique / F.lit(float(max(k, 1)))).alias("duplicate_rate"),
        F.col("total_new_tokens"),
        wall.alias("wall_time_sec"),
        (F.col("total_new_tokens") / wall).alias("new_tokens_per_sec"),
        (num_prompts / wall).alias("prompts_per_sec"),
    )


def per_prompt_outcomes(prompts: DataFrame, completions: DataFrame, k: int, arms: Sequence[str]) -> DataFrame:
    """A1, A2, A5 per (arm, prompt): prompts without completions appear with zeros."""
    scored, _ = score_completions(prompts, completions, k)
    pp = per_prompt_stats(scored)
    grid = arm_grid(prompts, arms)
    return grid.join(pp, ["arm", "prompt_id"], "left").select(
        "arm",
        "prompt_id",
        F.coalesce("first_hit", F.lit(0)).cast("int").alias("pass_1"),
        F.coalesce("any_hit", F.lit(0)).cast("int").alias("pass_k"),
        F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"),
        F.coalesce("n_scores", F.lit(0)).cast("long").alias("n_samples"),
        F.coalesce(
            F.when(F.col("_odd") > 0, F.lit(float("nan"))).otherwise(to_double([F.col(c) for c in SUM_COLS]) / F.col("n_scores")),
            F.lit(0.0),
        ).alias("mean_score"),
    )


def paired_outcomes(per_prompt: DataFrame, base: str, other: str) -> DataFrame:
    """Pair the two arms on the same prompts; wins/losses/ties on pass@k and the paired mean
    difference of per-prompt mean scores. One row per call; ``per_prompt`` has one row per (arm,
    prompt) and is read once."""
    def of(arm: str, value: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(value)))

    pairs = (
        per_prompt.groupBy("prompt_id")
        .agg(
            of(base, "pass_k").alias("b_pass"),
            of(other, "pass_k").alias("o_pass"),
            of(base, "mean_score").alias("b_score"),
            of(other, "mean_score").alias("o_score"),
        )
        .filter(F.col("b_pass").isNotNull() & F.col("o_pass").isNotNull())
        .withColumn("_d", limbs(F.col("o_score") - F.col("b_score")))
    )

    def number(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")

    return pairs.agg(
        F.count(F.lit(1)).cast("long").alias("n_pairs"),
        number(F.col("o_pass") > F.col("b_pass")).alias("wins"),
        number(F.col("o_pass") < F.col("b_pass")).alias("losses"),
        number(F.col("o_pass") == F.col("b_pass")).alias("ties"),
        *sums("_d", LIMBS, "_s"),
    ).select("n_pairs", "wins", "losses", "ties", (to_double([F.col(c) for c in SUM_COLS]) / F.col("n_pairs")).alias("mean_score_diff"))


def alignment_violations(prompts: DataFrame, completions: DataFrame, k: int, arms: Sequence[str]) -> DataFrame:
    """J2 + R13: report misaligned groups instead of raising.

    kinds: ``missing`` (prompt without completions in an arm), ``short`` / ``long`` (group size
    differs from k), ``dup_index`` (repeated sample_idx), ``orphan`` (completion for an unknown
    prompt). Columns: arm, prompt_id, kind, n_samples.
    """
    counts = completions.groupBy("arm", "prompt_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sample_idx").alias("nd")
    )
    grid = arm_grid(prompts, arms)
    g = grid.join(counts, ["arm", "prompt_id"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    kind = (
        F.when(n == 0, F.lit("missing"))
        .when(F.col("nd") < n, F.lit("dup_index"))
        .when(n < k, F.lit("short"))
        .when(n > k, F.lit("long"))
    )
    inside = g.select("arm", "prompt_id", kind.alias("kind"), n.cast("long").alias("n_samples")).filter(
        F.col("kind").isNotNull()
    )
    orphans = counts.join(prompts.select("prompt_id"), "prompt_id", "left_anti").select(
        "arm", "prompt_id", F.lit("orphan").alias("kind"), F.col("n").cast("long").alias("n_samples")
    )
    return inside.unionByName(orphans)


def group_samples(completions: DataFrame, by: Sequence[str] = ("arm", "prompt_id"), value: str = "completion") -> DataFrame:
    """T18 / D5 nested form: the k samples of each group as one array in sample order.

    A group holds the k samples of one prompt (bounded by k), so the collect stays small; the
    flat form is recovered with ``posexplode``.
    """
    return completions.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", value))), lambda x: x[value]).alias("samples")
    )


def assert_aligned(prompts: DataFrame, completions: DataFrame, k: int, arms: Sequence[str]) -> None:
    """J2, strict form: raise when any group is misaligned (the reference's strict zips).
    One small job; the message carries the count per kind."""
    v = alignment_violations(prompts, completions, k, arms).groupBy("kind").count().collect()
    if v:
        detail = ", ".join(f"{r['kind']}={r['count']}" for r in sorted(v, key=lambda r: r["kind"]))
        raise ValueError(f"completions are not aligned with prompts: {detail}")
