"""Registered evaluation queries (flagship and the reports built on it) with their oracles."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.scoring import isolating
from strata.functions.text import last_number, normalize, parse_number
from strata.operators import report
from strata.operators.report import COMPARED, LOGGED_DELTA
from strata.operators.evaluate import (
    alignment_violations,
    evaluate,
    merge_sketches,
    paired_outcomes,
    per_prompt_outcomes,
    scorer_failures,
    settled_scores,
    sketch_error,
    unique_sketches,
)
from strata.plans import sql
from strata.plans.fixtures import ARMS, BATCH_SIZE, K, eval_completions, eval_prompts, raw_samples
from strata.session import cut_lineage, ensure_checkpoint_dir
from strata.sources.tables import read_table, spread

# --- Spark side ----------------------------------------------------------------------------


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per-arm result record (A1-A11) of two arms built from lineitem x part."""
    return evaluate(eval_prompts(spark, sf_dir), eval_completions(spark, sf_dir), K, ARMS, batch_size=BATCH_SIZE)


def eval_per_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_prompt_outcomes(eval_prompts(spark, sf_dir), eval_completions(spark, sf_dir), K, ARMS)


def ab_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.compare_arms(eval_summary(spark, sf_dir), ARMS[0], ARMS[1])


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metric_log(eval_summary(spark, sf_dir), ARMS[0], ARMS[1])


#: The logged configuration of the rerun below.
RERUN_CONFIG = report.RunConfig("part x lineitem", "all", 0, 512, K, 256, 0.8, 1.0, 0, "builtin", *ARMS)


def metric_log_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S11 + S12: the log of two runs, read back as a whole and for the second one. That one was
    written twice, with its configuration, and ``kept_going`` says that a sink that cannot be written to
    did not stop it. The log lies in the shared folder of the cluster."""
    path = f"{ensure_checkpoint_dir(spark)}/metric-log-{uuid.uuid4().hex}"
    log = cut_lineage(metric_log(spark, sf_dir))
    kept_going = not report.write_metric_log(log, "no-such-file-system://log", "second")
    for run, scale, config in (("first", 1.0, None), ("second", -1.0, RERUN_CONFIG), ("second", 1.0, RERUN_CONFIG)):
        if not report.write_metric_log(log.withColumn("value", F.col("value") * scale), path, run, config):
            raise RuntimeError("the metric log was not written")
    reads = {"all": report.read_metric_log(spark, path), "one": report.read_metric_log(spark, path, ["second"])}
    cols = ["run", "metric", "value", "config_dataset", "config_num_samples", "config_temperature", F.lit(kept_going).alias("kept_going")]
    return reads["all"].select(F.lit("all").alias("read"), *cols).unionByName(reads["one"].select(F.lit("one").alias("read"), *cols))


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_lines(report.compare_arms(eval_summary(spark, sf_dir), ARMS[0], ARMS[1]))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the JSON report, read back from its text."""
    prompts = eval_prompts(spark, sf_dir)
    meta = report.RunMeta(
        dataset="part x lineitem",
        split="all",
        start=0,
        prompt_column="p_name",
        answer_column="p_size",
        num_samples=K,
    )
    text = report.report_json(eval_summary(spark, sf_dir), prompts, meta, ARMS[0], ARMS[1])
    paths = [f"meta.{c}" for c in _META_NUMERIC]
    paths += [f"{block}.{c}" for block in ARMS for c in _NUMERIC] + [f"delta.{m}" for m, _ in COMPARED]
    pairs = [F.struct(F.lit(p).alias("path"), F.get_json_object("report", f"$.{p}").cast("double").alias("value")) for p in paths]
    return text.select(F.explode(F.array(*pairs)).alias("e")).select("e.path", "e.value")


#: Ordinal of the first prompt of the custom_scorer slice, not a multiple of the batch size.
CUSTOM_START = 100


def closeness(prompt: Column, completion: Column, answer: Column) -> Column:
    """Example plug-in scorer: 1 / (1 + |number - answer|); no score (null: built-in) for multiples of 7."""
    number = parse_number(last_number(normalize(completion)))
    return F.when(number % 7 != 0, 1 / (1 + F.abs(number - answer.cast("double"))))


def custom_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2: the record under a plug-in scorer with fallbacks, on a slice that starts at CUSTOM_START."""
    shifted = F.col("prompt_id") + CUSTOM_START
    prompts = eval_prompts(spark, sf_dir).withColumn("prompt_id", shifted)
    completions = eval_completions(spark, sf_dir).withColumn("prompt_id", shifted)
    return evaluate(prompts, completions, K, ARMS, batch_size=BATCH_SIZE, slice_start=CUSTOM_START, scorer=closeness)


def _strict_closeness(prompt, completion, answer):
    """Example of a scorer that raises: as ``closeness``, but multiples of 7 are an error."""
    out = []
    for c, a in zip(completion, answer, strict=True):
        number = int(re.findall("[0-9]+", c)[-1])
        if number % 7 == 0:
            raise ValueError(f"no score for {number}")
        out.append(1 / (1 + abs(number - float(a))))
    return out


def failing_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record under a scorer that raises on some rows, with the failures per arm."""
    prompts, completions = eval_prompts(spark, sf_dir), eval_completions(spark, sf_dir)
    scorer = isolating(_strict_closeness)
    scored = settled_scores(prompts, completions, K, scorer)
    record = evaluate(prompts, completions, K, ARMS, batch_size=BATCH_SIZE, scorer=scorer, scored=scored)
    failures = scorer_failures(prompts, completions, K, ARMS, scorer, scored).withColumnRenamed("arm", "label")
    return record.join(failures, "label")


def paired_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_outcomes(eval_per_prompt(spark, sf_dir), ARMS[0], ARMS[1])


def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 on the raw lines, the order as sample index: an order that takes a part twice repeats it."""
    return alignment_violations(eval_prompts(spark, sf_dir), raw_samples(spark, sf_dir), K, ARMS)


def unique_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: distinct normalised texts per language, exact beside the union of stored sketches per
    (language, source): whether the estimate is within three standard errors."""
    docs = read_table(spark, sf_dir, "documents").select("lang", "source", "text")
    stored = cut_lineage(unique_sketches(spread(docs), ["lang", "source"], "text"))
    merged = merge_sketches(stored, ["lang"]).select("lang", "num_rows", "num_unique")
    exact = docs.groupBy("lang").agg(F.count_distinct(normalize(F.col("text"))).alias("num_exact"))
    off = F.abs(F.col("num_unique") - F.col("num_exact")) / F.greatest(F.col("num_exact"), F.lit(1))
    return merged.join(exact.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "lang", "num_rows", "num_exact", (off <= 3 * sketch_error()).alias("within")
    )


# --- DuckDB oracle -------------------------------------------------------------------------

_ARM_CASE = "CASE l_linestatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'arithmetic' ELSE l_linestatus END"

BASE_CTES = f"""
prompts AS (
  SELECT p_partkey AS prompt_id, p_name AS prompt, CAST(p_size AS VARCHAR) AS answer FROM part
),
li AS (
  SELECT {_ARM_CASE} AS arm, l_partkey AS prompt_id, l_orderkey, l_linenumber, l_quantity,
         l_extendedprice, l_shipdate
  FROM lineitem WHERE l_partkey IS NOT NULL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY arm, prompt_id
            ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) - 1 AS sample_idx
  FROM li
),
comp AS (
  SELECT arm, prompt_id, CAST(sample_idx AS INTEGER) AS sample_idx,
         '  The answer is \\boxed{{' || CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) || '}} ' AS completion,
         l_shipdate AS ts
  FROM ranked WHERE sample_idx < {K}
),
comp2 AS (
  SELECT *, CAST(len(string_split_regex(trim(completion), ' +')) AS BIGINT) AS new_tokens FROM comp
),
scored AS (
  SELECT c.*, p.answer, {sql.score("c.completion", "p.answer")} AS score,
         {sql.normalize("c.completion")} AS norm
  FROM comp2 c JOIN prompts p USING (prompt_id)
),
pp AS (
  SELECT arm, prompt_id,
         max(CASE WHEN sample_idx = 0 AND score > 0.5::DOUBLE THEN 1 ELSE 0 END) AS first_hit,
         max(CASE WHEN score > 0.5::DOUBLE THEN 1 ELSE 0 END) AS any_hit,
         count(DISTINCT norm) AS n_unique,
         sum(score) AS score_sum, count(*) AS n_scores,
         max(new_tokens) AS max_new_tokens, min(ts) AS ts_min, max(ts) AS ts_max
  FROM scored GROUP BY arm, prompt_id
),
grid AS (
  SELECT prompt_id, unnest(['baseline', 'arithmetic']) AS arm FROM prompts
),
joined AS (
  SELECT g.arm, g.prompt_id, pp.first_hit, pp.any_hit, pp.n_unique, pp.score_sum,
         pp.n_scores, pp.max_new_tokens, pp.ts_min, pp.ts_max
  FROM grid g LEFT JOIN pp ON g.arm = pp.arm AND g.prompt_id = pp.prompt_id
),
per_batch AS (
  SELECT arm, CAST(floor(prompt_id / {BATCH_SIZE}) AS BIGINT) AS batch_id,
         count(*) AS num_prompts, sum(coalesce(first_hit, 0)) AS h1, sum(coalesce(any_hit, 0)) AS hk,
         sum(coalesce(n_unique, 0)) AS uniq, sum(score_sum) AS ssum,
         sum(coalesce(n_scores, 0)) AS n,
         coalesce(max(max_new_tokens) * sum(n_scores), 0) AS bt, min(ts_min) AS t0, max(ts_max) AS t1
  FROM joined GROUP BY 1, 2
),
per_arm AS (
  SELECT arm, sum(num_prompts) AS num_prompts, sum(h1) AS h1, sum(hk) AS hk, sum(uniq) AS uniq,
         sum(ssum) AS ssum, sum(n) AS n, CAST(sum(bt) AS BIGINT) AS total_new_tokens,
         min(t0) AS t0, max(t1) AS t1
  FROM per_batch GROUP BY arm
),
fixed AS (SELECT arm, CAST(score * 1152921504606846976::DOUBLE AS HUGEINT) AS x FROM scored),
halves AS (SELECT arm, x, x // 1073741824 AS a, x % 1073741824 AS b FROM fixed),
moments AS (
  SELECT arm, count(*)::HUGEINT AS m, sum(x)::HUGEINT AS s, sum(a * a)::HUGEINT AS aa, sum(a * b)::HUGEINT AS ab, sum(b * b)::HUGEINT AS bb
  FROM halves GROUP BY arm
),
parts AS (SELECT *, s // 1099511627776 AS sa, s % 1099511627776 AS sb FROM moments),
spread AS (
  SELECT arm, s::DOUBLE / 1152921504606846976::DOUBLE / m::DOUBLE AS mean,
         sqrt(((536870912 * (m * aa) + m * ab - 562949953421312 * (sa * sa) - 1024 * (sa * sb))::DOUBLE * 2147483648::DOUBLE
               + (m * bb - sb * sb)::DOUBLE) / power(2::DOUBLE, 120)) / m::DOUBLE AS sd
  FROM parts
),
wall AS (
  SELECT per_arm.*, mean, sd, greatest(CAST(datediff('microsecond', t0, t1) AS DOUBLE) / 1e6, 1e-9) AS w FROM per_arm LEFT JOIN spread USING (arm)
),
summary AS (
  SELECT arm AS label, arm AS model_path, CAST(num_prompts AS BIGINT) AS num_prompts,
         CAST({K} AS INTEGER) AS num_samples,
         h1 / num_prompts AS pass_at_1, hk / num_prompts AS pass_at_k,
         CASE WHEN n > 0 THEN mean ELSE 0.0::DOUBLE END AS reward_mean,
         CASE WHEN n > 1 THEN sd ELSE 0.0::DOUBLE END AS reward_std,
         uniq / num_prompts AS avg_unique_completions,
         1.0::DOUBLE - (uniq / num_prompts) / {float(max(K, 1))!r} AS duplicate_rate,
         total_new_tokens, w AS wall_time_sec, total_new_tokens / w AS new_tokens_per_sec,
         num_prompts / w AS prompts_per_sec
  FROM wall
)
"""


def _with(body: str) -> str:
    return "WITH " + BASE_CTES.strip() + "\n" + body


_NUMERIC = (
    "num_prompts", "num_samples", "pass_at_1", "pass_at_k", "reward_mean", "reward_std",
    "avg_unique_completions", "duplicate_rate", "total_new_tokens", "wall_time_sec",
    "new_tokens_per_sec", "prompts_per_sec",
)
_META_NUMERIC = ("start", "count", "num_samples", "max_new_tokens", "temperature", "top_p", "top_k")
_VALUES = ", ".join(f"({i}, {sql.q(m)}, {sql.q(n)})" for i, (m, n) in enumerate(COMPARED))
_LONG = " UNION ALL ".join(
    f"SELECT label, {sql.q(m)} AS metric, CAST({m} AS DOUBLE) AS value FROM summary" for m, _ in COMPARED
)
CMP_CTE = f"""
, long AS ({_LONG}),
cmp AS (
  SELECT m.pos, m.metric, m.name, b.value AS baseline, o.value AS arithmetic, o.value - b.value AS delta
  FROM (VALUES {_VALUES}) m(pos, metric, name)
  JOIN long b ON b.metric = m.metric AND b.label = 'baseline'
  JOIN long o ON o.metric = m.metric AND o.label = 'arithmetic')
"""
_LOG_ARMS = " UNION ALL ".join(
    f"SELECT 'eval/' || label || '/{f}' AS metric, CAST({f} AS DOUBLE) AS value FROM summary "
    f"WHERE label IN ('baseline', 'arithmetic')"
    for f in _NUMERIC
)
_LOG_DELTA = ", ".join(sql.q(m) for m in LOGGED_DELTA)

ORACLE = {
    "ab_delta": _with(CMP_CTE + "SELECT * FROM cmp"),
    "metric_log": _with(
        CMP_CTE + f"{_LOG_ARMS} UNION ALL SELECT 'eval/delta/' || metric AS metric, delta AS value "
        f"FROM cmp WHERE metric IN ({_LOG_DELTA})"
    ),
    "summary_text": _with(
        CMP_CTE + "SELECT pos, printf('%s | %.6f | %.6f | %+.6f', name, baseline, arithmetic, "
        "arithmetic - baseline) AS line FROM cmp"
    ),
    "eval_summary": _with("SELECT * FROM summary"),
    "eval_per_prompt": _with(
        """
SELECT g.arm, g.prompt_id, CAST(coalesce(first_hit, 0) AS INTEGER) AS pass_1,
       CAST(coalesce(any_hit, 0) AS INTEGER) AS pass_k, CAST(coalesce(n_unique, 0) AS BIGINT) AS n_unique,
       CAST(coalesce(n_scores, 0) AS BIGINT) AS n_samples, coalesce(score_sum / n_scores, 0.0::DOUBLE) AS mean_score
FROM grid g LEFT JOIN pp ON g.arm = pp.arm AND g.prompt_id = pp.prompt_id"""
    ),
    "paired_outcome": _with(
        """
, ppo AS (
  SELECT g.arm, g.prompt_id, CAST(coalesce(any_hit, 0) AS INTEGER) AS pass_k,
         coalesce(score_sum / n_scores, 0.0::DOUBLE) AS mean_score
  FROM grid g LEFT JOIN pp ON g.arm = pp.arm AND g.prompt_id = pp.prompt_id)
SELECT CAST(count(*) AS BIGINT) AS n_pairs,
       CAST(sum(CASE WHEN o.pass_k > b.pass_k THEN 1 ELSE 0 END) AS BIGINT) AS wins,
       CAST(sum(CASE WHEN o.pass_k < b.pass_k THEN 1 ELSE 0 END) AS BIGINT) AS losses,
       CAST(sum(CASE WHEN o.pass_k = b.pass_k THEN 1 ELSE 0 END) AS BIGINT) AS ties,
       sign(sum(CAST((o.mean_score - b.mean_score) * 1152921504606846976::DOUBLE AS HUGEINT)))
         * abs(sum(CAST((o.mean_score - b.mean_score) * 1152921504606846976::DOUBLE AS HUGEINT)))::DOUBLE
         / 1152921504606846976::DOUBLE / count(*) AS mean_score_diff
FROM (SELECT * FROM ppo WHERE arm = 'baseline') b JOIN (SELECT * FROM ppo WHERE arm = 'arithmetic') o
  USING (prompt_id)"""
    ),
    "alignment_check": _with(
        f"""
, counts AS (SELECT arm, prompt_id, count(*) AS n, count(DISTINCT l_orderkey) AS nd FROM li GROUP BY 1, 2),
g2 AS (SELECT g.arm, g.prompt_id, coalesce(c.n, 0) AS n, c.nd FROM grid g
       LEFT JOIN counts c ON g.arm = c.arm AND g.prompt_id = c.prompt_id),
k AS (SELECT arm, prompt_id, CASE WHEN n = 0 THEN 'missing' WHEN nd < n THEN 'dup_index'
        WHEN n < {K} THEN 'short' WHEN n > {K} THEN 'long' END AS kind, CAST(n AS BIGINT) AS n_samples FROM g2)
SELECT * FROM k WHERE kind IS NOT NULL
UNION ALL
SELECT arm, prompt_id, 'orphan' AS kind, CAST(n AS BIGINT) AS n_samples FROM counts
WHERE prompt_id NOT IN (SELECT prompt_id FROM prompts)"""
    ),
}

# the batches of custom_scorer begin at the slice's first ordinal, so shifting both leaves them as they are
_CLOSE = (
    f"CASE WHEN num % 7 <> 0 THEN 1 / (1 + abs(num - CAST(p.answer AS DOUBLE))) "
    f"ELSE {sql.score('c.completion', 'p.answer')} END"
)
_SCORED = f"""scored AS (
  SELECT c.*, p.answer, {sql.score("c.completion", "p.answer")} AS score,
         {sql.normalize("c.completion")} AS norm
  FROM comp2 c JOIN prompts p USING (prompt_id)
)"""
_SCORED_CLOSE = f"""scored AS (
  SELECT c.*, p.answer, {_CLOSE} AS score, {sql.normalize("c.completion")} AS norm
  FROM (SELECT *, CAST(regexp_extract(completion, '[0-9]+') AS DOUBLE) AS num FROM comp2) c JOIN prompts p USING (prompt_id)
)"""
assert _SCORED in BASE_CTES
ORACLE["custom_scorer"] = "WITH " + BASE_CTES.strip().replace(_SCORED, _SCORED_CLOSE) + "\nSELECT * FROM summary"

ORACLE["failing_scorer"] = ORACLE["custom_scorer"].replace(
    "\nSELECT * FROM summary",
    """, failed AS (SELECT arm AS label, count(*) AS num_scored, count(*) FILTER (num % 7 = 0) AS num_failed,
       count(DISTINCT num) FILTER (num % 7 = 0) AS num_reasons FROM scored GROUP BY arm)
SELECT summary.*, num_scored, num_failed, num_reasons FROM summary JOIN failed USING (label)""",
)

_REPORT_ROWS = [f"SELECT 'meta.{c}' AS path, CAST({v} AS DOUBLE) AS value{f}" for c, v, f in (
    ("start", "0", ""), ("count", "max(num_prompts)", " FROM summary"), ("num_samples", str(K), ""),
    ("max_new_tokens", "256", ""), ("temperature", "0.8", ""), ("top_p", "1", ""), ("top_k", "0", ""),
)]
_REPORT_ROWS += [
    f"SELECT label || '.{c}' AS path, CAST({c} AS DOUBLE) AS value FROM summary WHERE label IN ('baseline', 'arithmetic')" for c in _NUMERIC
]
ORACLE["report_json"] = _with(
    CMP_CTE + " UNION ALL ".join([*_REPORT_ROWS, "SELECT 'delta.' || metric AS path, delta AS value FROM cmp"])
)

_RUNS = "('all', 'first', NULL, NULL, NULL), " + ", ".join(f"('{r}', 'second', 'part x lineitem', {K}, 0.8::DOUBLE)" for r in ("all", "one"))
ORACLE["metric_log_rerun"] = (
    "SELECT r.*, metric, value, true AS kept_going "
    f'FROM (VALUES {_RUNS}) r("read", run, config_dataset, config_num_samples, config_temperature) CROSS JOIN ({ORACLE["metric_log"]})'
)
ORACLE["unique_sketch"] = (
    f"SELECT lang, CAST(count(*) AS BIGINT) AS num_rows, CAST(count(DISTINCT {sql.normalize('text')}) AS BIGINT) AS num_exact, "
    "true AS within FROM documents GROUP BY lang"
)

QUERIES = {
    "eval_summary": eval_summary,
    "eval_per_prompt": eval_per_prompt,
    "ab_delta": ab_delta,
    "metric_log": metric_log,
    "metric_log_rerun": metric_log_rerun,
    "unique_sketch": unique_sketch,
    "summary_text": summary_text,
    "report_json": report_json,
    "custom_scorer": custom_scorer,
    "failing_scorer": failing_scorer,
    "paired_outcome": paired_outcome,
    "alignment_check": alignment_check,
}

