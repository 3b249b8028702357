"""Comparison of two arms and the report sinks.

All inputs here are the per-arm summary (one row per arm), so every step is tiny; the point is
that the reports stay DataFrames derived from the distributed evaluation, never driver dicts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.scoring import BUILTIN_BACKEND
from strata.operators.evaluate import RESULT_FIELDS

# --- fixed values (field sets and labels of the reference's reports) ------------------------
# Compared metrics, in console / JSON-delta order, with their console labels.
COMPARED = (
    ("pass_at_1", "pass@1"),
    ("pass_at_k", "pass@k"),
    ("reward_mean", "reward_mean"),
    ("reward_std", "reward_std"),
    ("avg_unique_completions", "avg_unique_completions"),
    ("duplicate_rate", "duplicate_rate"),
    ("new_tokens_per_sec", "new_tokens_per_sec"),
    ("prompts_per_sec", "prompts_per_sec"),
    ("wall_time_sec", "wall_time_sec"),
)
# The logged delta has only these seven.
LOGGED_DELTA = (
    "pass_at_1",
    "pass_at_k",
    "reward_mean",
    "reward_std",
    "avg_unique_completions",
    "duplicate_rate",
    "new_tokens_per_sec",
)
# Prefix of logged metric keys and the key of the delta block.
LOG_PREFIX = "eval"
DELTA_KEY = "delta"
# ---------------------------------------------------------------------------------------------


def _lookup(mapping: dict, key: Column) -> Column:
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.try_element_at(m, key)


def numeric_fields(df: DataFrame) -> list[str]:
    """Fields whose type is numeric (drops label and model_path)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def compare_arms(summary: DataFrame, base: str, other: str) -> DataFrame:
    """J3 + P8: (pos, metric, name, baseline, arithmetic, delta) for the nine compared metrics.

    ``unpivot`` to (label, metric, value), then ``pivot`` on the two fixed arm labels (one pass).
    """
    fields = [m for m, _ in COMPARED]
    long = summary.select("label", *[F.col(m).cast("double").alias(m) for m in fields]).unpivot(
        "label", fields, "metric", "value"
    )
    wide = long.groupBy("metric").pivot("label", [base, other]).agg(F.max("value"))
    pos = {m: i for i, (m, _) in enumerate(COMPARED)}
    names = dict(COMPARED)
    return wide.select(
        _lookup(pos, F.col("metric")).cast("int").alias("pos"),
        "metric",
        _lookup(names, F.col("metric")).alias("name"),
        F.col(base).alias("baseline"),
        F.col(other).alias("arithmetic"),
        (F.col(other) - F.col(base)).alias("delta"),
    )


def metric_log(summary: DataFrame, base: str, other: str) -> DataFrame:
    """S8 + T17 + U3: flat ``eval/{arm}/{field} -> value`` for every numeric field of both arms,
    plus ``eval/delta/{field}`` for the seven logged deltas. Columns: metric, value.

    One pass over the summary: each (arm, field, value) row emits its own key and, for logged
    fields, a signed contribution to the delta key (+other, -base); one ``groupBy`` adds them.
    A delta with one arm missing is null.
    """
    fields = numeric_fields(summary)
    long = (
        summary.filter(F.col("label").isin(base, other))
        .select("label", *[F.col(f).cast("double").alias(f) for f in fields])
        .unpivot("label", fields, "field", "value")
    )
    own = F.struct(F.concat_ws("/", F.lit(LOG_PREFIX), F.col("label"), F.col("field")).alias("metric"), F.col("value"), F.lit(1).alias("terms"))
    sign = F.when(F.col("label") == F.lit(other), F.lit(1.0)).otherwise(F.lit(-1.0))
    delta = F.struct(
        F.concat_ws("/", F.lit(LOG_PREFIX), F.lit(DELTA_KEY), F.col("field")).alias("metric"), (sign * F.col("value")).alias("value"),
        F.lit(2).alias("terms"),
    )
    parts = F.when(F.col("field").isin(*LOGGED_DELTA), F.array(own, delta)).otherwise(F.array(own))
    flat = long.select(F.explode(parts).alias("e")).select("e.metric", "e.value", "e.terms")
    # per-arm keys get one term; a delta key gets other + (-base), which is exactly other - base
    whole = F.count("value") == F.max("terms")
    return flat.groupBy("metric").agg(F.when(whole, F.sum("value")).alias("value"))


def fixed6(x: Column) -> Column:
    """``'%.6f' % x`` as a JVM expression: ``format_number`` rounds the exact binary value
    half-even (like C and Python formatting; ``format_string`` rounds the shortest decimal text
    half-up and differs on ties), then the grouping commas are removed. Java keeps only 17
    significant digits, so from 1e9 on the whole part and the fraction (both exact) are formatted
    apart; right for |x| < 2**63, beyond it as Java prints it."""
    whole = F.abs(x).cast("long")
    frac = F.format_number(F.abs(x) - whole, 6).cast("decimal(7,6)")
    large = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), (whole.cast("decimal(19,0)") + frac).cast("string"))
    in_range = (F.abs(x) >= 1e9) & (F.abs(x) < 2.0**63)
    return F.when(in_range, large).otherwise(F.regexp_replace(F.format_number(x, 6), ",", ""))


def signed_fixed6(x: Column) -> Column:
    """``'%+.6f' % x``."""
    s = fixed6(x)
    return F.when(s.startswith("-"), s).otherwise(F.concat(F.lit("+"), s))


def summary_lines(compared: DataFrame) -> DataFrame:
    """One console line per compared metric, ``name | base | other | delta`` (pos, line)."""
    b, a = F.col("baseline"), F.col("arithmetic")
    line = F.concat_ws(" | ", F.col("name"), fixed6(b), fixed6(a), signed_fixed6(a - b))
    return compared.select("pos", line.alias("line"))


SUMMARY_HEADER = ("metric", "baseline", "arithmetic", "delta (arith - base)")
SUMMARY_TITLE = "=== Evaluation Summary ==="
SUMMARY_RULE = "-" * 92


def console_text(compared: DataFrame, backend: str = BUILTIN_BACKEND) -> DataFrame:
    """S9 in full: title, backend, header, rule and the nine metric lines as one text (one row).
    The nine lines are ordered by their fixed position inside the aggregate."""
    lines = summary_lines(compared)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    head = "\n".join([SUMMARY_TITLE, f"Reward backend: {backend}", " | ".join(SUMMARY_HEADER), SUMMARY_RULE])
    return lines.agg(F.concat_ws("\n", F.lit(head), body).alias("text"))


@dataclass(frozen=True)
class RunMeta:
    """Run metadata of the report (``count`` comes from the data, not from here)."""

    dataset: str
    split: str
    start: int
    prompt_column: str
    answer_column: str
    num_samples: int
    dataset_config: str | None = None
    max_new_tokens: int = 256
    temperature: float = 0.8
    top_p: float = 1.0
    top_k: int = 0
    reward_backend: str = BUILTIN_BACKEND


def report_struct(summary: DataFrame, meta: RunMeta, base: str, other: str) -> DataFrame:
    """S7 + S10: one row ``report`` = struct(meta, baseline, arithmetic, delta). The block of an arm
    that the summary does not hold is null, and so are the deltas."""
    rec = F.struct(*[F.col(f) for f in RESULT_FIELDS])
    agg = summary.agg(
        F.max(F.when(F.col("label") == F.lit(base), rec)).alias("b"),
        F.max(F.when(F.col("label") == F.lit(other), rec)).alias("o"),
    )
    meta_struct = F.struct(
        F.lit(meta.dataset).alias("dataset"),
        F.lit(meta.dataset_config).cast("string").alias("dataset_config"),
        F.lit(meta.split).alias("split"),
        F.lit(meta.start).cast("long").alias("start"),
        F.coalesce(F.col("b.num_prompts"), F.col("o.num_prompts")).alias("count"),
        F.lit(meta.prompt_column).alias("prompt_column"),
        F.lit(meta.answer_column).alias("answer_column"),
        F.lit(meta.num_samples).cast("int").alias("num_samples"),
        F.lit(meta.max_new_tokens).cast("int").alias("max_new_tokens"),
        F.lit(float(meta.temperature)).alias("temperature"),
        F.lit(float(meta.top_p)).alias("top_p"),
        F.lit(meta.top_k).cast("int").alias("top_k"),
        F.lit(meta.reward_backend).alias("reward_backend"),
    )
    delta = F.struct(*[(F.col(f"o.{m}") - F.col(f"b.{m}")).alias(m) for m, _ in COMPARED])
    return agg.select(
        F.struct(
            meta_struct.alias("meta"),
            F.col("b").alias(base),
            F.col("o").alias(other),
            delta.alias("delta"),
        ).alias("report")
    )


def report_json(summary: DataFrame, prompts: DataFrame, meta: RunMeta, base: str, other: str) -> DataFrame:
    """The report as pretty JSON text, one row with column ``report``."""
    del prompts  # the slice size is the arms' num_prompts (every prompt is counted per arm)
    s = report_struct(summary, meta, base, other)
    return s.select(F.to_json("report", {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    """S7 sink: a one-row frame, so a single output file is fine here (and only here)."""
    report.coalesce(1).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class RunConfig:
    """The logged run configuration (requested count and model paths; unlike ``RunMeta`` it
    has no dataset config or column names)."""

    dataset: str
    split: str
    start: int
    count: int
    num_samples: int
    max_new_tokens: int
    temperature: float
    top_p: float
    top_k: int
    reward_backend: str
    baseline_model: str
    arithmetic_model: str


#: Partition column of a written log; a text that no reader takes for a number or a date.
RUN_KEY = "run_key"


def write_metric_log(log: DataFrame, path: str, run_name: str, config: RunConfig | None = None) -> bool:
    """S8 + S11 + S12: write the flat metrics with the run name (and the run configuration as columns)
    as the partition of this run. Only this partition is replaced (dynamic overwrite), so a run that is
    repeated, after a failure for instance, leaves its rows once and those of other runs as they are. A
    failing sink only warns."""
    try:
        out = log.withColumn("run", F.lit(run_name)).withColumn("logged_at", F.current_timestamp())
        if config is not None:
            for k, v in config.__dict__.items():
                out = out.withColumn(f"config_{k}", F.lit(v))
        out = out.withColumn(RUN_KEY, F.concat(F.lit("run-"), F.md5("run")))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN_KEY).parquet(path)
        return True
    except Exception as exc:  # noqa: BLE001 - logging must never fail the run
        print(f"[warn] metric log failed: {type(exc).__name__}: {exc}")
        return False


def read_metric_log(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    """The rows of a written log; with ``runs`` only the partitions of these runs are read. Runs logged
    without a configuration have null in the columns of one."""
    log = spark.read.option("mergeSchema", "true").parquet(path)
    if runs is not None:
        log = log.where(F.col(RUN_KEY).isin(*["run-" + hashlib.md5(r.encode()).hexdigest() for r in runs]))
    return log.drop(RUN_KEY)
