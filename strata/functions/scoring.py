"""Scoring of a completion against an answer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import is_close, last_number, normalize, parse_number

# Name reported for the built-in scorer (fixed value of the report's ``reward_backend``).
BUILTIN_BACKEND = "fallback_numeric_exact"
# A sample counts as correct when its score is strictly above this threshold.
PASS_THRESHOLD = 0.5


def score_expr(completion: Column, answer: Column) -> Column:
    """P3 on raw texts."""
    return score_normalized(normalize(completion), normalize(answer))


def score_normalized(c_norm: Column, a_norm: Column) -> Column:
    """1 when the normalised texts are equal and non-empty, else numeric comparison of the
    last numbers of the normalised texts (1 when close), else 0. Returns DOUBLE."""
    return _ladder((c_norm == a_norm) & (a_norm != F.lit("")), last_number(c_norm), last_number(a_norm))


def _ladder(equal: Column, c_last: Column, a_last: Column) -> Column:
    near = F.coalesce(is_close(parse_number(c_last), parse_number(a_last)), F.lit(False))
    numeric = F.when(near, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(equal, F.lit(1.0)).when(c_last.isNotNull() & a_last.isNotNull(), numeric).otherwise(F.lit(0.0))


def score_key(text: Column) -> Column:
    """What P3 needs of a text, in a few bytes: the digest of its normal form (null when that is
    empty) and its last number. Join on these instead of whole texts."""
    norm = normalize(text)
    digest = F.when(norm != F.lit(""), F.sha2(norm, 256))
    return F.struct(digest.alias("digest"), last_number(norm).alias("last"))


def score_keys(completion: Column, answer: Column) -> Column:
    """P3 on two ``score_key`` structs (a null struct is an empty text)."""
    equal = F.coalesce(completion["digest"] == answer["digest"], F.lit(False))
    return _ladder(equal, completion["last"], answer["last"])


def is_correct(score: Column) -> Column:
    """Strict threshold."""
    return score > F.lit(PASS_THRESHOLD)


ScorerFn = Callable[[Column, Column, Column], Column]


def score(
    df: DataFrame,
    completion: str = "completion",
    answer: str = "answer",
    prompt: str = "prompt",
    scorer: ScorerFn | None = None,
    out: str = "score",
    builtin: Column | None = None,
) -> tuple[DataFrame, str]:
    """Add a score column and return ``(df, backend_name)``.

    ``scorer`` is any callable ``(prompt, completion, answer) -> Column`` — a column expression
    or a pandas UDF applied to the three columns. A null from it (the plug-in failed for that
    sample) falls back to the built-in score for that row (X2). ``scorer=None`` uses the built-in
    score (X3), which is ``builtin`` where the caller has it at hand. A scorer made by ``isolating``
    also gives the column ``scorer_error`` (null where it did not raise).
    """
    if builtin is None:
        builtin = score_expr(F.col(completion), F.col(answer))
    if scorer is None:
        return df.withColumn(out, builtin), BUILTIN_BACKEND
    p = F.col(prompt) if prompt in df.columns else F.lit("")
    name = getattr(scorer, "backend_name", getattr(scorer, "__name__", "custom"))
    if getattr(scorer, "tells_errors", False):
        told = df.withColumn("_plug", scorer(p, F.col(completion), F.col(answer)))
        told = told.withColumn(out, F.coalesce("_plug.score", builtin)).withColumn("scorer_error", F.col("_plug.error"))
        return told.drop("_plug"), name
    plug = scorer(p, F.col(completion), F.col(answer)).cast("double")
    return df.withColumn(out, F.coalesce(plug, builtin)), name


def isolating(fn: Callable, name: str | None = None) -> ScorerFn:
    """A plug-in scorer from ``fn(prompts, completions, answers) -> scores`` (pandas Series) that may
    raise. It runs over Arrow batches. A batch on which it raises is halved until the rows that cause
    it stand alone (two calls per level, so a few bad rows cost a few logarithms); these get no score
    (the built-in one takes their place) and the exception as the reason, all others keep theirs. A
    result of another length counts as a failure too, a null or non-number as a row without score."""

    def scores(prompt: pd.Series, completion: pd.Series, answer: pd.Series) -> pd.DataFrame:
        values: list[float | None] = [None] * len(prompt)
        columns = [x.to_numpy(dtype="object") for x in (prompt, completion, answer)]
        reasons: list[str | None] = [None] * len(prompt)
        waiting = [(0, len(prompt))]
        while waiting:
            lo, hi = waiting.pop()
            if lo == hi:
                continue
            part = [pd.Series(x[lo:hi].copy(), dtype=s.dtype) for x, s in zip(columns, (prompt, completion, answer), strict=True)]
            try:
                got = list(fn(*part))
                if len(got) != hi - lo:
                    raise ValueError(f"{len(got)} scores for {hi - lo} rows")
                if any(type(x) is not float for x in got):
                    got = pd.to_numeric(pd.Series(got, dtype="object"), errors="coerce")
                values[lo:hi] = [None if pd.isna(x) else float(x) for x in got]
            except Exception as e:  # noqa: BLE001 - whatever the plug-in raises
                if hi - lo == 1:
                    reasons[lo] = f"{type(e).__name__}: {e}"
                else:
                    mid = (lo + hi) // 2
                    waiting += [(mid, hi), (lo, mid)]
        return pd.DataFrame({"score": pd.Series(values, dtype="float64"), "error": pd.Series(reasons, dtype="object")})

    udf = F.pandas_udf(scores, "score double, error string")

    def scorer(prompt: Column, completion: Column, answer: Column) -> Column:
        return udf(prompt, completion, answer)

    scorer.backend_name = name or getattr(fn, "__name__", "custom")
    scorer.tells_errors = True
    return scorer
