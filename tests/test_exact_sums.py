"""Order-independent sums: equal to rational arithmetic, whatever the partitions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strata.functions.exact import LIMBS, limbs, spread_digits, square_limbs, summable, sums, to_double
from strata.operators.evaluate import evaluate

_RND = random.Random(5)
CASES = {
    "unit": [_RND.random() for _ in range(3000)],
    "narrow": [1000 + _RND.random() * 1e-7 for _ in range(2000)],
    "signed": [_RND.uniform(-1e6, 1e6) for _ in range(2000)],
    "neighbours": [1 - 2**-50, 1 + 2**-50] * 40,
    "constant": [0.1] * 10,
    "nulls": [None, 0.25, None, -0.75],
}


@pytest.mark.parametrize("name", CASES)
def test_equal_to_rational_sums(spark, name):
    vals = CASES[name]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    df = df.withColumn("d", limbs(F.col("x"))).withColumn("dd", square_limbs(F.col("d")))
    agg = df.agg(*sums("d", LIMBS, "s"), *sums("dd", 2 * LIMBS - 1, "q"), F.count("x").alias("n"))
    s, q = [F.col(f"s{i}") for i in range(LIMBS)], [F.col(f"q{i}") for i in range(2 * LIMBS - 1)]
    got = agg.select(to_double(s).alias("t"), to_double(spread_digits(s, q, F.col("n"))).alias("v")).first()
    have = [Fraction(v) for v in vals if v is not None]
    total = sum(have)
    assert got.t == float(total)
    assert got.v == float(len(have) * sum(x * x for x in have) - total * total)


def test_values_that_cannot_be_summed(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0**31,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(summable(F.col("x"))).collect()] == [False, False, False, True, True]
    assert [r[0][0] for r in df.select(limbs(F.col("x"))).collect()] == [0, 0, 0, 1, 0]


def test_an_odd_score_shows_as_nan_in_its_arm_only(spark):
    prompts = spark.createDataFrame([(0, "p", "1"), (1, "p", "2")], "prompt_id long, prompt string, answer string")
    comps = spark.createDataFrame([("a", 0, 0, "1"), ("a", 1, 0, "inf"), ("b", 0, 0, "1"), ("b", 1, 0, "3")], "arm string, prompt_id long, sample_idx int, completion string")
    scorer = lambda prompt, completion, answer: completion.cast("double")
    rows = {r.label: r for r in evaluate(prompts, comps, 1, ["a", "b"], scorer=scorer).collect()}
    assert rows["a"].reward_mean != rows["a"].reward_mean
    assert rows["b"].reward_mean == 2.0 and rows["b"].reward_std == 1.0
