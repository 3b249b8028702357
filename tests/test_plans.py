"""Plan-level guards for the scale design."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from strata.operators import distribution as dist
from strata.operators.evaluate import first_k_samples
from strata.operators.scan import _sliced, prefix_sum

from .conftest import SMALL

FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_group_is_split_across_slices(spark):
    # one group holds a third of all rows; the range slices must cut it over several tasks
    rows = [("hot", i, 1) for i in range(3000)] + [(f"k{i % 2000}", i, 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    s = _sliced(df, ["g"], [F.col("o")], 8)
    spans = s.filter(F.col("g") == "hot").groupBy("_slice").count().collect()
    assert len(spans) >= 3
    assert max(r["count"] for r in spans) < 3000
    got = prefix_sum(df, ["g"], [F.col("o")], F.col("v"), slices=8).filter(F.col("g") == "hot")
    assert {r.o: r.cum_incl for r in got.collect()} == {i: i + 1 for i in range(3000)}


def test_partial_group_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "p long, o long")
    plan = _plan(first_k_samples(df, 4, ["p"], ["o"]))
    # the plan prints top-down: final WindowGroupLimit, then the exchange, then the partial one
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    d = spark.createDataFrame([("x", i, float(i)) for i in range(50)], "context string, token long, logit double")
    assert _plan(dist.apply_top_k(d, ["context"], 5)).count("WindowGroupLimit") == 2


def test_no_cartesian_or_row_udf_in_registered_queries(spark):
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SMALL))
        assert not FORBIDDEN.search(plan), name
