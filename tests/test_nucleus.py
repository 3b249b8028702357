import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import distribution as dist
from strata.operators.nucleus import ONE, select_top_p

SCHEMA = "context string, token long, logit double, note int"


def brute(rows, p):
    """Kept (context, token, logit, weight), by the definition: share of the weight strictly before a row."""
    groups = defaultdict(list)
    for c, t, x, _ in rows:
        if x is not None and not math.isnan(x) and t is not None:
            groups[c].append((t, x))
    out = []
    for c, g in groups.items():
        top = max(x for _, x in g)
        g = sorted((-(ONE if x == top else math.floor(math.exp(x - top) * ONE + 0.5)), t, x) for t, x in g)
        limit = math.floor(p * -sum(w for w, _, _ in g))
        for w, t, x in g:
            before = -sum(v for v, u, _ in g if (v, u) < (w, t))
            if before <= limit:
                out.append((c, t, x, -w))
    return sorted(out, key=str)


def kept(df):
    return sorted(((r.context, r.token, r.logit, r.weight) for r in df.select("context", "token", "logit", "weight").collect()), key=str)


def cases():
    rng = np.random.default_rng(8)
    hot = [("hot", int(t), float(x), 1) for t, x in zip(rng.integers(-(1 << 62), 1 << 62, 300), rng.normal(size=300), strict=True)]
    ties = [("ties", int(t), float(x), 1) for t, x in zip(rng.permutation(200) * 70_000 - 5_000_000, rng.integers(0, 3, 200), strict=True)]
    odd = [("one", 5, 1.0, 1), ("null", None, 1.0, 1), (None, 1, None, 1), (None, 2, 0.0, 1), (None, 3, float("nan"), 1), (None, -3, 0.0, 1)]
    same = [("same", 7, 2.0, 1)] * 5 + [("same", 6, 2.0, 1)] * 5
    inf = [("inf", 1, float("inf"), 1), ("inf", 2, float("inf"), 1), ("inf", 3, 0.0, 1), ("low", 1, float("-inf"), 1), ("low", 2, 1.0, 1)]
    return hot + ties + odd + same + inf


@pytest.mark.parametrize("most", [100, 2])
def test_histogram_cut_equals_brute_force(spark, most):
    rows = cases()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for p in (0.05, 0.5, 0.93):
        got = select_top_p(df, ["context"], p, broadcast_contexts=most)
        assert kept(got) == brute(rows, p) and got.columns == [*df.columns, "weight"]
    assert select_top_p(df.limit(0), ["context"], 0.5, broadcast_contexts=most).count() == 0


def test_global_off_and_agreement(spark):
    rows = [(None, t, x, n) for _, t, x, n in cases() if x is not None and not math.isinf(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert kept(select_top_p(df, [], 0.7)) == brute(rows, 0.7)
    assert select_top_p(df.limit(0), [], 0.7).count() == 0
    assert select_top_p(df, ["context"], 1.0).count() == sum(not math.isnan(x) and t is not None for _, t, x, _ in rows)
    hot = spark.createDataFrame([r for r in cases() if r[0] == "hot"], SCHEMA)
    scan = {r.token for r in dist.apply_top_p(hot, ["context"], 0.8).collect()}
    assert {r.token for r in select_top_p(hot, ["context"], 0.8).collect()} == scan


def test_plan_has_no_sort_of_the_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("context"), F.col("id").alias("token"), (F.col("id") % 50 / 7).alias("logit"))
    plan = select_top_p(df, ["context"], 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower() and "Scan ExistingRDD" not in plan and "SortMergeJoin" not in plan
