"""Randomised checks of the sliced scans against plain Python, over random skew and slice counts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.operators.scan import inverse_cdf, prefix_sum

groups = st.lists(st.tuples(st.integers(0, 4), st.integers(1, 300)), min_size=1, max_size=5)


@settings(max_examples=8, deadline=None)
@given(groups, st.integers(1, 12), st.integers(0, 10**6))
def test_prefix_sum_random(spark, sizes, slices, seed):
    import random

    rnd = random.Random(seed)
    rows = []
    for g, n in sizes:
        rows += [(g, rnd.randint(0, 10**6), rnd.randint(0, 9)) for _ in range(n)]
    rows = list({(g, o): (g, o, v) for g, o, v in rows}.values())  # (g, o) is a total order
    df = spark.createDataFrame(rows, "g int, o long, v long")
    got = {(r.g, r.o): (r.cum_excl, r.cum_incl, r.cum_total) for r in prefix_sum(df, ["g"], [F.col("o")], F.col("v"), slices=slices).collect()}
    want, acc, tot = {}, {}, {}
    for g, o, v in sorted(rows):
        tot[g] = tot.get(g, 0) + v
    for g, o, v in sorted(rows):
        a = acc.get(g, 0)
        want[(g, o)] = (a, a + v, tot[g])
        acc[g] = a + v
    assert got == want


@settings(max_examples=8, deadline=None)
@given(groups, st.integers(1, 12), st.integers(0, 10**6))
def test_inverse_cdf_random(spark, sizes, slices, seed):
    import random

    rnd = random.Random(seed)
    drows, prows, table = [], [], {}
    for g, n in sizes:
        if g in table:
            continue
        ws = [rnd.randint(1, 5) for _ in range(n)]
        tot, acc = sum(ws), 0
        table[g] = []
        for t, w in enumerate(ws):
            table[g].append((t, acc / tot, (acc + w) / tot))
            drows.append((g, t, acc / tot, (acc + w) / tot))
            acc += w
        for j in range(rnd.randint(1, 40)):
            prows.append((g, j, rnd.choice([0.0, 1.0, rnd.random()])))
    d = spark.createDataFrame(drows, "g int, token int, lo double, hi double")
    p = spark.createDataFrame(prows, "g int, pid int, c double")
    got = {(r.g, r.pid): r.token for r in inverse_cdf(p, d, ["g"], slices=slices).collect()}
    for g, pid, c in prows:
        assert got[(g, pid)] == next(t for t, lo, hi in table[g] if (c > lo or lo == 0) and c <= hi)
