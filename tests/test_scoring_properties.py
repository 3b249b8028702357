"""Properties of the score ladder, stated as laws and literal cases over random texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions.scoring import score_expr
from strata.functions.text import last_number, normalize

PIECES = ["0", "1", "7", "12", ".", "-", "e", "x", "B", "é", " ", "  ", "\t", "\n", "}", "\\boxed{", ",", "5.25"]
texts = st.lists(st.sampled_from(PIECES), max_size=10).map("".join)


def scores(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c string, a string")
    return [r.s for r in df.select("i", score_expr(F.col("c"), F.col("a")).alias("s")).orderBy("i").collect()]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=40))
def test_laws(spark, pairs):
    base = scores(spark, pairs)
    assert set(base) <= {0.0, 1.0}
    assert scores(spark, [(a, c) for c, a in pairs]) == base  # symmetric
    assert scores(spark, [(c.upper(), a) for c, a in pairs]) == base  # case does not matter
    assert scores(spark, [(f"  {c}\n", a.replace(" ", "\t ")) for c, a in pairs]) == base  # nor does the amount of white space
    assert all(s == 1.0 for s, (c, _) in zip(scores(spark, [(c, c) for c, _ in pairs]), pairs) if any(x.isalnum() for x in c.replace("\\boxed{", "")))


@pytest.mark.parametrize(
    "text, norm, number",
    [
        ("", "", None),
        ("  A \t b ", "a b", None),
        ("so \\boxed{42}", "so 42", "42"),
        ("-1.5e3 then +7.", "-1.5e3 then +7.", "+7"),
        ("x=.25", "x=.25", ".25"),
        ("1,234", "1,234", "234"),
    ],
)
def test_literal_cases(spark, text, norm, number):
    row = spark.createDataFrame([(text,)], "t string").select(normalize(F.col("t")).alias("n"), last_number(normalize(F.col("t"))).alias("l")).first()
    assert (row.n, row.l) == (norm, number)


def test_tolerance_edges(spark):
    pairs = [("1", "1.0000000005"), ("1", "1.00000001"), ("0", "5e-10"), ("0", "5e-9"), ("1e3", "1000"), ("", ""), ("a", "b")]
    assert scores(spark, pairs) == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0]
