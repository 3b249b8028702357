import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.scoring import score_expr
from strata.functions.text import as_text, as_text_expr, last_number, normalize
from strata.sources.dataset import ANSWER_CANDIDATES, PROMPT_CANDIDATES, resolve_column


def _one(spark, expr, values, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_normalize(spark):
    vals = ["  \\boxed{ 5 } ", "a b 7", "\u001c 7", "ABC  d\t\n"]
    assert _one(spark, normalize(F.col("s")), vals) == [" 5 ", "a b 7", "7", "abc d"]


def test_last_number(spark):
    cases = {
        "1,234": "234", "3.": "3", "1/2": "2", "x-5": "-5", "2-1": "-1", "1e5": "1e5", "1e+": "1",
        "12.34.56": ".56", "-.5e-3x": "-.5e-3", "abc": None,
    }
    got = _one(spark, last_number(F.col("s")), list(cases))
    assert got == list(cases.values())


SCORE_CASES = [
    ("\\boxed{5}", "5", 1.0),
    ("  \\boxed{ 5 } ", "5", 1.0),
    ("so x = 5.0000000001", "5", 1.0),
    ("5.1", "5", 0.0),
    ("abc", "abd", 0.0),
    ("", "", 0.0),
    ("1e999", "5", 0.0),
    ("1e999", "2e999", 1.0),
    ("1,234", "234", 1.0),
    ("-1e999", "1e999", 0.0),
    ("1e-12", "0", 1.0),
    ("ABC  d", "abc d", 1.0),
]


def test_score_ladder(spark):
    df = spark.createDataFrame([(c, a) for c, a, _ in SCORE_CASES], "c string, a string")
    got = [r[0] for r in df.select(score_expr(F.col("c"), F.col("a"))).collect()]
    assert got == [s for _, _, s in SCORE_CASES]


def test_as_text_chat_and_lists(spark):
    chat_t = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    df = spark.createDataFrame(
        [([("u", "a"), ("a", ""), ("u", "b")],), ([],), (None,)], T.StructType([T.StructField("m", chat_t)])
    )
    assert _one_col(df, "m") == ["a\nb", "", ""]
    lst = spark.createDataFrame([(["a", "", "b"],), ([],)], "l array<string>")
    assert _one_col(lst, "l") == ["a\n\nb", ""]


def test_as_text_struct_and_map(spark):
    st = spark.createDataFrame([(("t", "z"),)], "x struct<text:string, answer:string>")
    assert _one_col(st, "x") == ["t"]
    st2 = spark.createDataFrame([((None, "t"),)], "x struct<content:string, text:string>")
    assert _one_col(st2, "x") == [""]
    mp = spark.createDataFrame([({"value": "v", "answer": "a"},), ({"other": "o"},)], "m map<string,string>")
    assert _one_col(mp, "m") == ["v", '{"other":"o"}']
    num = spark.createDataFrame([(1.5,), (None,)], "d double")
    assert _one_col(num, "d") == ["1.5", ""]


def _one_col(df, c):
    return [r[0] for r in df.select(as_text_expr(F.col(c), df.schema[c].dataType)).collect()]


def test_resolver():
    assert resolve_column(["Problem", "prompt"], None, PROMPT_CANDIDATES, "prompt") == "prompt"
    assert resolve_column(["id", "Question"], None, PROMPT_CANDIDATES, "prompt") == "Question"
    assert resolve_column(["user_input_len", "my_prompt"], None, PROMPT_CANDIDATES, "prompt") == "user_input_len"
    assert resolve_column(["question_answer"], None, PROMPT_CANDIDATES, "prompt") == "question_answer"
    assert resolve_column(["question_answer"], None, ANSWER_CANDIDATES, "answer") == "question_answer"
    assert resolve_column(["a", "Prompt"], "", PROMPT_CANDIDATES, "prompt") == "Prompt"
    with pytest.raises(ValueError):
        resolve_column(["a", "b"], None, PROMPT_CANDIDATES, "prompt")
    with pytest.raises(ValueError):
        resolve_column(["prompt"], "Prompt", PROMPT_CANDIDATES, "prompt")


def test_chat_text_blocks(spark):
    from strata.plans.text_queries import chat_text

    rows = [(1, t, "u", ("" if t % 5 == 0 else f"m{t}")) for t in range(150)] + [(2, 0, "u", None), (2, 1, "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat_text(df, block=7).collect()}
    assert got[1] == (150, "\n".join(f"m{t}" for t in range(150) if t % 5))
    assert got[2] == (2, "x")


def test_as_text_map_with_int_keys(spark):
    df = spark.createDataFrame([({1: "a"},)], "m map<int,string>")
    assert _one_col(df, "m") == ['{"1":"a"}']


def test_variant_cells_are_dispatched_by_value(spark):
    """Each cell by its own kind, as the recursive rules give it."""
    from strata.functions.text import variant_text

    cells = [
        ('"plain"', "plain"), ('""', ""), ("null", ""), ("12", "12"), ("true", "true"), ("[]", ""), ("{}", "{}"), (None, ""),
        ('[{"role": "s", "content": ""}, {"content": "a"}, {"role": "x"}, {"content": "b"}]', "a\nb"),
        ('[{"role": "x"}, {"content": "b"}]', '{"role":"x"}\nb'),
        ('{"solution": "s", "answer": "a"}', "a"), ('{"text": null, "answer": "a"}', ""),
        ('{"value": {"content": ["x", {"text": "y"}, ["z", null]]}}', "x\ny\nz\n"),
        ('["a", "", "b"]', "a\n\nb"), ('{"b": [1, 2]}', '{"b":[1,2]}'), ('"[1, 2]"', "[1, 2]"),
        ('{"text": "line\\nbreak \\u00e9"}', "line\nbreak é"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cells)], "id int, c string").withColumn("v", F.parse_json("c"))
    got = {r.id: r.t for r in df.select("id", as_text(df, "v").alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cells)}
    deep = "[" * 12 + '"x"' + "]" * 12
    one = spark.createDataFrame([(deep,)], "c string").withColumn("v", F.parse_json("c"))
    assert one.select(variant_text(F.col("v")).alias("t")).first().t == "[" * 4 + '"x"' + "]" * 4
