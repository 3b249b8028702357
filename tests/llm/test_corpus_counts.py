"""Source divergence against its SQL, token counts against the library."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import source_divergence as sd
from strata.llm import token_counts as tc
from strata.session import ship_package

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()

DOCS = [
    (1, "The cat, the dog; ÉCLAIR éclair 12", "en", "a"), (2, "the cat THE", "en", "b"), (3, "the cat dog's", "en", "c"), (3, "the cat dog's", "en", "c"),
    (None, "cat the Zebra", "en", None), (5, None, "en", "d"), (6, "", None, None), (7, "  \x7f\x00@[`{ ", "fr", "a"), (8, "seul", "fr", "b"),
    (9, "漢字 漢字 é", "zh", "a"), (10, "漢字 é", "zh", "b"), (11, "漢字 Éé é", "zh", "b"), (12, "x " * 50_000 + "the cat", "en", "a"),
    (13, "the cat", "en", "b"), (14, "alone here", "de", "only"), (15, "nul nul nul", "", ""), (16, "nul NUL", "", "z"), (17, "nul", "", ""),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_sql(df):
    given = df.toPandas()
    con = duckdb.connect()
    con.register("given", given)
    con.execute("CREATE TABLE documents AS SELECT text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM given")
    return sorted(con.execute(sd.ORACLE_SQL).fetchall(), key=str)


def test_divergence_equals_its_sql_however_it_spills(spark):
    ship_package(spark)
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    want = by_sql(df)
    assert rows_of(sd.source_divergence(df)) == want
    assert rows_of(sd.source_divergence(df, cells=5, block=2)) == want
    more = df.select("*", *[F.lit("x").alias(c) for c in ("term", "df", "sources", "counts", "part", "item", "value", "rank", "totals")])
    assert rows_of(sd.source_divergence(more)) == want
    assert {r[0] for r in want} >= {"", "fr", "zh", "en"}


def test_divergence_of_an_empty_table(spark):
    ship_package(spark)
    assert sd.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_top_terms_break_ties_in_utf8_order(spark):
    ship_package(spark)
    words = ["é", "z", "a", "漢", "m"]
    docs = [(i, " ".join(words), "en", "a") for i in range(3)] + [(i, "q", "en", "b") for i in range(3, 6)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = [r.item for r in sd.source_divergence(df, top=3).where("part = 'term' AND source = 'a'").orderBy("rank").collect()]
    assert got == sorted(words, key=str.encode)[:3]


def test_shares_are_exact():
    rnd = random.Random(2)
    for _ in range(2000):
        total = rnd.randint(1, 9 * 10**13)
        n = rnd.randint(0, total - 1)
        assert int(sd.shares(np.array([n]), np.array([total]))[0]) == 1 + sd.SCALE * (n + 1) // total


def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def test_counts_of_any_text_equal_the_library():
    lib, own, rnd = library(), tc.TokenCounter(SPEC, tc.FrequentTable.of({"the": 1, "cat": 1, "'s": 1})), random.Random(4)
    alphabet = "abAB'sStTreREllé́̂ÉñŒßſİıΣσς 1²½,.!?\n\t\x1c\x85\xa0 Kﬁ漢😀"
    for _ in range(4000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        if rnd.random() < 0.2:
            text += rnd.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|"]) + rnd.choice(["x", " 's", ""])
        assert own.count(text) == lib(text), repr(text)


def test_every_letter_that_is_split_here(spark):
    lib, own = library(), tc.TokenCounter(SPEC)
    for cp in [*range(0x250), *range(0x2000, 0x2100), 0x1E9E, 0xFB01, 0x10FFFF]:
        text = f"ab{chr(cp)}c {chr(cp)}d's{chr(cp)}"
        assert own.count(text) == lib(text), hex(cp)


def test_token_count_rows(spark):
    ship_package(spark)
    long = "word Wörter, 12 it's " * 40_000
    docs = [(1, "Hello, world"), (1, "Hello, world"), (None, "x"), (2, None), (3, ""), (4, long), (5, "a" * 200_000), (6, "one <|endoftext|> two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("id"), F.lit(2).alias("n_tokens"), F.lit(3).alias("n_bytes"))
    lib = library()
    want = sorted(((i, len((t or "").encode()), lib(t or ""), lib(t or "") > 2048) for i, t in docs), key=str)
    assert rows_of(tc.token_counts(df, PATH)) == want
    assert rows_of(tc.token_counts(df, PATH, entries=1)) == want
    assert tc.token_counts(df.limit(0), PATH).count() == 0
    few = {r.doc_id: r.over_limit for r in tc.token_counts(df.where("doc_id > 1"), PATH, limit=3).collect()}
    assert few == {2: False, 3: False, 4: True, 5: True, 6: False}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.TokenCounter(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
