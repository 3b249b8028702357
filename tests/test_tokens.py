from pyspark.sql import functions as F

from strata.functions import tokens as tk


def test_truncate_mask_strip(spark):
    df = spark.createDataFrame([([5, 6, 2, 0, 0],), ([5, 6],)], "ids array<int>")
    r = df.select(
        tk.truncate_at_eos("ids", [2]).alias("t"), tk.first_eos("ids", [2]).alias("p"),
        tk.completion_mask("ids", [2]).alias("m"), tk.has_eos("ids", [2]).alias("h"),
    ).collect()
    assert r[0].t == [5, 6, 2] and r[0].p == 3 and r[0].m == [1, 1, 1, 0, 0] and r[0].h
    assert r[1].t == [5, 6] and r[1].p == 0 and r[1].m == [1, 1] and not r[1].h
    pad = spark.createDataFrame([([0, 0, 7, 8], [0, 0, 1, 1])], "ids array<int>, mask array<int>")
    assert pad.select(tk.strip_padding("ids", "mask")).first()[0] == [7, 8]


def test_pad_prefix_special(spark):
    df = spark.createDataFrame([([3, 4],)], "ids array<int>")
    r = df.select(
        tk.left_pad("ids", F.lit(4), 0).alias("p"), tk.left_pad_mask("ids", F.lit(4)).alias("m"),
        tk.drop_prefix("ids", 1).alias("d"), tk.cap_length("ids", 1).alias("c"),
        tk.strip_special("ids", [3]).alias("s"), tk.positional_checksum("ids").alias("k"),
    ).first()
    assert r.p == [0, 0, 3, 4] and r.m == [0, 0, 1, 1] and r.d == [4] and r.c == [3] and r.s == [4] and r.k == 3 + 8


def test_right_padding_and_pad_fallback(spark):
    from strata.operators.batching import pad_batches

    df = spark.createDataFrame([(0, [3, 4]), (0, [5])], "b long, ids array<int>")
    r = pad_batches(df, "ids", ["b"], pad=None, side="right", eos=2).orderBy(F.size("ids")).collect()
    assert r[0].padded == [5, 2] and r[0].mask == [1, 0] and r[1].padded == [3, 4]
