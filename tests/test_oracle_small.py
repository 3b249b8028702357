"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from strata.sources.tables import TABLES

from .conftest import SMALL

FAST = [
    "eval_summary", "ab_delta", "metric_log", "summary_text", "paired_outcome", "alignment_check",
    "score_ladder", "chat_as_text", "ordinal_slice", "split_leakage", "eos_truncate", "pad_strip",
    "batch_token_count", "throughput", "top_p_dist", "cdf_dist", "systematic_sample",
    "inverse_cdf_join", "sampler_variance", "decode_lattice", "decode_eval",
    "decode_shaped", "custom_scorer", "report_json", "inferred_columns", "decode_iid", "sampler_diversity",
    "failing_scorer", "generate_batch", "positional_slice",
    "ngram_table", "decode_ngram", "mixed_cells", "unique_sketch", "metric_log_rerun",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL, t + '.parquet')}')")
    return c


def _norm(rows):
    def f(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(f(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert _norm(got) == _norm(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 2 and "pass_at_1" in df.columns


def test_every_query_has_a_name_in_both_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {name for name in set(q) - set(o) if name != "pipeline" and not name.startswith("op")} == set()
