"""Conversation repair against exhaustive search and against its SQL, with edge rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strata.llm import conversation_repair as cr
from strata.llm.conversation_repair import Costs, Repair
from strata.session import ship_package


def exhaustive(rows, costs):
    """Least (cost, letters) over all edit strings with up to two inserts in a row."""

    def with_inserts(paths):
        out, front = dict(paths), paths
        for _ in range(2):
            step = {}
            for (s, a), k in front.items():
                key = (cr._DUE[s], a + "I")
                if k + costs.insert < out.get(key, 1 << 30):
                    out[key] = step[key] = k + costs.insert
            front = step
        return out

    paths = {(0, ""): 0}
    for initial, must, truncated in rows:
        step = {}
        for (s, a), k in with_inserts(paths).items():
            extra = costs.truncated if truncated else 0
            ways = [(s, "D", costs.delete)]
            if not must:
                ways.append((cr._DUE[s], "R", costs.rerole + extra))
                if s in cr._TO.get(initial, {}):
                    ways.append((cr._TO[initial][s], "K", costs.keep + extra))
            for to, letter, cost in ways:
                step[to, a + letter] = min(k + cost, step.get((to, a + letter), 1 << 30))
        paths = step
    return min((k, a) for (s, a), k in with_inserts(paths).items() if s in cr.FINAL)


@pytest.mark.parametrize("costs", [Costs(), Costs(0, 1, 5, 1, 2), Costs(0, 1, 1, 1, 1), Costs(0, 2, 4, 2, 0)])
def test_search_equals_exhaustive_search(costs):
    rnd = random.Random(3)
    for _ in range(250):
        rows = [(rnd.choice(["s", "u", "a", "u", "x", ""]), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 5))]
        search, told = Repair(costs), []
        for r in rows:
            told += search.step(*r, r)
        cost, rest = search.finish()
        assert (cost, "".join(letter for letter, _, _ in told + rest)) == exhaustive(rows, costs), rows


def test_open_rows_stay_few():
    rnd, search, told, most = random.Random(1), Repair(), 0, 0
    for i in range(20000):
        told += len(search.step(rnd.choice("ua"), rnd.random() < 0.1, rnd.random() < 0.2, i))
        most = max(most, i + 1 - told)
    assert most < 200
    assert told + len(search.finish()[1]) == 20000


ROWS = [
    (1, 0, "user", "Hi there."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 4, "user", "cut of"), (1, 9, "assistant", "Fine."),
    (2, None, None, None), (2, None, "user", "a"), (2, 3, "user", "A."), (2, 4, "tool", "B."), (2, 5, "", "é?"),
    (None, 1, "user", "Q?"), (None, 2, "assistant", "R.\n"), (None, None, "system", "S."), (3, 7, "system", " \t"),
    (4, 0, "user", "x" * 300_000 + "."), (4, 1, "assistant", "Done!"), (5, -3, "User", "T."), (5, 1 << 40, "assistant", "T."),
] + [(6, t, "user" if t % 2 else "assistant", "Same.") for t in range(300)] + [(7, t, "user", f"{t}?") for t in range(60)]
SCHEMA = "conv_id long, turn long, role string, text string"


def both(df):
    conversations = df.toPandas()  # noqa: F841 - read by DuckDB
    con = duckdb.connect()
    con.register("given", conversations)
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM given")
    want = sorted(con.execute(cr.oracle_sql()).fetchall(), key=str)
    got = sorted((tuple(r) for r in cr.conversation_repair(df).collect()), key=str)
    return got, want


def test_query_equals_its_sql(spark):
    ship_package(spark)
    for shift in (0, 100):  # other ids are damaged in other ways
        rows = [(None if c is None else c + shift, *rest) for c, *rest in ROWS]
        got, want = both(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert got == want
        assert len(got) == len({r[0] for r in rows})


def test_empty_table_and_clashing_columns(spark):
    ship_package(spark)
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert cr.conversation_repair(df.limit(0)).count() == 0
    more = df.select("*", *[F.lit(1).alias(c) for c in ("conv", "alive", "kind", "copy", "digest", "later", "seq")])
    assert sorted(map(str, cr.conversation_repair(more).collect())) == sorted(map(str, cr.conversation_repair(df).collect()))


def test_edits_give_legal_roles_and_whole_texts(spark):
    ship_package(spark)
    rows = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")], "conv long, turn long, role string, text string")
    edits = cr.repair_conversations(rows).orderBy("seq").collect()
    assert [(e.edit, e.role) for e in edits] == [("R", "user"), ("K", "assistant"), ("K", "user"), ("K", "assistant")]
    strict = cr.repair_conversations(rows, Costs(rerole=3)).orderBy("seq").collect()
    assert [(e.edit, e.role) for e in strict] == [("K", "system"), ("D", None), ("K", "user"), ("K", "assistant")]
    dear = cr.repair_conversations(rows, Costs(delete=9, insert=1)).orderBy("seq").collect()
    assert [(e.edit, e.role) for e in dear] == [("K", "system"), ("I", "user"), ("K", "assistant"), ("K", "user"), ("K", "assistant")]
