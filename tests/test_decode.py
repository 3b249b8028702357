from pyspark.sql import functions as F

from strata.operators import decode as dec
from strata.operators import lookup
from strata.operators.scan import inverse_cdf


def _brute(docs, prompts, G, steps, method, seed):
    """Python re-statement of the decode rules over the same keyed uniforms."""
    import hashlib

    def ku(*parts):
        h = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()
        return int(h[:13], 16) / 2**52

    counts = {}
    for text in docs:
        w = text.lower().split()
        for i, x in enumerate(w):
            nxt = w[i + 1] if i + 1 < len(w) else dec.END_TOKEN
            counts.setdefault(x, {}).setdefault(nxt, 0)
            counts[x][nxt] += 1
    table = {}
    for ctx, m in counts.items():
        tot, acc, rows = sum(m.values()), 0, []
        for t in sorted(m, key=lambda s: s.encode()):
            rows.append((t, acc / tot, (acc + m[t]) / tot))
            acc += m[t]
        table[ctx] = rows
    out = {}
    for gid, first in prompts:
        u = ku(seed, gid)
        for g in range(G):
            c, cur, seq = (g + u) / G, first, []
            for step in range(steps):
                if method == "iid":
                    c = ku(seed, gid, g, step)
                t, lo, hi = next(r for r in table[cur] if (c > r[1] or r[1] == 0) and c <= r[2])
                c = min(max((c - lo) / max(hi - lo, 1e-10), 0.0), 1.0)
                seq.append(t)
                cur = t
                if t == dec.END_TOKEN:
                    break
            out[(gid, g)] = seq
    return out


def test_decode_matches_brute_force(spark, monkeypatch):
    docs = ["the cat sat on the mat", "the dog sat", "a cat and the dog", "the the the cat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    prompts = dec.document_prompts(df)
    table = dec.bigram_table(df)
    for method in ("lattice", "iid"):
        want = _brute(docs, [(r.group_id, r.context) for r in prompts.collect()], 4, 5, method, 11)
        for per_cell in (1, 32):  # rows per cell of the interval table
            monkeypatch.setattr(lookup, "ROWS_PER_CELL", per_cell)
            got = dec.decode(prompts, table, num_samples=4, max_steps=5, method=method, seed=11, checkpoint_every=2, local_rows=0)
            assert {(r.group_id, r.g): list(r.out) for r in got.collect()} == want
        got = dec.decode(prompts, table, num_samples=4, max_steps=5, method=method, seed=11)  # broadcast table
        assert {(r.group_id, r.g): list(r.out) for r in got.collect()} == want


def test_both_ways_to_decode_agree(spark):
    """Prompts with bounds of their own, a null and an unknown context, a string key, both arms."""
    docs = ["the cat sat on the mat", "the dog sat", "a cat and the dog", "the the the cat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    prompts = spark.createDataFrame(
        [("p", "the", 6), ("q", "the", 1), ("r", "cat", 0), ("s", "zzz", 4), ("t", None, 4), ("u", "sat", None)],
        "group_id string, context string, max_tokens int",
    )
    table = dec.bigram_table(df)
    rows = [
        sorted(dec.decode_arms(prompts, table, num_samples=3, max_steps=9, seed=5, checkpoint_every=3, local_rows=n).collect(), key=str)
        for n in (0, 100)
    ]
    assert rows[0] == rows[1] and len(rows[0]) == 36
    ends = {(r.group_id, r.finished) for r in rows[0] if r.group_id in "rst"}
    assert ends == {("r", False), ("s", True), ("t", True)}
    assert max(r.steps for r in rows[0] if r.group_id == "q") == 1
    none = dec.decode_arms(prompts, table.limit(0), num_samples=1, max_steps=3)
    assert {(r.finished, r.steps) for r in none.where("group_id <> 'r'").collect()} == {(True, 0)}


def test_bigram_counts(spark):
    df = spark.createDataFrame([(0, "A b  a"), (1, "")], "doc_id long, text string")
    got = {(r.context, r.token): r.cnt for r in dec.bigram_counts(df).collect()}
    assert got == {("a", "b"): 1, ("b", "a"): 1, ("a", dec.END_TOKEN): 1}


def test_zero_steps_and_diversity(spark):
    df = spark.createDataFrame([(0, "x y")], "doc_id long, text string")
    out = dec.decode(dec.document_prompts(df), dec.bigram_table(df), num_samples=2, max_steps=0)
    assert [r.steps for r in out.collect()] == [0, 0]
    d = dec.diversity(out.withColumn("arm", F.lit("a")), 2).first()
    assert d.avg_unique_completions == 1.0 and d.duplicate_rate == 0.5


def test_context_missing_from_table_ends_sequence(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "zzz")], "doc_id long, text string")
    table = dec.bigram_table(df.filter("doc_id = 0"))  # no row for context 'zzz'
    out = dec.decode(dec.document_prompts(df), table, num_samples=2, max_steps=3)
    got = {(r.group_id, r.g): (list(r.out), r.finished) for r in out.collect()}
    assert got[(1, 0)] == ([], True) and got[(1, 1)] == ([], True)
    assert got[(0, 0)][0] == [dec.END_TOKEN]  # prompted by the last word, "b"


def test_lattice_decode_has_no_step_limit(spark):
    # one successor per context: the only path is the ring a -> b -> a, for as many steps as asked
    ring = spark.createDataFrame([("a", "b", 0.0, 1.0), ("b", "a", 0.0, 1.0)], "context string, token string, lo double, hi double")
    prompts = spark.createDataFrame([(0, "a")], "group_id long, context string")
    for rows in (0, 10):  # joined and broadcast
        out = dec.decode(prompts, ring, num_samples=1, max_steps=66, local_rows=rows, checkpoint_every=6).collect()
        assert [list(r.out) for r in out] == [["b", "a"] * 33] and not out[0].finished


def test_interval_lookup_ties_and_edges(spark):
    rows = [("x", "a", 0.0, 0.5), ("x", "b", 0.5, 0.5), ("x", "c", 0.5, 1.0)]
    pts = spark.createDataFrame([("x", i, c) for i, c in enumerate([0.0, 0.3, 0.5, 0.75, 1.0])] + [("y", 9, 0.5)], "context string, i int, c double")
    for order in (rows, rows[::-1]):
        t = spark.createDataFrame(order, "context string, token string, lo double, hi double")
        got = {r.i: r.token for r in lookup.lookup_intervals(pts, lookup.interval_table(t)).collect()}
        assert got == {0: "a", 1: "a", 2: "a", 3: "c", 4: "c", 9: None}
        for slices in (1, 3):
            scan = {r.i: r.token for r in inverse_cdf(pts.where("context = 'x'"), t, ["context"], slices=slices).collect()}
            assert scan == {0: "a", 1: "a", 2: "a", 3: "c", 4: "c"}


def test_tail_is_the_whole_rest(spark):
    df = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(25))), (1, "One"), (2, " "), (3, None)], "doc_id long, text string")
    got = {r.group_id: (r.head, r.tail) for r in dec.split_documents(df).collect()}
    assert got == {0: ([f"w{i}" for i in range(23)], ["w23", "w24"]), 1: (["one"], [])}


# As many steps as the reference allows a completion, several times the bits of a double.
LONG_STEPS = dec.MAX_NEW_TOKENS


def test_long_lattice_decode_against_sql(spark):
    """LONG_STEPS steps over a cycle that never ends, held against a recursive SQL query."""
    import duckdb

    rows = [("a", "a", 3), ("a", "b", 2), ("b", "a", 1), ("b", "b", 4)]
    counts = spark.createDataFrame(rows, "context string, token string, cnt long")
    prompts = spark.createDataFrame([(0, "a"), (1, "b")], "group_id long, context string")
    table = dec.cdf(counts, ["context"], weight="cnt")
    got = dec.decode(prompts, table, num_samples=2, max_steps=LONG_STEPS, seed=3)
    con = duckdb.connect()
    start = dec.lattice_points(prompts, "group_id", 2, 3).toPandas()  # noqa: F841 - read by DuckDB
    dist = table.toPandas()  # noqa: F841
    want = con.execute(
        f"""WITH RECURSIVE s AS (
             SELECT group_id, g, c, context AS cur, []::VARCHAR[] AS out FROM start
             UNION ALL
             SELECT s.group_id, s.g, least(greatest((s.c - d.lo) / greatest(d.hi - d.lo, 1e-10), 0::DOUBLE), 1::DOUBLE),
                    d.token, list_append(s.out, d.token)
             FROM s JOIN dist d ON d.context = s.cur AND (s.c > d.lo OR (s.c <= 0 AND d.lo = 0)) AND s.c <= d.hi
             WHERE len(s.out) < {LONG_STEPS})
           SELECT group_id, g, out FROM s WHERE len(out) = {LONG_STEPS}"""
    ).fetchall()
    assert {(r.group_id, r.g): r.out for r in got.collect()} == {(a, b): c for a, b, c in want}


def test_generate_batch(spark):
    def twice(pdf):
        return pdf.loc[pdf.index.repeat(2)].assign(completion=pdf["prompt"].str.upper())

    df = spark.createDataFrame([(0, "a"), (1, "b")], "prompt_id long, prompt string")
    out = dec.generate_batch(df, twice, "prompt_id long, prompt string, completion string")
    assert sorted((r.prompt_id, r.completion) for r in out.collect()) == [(0, "A"), (0, "A"), (1, "B"), (1, "B")]
