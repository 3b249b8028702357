"""Deduplication and mixing against brute force, with ties, nulls, collisions and hot groups."""

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import embedding_dedup, exact_dedup, mixing, simhash
from strata.llm.common import read_table
from strata.llm.components import connected_components
from strata.session import ship_package
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string"
ROWS = [(5, "a b"), (2, "ab"), (7, "a  b"), (1, "ab c"), (9, None), (8, ""), (3, " \t"), (None, "ab"), (None, "only"), (2, "ab"), (4, "é")]


def brute_exact(rows):
    strip = str.maketrans("", "", " \t\n\r\x0b\x0c")
    norm = [(t or "").translate(strip) for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        same = [r for r, m in zip(rows, norm, strict=True) if m == n]
        ids = [(-len(t or ""), k) for k, t in same if k is not None]
        keep = min(ids)[1] if ids else None
        out.append((i, keep, len(same), i == keep))
    return sorted(out, key=str)


def test_exact_dedup_with_any_hash(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("kept", F.lit(3)).withColumn("h", F.lit(1)).withColumn("norm", F.lit(1))
    weak = [F.md5, lambda c: F.lit("same"), lambda c: F.md5((F.length(c) % 2).cast("string"))]
    for fn in weak:
        got = exact_dedup.exact_dedup(df, hash_fn=fn).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute_exact(ROWS)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    perm = rng.permutation(400).tolist()
    edges = [(perm[i], perm[i + 1]) for i in range(99)] + [(perm[150], perm[k]) for k in range(151, 300)] + [(perm[310], perm[310]), (perm[311], perm[312])] * 2
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for part in (perm[:100], perm[150:300], perm[310:311], perm[311:313]):
        assert {got[x] for x in part} == {min(part)}


def plain_fingerprint(text):
    w = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    w = [x for x in w if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near(fps, bits):
    up = list(range(len(fps)))
    root = lambda a: a if up[a] == a else root(up[a])
    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits)[0]:
            up[root(i)] = root(int(i + 1 + j))
    return [root(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    ship_package(spark)
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "One Two"), (-4, "one  two"), (None, "one two"), (-5, "w " * 90_000)], SCHEMA)
    df = docs.union(more).withColumn("fp", F.lit(1)).withColumn("root", F.lit("x"))
    rows = simhash.simhash_near_dedup(df).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(rows) == df.count() and all(r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}" for r in rows)
    root = near(np.array([int(r.fingerprint, 16) for r in rows], dtype=np.uint64), 2)
    for r, x in zip(rows, root, strict=True):
        assert r.component_id == min(q.doc_id for q, y in zip(rows, root, strict=True) if x == y and q.doc_id is not None)
    assert simhash.simhash_near_dedup(df.limit(0)).count() == 0


def test_simhash_links_of_families(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 5, 400)]
    fps = np.unique(np.array([int(centre[i % 3]) ^ f for i, f in enumerate(flips)], dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.astype(np.int64)], "fp long")
    for bits in (0, 1, 2, 3):
        want = near(fps, bits)
        found = simhash.links(df, bits).distinct().cache()
        apart = [(x, y) for x in fps for y in fps if x < y and int(x ^ y).bit_count() <= bits]
        assert found.count() == len(apart)
        node = {r.node: r.root for r in connected_components(found).collect()}
        got = [node.get(int(x), int(x)) for x in fps.astype(np.int64)]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_simhash_cells_are_pivot_distances(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 50)] + [0, -1, 1 << 62, -(1 << 63)]
    ref = simhash._pivots(1)[0]
    rows = spark.createDataFrame([(x,) for x in fps], "fp long").select("fp", simhash.pivot_cell(F.col("fp")), simhash._cells(F.col("fp"), 2)).collect()

    def distance(x, y):
        return ((x ^ y) & (1 << 64) - 1).bit_count()

    for fp, cell, cells in rows:
        at = [cell >> 2 * i & 3 for i in range(32)]
        assert at == [(distance(fp, ref) - distance(fp, ref ^ 3 << 2 * i)) // 2 + 1 for i in range(32)]
        steps = [[at[j] + (j == i) * up for j in range(32)] for i in range(32) for up in (-1, 1) if 0 <= at[i] + up <= 2]
        assert sorted([c >> 2 * i & 3 for i in range(32)] for c in cells) == sorted([at, *steps])


def test_embedding_links(spark):
    ship_package(spark)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 20))
    vec = [(b + rng.normal(scale=0.03, size=20)).tolist() for b in base for _ in range(25)] + [base[0].tolist()] * 40
    rows = [(i, v, i % 2) for i, v in enumerate(vec)]
    rows += [(1000, None, 0), (1001, [0.0] * 20, 0), (1002, [float("nan")] * 20, 0), (1003, [None] * 20, 0), (1004, vec[0], None)]
    rows += [(None, vec[0], 0), (1005, [], 0), (1006, [float("inf")] * 20, 0), (1007, vec[0][:19], 0), (1008, [2 * x for x in vec[0]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).withColumn("rep", F.lit(1))
    for block in (7, 512):
        got = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(df, block=block).collect()}
        assert len(got) == len(rows)
        ok = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and (i < 1000 or i == 1008)]
        links = {i: {j for j, w, m in ok if j != i and m == lab and v @ w >= 0.98} for i, v, lab in ok}
        for i in links:
            seen, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen))
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (None, *range(1000, 1008)))
    assert embedding_dedup.embedding_near_dedup(df.limit(0)).count() == 0


def test_mixing_margins_and_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), "hot" if i % 3 else f"s{i % 5}", ["en", "de", None][i % 3], i % 2) for i in range(900)]
    rows += [(None, None, None, None, 0), (1, "", "hot", "en", 0), (1, "", "hot", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    mixed = mixing.mix_to_targets(df).cache()
    out = mixed.collect()
    assert len(out) == len(rows)
    total = sum(r.tokens for r in out)
    assert abs(sum(r.tokens * r.probability for r in out) / total - mixing.FRACTION) < 0.01
    assert abs(sum(r.tokens for r in out if r.selected) / total - mixing.FRACTION) < 0.06
    cells = spark.createDataFrame([(a, x, t, n) for (a, x, t), n in zip([(a, x, t) for a in "ab" for x in "xy" for t in "12"], [90, 5, 7, 12, 5, 20, 9, 4], strict=True)], "source string, lang string, topic string, tokens long")
    goal = {"source": [("a", 0.5), ("b", 0.5)], "lang": [("x", 0.6), ("y", 0.4)], "topic": [("1", 0.7), ("2", 0.3)]}
    fitted = mixing.rake(cells, {d: spark.createDataFrame(g, "value string, share double") for d, g in goal.items()}, 3).collect()
    for d, g in goal.items():
        for value, share in g:
            assert abs(sum(r.weight for r in fitted if r[d] == value) / 152 - share) < 1e-2
    assert mixing.mix_to_targets(df.limit(0)).count() == 0


def test_raking_of_sparse_cells_and_of_targets_out_of_reach(spark):
    sparse = [("a", "x", "1", 90), ("a", "y", "1", 5), ("b", "x", "1", 5), ("b", "y", "2", 20)]
    cells = spark.createDataFrame(sparse, "source string, lang string, topic string, tokens long")
    goal = {"source": [("a", 0.5), ("b", 0.5)], "lang": [("x", 0.6), ("y", 0.4)], "topic": [("1", 0.7), ("2", 0.3)]}
    targets = {d: spark.createDataFrame(g, "value string, share double") for d, g in goal.items()}

    def margins(budget):
        fitted = mixing.rake(cells, targets, budget=budget).collect()
        assert budget is None or all(r.weight <= r.tokens for r in fitted)
        return max(abs(sum(r.weight for r in fitted if r[d] == v) / (budget or 120) - share) for d, g in goal.items() for v, share in g)

    assert margins(None) <= mixing.TOLERANCE  # uncapped, production sweeps
    assert margins(22.5) <= mixing.TOLERANCE  # capped: cell b-x holds 5 tokens and is due 4.5
    cut = {r.value: r.share for r in mixing.reachable_targets(cells, targets, 0.8)["source"].collect()}
    assert abs(cut["b"] - 0.9 * 25 / 96) < 1e-12 and abs(cut["a"] + cut["b"] - 1) < 1e-12
    rng = np.random.default_rng(6)
    many = [(i, "w " * int(rng.integers(1, 60)), f"s{rng.integers(6) if i % 2 else 0}", ["en", "en", "de", "es"][int(rng.integers(4))]) for i in range(1500)]
    mixed = mixing.mix_to_targets(spark.createDataFrame(many, "doc_id long, text string, source string, lang string")).cache()
    for r in mixing.margin_report(mixed).collect():
        assert abs(r.expected - r.reachable) < 2 * mixing.TOLERANCE and abs(r.drawn - r.reachable) < 0.05, r
    targets["topic"] = spark.createDataFrame([("1", 0.1), ("2", 0.9)], "value string, share double")
    with pytest.warns(UserWarning, match="off by"):
        mixing.rake(cells, targets, sweeps=5, budget=20.0)


def test_pipeline_keeps_one_row_of_a_group_whatever_the_ids(spark):
    ship_package(spark)
    rows = [(1, "same text"), (1, "same text"), (2, "alpha beta"), (2, "same text"), (None, "gamma"), (None, "same  text"), (None, "gamma"), (7, None), (8, ""), (7, "")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit("s")).withColumn("lang", F.lit("en")).repartition(parts)
        exact = corpus_pipeline.exact_dedup_stage(spark, df, SMALL)
        assert exact.columns == df.columns
        got = sorted(((r.doc_id, r.text) for r in exact.collect()), key=str)
        assert [x for x in got if x[1]] == [(2, "alpha beta"), (None, "gamma"), (None, "same  text")] and len(got) == 4  # one more: empty
        assert [x[0] for x in got if not x[1]] == [7]
        near_ones = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (5, "quite another text here"), (None, "z y x"), (3, "z y x")]
        df2 = spark.createDataFrame(near_ones, SCHEMA).withColumn("source", F.lit("s")).withColumn("lang", F.lit("en")).repartition(parts)
        stay = corpus_pipeline.simhash_stage(spark, df2, SMALL)
        assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=str) == [(3, "z y x"), (5, "a b c d e f g"), (5, "quite another text here")]
        many = spark.createDataFrame([(None, f"text {i}") for i in range(400)], SCHEMA).withColumn("source", F.lit("s")).withColumn("lang", F.lit("en")).repartition(parts)
        assert 0.6 < corpus_pipeline.mixing_stage(spark, many, SMALL).count() / 400 < 0.95  # nulls are drawn one by one


def test_pipeline_rows_equal_its_operators_one_by_one(spark):
    ship_package(spark)
    docs = read_table(spark, SMALL, "documents").withColumn("kept", F.lit("x")).cache()
    n = docs.count()
    tox = corpus_pipeline.toxicity_stage(spark, docs, SMALL)
    assert tox.columns == docs.columns
    kept = {r.doc_id: r.text for r in tox.collect()}
    one = spark.createDataFrame(list(kept.items()), SCHEMA)
    exact = {i for i, k, _, same in brute_exact(list(kept.items())) if same}
    stage = corpus_pipeline.exact_dedup_stage(spark, tox, SMALL)
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == exact
    ids = sorted(exact)
    root = near(np.array([plain_fingerprint(kept[i]) for i in ids], dtype=np.uint64), 2)
    first = {x: min(i for i, y in zip(ids, root, strict=True) if x == y) for x in root}
    stage = corpus_pipeline.simhash_stage(spark, stage, SMALL)
    assert {r.doc_id for r in stage.collect()} == set(first.values())
    drawn = {r.doc_id for r in corpus_pipeline.mixing_stage(spark, stage, SMALL).collect()}
    got = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == drawn <= set(first.values()) and n * 0.5 < len(got) <= one.count()
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SMALL).count() == 0, name


def test_oracles_run_and_match(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    docs = read_table(spark, SMALL, "documents")
    for df, sql in ((exact_dedup.exact_dedup(docs), exact_dedup.ORACLE_SQL), (mixing.mix_to_targets(docs), mixing.oracle_sql())):
        want = sorted(map(str, c.sql(sql).df()[df.columns].itertuples(index=False, name=None)))
        assert sorted(map(str, df.toPandas().itertuples(index=False, name=None))) == want
