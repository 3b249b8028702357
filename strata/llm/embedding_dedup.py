"""Embedding near-deduplication by cross-polytope hashing.

1. Equal vectors of a label are one class with a count (partial aggregation: a vector that a third of
   all rows share becomes one row per task).
2. A vector is rotated ``TABLES * ROTATIONS`` times by H D H D H D (random signs D, fast Hadamard
   transform H, padded to a power of two); the hash of a rotation is the signed axis of the largest
   coordinate. A table's key joins its rotations' axes. Multiprobe: besides the best axes, each
   rotation in turn takes its second axis, so a table puts a vector into 1 + ROTATIONS buckets.
3. Buckets with one vector are left out. A larger bucket is cut into hashed blocks of about
   ``BLOCK`` vectors and every pair of blocks is one unit of work, so no task holds a whole bucket.
   A unit multiplies its two blocks in numpy (double precision) and verifies every pair's cosine.
4. Pairs are never written out. A unit returns, per vector, the weight of its verified partners for
   which this bucket is the smallest one they share (so each link counts once), and a spanning
   forest of its links, which keeps the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage
from strata.llm.components import connected_components

COSINE, TABLES, ROTATIONS, BLOCK, SEED = 0.98, 8, 2, 512, 23


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def bucket_keys(unit: np.ndarray, tables: int, rotations: int, seed: int) -> np.ndarray:
    """(rows, tables * (1 + rotations)) bucket numbers; the table is part of the number. Rows are
    unit vectors of one length, which also picks the random signs."""
    n, d = unit.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, wide))
    x[:, :d] = unit
    rng = np.random.default_rng([seed, d])
    out = []
    for t in range(tables):
        first, second = [], []
        for _ in range(rotations):
            r = x
            for _ in range(3):
                r = _hadamard(r * rng.choice([-1.0, 1.0], size=wide))
            order = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :2]
            sign = (np.take_along_axis(r, order, axis=1) < 0).astype(np.int64)
            axes = 2 * order.astype(np.int64) + sign
            first.append(axes[:, 0])
            second.append(axes[:, 1])
        for probe in range(-1, rotations):
            key = np.full(n, t, dtype=np.int64)
            for k in range(rotations):
                key = key * (2 * wide) + (second[k] if k == probe else first[k])
            out.append(key)
    return np.stack(out, axis=1)


def _matrix(col: pa.ListArray) -> list[np.ndarray]:
    values, at = col.values.to_numpy(zero_copy_only=False).astype(np.float64), col.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


def _hashed(tables: int, rotations: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b.column(2))
            by_dim: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                by_dim.setdefault(len(r), []).append(i)
            for dim, at in by_dim.items():
                x = np.stack([rows[i] for i in at])
                keys = bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, rotations, seed)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(take),
                        b.column(1).take(take),
                        b.column(2).take(take),
                        b.column(3).take(take),
                        pa.array([dim] * len(at), pa.int32()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    ["rep", "label", "vector", "n", "dim", "keys"],
                )

    return run


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links u[i] - v[i]."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _unit(key: int, i: int, j: int, rep, block, n, sig, vec, least: float) -> tuple[list, list, list]:
    """(u, v, n) rows of one unit: (vector, null, weight of partners) and (vector, vector, 0)."""
    left = np.nonzero(block == i)[0]
    right = left if i == j else np.nonzero(block == j)[0]
    if not len(left) or not len(right):
        return [], [], []
    a, b = vec[left], vec[right]
    cos = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    near = cos >= least
    if i == j:
        near &= np.tri(len(left), k=-1, dtype=bool).T
    p, q = np.nonzero(near)
    if not len(p):
        return [], [], []
    p, q = left[p], right[q]
    count = np.zeros(len(rep), dtype=np.int64)
    for k in range(0, len(p), 20_000):
        x, y = p[k : k + 20_000], q[k : k + 20_000]
        both = sig[x][:, :, None] == sig[y][:, None, :]
        lowest = np.where(both.any(axis=2), sig[x], np.iinfo(np.int64).max).min(axis=1)
        own = lowest == key
        np.add.at(count, x[own], n[y[own]])
        np.add.at(count, y[own], n[x[own]])
    at = np.nonzero(count)[0]
    edges = _forest(rep[p], rep[q])
    return (
        rep[at].tolist() + [e[0] for e in edges],
        [None] * len(at) + [e[1] for e in edges],
        count[at].tolist() + [0] * len(edges),
    )


def _verified(least: float):
    """Streams rows sorted by unit; a unit may span Arrow batches and is held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            cols = {c: t.column(c).to_numpy() for c in ("label", "dim", "key", "i", "j", "block", "rep", "n")}
            unit = np.stack([cols[c] for c in ("label", "dim", "key", "i", "j")], axis=1).astype(np.int64)
            cut = np.nonzero((unit[1:] != unit[:-1]).any(axis=1))[0] + 1
            sig, vec = _matrix_of(t, "keys").astype(np.int64), _matrix(t.column("vector").chunk(0))
            u, v, n = [], [], []
            for a, b in zip([0, *cut], [*cut, len(unit)], strict=True):
                if b - a > 1:
                    got = _unit(
                        int(cols["key"][a]), int(cols["i"][a]), int(cols["j"][a]), cols["rep"][a:b], cols["block"][a:b],
                        cols["n"][a:b], sig[a:b], np.stack(vec[a:b]), least,
                    )
                    u += got[0]
                    v += got[1]
                    n += got[2]
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

        def last_start(b: pa.RecordBatch) -> int:
            at = b.num_rows - 1
            end = [b.column(c)[at].as_py() for c in ("label", "dim", "key", "i", "j")]
            same = np.ones(b.num_rows, dtype=bool)
            for c, x in zip(("label", "dim", "key", "i", "j"), end, strict=True):
                same &= b.column(c).to_numpy() == x
            first = int(np.nonzero(same)[0][0])
            return first

        for b in batches:
            if not b.num_rows:
                continue
            first = last_start(b)
            if first == 0 and held and all(held[-1].column(c)[-1].as_py() == b.column(c)[0].as_py() for c in ("label", "dim", "key", "i", "j")):
                held.append(b)
                continue
            if first:
                yield work([*held, b.slice(0, first)])
                held = [b.slice(first)]
            else:
                if held:
                    yield work(held)
                held = [b]
        if held:
            yield work(held)

    return run


def _matrix_of(t: pa.Table, name: str) -> np.ndarray:
    col = t.column(name).chunk(0)
    return col.flatten().to_numpy().reshape(len(col), -1)


def embedding_near_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE,
    tables: int = TABLES, rotations: int = ROTATIONS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept.

    Links need equal labels and cosine >= ``least``. A row with a null label or id, or a vector that
    is null, empty, zero or holds null or non-finite components, links with nothing: n_links 0,
    component_id its id, kept. Repeated rows are vectors of their own that link with each other.
    Vectors of different lengths do not link. An empty table gives an empty result; other columns
    are ignored."""
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable").select("id", "label", "vector")
    classes = cut_lineage(good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))

    hashed = classes.select("rep", "label", "vector", "n").mapInArrow(
        _hashed(tables, rotations, seed), "rep long, label long, vector array<double>, n long, dim int, keys array<long>"
    )
    hashed = cut_lineage(hashed)
    bucket = ["label", "dim", "key"]
    member = hashed.select("rep", "label", "dim", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = member.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = member.join(sizes, bucket).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    units = placed.select("rep", *bucket, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "rep", *bucket, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    units = units.join(hashed.select("rep", "label", "vector", "n", "keys"), ["rep", "label"])
    order = [*bucket, "i", "j"]
    found = cut_lineage(
        units.select(*order, "block", "rep", "n", "vector", "keys")
        .repartition(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_verified(least), "u long, v long, n long")
    )
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("rep"), "root")
    done = classes.join(counts, "rep", "left").join(roots, "rep", "left")
    done = cut_lineage(
        done.select("label", "vector", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    linked = good.join(done, ["label", "vector"]).select("id", "n_links", "component_id")
    lone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(lone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
