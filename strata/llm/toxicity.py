"""Toxicity scoring with a counterfactually regularised classifier.

Features are hashed words and word stems (prefixes that go on), each counted once per text, so a
single term in a very long text weighs as much as in a short one. Training takes a bounded sample
of labelled rows (``per_class`` of each label, by a hash of the id), chooses the features that tell
the labels apart (chi-squared, counted in Spark), and fits a logistic regression in numpy that also
pays for every change of score when an identity term in a labelled text is swapped for another one.
Scoring is one pass of a pandas UDF: no shuffle, and the model is a table of at most ``features``
weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage, hash_sample, id_remainder

# Words that name groups of people without judging them.
IDENTITY_TERMS = (
    "woman", "women", "man", "men", "girl", "boy", "muslim", "muslims", "jew", "jewish", "christian", "hindu",
    "buddhist", "atheist", "black", "white", "asian", "african", "arab", "latino", "gay", "lesbian", "straight",
    "transgender", "deaf", "blind", "disabled", "immigrant", "refugee", "german", "french", "spanish", "turkish",
    "frau", "mann", "muslime", "jude", "christ", "femme", "homme", "musulman", "juif", "mujer", "hombre", "judío",
)

_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6, 7, 8)
_CACHE = 300_000


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word: itself, and each of its stems that goes on behind."""
    names = [word] + [f"{word[:k]}+" for k in _STEMS if len(word) > k]
    return [zlib.crc32(x.encode()) for x in names]


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class ToxicityModel:
    """Bias and one weight per feature; no feature: a constant score."""

    bias: float
    weights: dict[int, float]

    def score(self, text: str | None, known: dict[str, tuple[int, ...]]) -> float:
        hit: set[int] = set()
        for w in text_words(text):
            found = known.get(w)
            if found is None:
                if len(known) > _CACHE:
                    known.clear()
                found = known[w] = tuple(x for x in word_features(w) if x in self.weights)
            if found:
                hit.update(found)
        z = self.bias + sum(self.weights[x] for x in sorted(hit))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))


def _fit(x: np.ndarray, y: np.ndarray, row_weight: np.ndarray, pairs, swap_penalty: float, decay: float, steps: int):
    """Full-batch Adam on weighted log loss + decay * |w|^2 + swap_penalty * mean (s(a) - s(b))^2."""
    n, k = x.shape
    w = np.zeros(k + 1, dtype=np.float64)
    rate = float(np.clip((row_weight * y).sum() / row_weight.sum(), 1e-6, 1 - 1e-6))
    w[k] = np.log(rate / (1 - rate))
    m, v = np.zeros_like(w), np.zeros_like(w)
    row_weight = row_weight / row_weight.sum()
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))
    for step in range(1, steps + 1):
        err = row_weight * (sigmoid(x @ w[:k].astype(np.float32) + w[k]) - y)
        grad = np.append(x.T @ err.astype(np.float32) + 2 * decay * w[:k], err.sum())
        if pairs is not None:
            a, b = pairs
            sa, sb = (sigmoid(q @ w[:k].astype(np.float32) + w[k]) for q in (a, b))
            ga, gb = ((sa - sb) * s * (1 - s) * 2 * swap_penalty / len(sa) for s in (sa, sb))
            grad[:k] += a.T @ ga.astype(np.float32) - b.T @ gb.astype(np.float32)
            grad[k] += ga.sum() - gb.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def _swapped(rows: list[set[int]], at: dict[int, int], rng: np.random.Generator, n_pairs: int):
    """Labelled texts with an identity term, as index sets, and the same with another term: a text
    that has one loses it to the other term; one that has none gets a mention of either."""
    terms = [{at[f] for f in word_features(t) if f in at} for t in IDENTITY_TERMS]
    a, b = [], []
    for i in rng.choice(len(rows), size=min(n_pairs, len(rows)), replace=False):
        own = [j for j, t in enumerate(terms) if t and t <= rows[i]]
        j = own[0] if own else int(rng.integers(len(terms)))
        k = int((j + 1 + rng.integers(len(terms) - 1)) % len(terms))
        rest = rows[i] - terms[j] if own else rows[i]
        a.append(rest | terms[j])
        b.append(rest | terms[k])
    return a, b


def _dense(rows: list[set[int]], k: int) -> np.ndarray:
    x = np.zeros((len(rows), k), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, list(r)] = 1.0
    return x


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 3000,
    features: int = 2048,
    swap_penalty: float = 5.0,
    decay: float = 1e-5,
    steps: int = 250,
    seed: int = 7,
) -> ToxicityModel:
    """Fit on about ``per_class`` labelled rows of each class. Rows with a null id or label do not
    count; a doc labelled twice is toxic if any label says so; without labelled rows of both classes
    the model is a constant. The driver holds at most 2 * per_class rows of ``features`` indexes."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(total) < 2:
        return ToxicityModel(-20.0 if 1 not in total else 0.0, {})
    sample = F.broadcast(hash_sample(known, "id", "y", per_class))  # at most about 2 * per_class rows

    @F.pandas_udf("array<long>")
    def all_features(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted({f for w in text_words(t) for f in word_features(w)}))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    rows = cut_lineage(rows.select("y", all_features("text").alias("f")))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return ToxicityModel(-20.0 if 1 not in n else 0.0, {})
    a, c = F.col("pos"), F.col("n") - F.col("pos")
    chi = F.pow(a * (n[0] - c) - c * (n[1] - a), 2) / ((a + c) * (n[0] + n[1] - a - c + 1))
    best = (
        rows.select("y", F.explode("f").alias("f"))
        .groupBy("f")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
        .where("n >= 4")
        .orderBy(chi.desc(), "f")
        .limit(features)
        .collect()
    )
    names = list(dict.fromkeys([r["f"] for r in best] + [f for t in IDENTITY_TERMS for f in word_features(t)]))
    at = {f: i for i, f in enumerate(names)}
    own = F.expr(f"array({', '.join(f'{x}L' for x in names)})")
    got = rows.select("y", F.array_intersect("f", own).alias("f")).collect()
    sets = [{at[f] for f in r["f"]} for r in got]
    order = sorted(range(len(got)), key=lambda i: (got[i]["y"], sorted(sets[i])))  # whatever the partitions
    sets, y = [sets[i] for i in order], np.array([got[i]["y"] for i in order], dtype=np.float64)
    a_rows, b_rows = _swapped(sets, at, np.random.default_rng(seed), 512)
    weight = np.where(y == 1, total[1] / n[1], total[0] / n[0])
    k = len(names)
    w = _fit(_dense(sets, k), y, weight, (_dense(a_rows, k), _dense(b_rows, k)), swap_penalty, decay, steps)
    return ToxicityModel(float(w[k]), {f: float(x) for f, x in zip(names, w[:k], strict=True) if abs(x) > 1e-6})


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The score of a text, 0 to 1; null counts as empty. The model travels with the function."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for p in parts:
            yield p.map(lambda t: model.score(t, known)).astype("float64")

    return score(text)


def training_rows(docs: DataFrame, id_col: str = "doc_id", divisor: int = 5, held_out: int = 0) -> DataFrame:
    """Rows to learn from: crc32(id as text) mod ``divisor`` is not ``held_out``."""
    return docs.where(id_remainder(id_col, divisor) != held_out)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **train
) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score, predicted.

    Learns only from labelled rows that are not held out. Null and empty texts get the score of a
    text without words. A null id is not held out and not learnt from. Repeated rows are returned as
    often as they occur; an empty table gives an empty result; other columns are ignored."""
    model = train_toxicity(docs, training_rows(labels, id_col), id_col, text_col, label_col, **train)
    held = F.coalesce(id_remainder(id_col, 5) == 0, F.lit(False)).alias("held_out")
    scored = docs.select(id_col, held, toxicity_score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
