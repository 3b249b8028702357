"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled rows (``per_lang`` documents of each language, chosen
by a hash of the id) and are summed in Spark; the driver holds one count per (language, bucket). The
log-probability matrix (buckets x languages) is broadcast, and every Arrow batch is scored as a
sparse product: the buckets of all n-grams of a group of texts pick matrix rows, which are summed
text by text. Groups are bounded in n-grams, and a longer text is summed in slices, so memory does
not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import hash_sample, id_remainder

BUCKET_BITS = 14
LENGTHS = (1, 2, 3)
_CELLS = 4_000_000  # matrix cells that one group of texts may pick at once
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; built once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngram_buckets(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of the lower-case text, other characters than letters read as spaces;
    None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32)).astype(np.uint32)
    out = []
    for n in LENGTHS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) ^ points[i : len(points) - n + 1 + i]
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


@dataclass
class LanguageModel:
    langs: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # buckets x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        room = max(1, _CELLS // len(self.langs))
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if not group:
                return
            first = np.cumsum([0] + [len(b) for _, b in group[:-1]])
            sums = np.add.reduceat(self.log_p[np.concatenate([b for _, b in group])], first, axis=0)
            for (i, _), s in zip(group, sums, strict=True):
                langs[i], scores[i] = self._best(s)
            group.clear()
            held = 0

        for i, t in enumerate(texts):
            b = ngram_buckets(t)
            if b is None:
                continue
            if len(b) > room:
                s = sum(self.log_p[b[k : k + room]].sum(axis=0) for k in range(0, len(b), room))
                langs[i], scores[i] = self._best(s)
                continue
            if held + len(b) > room:
                flush()
            group.append((i, b))
            held += len(b)
        flush()
        return langs, scores

    def _best(self, log_likelihood: np.ndarray) -> tuple[str, float]:
        z = log_likelihood + self.prior
        k = int(z.argmax())
        return self.langs[k], float(1.0 / np.exp(z - z[k]).sum())


def train_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 3000, alpha: float = 0.5
) -> LanguageModel:
    """Fit on about ``per_lang`` rows of each non-null language with text. Without any, the model
    knows no language and answers ``und``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sample = hash_sample(rows.where("id is not null and text is not null"), "id", "lang", per_lang)
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = ngram_buckets(text.as_py())
                texts[lang] = texts.get(lang, 0) + 1
                if found is not None:
                    by.setdefault(lang, np.zeros(size, dtype=np.int64))
                    by[lang] += np.bincount(found, minlength=size)
        for lang, n in texts.items():
            c = by.get(lang, np.zeros(size, dtype=np.int64))
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": [-1, *at.tolist()], "n": [n, *c[at].tolist()]})

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    c = np.zeros((size, len(langs)))
    prior = np.zeros(len(langs))
    at = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    c[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    prior[at[bucket < 0]] = n[bucket < 0]
    log_p = np.log((c + alpha) / (c.sum(axis=0) + alpha * size))
    return LanguageModel(langs, np.log(prior / prior.sum()) if langs else prior, log_p)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **train) -> DataFrame:
    """One row per input row: ``id_col``, held_out, lang_pred, score (posterior of the answer).

    Learns only from rows with text, a non-null language and crc32(id as text) mod 4 other than 2.
    Null texts and texts without a letter give ``und`` and score 0. A null id is neither held out
    nor learnt from; repeated rows are returned as often as they occur; an empty table gives an
    empty result; other columns are ignored."""
    model = train_language_model(docs.where(id_remainder(id_col, 4) != 2), id_col, text_col, lang_col, **train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column(2).to_pylist())
            cols = [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "lang_pred", "score"])

    held = F.coalesce(id_remainder(id_col, 4) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
