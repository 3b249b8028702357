"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

Patterns (kinds assign, access, hex) give the base findings. Candidates are the base findings and
every other run of 12 or more characters of the token alphabet that has a digit, a capital behind a
small letter, or 20 characters; and of a run that separators divide (paths, URLs, assignments) also
each part that would be a candidate alone. The network reads windows of characters: ``BEFORE`` in
front, ``INSIDE`` of the candidate and ``AFTER`` behind, with a flag per character for being inside;
a longer candidate is covered by overlapping windows and has the score of its best. Embedding,
convolution of width 5, ReLU, maximum over the candidate and over its context, logistic output; all in
numpy. It is trained with backpropagation on labelled findings: base findings of a bounded sample of
documents, tokens of that sample whose format is plain beyond doubt (numbers, dates, words, paths of
words; other tokens have no label and are left out), and generated tokens with known labels. Formats
of secrets that training has not seen calibrate the scores (Platt) and fix the threshold: the highest
one that keeps the demanded recall on them. Candidates at or above it become spans of kind cnn (the
parts rather than the whole run, if parts reach it); base findings stay whatever their score.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import sample_rows

# The base patterns and the least lengths of a finding.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal: the same as runs of any length, short ones dropped
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "cnn")
KEYWORD = re.compile("password|passwd|secret|token|api_?key", re.IGNORECASE)

ALPHABET = frozenset(string.ascii_letters + string.digits + "+/_=.-")
_TOKEN_SET = r"[A-Za-z0-9+/_=.-]"
LONG_RUN = 20
_ANCHOR = re.compile(rf"[0-9]|[a-z](?=[A-Z])|(?<!{_TOKEN_SET})(?={_TOKEN_SET}{{{LONG_RUN}}})")
_RUN = re.compile(f"{_TOKEN_SET}+")
_PART = re.compile("[A-Za-z0-9+_-]+")  # between the separators / = .
CANDIDATE_LEAST = 12
BEFORE, INSIDE, AFTER = 24, 40, 8
#: Distance of the windows that cover a long candidate.
STRIDE = INSIDE // 2
WINDOW = BEFORE + INSIDE + AFTER
_EMBED, _FILTERS, _WIDTH = 8, 24, 5
_SYMBOLS = 98  # printable ASCII, other, and padding
# Formats without a secret beyond doubt: numbers with punctuation; words, also joined by separators
# (small letters or one capital in front, or capitals only), each with a few digits at most.
PLAIN_FORM = re.compile(r"[0-9+/_=.-]+|(?:(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,12})[0-9]{0,3}|[0-9]{1,8})(?:[/_=.-]+(?:(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,12})[0-9]{0,3}|[0-9]{1,8}))*")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST] if KEYWORD.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _joined(base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base findings of all kinds as disjoint spans in order."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in base:
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], k, max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the token runs with a digit, an inner capital or ``LONG_RUN`` characters that no
    base finding touches."""
    out, behind, at = [], 0, 0
    base = _joined(base)
    for m in _ANCHOR.finditer(text):
        if m.start() < behind:
            continue
        start = m.start()
        while start > behind and text[start - 1] in ALPHABET:
            start -= 1
        end = behind = _RUN.match(text, m.start()).end()
        while end > start and text[end - 1] in ".-=":  # sentence ends are not part of a token
            end -= 1
        while at < len(base) and base[at][2] <= start:
            at += 1
        touched = at < len(base) and base[at][0] < end
        if end - start >= CANDIDATE_LEAST and not touched and any(c.isalnum() for c in text[start:end]):
            out.append((start, end))
    return out


def parts_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Parts of a run between separators that are candidates on their own; none if it has no separator."""
    found = []
    for m in _PART.finditer(text, start, end):
        s, e = m.span()
        if e - s >= CANDIDATE_LEAST and (s, e) != (start, end) and _ANCHOR.search(text, s, e):
            found.append((s, e))
    return found


def window_codes(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of one window (WINDOW,): the first ``INSIDE`` characters of the candidate from
    BEFORE on, padded behind; ``windows`` covers longer ones."""
    own = min(end - start, INSIDE)
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    right = text[start + own : start + own + AFTER].ljust(AFTER, "\0")
    line = left + text[start : start + own].ljust(INSIDE, "\0") + right
    points = np.frombuffer(line.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    return np.where(points == 0, 97, np.where((points >= 32) & (points < 127), points - 32, 96))


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Overlapping windows over the whole candidate, the last one at its end."""
    last = max(start, end - INSIDE)
    return [window_codes(text, min(s, last), end) for s in range(start, last + STRIDE, STRIDE)]


def _inside() -> np.ndarray:
    flag = np.zeros(WINDOW, dtype=np.float32)
    flag[BEFORE : BEFORE + INSIDE] = 1.0
    return flag


@dataclass
class SecretModel:
    """Weights of the network, the calibration (slope, offset) and the threshold on its scores."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.1

    def _forward(self, codes: np.ndarray):
        n = len(codes)
        x = np.concatenate([self.embed[codes], np.broadcast_to(_inside(), (n, WINDOW))[:, :, None]], axis=2)
        columns = np.lib.stride_tricks.sliding_window_view(x, _WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - _WIDTH + 1, -1)
        act = np.maximum(columns @ self.conv + self.conv_bias, 0)
        mid = slice(BEFORE - 2, BEFORE + INSIDE - 2)
        own = act[:, mid].argmax(axis=1) + mid.start
        rest = act.copy()
        rest[:, mid] = -1.0
        ctx = rest.argmax(axis=1)
        at = np.arange(n)[:, None], np.arange(_FILTERS)[None, :]
        pooled = np.concatenate([act[at[0], own, at[1]], act[at[0], ctx, at[1]]], axis=1)
        return columns, own, ctx, pooled, pooled @ self.out + self.out_bias

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, in blocks so that memory is bounded."""
        z = np.concatenate([self._forward(codes[i : i + 512])[-1] for i in range(0, len(codes), 512)] or [np.zeros(0)])
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * z + self.offset, -60, 60)))


def _train(codes: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> SecretModel:
    rng = np.random.default_rng(seed)
    m = SecretModel(
        embed=rng.normal(0, 0.3, (_SYMBOLS, _EMBED)).astype(np.float32),
        conv=rng.normal(0, 0.15, (_WIDTH * (_EMBED + 1), _FILTERS)).astype(np.float32),
        conv_bias=np.zeros(_FILTERS, dtype=np.float32),
        out=rng.normal(0, 0.2, 2 * _FILTERS).astype(np.float32),
        out_bias=0.0,
    )
    names = ("embed", "conv", "conv_bias", "out", "out_bias")
    state = {k: [np.zeros_like(np.asarray(getattr(m, k), dtype=np.float32)) for _ in range(2)] for k in names}
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            b = order[i : i + 64]
            columns, own, ctx, pooled, z = m._forward(codes[b])
            err = balance[b] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[b]) / len(b)
            back = err[:, None] * m.out[None, :] * (pooled > 0)
            d_act = np.zeros((len(b), WINDOW - _WIDTH + 1, _FILTERS), dtype=np.float32)
            rows, cols = np.arange(len(b))[:, None], np.arange(_FILTERS)[None, :]
            np.add.at(d_act, (rows, own, cols), back[:, :_FILTERS])
            np.add.at(d_act, (rows, ctx, cols), back[:, _FILTERS:])
            d_col = (d_act @ m.conv.T).reshape(len(b), -1, _WIDTH, _EMBED + 1)
            d_embed = np.zeros_like(m.embed)
            for k in range(_WIDTH):
                np.add.at(d_embed, codes[b][:, k : k + d_col.shape[1]], d_col[:, :, k, :_EMBED])
            grads = {
                "embed": d_embed,
                "conv": np.tensordot(columns, d_act, axes=([0, 1], [0, 1])),
                "conv_bias": d_act.sum(axis=(0, 1)),
                "out": pooled.T @ err,
                "out_bias": err.sum(),
            }
            step += 1
            for k, g in grads.items():
                s = state[k]
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                now = getattr(m, k) - 0.01 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
                setattr(m, k, now if k == "out_bias" else now.astype(np.float32))
    return m


def _calibrate(m: SecretModel, codes: np.ndarray, y: np.ndarray, recall: float) -> SecretModel:
    """Platt's slope and offset by gradient steps, then the highest threshold with that recall."""
    z = np.concatenate([m._forward(codes[i : i + 512])[-1] for i in range(0, len(codes), 512)])
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        a, b = a - 0.05 * float(((p - y) * z).mean()), b - 0.05 * float((p - y).mean())
    m.slope, m.offset = max(a, 1e-3), b
    found = np.sort(m.score(codes[y == 1]))
    if len(found):
        m.threshold = float(found[int((1 - recall) * len(found))])
    return m


#: Of the formats of generated secrets, in order, those that only calibration sees.
HELD_OUT_FORMATS = (3, 7, 9)


def generated_findings(n: int, seed: int, held_out: bool = False) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): token formats with known labels between words of plain text, some
    behind a path. ``held_out`` chooses between the two groups of secret formats."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    b64, low, dig, hexa = string.ascii_letters + string.digits, string.ascii_lowercase, string.digits, "0123456789abcdef"
    word = lambda least=4, most=9: "".join(pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) for _ in range(int(rng.integers(least, most)) // 2))
    secret = [
        lambda: pick(b64, int(rng.integers(20, 44))),
        lambda: pick(b64 + "+/", int(rng.integers(24, 60))) + "==",
        lambda: rng.choice(["sk_live_", "sk-", "xoxb-", "pk_test_"]) + pick(b64, 30),
        lambda: rng.choice(["ghp_", "glpat-", "AIza"]) + pick(b64, int(rng.integers(24, 36))),
        lambda: pick(hexa, int(rng.choice([32, 40, 64]))),
        lambda: pick(hexa.upper(), int(rng.choice([32, 40, 64]))),
        lambda: "AKIA" + pick(string.ascii_uppercase + dig, 16),
        lambda: "eyJ" + pick(b64, 20) + "." + pick(b64, 24) + "." + pick(b64, 30),
        lambda: pick(string.ascii_letters, int(rng.integers(20, 44))),
        lambda: pick(string.ascii_letters, 24) + "-" + pick(b64, 12),
        lambda: pick(low + dig, int(rng.integers(20, 40))),
    ]
    secret = [f for i, f in enumerate(secret) if (i in HELD_OUT_FORMATS) == held_out]
    plain = [
        lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4)),
        lambda: pick(low, 6) + str(rng.integers(10, 99)) + "." + pick(low, 6) + "." + pick(low, 3),
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}",
        lambda: "/".join(pick(low, 5) for _ in range(3)) + "/" + pick(dig, 4) + ".html",
        lambda: pick(low, 8) + "_" + pick(low, 7) + "_" + pick(dig, 2),
        lambda: "-".join(pick(dig, 4) for _ in range(3)),
        lambda: pick(low, 5) + "=" + pick(dig, 3) + "-" + pick(low, 6),
        lambda: "v" + ".".join(pick(dig, 2) for _ in range(3)) + "-" + pick(low, 5),
        lambda: word(20, 40),
        lambda: word().capitalize() + word(20, 32),
        lambda: word() + "".join(word().capitalize() for _ in range(int(rng.integers(2, 5)))),
        lambda: "_".join(word().upper() for _ in range(int(rng.integers(3, 6)))),
        lambda: "/".join(word(4, 14) for _ in range(int(rng.integers(3, 7)))),
        lambda: ".".join(word(4, 14) for _ in range(int(rng.integers(2, 5)))) + "/" + word(4, 20),
        lambda: "-".join(word() for _ in range(int(rng.integers(3, 6)))) + "-" + pick(dig, int(rng.integers(1, 8))),
    ]
    words = lambda: " ".join(pick(low, int(rng.integers(2, 9))) for _ in range(int(rng.integers(2, 6))))
    out = []
    for i in range(n):
        label = i % 2
        token = str((secret if label else plain)[int(rng.integers(len(secret) if label else len(plain)))]())
        key = str(rng.choice(["token = ", "api_key: ", "secret=", "key ", "Authorization: Bearer "])) if label and rng.random() < 0.4 else ""
        path = "https://" + word() + "." + word() + "/" + word() + str(rng.choice(["/", "=", "/" + pick(dig, 6) + "/"])) if rng.random() < 0.3 else ""
        left = words() + " " + key + path
        out.append((left + token + " " + words(), len(left), len(left) + len(token), label))
    return out


def train_secret_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 3000, per_doc: int = 8, generated: int = 2400,
    recall: float = 0.98, epochs: int = 8, seed: int = 5,
) -> SecretModel:
    """Train on the findings of ``sample_docs`` documents (smallest hashes of the id, one row each; at
    most ``per_doc`` findings of each label per document) and ``generated`` made ones; calibrate on half
    as many made ones whose secrets have other formats, and on every fourth token of the sample."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_findings(text)
                found = [(*window_codes(text, s, e).tolist(), 1) for s, _, e in base[:per_doc]]
                plain = [(s, e) for s, e in other_candidates(text, base) if PLAIN_FORM.fullmatch(text, s, e)]
                found += [(*window_codes(text, s, e).tolist(), 0) for s, e in plain[:per_doc]]
                yield pa.RecordBatch.from_pydict({"id": [doc] * len(found), "row": found}, schema=kind)

    kind = pa.schema([("id", pa.int64()), ("row", pa.list_(pa.int32()))])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    got = sample_rows(rows, "text", sample_docs).mapInArrow(extract, "id long, row array<int>")
    got = sorted((r["id"], list(r["row"])) for r in got.collect())
    made, fresh = generated_findings(generated, seed), generated_findings(generated // 2, seed + 1, held_out=True)
    slide = np.random.default_rng(seed)

    def one(text: str, start: int, end: int) -> list[int]:
        """A window of a made token; of a long one any of its windows."""
        all_ = windows(text, start, end)
        return all_[int(slide.integers(len(all_)))].tolist()

    codes = np.array([r[1][:-1] for r in got] + [one(t, s, e) for t, s, e, _ in made + fresh], dtype=np.int64)
    y = np.array([r[1][-1] for r in got] + [m[3] for m in made + fresh], dtype=np.float32)
    # tokens that match a base pattern are found anyway, so they do not count for the demanded recall
    held = np.array([i % 4 == 3 and r[1][-1] == 0 for i, r in enumerate(got)] + [False] * len(made) + [True] * len(fresh))
    blank = np.random.default_rng(seed).random(len(y)) < 0.3  # some without context, lest it decide alone
    seen = codes.copy()
    seen[blank, :BEFORE] = 97
    return _calibrate(_train(seen[~held], y[~held], epochs, seed), codes[held], y[held], recall)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **train) -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex, base (text of base spans),
    spans (text of all spans), n_cnn, and max_score, the highest calibrated score of a candidate.

    A span is kind:start:end, code points, end exclusive, by start, then kind; lists are joined by
    commas. Null texts count as empty and have no span (max_score null). Texts are read whole,
    whatever their length. Null and repeated ids are returned as they are; an empty table gives an
    empty result; other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(train_secret_model(docs, id_col, text_col, **train))

    def scan(text: str) -> tuple:
        base = base_findings(text)
        runs = other_candidates(text, base)
        spans = [(s, e, -1) for s, _, e in base]  # -1: a base span, else the number of the run
        for r, (s, e) in enumerate(runs):
            spans += [(s, e, r), *((a, b, r) for a, b in parts_of(text, s, e))]
        waiting: list[np.ndarray] = []
        owners: list[int] = []
        best = np.zeros(len(spans))

        def settle() -> None:
            np.maximum.at(best, owners, model.value.score(np.stack(waiting)))
            waiting.clear()
            owners.clear()

        for k, (s, e, _) in enumerate(spans):
            for w in windows(text, s, e):
                waiting.append(w)
                owners.append(k)
                if len(waiting) == 4096:
                    settle()
        if waiting:
            settle()
        scores = best.tolist()
        hits = {k for k, (_, _, r) in enumerate(spans) if r >= 0 and scores[k] >= model.value.threshold}
        divided = {spans[k][2] for k in hits if spans[k][:2] != runs[spans[k][2]]}  # runs with a part of their own
        added = [(spans[k][0], 3, spans[k][1]) for k in sorted(hits) if spans[k][:2] != runs[spans[k][2]] or spans[k][2] not in divided]
        write = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        return (*n, write(base), write(base + added), len(added), max(scores, default=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py() or "") for t in b.column(1)]
            cols = [pa.array([f[j] for f in found], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *names])

    names = ["n_assign", "n_access", "n_hex", "base", "spans", "n_cnn", "max_score"]
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
    schema = "id long, n_assign long, n_access long, n_hex long, base string, spans string, n_cnn long, max_score double"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col, "n_assign", "n_access", "n_hex", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans", "n_cnn", "max_score"
    )
