"""Token counts by a two-tier table of pre-token lengths, without moving any pre-token.

The tokenizer splits a text into pre-tokens and encodes each on its own, so a text's count is the sum
of its pre-tokens' lengths. Tier one is a compact table of the most frequent pre-tokens (one string of
keys, one byte or more a length), fitted on a bounded sample of documents and broadcast: its size is a
parameter. Tier two is a cache in each Python worker, bounded by characters, that the library fills
for pre-tokens outside the table. Both tiers hold lengths that the library gave, so they only save
time: the counts are the library's whatever the sample was. The documents are read once, in place;
nothing is shuffled by pre-token.

Texts are split here as far as the split is certain: words of ASCII and Latin letters. A word (between
ASCII white space, at which neither normalising nor splitting looks across) with any other character
goes to the library as it is.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_LIMIT = 2048
#: Documents (about) that the table of frequent pre-tokens is fitted on, and its entries.
SAMPLE_DOCS, FREQUENT = 4_000, 32_768
#: Tasks that count the sample; each sends ``FREQUENT`` rows at most.
SAMPLE_TASKS = 8
#: Characters of keys that a worker's cache of rare pre-tokens holds before it starts anew.
CACHE_CHARS = 8_000_000
#: Longer pre-tokens are encoded each time and not kept.
LONGEST_KEPT = 64

# Letters on which the regular-expression libraries, Unicode versions and normal forms agree.
_LOWER = "a-zà-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
_PLAIN = _LOWER + "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮĲĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_ODD = re.compile(f"[^\x00-\x1b\x20-\x7e{_PLAIN}]")
_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(f"[^{_SPACE}]+")
#: The split of the tokenizer family that is supported here (fixed value of its file).
CLIP_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^{_SPACE}{_LOWER}0-9]+")


@dataclass(frozen=True)
class FrequentTable:
    """Keys in one string, separated by line feeds (no pre-token holds white space), and lengths."""

    keys: bytes
    lengths: np.ndarray

    @staticmethod
    def of(lengths: dict[str, int]) -> FrequentTable:
        values = list(lengths.values())
        kind = np.min_scalar_type(max(values, default=0))
        return FrequentTable("\n".join(lengths).encode(), np.array(values, dtype=kind))

    def as_dict(self) -> dict[str, int]:
        return dict(zip(self.keys.decode().split("\n"), self.lengths.tolist(), strict=True)) if len(self.lengths) else {}


class _Rare(dict):
    """Tier two: the worker's cache of pre-tokens (or odd words) outside the table."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.chars = tokenizer, 0

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST_KEPT:
            if self.chars > CACHE_CHARS:
                self.clear()
                self.chars = 0
            self.chars += len(piece) + 8
            self[piece] = n
        return n


class _Frequent(dict):
    """Tier one; what it lacks is asked of tier two and not kept here."""

    def __init__(self, known: dict[str, int], rare: _Rare):
        super().__init__(known)
        self.rare = rare

    def __missing__(self, piece: str) -> int:
        return self.rare[piece]


def _splits_as_here(spec: dict) -> bool:
    """Whether the file's normaliser and split are those that ``_PIECE`` stands for."""
    norm = [(n["type"], n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [(p["pattern"].get("Regex"), p["behavior"], p["invert"]) for p in parts if p["type"] == "Split"]
    levels = [(p["add_prefix_space"], p["use_regex"]) for p in parts if p["type"] == "ByteLevel"]
    return (
        norm == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
        and split == [(CLIP_SPLIT, "Removed", True)]
        and levels == [(False, False)]
        and len(parts) == 2
    )


class TokenCounter:
    """Counts the tokens of whole texts as ``encode(text, add_special_tokens=False)`` of the library,
    with its default for special strings inside texts (each is one token and parts the text)."""

    def __init__(self, spec: str, table: FrequentTable | None = None):
        from tokenizers import Tokenizer

        said = json.loads(spec)
        if not _splits_as_here(said):
            raise ValueError("the tokenizer splits texts in a way that is not supported")
        added = said.get("added_tokens", [])
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("added tokens with stripping, word or normalising rules are not supported")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(sorted((re.escape(a["content"]) for a in added), key=len, reverse=True)) or r"(?!)")
        self.rare = _Rare(self.tokenizer)
        self.frequent = _Frequent({} if table is None else table.as_dict(), self.rare)

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """The pre-tokens of ``text`` (without special strings), and its odd words, left whole."""
        odd: list[str] = []
        if _ODD.search(text):
            plain = []
            for w in _WORD.findall(text):
                (odd if _ODD.search(w) else plain).append(w)
            text = " ".join(plain)
        return _PIECE.findall(text.lower()), odd

    def count(self, text: str | None) -> int:
        total = 0
        parts = self.special.split(text) if text else []
        for part in parts:
            pieces, odd = self.pieces(part)
            total += sum(map(self.frequent.__getitem__, pieces)) + sum(map(self.rare.__getitem__, odd))
        return total + max(len(parts) - 1, 0)


def frequent_table(
    docs: DataFrame, spec: str, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, entries: int = FREQUENT, seed: int = 7
) -> FrequentTable:
    """The ``entries`` most frequent pre-tokens of about ``sample_docs`` random documents, with their
    lengths. The driver receives at most ``SAMPLE_TASKS * entries`` words of ``LONGEST_KEPT``
    characters; a task's own counts are thinned to the larger half when they pass ten times that."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    rows = docs.select(F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull() & (F.rand(seed) < F.lit(share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = TokenCounter(spec), Counter()
        for b in batches:
            for t in b.column(0):
                for part in counter.special.split(t.as_py()):
                    seen.update(p for p in counter.pieces(part)[0] if len(p) <= LONGEST_KEPT)
                if len(seen) > 10 * entries:
                    seen = Counter(dict(seen.most_common(5 * entries)))
        top = seen.most_common(entries)
        lengths = [counter.rare[w] for w, _ in top]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array(lengths, pa.int64())], ["w", "n", "len"])

    found: Counter = Counter()
    length: dict[str, int] = {}
    told = rows.repartition(SAMPLE_TASKS).mapInArrow(run, "w string, n long, len long").toArrow()
    for b in told.to_batches():
        for w, n, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found[w] += n
            length[w] = size
    return FrequentTable.of({w: length[w] for w, _ in found.most_common(entries)})


_COUNTERS: dict[tuple[str, int], TokenCounter] = {}


def _counter(key: tuple[str, int], shared) -> TokenCounter:
    """One counter per worker process, so that later tasks find its cache filled."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(*shared.value)
    return _COUNTERS[key]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = TOKEN_LIMIT,
    sample_docs: int = SAMPLE_DOCS,
    entries: int = FREQUENT,
) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null text counts as empty: no bytes, no tokens. Texts are counted whole, whatever their length.
    Rows with null or repeated ids are returned as they are. An empty table gives an empty result;
    other columns, whatever their names, are ignored. The tokenizer's file is read on the driver and
    broadcast with the table (both of fixed size)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    TokenCounter(spec)  # an unsupported file fails here, not in a task
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = frequent_table(rows, spec, "text", sample_docs, entries)
    shared = docs.sparkSession.sparkContext.broadcast((spec, table))
    key = (tokenizer_path, hash((len(spec), table.keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, shared)
        for b in batches:
            counts = [counter.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    sized = rows.select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    out = sized.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
