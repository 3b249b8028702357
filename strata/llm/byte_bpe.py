"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string is determined by one number per prefix: the last token of the
prefix's own encoding. It is the unique vocabulary token t that ends the prefix and *fits* the last
token of what is left in front of it (fits: the two tokens, joined, would encode to themselves). So
the table of last tokens grows by appending bytes without looking back further than the longest
token, the encoding is read off backwards, and after an edit only the table from the edit on is
recomputed, up to the point where it agrees with the old one again.

On Spark each task encodes Arrow batches of texts piece by piece (matches of the split pattern).
Short pieces share one table, keyed by prefix bytes, so words with a common stem share its rows.
Both caches are bounded and only save time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHORT = 48  # bytes; longer pieces get a table of their own
_CACHE = 600_000  # entries of the piece cache, the prefix table and the pair table, each

# Characters on which the two regular-expression libraries agree: ASCII without the four separators
# U+001C..U+001F, and Latin letters.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNUSUAL = re.compile(f"[^\x00-\x1b\x20-\x7e{_LATIN}]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _plain_merge(text: bytes, ranks: dict[bytes, int], without: bytes | None = None) -> list[bytes]:
    """Merge the adjacent pair of the lowest rank, leftmost first, until none is left."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            joined = parts[i] + parts[i + 1]
            r = None if joined == without else ranks.get(joined)
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merge_halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens whose merge makes each longer token; tokens that merging never makes are
    absent (they stand only for pieces that equal them)."""
    out = {}
    for text, rank in ranks.items():
        parts = _plain_merge(text, ranks, without=text) if len(text) > 1 else []
        if len(parts) == 2:
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class PrefixBPE:
    """Encoder and decoder over the ranks of a byte-level vocabulary that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.halves = merge_halves(ranks) if halves is None else halves
        self.made = {t: r for t, r in ranks.items() if len(t) == 1 or r in self.halves}
        self.longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        self._last: dict[bytes, int] = {}

    def fits(self, a: int, b: int) -> bool:
        """The bytes of ``a`` followed by those of ``b`` encode to [a, b].

        Undo the merges at the seam, latest first (of equal ranks the right one is later). While
        both sides of the seam stand, a merge across it must not come before the merge that was
        undone last: it would have taken place instead."""
        key = (a, b)
        known = self._fits.get(key)
        if known is not None:
            return known
        before, token, ranks, halves = len(self.token) + 1, self.token, self.ranks, self.halves
        answer = True
        while True:
            across = ranks.get(token[a] + token[b])
            if across is not None and across < before:
                answer = False
                break
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                break
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]
        if len(self._fits) > _CACHE:
            self._fits.clear()
        self._fits[key] = answer
        return answer

    def _step(self, text: bytes, end: int, last) -> int:
        """The last token of the prefix ``text[:end]``; ``last(j)`` is that of ``text[:j]``."""
        for start in range(max(0, end - self.longest), end):
            t = self.made.get(text[start:end])
            if t is not None and (start == 0 or self.fits(last(start), t)):
                return t
        raise ValueError("the vocabulary lacks a single byte")

    def table(self, text: bytes, last: list[int] | None = None) -> list[int]:
        """Last tokens of all prefixes of ``text``; ``last`` holds those already known."""
        last = [] if last is None else last
        for end in range(len(last) + 1, len(text) + 1):
            last.append(self._step(text, end, lambda j: last[j - 1]))
        return last

    def read_off(self, last: list[int]) -> list[int]:
        """The encoding whose prefix table is ``last``."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.token[last[at - 1]])
        return out[::-1]

    def _short(self, text: bytes) -> list[int]:
        """As ``read_off(table(text))``, with one table for all short pieces, keyed by the prefix.
        It is closed under prefixes: rows are added shortest first and dropped all at once."""
        last, made, token, known = self._last, self.made, self.token, self._fits
        if len(last) > _CACHE:
            last.clear()
        n = len(text)
        end = n
        while end and text[:end] not in last:
            end -= 1
        chain = [0, *(last[text[:e]] for e in range(1, end + 1))]
        for e in range(end + 1, n + 1):
            for start in range(e):
                t = made.get(text[start:e])
                if t is not None:
                    if not start:
                        break
                    ok = known.get((chain[start], t))
                    if ok or (ok is None and self.fits(chain[start], t)):
                        break
            chain.append(t)
            last[text[:e]] = t
        out, at = [], n
        while at:
            out.append(chain[at])
            at -= len(token[chain[at]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._short(piece) if len(piece) <= _SHORT else self.read_off(self.table(piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class EditableEncoding:
    """The encoding of one piece under exact appends and local edits."""

    def __init__(self, bpe: PrefixBPE, text: bytes = b""):
        self.bpe, self.text = bpe, text
        self.last = bpe.table(text)

    def append(self, more: bytes) -> None:
        self.text += more
        self.bpe.table(self.text, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Replace bytes start..stop. Rows behind the edit are recomputed until as many rows in a
        row as the longest token has bytes agree with the old ones; the rest is kept."""
        old, tail = self.last, len(self.text) - stop
        self.text = self.text[:start] + new + self.text[stop:]
        last = old[:start]
        same = 0
        for end in range(start + 1, len(self.text) + 1):
            last.append(self.bpe._step(self.text, end, lambda j: last[j - 1]))
            behind = end - (len(self.text) - tail)
            same = same + 1 if behind > 0 and old[stop + behind - 1] == last[-1] else 0
            if same >= self.bpe.longest:
                last += old[stop + behind :]
                break
        self.last = last

    def ids(self) -> list[int]:
        return self.bpe.read_off(self.last)


class _PieceIds(dict):
    """Piece of text to its ids as little-endian 32-bit bytes."""

    def __init__(self, bpe: PrefixBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) > _CACHE:
            self.clear()
        ids = np.array(self.bpe.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= _SHORT:
            self[piece] = ids
        return ids


class TextEncoder:
    """Splits texts by ``pattern`` and encodes each match; ids as little-endian 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, halves: dict[int, tuple[int, int]] | None = None):
        self.bpe = PrefixBPE(ranks, halves)
        self.pieces = _PieceIds(self.bpe)
        self.full = regex.compile(pattern)
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LATIN}0-9]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
        self.plain = None if r"\p" in plain else re.compile(plain)

    def split(self, text: str) -> list[str]:
        if self.plain is not None and not _UNUSUAL.search(text):
            return self.plain.findall(text)
        return [m.group() for m in self.full.finditer(text)]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return self.bpe.decode(np.frombuffer(ids, "<u4").tolist())


_CODERS: dict[tuple[int, str], TextEncoder] = {}


def _coder(key: int, shared, pattern: str) -> TextEncoder:
    """One encoder per worker process and vocabulary, so that later tasks find its caches filled."""
    if (key, pattern) not in _CODERS:
        _CODERS.clear()
        _CODERS[key, pattern] = TextEncoder(shared.value[0], pattern, shared.value[1])
    return _CODERS[key, pattern]


def bpe_encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False
) -> DataFrame:
    """One row per input row: ``id_col``, ids (binary, little-endian unsigned 32-bit), and with
    ``decode`` also decoded (binary), the bytes that the ids stand for.

    Null text counts as empty and gives no ids. Any text is encoded whole, whatever its length. Rows
    with null or repeated ids are returned as they are. An empty table gives an empty result; other
    columns are ignored. ``ranks`` (one vocabulary) is broadcast."""
    halves = merge_halves(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, halves))
    key = hash((len(ranks), tuple(halves.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, shared, pattern)
        for b in batches:
            ids = [coder.encode(t.as_py() or "") for t in b.column(1)]
            out = [b.column(0), pa.array(ids, pa.binary())]
            if decode:
                out.append(pa.array([coder.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "ids"] + ["decoded"] * decode
    schema = "id long, ids binary" + ", decoded binary" * decode
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def bpe_decode(tokens: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and text for rows (``id_col``, ids) of ``bpe_encode``; null ids give empty text,
    and bytes that are not UTF-8 are replaced."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t for t, r in shared.value.items()}
        for b in batches:
            text = [b"".join(map(token.__getitem__, np.frombuffer(i.as_py() or b"", "<u4").tolist())).decode("utf-8", "replace") for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["id", "text"])

    rows = tokens.select(F.col(id_col).cast("long").alias("id"), "ids")
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def token_digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 of rows of ``bpe_encode(decode=True)``."""
    return tokens.select(
        id_col,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
