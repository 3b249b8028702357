"""SimHash near-deduplication with pivot distance tables.

1. Fingerprints: 64 bits per document from the XXH64 hashes of its word shingles (Arrow batches,
   one document at a time, long documents in slices of hashes).
2. Distinct fingerprints get a pivot table: their Hamming distances to reference fingerprints. By the
   triangle inequality two fingerprints at distance <= d differ by at most d in every coordinate.
3. Cells: 33 of the references are one fingerprint r and, for each of the 32 pairs of neighbouring
   bits, r with that pair inverted. If D and D_i are the distances to r and to the i-th of these,
   (D - D_i) / 2 + 1 is 0, 1 or 2, and one differing bit moves one of these 32 coordinates by one. The
   cell is the vector of them, two bits each in one long. A fingerprint is written into its own cell and
   those within ceil(d / 2) steps of it (49 cells on average for d = 2), so two linked fingerprints,
   at most d steps apart, meet in a cell half way.
4. Fingerprints that meet are held against ``PIVOTS`` further references: a pair whose largest coordinate
   difference exceeds d is discarded, survivors are verified by the bit count of the XOR, both inside
   the join. A family of near copies does not meet as a whole: its members share a cell only if
   their differences cancel out pair by pair, so few pairs are formed that are no links.
5. Components of the links over distinct fingerprints; every document takes its fingerprint's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage
from strata.llm.components import connected_components

SEED = 42
PIVOTS = 8
_SLICE = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as a signed long: bit b is set if more than half of
    the shingle hashes have it. No words: 0."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SLICE):
        to = min(n, at + _SLICE)
        h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[at:to], last[at:to], strict=False)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((fingerprint(t.as_py(), shingle) for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _pivots(n: int) -> list[int]:
    """Reference fingerprints by rule: the XXH64 hashes of 0 .. n-1, as signed longs."""
    h = (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n))
    return [x - (1 << 64) if x >> 63 else x for x in h]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_cell(fp: Column) -> Column:
    """The 32 coordinates (D - D_i) / 2 + 1 of a fingerprint as two-bit numbers: for each pair of
    neighbouring bits, how many of them differ from the reference."""
    x = fp.bitwiseXOR(F.lit(_pivots(1)[0]))
    low = x.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x5555555555555555))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _steps(cell: Column) -> Column:
    """The cells one step away: a coordinate of 0 or 1 swaps its low bit, one of 1 or 2 both bits."""
    low = F.array(*[F.lit(1 << 2 * i) for i in range(32)])
    both = F.array(*[F.lit(_signed(3 << 2 * i)) for i in range(32)])
    return F.concat(
        F.transform(F.filter(low, lambda m: cell.bitwiseAND(F.shiftleft(m, 1)) == 0), lambda m: cell.bitwiseXOR(m)),
        F.transform(F.filter(both, lambda m: cell.bitwiseAND(m) != 0), lambda m: cell.bitwiseXOR(m)),
    )


def _cells(fp: Column, bits: int) -> Column:
    """The cell of a fingerprint and all within ceil(bits / 2) steps of it."""
    found = F.array(pivot_cell(fp))
    for _ in range((bits + 1) // 2):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, _steps))))
    return found


def _coordinates_near(bits: int) -> Column:
    """The largest coordinate difference of the two pivot rows is at most ``bits``."""
    near = None
    for j in range(PIVOTS):
        a, b = (F.shiftrightunsigned(F.col(c), 8 * j).bitwiseAND(F.lit(255)) for c in ("a_table", "b_table"))
        one = F.abs(a - b) <= bits
        near = one if near is None else near & one
    return near


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v) of all pairs of the distinct fingerprints (column fp) at Hamming distance <=
    ``bits``; a pair is named once per cell where it meets. Both sides of the join are one shuffle of
    (cell, fp, pivots); pairs that share their own cell are taken from that one alone."""
    table = None
    for j, p in enumerate(_pivots(1 + PIVOTS)[1:]):
        d = F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * j)
        table = d if table is None else table.bitwiseOR(d)
    rows = distinct.select("fp", table.alias("pivots"), F.explode(_cells(F.col("fp"), bits)).alias("cell"))
    a = rows.select("cell", F.col("fp").alias("u"), F.col("pivots").alias("a_table"))
    b = rows.select("cell", F.col("fp").alias("v"), F.col("pivots").alias("b_table"))
    home = pivot_cell(F.col("u"))
    return (
        a.join(b, "cell")
        .where(F.col("u") < F.col("v"))
        .where((home != pivot_cell(F.col("v"))) | (home == F.col("cell")))
        .where(_coordinates_near(bits))
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
        .select("u", "v")
    )


def simhash_near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2
) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id (smallest id
    reachable by links at Hamming distance <= ``bits``, itself included).

    Null and empty texts have fingerprint zero, which links like any other. Rows with a null id take
    part with their text; their component_id is the smallest id of the component, null if none has
    an id. Repeated rows are returned as often as they occur. An empty table gives an empty result;
    other columns are ignored.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("id")))
    roots = connected_components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_fp = cut_lineage(rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id"))
    return fps.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
