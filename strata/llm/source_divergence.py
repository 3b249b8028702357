"""Source divergence audit with in-mapper stripes.

How far the word use of each source departs from the other sources of its language, and by which
terms. Three steps:

1. *Fold.* Each task folds whole documents into hash stripes: (language, term) to its document
   frequency and the counts per source. A task's stripes are written out ("spilled") and started anew
   when they hold ``CELLS`` cells, so memory is bounded however many terms there are; a source is
   named by an empty stripe, so one without terms counts too.
2. *Merge.* The spills are placed by a hash of (language, term) and sorted inside each partition, so a
   term's stripes meet as neighbours and are added up one after the other. Before the shuffle a term
   is one row per task and spill, whatever its frequency. Terms in too few documents go; the rest are
   packed into blocks of at most ``BLOCK`` stripes of one language and written.
3. *Emit.* The totals per source (from the blocks) come to the blocks by a join on the language; a
   block turns its stripes straight into divergence sums per pair of sources and into the top terms
   of each source. Sums per pair are added by Spark (one row per block and pair before), the top terms
   are cut again by a window with partial limits.

Shares are p = 1 + floor(10^9 (count + 1) / (total + V)) for V kept terms of the language, and the
divergence of p from q on a term is floor((p - q)^2 / q). All of it is integer arithmetic: shares are
at most 10^9 + 1, so squares fit in 64 bits, and so do their sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage

MIN_DOCS, TOP = 3, 200
SCALE = 10**9
#: Cells (term, source) that a task's stripes hold before they are written out.
CELLS = 400_000
#: Stripes of a block.
BLOCK = 2048

#: Bytes of UTF-8 text: A-Z to lower case, other ASCII that is no letter to a space, the rest as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

_STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_BLOCK = (
    "lang string, terms array<string>, sizes array<int>, codes array<int>, counts array<long>, "
    "block_sources array<string>, block_sums array<long>"
)
_OUT = "lang string, source string, part string, item string, value long"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters and non-ASCII characters, A-Z in lower case, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Stripes:
    """Per language: term to [document frequency, {source: count}]."""

    def __init__(self):
        self.held: dict[str, dict[bytes, list]] = {}
        self.cells = 0

    def fold(self, lang: str, source: str, text: str | None) -> None:
        held = self.held.setdefault(lang, {})
        new = 0
        held.setdefault(b"", [0, {}])[1].setdefault(source, 0)
        for term, n in Counter(terms_of(text)).items():
            stripe = held.get(term)
            if stripe is None:
                held[term] = [1, {source: n}]
                new += 1
                continue
            stripe[0] += 1
            counts = stripe[1]
            if source in counts:
                counts[source] += n
            else:
                counts[source] = n
                new += 1
        self.cells += new

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The stripes as batches; afterwards none are held."""
        items = [(lang, term, stripe) for lang, held in self.held.items() for term, stripe in held.items()]
        self.held, self.cells = {}, 0
        for i in range(0, len(items), 16_384):
            part = items[i : i + 16_384]
            ends = np.cumsum([0, *(len(s[1]) for _, _, s in part)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in part], pa.string()),
                    pa.array([k for _, k, _ in part], pa.binary()).cast(pa.string()),
                    pa.array([s[0] for _, _, s in part], pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array([x for _, _, s in part for x in s[1]], pa.string())),
                    pa.ListArray.from_arrays(ends, pa.array([x for _, _, s in part for x in s[1].values()], pa.int64())),
                ],
                ["lang", "term", "df", "sources", "counts"],
            )


def term_stripes(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Step 1: (lang, term, df, sources, counts), a row per task, spill and term; the empty term has
    the sources that occur. Null languages, sources and texts are read as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for b in batches:
            for lang, source, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
                stripes.fold(lang.as_py(), source.as_py(), text.as_py())
                if stripes.cells >= cells:
                    yield from stripes.spill()
        yield from stripes.spill()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*text).mapInArrow(run, _STRIPE)


class _Merged:
    """Consecutive stripes added up by (lang, term), in arrays: the cells of term i lie side by side."""

    def __init__(self, b: pa.RecordBatch):
        lang, term = b.column(0), b.column(1)
        new = np.ones(b.num_rows, dtype=bool)
        if b.num_rows > 1:
            moved = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
            new[1:] = moved.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        self.langs, self.terms = lang.take(pa.array(at)), term.take(pa.array(at))
        self.df = np.add.reduceat(b.column(2).to_numpy(), at)
        held = b.column(3).flatten().dictionary_encode()
        self.names = held.dictionary.to_pylist()
        group = np.repeat(np.cumsum(new) - 1, pc.list_value_length(b.column(3)).to_numpy())
        key = group * len(self.names) + held.indices.to_numpy().astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.counts = np.add.reduceat(b.column(4).flatten().to_numpy()[order], first)
        self.group, self.code = np.divmod(key[first], len(self.names))

    def last(self, schema: pa.Schema) -> pa.RecordBatch:
        """The last stripe as a row: it may go on in the next batch."""
        n = len(self.df) - 1
        mine = self.group == n
        sources = [[self.names[c] for c in self.code[mine].tolist()]]
        cols = [self.langs[n:], self.terms[n:], self.df[n:], sources, [self.counts[mine].tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


class _Block:
    """Merged stripes of one language on their way into a row."""

    def __init__(self, lang: str):
        self.lang, self.number = lang, {}
        self.terms: list[str] = []
        self.sizes, self.codes, self.counts = [], [], []

    def add(self, m: _Merged, groups: np.ndarray, kept: bool) -> None:
        """The stripes ``groups`` (ascending) of ``m``; if not ``kept``, only their sources."""
        mine = np.isin(m.group, groups)
        place = {c: self.number.setdefault(m.names[c], len(self.number)) for c in np.unique(m.code[mine]).tolist()}
        if kept:
            self.terms += m.terms.take(pa.array(groups)).to_pylist()
            self.sizes.append(np.bincount(np.searchsorted(groups, m.group[mine]), minlength=len(groups)))
            number = np.zeros(len(m.names), dtype=np.int64)
            number[list(place)] = list(place.values())
            self.codes.append(number[m.code[mine]])
            self.counts.append(m.counts[mine])

    def row(self) -> pa.RecordBatch:
        sizes, codes, counts = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (self.sizes, self.codes, self.counts))
        sums = np.zeros(len(self.number), dtype=np.int64)
        np.add.at(sums, codes, counts)
        cols = [self.lang, self.terms, sizes, codes, counts, list(self.number), sums]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
        names = ["lang", "terms", "sizes", "codes", "counts", "block_sources", "block_sums"]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], names)


def merged_blocks(stripes: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK) -> DataFrame:
    """Step 2: the stripes added up by (lang, term) and packed into blocks of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: pa.RecordBatch | None = None
        now: _Block | None = None

        def packed(m: _Merged, upto: int) -> Iterator[pa.RecordBatch]:
            """The first ``upto`` stripes go into their languages' blocks; full blocks come out."""
            nonlocal now
            langs = m.langs[:upto].to_pylist()
            bounds = [i for i in range(upto) if i == 0 or langs[i] != langs[i - 1]] + [upto]
            named = m.terms[:upto].to_numpy(zero_copy_only=False) == ""
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if now is not None and now.lang != langs[lo]:
                    yield now.row()
                    now = None
                now = now or _Block(langs[lo])
                here = np.arange(lo, hi)
                now.add(m, here[named[lo:hi]], kept=False)
                good = here[~named[lo:hi] & (m.df[lo:hi] >= min_docs)]
                while len(good):
                    room = block - len(now.terms)
                    now.add(m, good[:room], kept=True)
                    good = good[room:]
                    if len(now.terms) >= block:
                        yield now.row()
                        now = _Block(langs[lo])

        for b in batches:
            if not b.num_rows:
                continue
            if open_row is not None:
                b = pa.Table.from_batches([open_row, b.cast(open_row.schema)]).combine_chunks().to_batches()[0]
            m = _Merged(b)
            yield from packed(m, len(m.df) - 1)
            open_row = m.last(b.schema)
        if open_row is not None:
            yield from packed(_Merged(open_row), 1)
        if now is not None:
            yield now.row()

    placed = stripes.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return placed.mapInArrow(run, _BLOCK)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total) in 64 bits, for counts < total up to 9 * 10^13: the
    scale is multiplied in two steps, with the remainder of the first."""
    half = 10**5
    first, rest = np.divmod((counts + 1) * half, total)
    return 1 + first * (SCALE // half) + rest * (SCALE // half) // total


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _emit(row: dict, top: int) -> Iterator[tuple[list[str], str, list[str], list[int]]]:
    """(sources, part, items, values) of one block; ``totals`` are those of its language."""
    names = [t["source"] for t in row["totals"]]
    sums = np.array([t["n"] for t in row["totals"]], dtype=np.int64)
    place = {s: i for i, s in enumerate(names)}
    code = np.array([place[s] for s in row["block_sources"]], dtype=np.int64)
    sizes = np.array(row["sizes"], dtype=np.int64)
    at_term, at_source = np.repeat(np.arange(len(sizes)), sizes), code[np.array(row["codes"], dtype=np.int64)]
    counts = np.array(row["counts"], dtype=np.int64)
    vocabulary = row["vocabulary"]

    whole = np.zeros(len(sizes), dtype=np.int64)
    np.add.at(whole, at_term, counts)
    q_lang = shares(whole, np.int64(sums.sum() + vocabulary))
    p_here = shares(counts, sums[at_source] + vocabulary)
    value = _divergence(p_here, q_lang[at_term])
    above = p_here > q_lang[at_term]
    terms = row["terms"]
    by_source: dict[int, list[tuple[int, bytes, int]]] = {}
    for s, t, v in zip(at_source[above].tolist(), at_term[above].tolist(), value[above].tolist(), strict=True):
        by_source.setdefault(s, []).append((-v, terms[t].encode(), t))
    for s, found in by_source.items():
        found.sort()
        best = found[:top]
        yield [names[s]] * len(best), "term", [terms[t] for _, _, t in best], [-v for v, _, _ in best]

    if not len(sizes):
        return
    at_once = max(1, (1 << 20) // max(1, len(names)))  # rows of the table of shares worked on together
    for lo in range(0, len(sizes), at_once):
        hi = min(lo + at_once, len(sizes))
        table = np.zeros((hi - lo, len(names)), dtype=np.int64)
        mine = (at_term >= lo) & (at_term < hi)
        table[at_term[mine] - lo, at_source[mine]] = counts[mine]
        p = shares(table, sums[None, :] + vocabulary)
        for s in range(len(names)):
            total = _divergence(p[:, s : s + 1], p).sum(axis=0)
            others = [i for i in range(len(names)) if i != s]
            yield [names[s]] * len(others), "pair", [names[i] for i in others], total[others].tolist()


def _block_divergences(blocks: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Step 3 before the sums: (lang, source, part, item, value) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                for sources, part, items, values in _emit(row, top):
                    n = len(items)
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["lang"]] * n, pa.string()), pa.array(sources, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())],
                            ["lang", "source", "part", "item", "value"],
                        )

    return blocks.join(totals, "lang").mapInArrow(run, _OUT)


def source_divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    cells: int = CELLS,
    block: int = BLOCK,
) -> DataFrame:
    """Columns lang, source, part, item, value, rank.

    Part ``pair``: the divergence of the source from each other source of its language, summed over
    the language's kept terms (those in ``min_docs`` documents or more; without any, 0). Part
    ``term``: the ``top`` terms that the source uses more than its language does. Ranks run from 1 per
    (lang, source, part) by value downwards, then by item in UTF-8 order.

    Null languages, sources and texts are read as ''; a text counts whole, whatever its length.
    Repeated rows count as often as they occur, ids are not read. An empty table gives an empty
    result; other columns, whatever their names, are ignored. The result has a row per ordered pair
    of sources of a language; a task holds one language's totals, a row per source."""
    blocks = cut_lineage(merged_blocks(term_stripes(docs, lang_col, source_col, text_col, cells), min_docs, block))
    per_source = blocks.select("lang", F.explode(F.arrays_zip("block_sources", "block_sums")).alias("x"))
    per_source = per_source.groupBy("lang", F.col("x.block_sources").alias("source")).agg(F.sum("x.block_sums").alias("n"))
    known = blocks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("vocabulary"))
    lists = per_source.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("totals"))
    totals = cut_lineage(lists.join(known, "lang"))
    found = cut_lineage(_block_divergences(blocks.where(F.size("terms") > 0), totals, top))

    zero = totals.where("vocabulary = 0").select("lang", "totals", F.explode("totals.source").alias("source"))
    zero = zero.select("lang", "source", F.lit("pair").alias("part"), F.explode("totals.source").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").unionByName(zero.where("source <> item"))
    pairs = pairs.groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("long").alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(place))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
ns AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
nl AS (SELECT lang, sum(total) AS total FROM ns GROUP BY lang),
p AS MATERIALIZED (
  SELECT ns.lang, ns.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + {SCALE} * (coalesce(c.n, 0) + 1)::HUGEINT // (ns.total + v.v)::HUGEINT AS BIGINT) AS p
  FROM ns JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = ns.lang AND c.source = ns.source AND c.term = k.term),
q AS MATERIALIZED (
  SELECT lang, term, CAST(1 + {SCALE} * (n + 1)::HUGEINT // (total + v)::HUGEINT AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN nl USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value
          FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
