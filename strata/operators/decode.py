"""Multi-step decoding against a transition table.

The next-token distribution comes from a table ``(context, token, lo, hi)`` — here bigram counts
of a corpus (R8; longer contexts with back-off in ``operators.ngram``) — instead of a model call. A table of a checked size is copied to every machine, where each task
decodes its sequences to the end; a larger one is packed into parts, to which the *open* sequences are
sent step by step, finished ones leaving the frontier. The frontier is written to the cluster's
checkpoint folder every few steps (reliable: a lost executor does not lose it), so the plan does not
grow with the step count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.hashing import TWO_POW_52, keyed_uniform
from strata.functions.text import WS_CHARS
from strata.operators.distribution import cdf, shape
from strata.operators.lookup import cell_of
from strata.operators.sampling import DEFAULT_SEED, MIN_PROB, iid_points, lattice_points, renormalise
from strata.operators.shared_table import Lookup, SharedTable, share_table
from strata.session import cut_lineage, settle
from strata.sources.tables import spread

# End-of-sequence marker of the bigram table (a fixed value of our table format).
END_TOKEN = "</s>"


def words(text) -> F.Column:
    """Lower-cased whitespace-separated words of a text, empties dropped (the whole text)."""
    # one kind of blank, which split finds without a regular expression
    blank = F.translate(F.lower(text), WS_CHARS, " " * len(WS_CHARS))
    return F.filter(F.split(blank, " "), lambda w: w != F.lit(""))


def bigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(context, token, cnt) over every adjacent word pair of every document; the last word
    of a document is followed by the end marker. Pairs are generated inside each row (no window,
    no shuffle) and counted with a partially aggregated ``groupBy``."""
    w = spread(docs.select(text)).select(words(F.col(text)).alias("w"))
    nxt = F.concat(F.slice("w", 2, F.size("w")), F.array(F.lit(END_TOKEN)))
    pairs = w.select(F.explode(F.arrays_zip(F.col("w").alias("context"), nxt.alias("token"))).alias("p")).select(
        "p.context", "p.token"
    )
    # a text without words; a filter on the words would make Spark split every text twice
    pairs = pairs.where("context IS NOT NULL")
    return pairs.groupBy("context", "token").agg(F.count(F.lit(1)).alias("cnt"))


def bigram_table(docs: DataFrame, text: str = "text", contexts: DataFrame | None = None) -> DataFrame:
    """R8 + W2: bigram counts with their CDF interval per context in token order. ``contexts``
    (column ``context``) keeps only the contexts that a one-step lookup will ask for."""
    counts = bigram_counts(docs, text)
    if contexts is not None:
        counts = counts.join(contexts.select("context").distinct(), "context", "left_semi")
    return cdf(counts, ["context"], weight="cnt", token="token")


#: Weights of a shaped table are whole multiples of 2^-30 of the largest.
WEIGHT_UNITS = 1 << 30


def shaped_bigram_table(
    docs: DataFrame, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, text: str = "text"
) -> DataFrame:
    """R6 in R7 and R9: the bigram table after temperature, top-k and top-p, a pair's logit being
    the logarithm of its count. The distribution of a context is the same at every step, so it is
    shaped once for both arms. Weights become integers (at least 1): their running sums are exact, so
    the intervals do not depend on the order of summation, which a lattice point, rescaled at every
    step, would otherwise magnify to another token after some ten steps."""
    # the counts are read several times
    logits = settle(bigram_counts(docs, text)).withColumn("logit", F.log("cnt"))
    shaped = shape(logits, ["context"], temperature=temperature, top_k=top_k, top_p=top_p, normalize=False)
    units = F.greatest(F.round(F.col("weight") * F.lit(float(WEIGHT_UNITS))).cast("long"), F.lit(1))
    return cdf(shaped.withColumn("weight", units), ["context"], weight="weight", token="token").select("context", "token", "lo", "hi")


METHODS = ("lattice", "iid")
#: Most tokens of a completion (the reference's default).
MAX_NEW_TOKENS = 256
#: Largest table, in rows (12 bytes each) and in different names, that every machine is given a copy of.
LOCAL_ROWS = 1 << 27
LOCAL_NAMES = 1 << 24
#: Sequences that a task decodes together, about, and hands on together.
TASK_SEQUENCES = 1 << 15
OUT_SEQUENCES = 1 << 12
#: Steps between two writes of the frontier when the table stays distributed.
STEPS_PER_CHECKPOINT = 4
#: Rows of a context beyond which it is cut into cells, and rows of a part, in a distributed table.
CELL_ROWS = 4096
PART_ROWS = 1 << 18


def decode(
    prompts: DataFrame,
    dist: DataFrame,
    *,
    num_samples: int,
    max_steps: int = MAX_NEW_TOKENS,
    method: str = "lattice",
    seed: int = DEFAULT_SEED,
    eos: Sequence[str] = (END_TOKEN,),
    checkpoint_every: int = STEPS_PER_CHECKPOINT,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """``decode_arms`` for one method, without the column ``arm``."""
    arms = decode_arms(
        prompts, dist, num_samples=num_samples, max_steps=max_steps, methods=(method,), seed=seed, eos=eos,
        checkpoint_every=checkpoint_every, local_rows=local_rows,
    )
    return arms.drop("arm")


def decode_arms(
    prompts: DataFrame,
    dist: DataFrame,
    *,
    num_samples: int,
    max_steps: int = MAX_NEW_TOKENS,
    methods: Sequence[str] = METHODS,
    seed: int = DEFAULT_SEED,
    eos: Sequence[str] = (END_TOKEN,),
    checkpoint_every: int = STEPS_PER_CHECKPOINT,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Decode ``num_samples`` sequences per prompt and method until an end marker.

    ``prompts``: (group_id, context[, max_tokens]) — the context is the prompt's last token, and
    ``max_tokens`` bounds this prompt's steps (as ``max_steps`` bounds all; 0 gives empty completions).
    ``dist``: (context, token, lo, hi[, next]) — ``next`` is the context that follows a row (see
    ``operators.ngram``), the token itself without it.
    ``methods``: ``lattice`` (one shared shift per group, code point renormalised each step) and
    ``iid`` (a fresh keyed uniform per group, sample and step); all are decoded together.
    Output: (arm, group_id, g, out ARRAY<STRING> up to and including EOS, finished BOOLEAN, steps INT).

    The table is counted first. Up to ``local_rows`` rows (half as many with ``next``) every machine is given a
    copy (see ``operators.shared_table``) and each task decodes its sequences to the end by binary search, without a
    shuffle. A larger table, or one of more than ``LOCAL_NAMES`` names, stays where it is: see ``_decode_by_parts``. Both give the same tokens. A lattice point that has used up the bits
    of its double goes on with what renormalisation leaves.
    """
    if not methods or any(m not in METHODS for m in methods):
        raise ValueError("methods must be 'lattice' or 'iid'")
    G = int(num_samples)
    limit = F.lit(int(max_steps))
    if "max_tokens" in prompts.columns:
        limit = F.least(limit, F.coalesce(F.col("max_tokens").cast("int"), limit))
    start = lattice_points(prompts, "group_id", G, seed)
    start = start.select(
        F.explode(F.array(*[F.lit(m) for m in methods])).alias("arm"), "group_id", "g", "c", F.col("context").alias("cur"),
        limit.alias("limit"),
    )
    if max_steps <= 0:
        empty = F.array().cast(T.ArrayType(T.StringType()))
        return start.select("arm", "group_id", "g", empty.alias("out"), F.lit(False).alias("finished"), F.lit(0).alias("steps"))
    leads = ["next"] if "next" in dist.columns else []
    bounds = [F.col(x).cast("double").alias(x) for x in ("lo", "hi")]
    wide = settle(dist.select("context", "token", *bounds, *leads).where("hi > lo"))
    rows = wide.count()
    if rows <= local_rows // (1 + len(leads)) and (table := share_table(wide, rows, LOCAL_NAMES)):
        return _decode_in_tasks(start, table, seed, list(eos))
    return _decode_by_parts(start, wide, rows, seed, list(eos), int(max_steps), int(checkpoint_every))


def _search(first: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of each context (rows of context k are first[k]..first[k + 1], by ``hi``) whose interval
    holds ``c``; -1 where there is none."""
    known = context >= 0
    low, end = first[np.where(known, context, 0)], first[np.where(known, context, 0) + 1]
    high = end.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        right = open_ & (hi[np.minimum(mid, len(hi) - 1)] < c)
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    at = np.minimum(low, len(hi) - 1)
    held = known & (low < end) & ((c > lo[at]) | ((c <= 0) & (lo[at] <= 0)))
    return np.where(held, low, -1)


def _uniforms(seed: int, keys: np.ndarray, step: int) -> np.ndarray:
    """``functions.hashing.keyed_uniform`` of (seed, group, g, step); ``keys`` are "seed:group:g:" as bytes."""
    end = str(step).encode()
    words = b"".join([hashlib.md5(k + end).digest()[:8] for k in keys])
    return (np.frombuffer(words, dtype=">u8") >> 12).astype(np.float64) / TWO_POW_52


def _decode_in_tasks(start: DataFrame, table: SharedTable, seed: int, eos: list[str]) -> DataFrame:
    """Every task decodes its own sequences to the end; the table is on its machine."""
    kind = start.schema["group_id"].dataType.simpleString()

    def decoded(b: pa.Table, t: Lookup) -> Iterator[pa.RecordBatch]:
        n, limit = b.num_rows, b.column("limit").to_numpy()
        fresh = pc.equal(b.column("arm"), "iid").to_numpy()
        keys = np.array([k.encode() for k in b.column("key").to_pylist()], dtype=object)
        c = b.column("c").to_numpy().copy()
        cur = t.numbers(b.column("cur"))
        ends = t.numbers(pa.chunked_array([pa.array(eos, pa.string())]))
        finished = np.zeros(n, dtype=bool)
        said: list[tuple[np.ndarray, np.ndarray]] = []  # sequences and their tokens, step by step
        active, step = np.flatnonzero(limit > 0), 0
        while len(active):
            drawn = active[fresh[active]]
            c[drawn] = _uniforms(seed, keys[drawn], step)
            hit, lo, hi, token, lead = t.find(cur[active], c[active])
            missed = np.ones(len(active), dtype=bool)
            missed[hit] = False
            finished[active[missed]] = True
            active = active[hit]
            c[active] = np.minimum(np.maximum((c[active] - lo) / np.maximum(hi - lo, MIN_PROB), 0.0), 1.0)
            said.append((active.astype(np.int32), token))
            cur[active] = lead
            ended = np.isin(token, ends)
            finished[active] = ended
            step += 1
            active = np.sort(active[~ended & (limit[active] > step)])
        owner = np.concatenate([x for x, _ in said]) if said else np.zeros(0, dtype=np.int32)
        order = np.argsort(owner, kind="stable")
        tokens = (np.concatenate([x for _, x in said]) if said else np.zeros(0, dtype=np.int32))[order]
        ends_at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        rest = [b.column(x).combine_chunks() for x in ("arm", "group_id", "g")]
        for i in range(0, n, OUT_SEQUENCES):
            j = min(i + OUT_SEQUENCES, n)
            words_said = t.names.take(pa.array(tokens[ends_at[i] : ends_at[j]]))
            out = pa.ListArray.from_arrays((ends_at[i : j + 1] - ends_at[i]).astype(np.int32), words_said)
            parts = [x.slice(i, j - i) for x in rest]
            yield pa.RecordBatch.from_arrays([*parts, out, pa.array(finished[i:j])], ["arm", "group_id", "g", "out", "finished"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, kept, n = table.open(), [], 0
        for b in batches:
            kept, n = [*kept, b], n + b.num_rows
            if n >= TASK_SEQUENCES:
                yield from decoded(pa.Table.from_batches(kept).combine_chunks(), t)
                kept, n = [], 0
        if n:
            yield from decoded(pa.Table.from_batches(kept).combine_chunks(), t)

    # the key of a fresh draw, and points in as many partitions as there are slots
    key = F.concat_ws(":", F.lit(str(seed)), F.col("group_id").cast("string"), F.col("g").cast("string"), F.lit(""))
    rows = spread(start).select("arm", "group_id", "g", F.col("c").cast("double"), "cur", key.alias("key"), "limit")
    found = rows.mapInArrow(run, f"arm string, group_id {kind}, g int, out array<string>, finished boolean")
    return found.withColumn("steps", F.size("out").cast("int"))


def _pack(group: pa.Table) -> pa.Table:
    """The rows of one part, sorted by (place, hi), as one value that a task reads without a copy."""
    t = group.combine_chunks()
    place, token = (t.column(x).chunk(0).dictionary_encode() for x in ("place", "token"))
    lead = t.column("next").chunk(0).dictionary_encode() if "next" in t.column_names else token
    at, hi, lo = place.indices.to_numpy(), t.column("hi").to_numpy(), t.column("lo").to_numpy()
    order = np.lexsort((hi, at))
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(place.dictionary)))])
    cells = np.ones(len(lead.dictionary))
    cells[lead.indices.to_numpy()] = t.column("lead_cells").to_numpy()
    lo, hi, token_at = lo[order], hi[order], token.indices.to_numpy()[order]
    columns = {"places": place.dictionary, "first": first, "hi": hi, "token": token_at, "tokens": token.dictionary, "cells": cells}
    columns["start"] = lo[first[:-1]]
    follows = np.ones(len(lo), dtype=bool)
    follows[first[:-1]] = False
    if not np.array_equal(lo[follows], hi[np.flatnonzero(follows) - 1]):  # else a row begins where the one before it ends
        columns["lo"] = lo
    if lead is not token:
        columns |= {"lead": lead.indices.to_numpy()[order], "leads": lead.dictionary}
    row = pa.RecordBatch.from_pydict({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema) as out:
        out.write_batch(row)
    return pa.table({"part": t.column("part").slice(0, 1), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _placed_once(df: DataFrame, tasks: int, key: str) -> DataFrame:
    """A checkpoint of ``df`` by ``key`` that Spark knows to be so. An adaptive plan does not tell how
    its result is partitioned, and the parts would be shuffled again at every step."""
    conf, adaptive = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(adaptive)
    rows = settle(df)
    try:
        conf.set(adaptive, "false")
        return cut_lineage(rows.repartition(tasks, key).sortWithinPartitions(key))
    finally:
        conf.set(adaptive, before)


def _look(asked: pa.Table, part: pa.Table) -> pa.Table:
    """The points of one part with lo, hi, token, lead and lead_cells of the rows that hold them."""
    found = {"lo": pa.float64(), "hi": pa.float64(), "token": pa.string(), "lead": pa.string(), "lead_cells": pa.float64()}
    if not asked.num_rows or not part.num_rows:
        for name, kind in found.items():
            asked = asked.append_column(name, pa.nulls(asked.num_rows, kind))
        return asked
    t = {f: c.chunk(0).values for f, c in zip(*(lambda x: (x.column_names, x.columns))(pa.ipc.open_stream(part.column("rows")[0].as_buffer()).read_all()))}
    first, hi, token, cells = (t[x].to_numpy() for x in ("first", "hi", "token", "cells"))
    lead, leads = (t["lead"].to_numpy(), t["leads"]) if "lead" in t else (token, t["tokens"])
    if "lo" in t:
        lo = t["lo"].to_numpy()
    else:
        lo = np.concatenate([[0.0], hi[:-1]])
        lo[first[:-1]] = t["start"].to_numpy()
    place = pc.fill_null(pc.index_in(asked.column("place").combine_chunks(), value_set=t["places"]), -1).to_numpy(zero_copy_only=False)
    c = pc.fill_null(asked.column("c"), float("nan")).to_numpy()
    row = _search(first, lo, hi, place, c)
    none = row < 0
    row = np.where(none, 0, row)
    values = (
        pa.array(lo[row], mask=none), pa.array(hi[row], mask=none), t["tokens"].take(pa.array(token[row], mask=none)),
        leads.take(pa.array(lead[row], mask=none)), pa.array(cells[lead[row]], mask=none),
    )
    for name, value in zip(found, values, strict=True):
        asked = asked.append_column(name, value)
    return asked


def _decode_by_parts(start: DataFrame, wide: DataFrame, rows: int, seed: int, eos: list[str], max_steps: int, every: int) -> DataFrame:
    """The table stays distributed: packed once into parts by (context, cell), which the points are sent to.

    The unit interval of a context of more than ``CELL_ROWS`` rows is cut into cells, as in
    ``operators.lookup``, so that neither its rows nor its points meet in one part. Every row names the
    cells of the context that follows it. A step moves the open sequences alone and searches a part in
    memory; the parts keep their place.

    The frontier is narrow (one row per open sequence: its code point, its last token and the tokens of
    the last ``every`` steps). Every ``every`` steps it is written to the checkpoint folder; that file is
    at the same time the log of these steps, so a token is written once and the bytes grow with the
    tokens, not with their square. The logs are put together by sequence at the end."""
    spark = start.sparkSession
    leads = "next" if "next" in wide.columns else "token"
    wide = wide.where("context IS NOT NULL AND token IS NOT NULL")
    levels = F.ceil(F.log2(F.col("n") / F.lit(float(CELL_ROWS))))
    large = wide.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS)
    large = settle(large.select(F.col("context").alias("_large"), F.pow(F.lit(2.0), levels).alias("_cells")))

    def celled(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.join(large, F.col(key) == F.col("_large"), "left").withColumn(out, F.coalesce("_cells", F.lit(1.0))).drop("_large", "_cells")

    def placed(cell: Column, context: Column) -> Column:
        return F.concat(cell.cast("string"), F.lit(" "), context)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (4 * PART_ROWS)))
    parts = F.lit(4 * tasks)
    listed = celled(wide, "context", "cells").withColumn("cell", F.explode(F.sequence(cell_of(F.col("lo"), F.col("cells")), cell_of(F.col("hi"), F.col("cells")))))
    listed = celled(listed, leads, "lead_cells").withColumn("place", placed(F.col("cell"), F.col("context")))
    kept = ["place", "lo", "hi", *dict.fromkeys(["token", leads]), "lead_cells"]
    listed = listed.select(F.pmod(F.xxhash64("place"), parts).cast("int").alias("part"), *kept)
    packed = listed.repartition(tasks, "part").groupBy("part").applyInArrow(_pack, "part int, rows binary")
    table = _placed_once(packed, tasks, "part").groupBy("part")

    # a row has a number of its own: neither its group nor its sample need be unique
    start = settle(start.withColumn("id", F.monotonically_increasing_id()))
    key = F.concat_ws(":", F.col("group_id").cast("string"), F.col("g").cast("string"))
    none_yet = F.array().cast(T.ArrayType(T.StringType()))
    front = celled(start, "cur", "cells").select(
        "id", (F.col("arm") == "iid").alias("fresh"), key.alias("key"), F.col("c").cast("double").alias("c"), "cur", "cells", "limit",
        none_yet.alias("recent"), (F.col("limit") > 0).alias("open"), F.lit(False).alias("finished"),
    )
    logs, step = [], 0
    while step < max_steps:
        first = step
        for step in range(first, min(first + every, max_steps)):
            point = F.when(F.col("fresh"), keyed_uniform(seed, "key", F.lit(step))).otherwise(F.col("c"))
            asked = front.withColumn("c", point)
            asked = asked.withColumn("place", F.when(F.col("open"), placed(cell_of(F.col("c"), F.col("cells")), F.col("cur"))))
            number = F.when(F.col("place").isNotNull(), F.xxhash64("place")).otherwise(F.xxhash64("id"))
            asked = asked.select(F.pmod(number, parts).cast("int").alias("part"), "place", *front.columns)
            kinds = ", ".join(f"{n} {k}" for n, k in asked.dtypes)
            hit = asked.groupBy("part").cogroup(table).applyInArrow(_look, f"{kinds}, lo double, hi double, token string, lead string, lead_cells double")
            none, token = F.col("token").isNull(), F.col("token")
            ended = F.col("open") & (none | token.isin(*eos))
            front = hit.select(
                "id", "fresh", "key",
                F.coalesce(renormalise(F.col("c"), F.col("lo"), F.col("hi")), F.col("c")).alias("c"),
                F.coalesce("lead", "cur").alias("cur"),
                F.coalesce("lead_cells", "cells").alias("cells"),
                "limit",
                F.when(none, F.col("recent")).otherwise(F.array_append("recent", token)).alias("recent"),
                (F.col("open") & ~ended & (F.col("limit") > step + 1)).alias("open"),
                (F.col("finished") | ended).alias("finished"),
            )
        step += 1
        front = settle(front)
        logs.append(front.select("id", F.lit(first).alias("at"), "recent", "finished"))
        front = front.where("open").withColumn("recent", none_yet)
        if front.isEmpty():  # A12: every sequence has finished
            break
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    whole = log.groupBy("id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "recent"))), lambda x: x["recent"])).alias("out"),
        F.max("finished").alias("finished"),
    )
    return start.join(whole, "id").select("arm", "group_id", "g", "out", "finished", F.size("out").cast("int").alias("steps"))


# Share of a document's words, in percent, that a decode has to continue to (rounded down).
TAIL_PERCENT = 10


def split_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tail_percent: int = TAIL_PERCENT) -> DataFrame:
    """(group_id, head ARRAY, tail ARRAY): each document with at least one word, its words split
    into the prompt (never empty) and the whole rest."""
    w = docs.select(F.col(id_col).alias("group_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n_tail = F.floor(F.size("w") * tail_percent / 100).cast("int")
    head = F.slice("w", 1, F.size("w") - n_tail)
    return w.select("group_id", head.alias("head"), F.slice("w", F.size("w") - n_tail + 1, n_tail).alias("tail"))


def document_prompts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(group_id, context): the context of a document is the last word of its head."""
    return split_documents(docs, text, id_col).select("group_id", F.element_at("head", -1).alias("context"))


def continuation_prompts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``document_prompts`` with ``max_tokens``, so that a completion can reach the end of the tail:
    its words and the end marker."""
    parts = split_documents(docs, text, id_col)
    return parts.select("group_id", F.element_at("head", -1).alias("context"), (F.size("tail") + 1).alias("max_tokens"))


def diversity(decoded: DataFrame, num_samples: int) -> DataFrame:
    """R11 (+ A5-A7): per arm, mean unique completions per prompt and the duplicate rate."""
    per = decoded.groupBy("arm", "group_id").agg(F.count_distinct(F.array_join("out", " ")).alias("n_unique"))
    return per.groupBy("arm").agg(
        F.count(F.lit(1)).cast("long").alias("num_prompts"),
        (F.sum("n_unique") / F.count(F.lit(1))).alias("avg_unique_completions"),
    ).withColumn("duplicate_rate", F.lit(1.0) - F.col("avg_unique_completions") / F.lit(float(max(num_samples, 1))))


#: Generation batches that are sent to a Python worker at once.
BATCHES_PER_GROUP = 64
#: Such groups that one task is given, about.
GROUPS_PER_TASK = 16
GeneratorFn = Callable[[pd.DataFrame], pd.DataFrame]


def generate_batch(prompts: DataFrame, fn: GeneratorFn, schema: str | T.StructType) -> DataFrame:
    """Run a user generator over Arrow batches of prompts (``mapInPandas``).

    ``fn`` maps a pandas frame of prompts to a frame of completions with ``schema``; Spark feeds
    each task its partition's batches, so generation scales with the partitions of ``prompts``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return prompts.mapInPandas(run, schema)


def generate_batches(
    prompts: DataFrame,
    fn: GeneratorFn,
    schema: str | T.StructType,
    *,
    batch_size: int,
    log: str | None = None,
    batches_per_commit: int = 256,
    slice_start: int = 0,
) -> DataFrame:
    """R15 / X5 + W6: run a user generator over whole generation batches.

    ``prompts`` has a column ``prompt_id`` (the ordinal); consecutive prompts from ``slice_start`` on form
    a batch of ``batch_size``, as in ``evaluate``. Up to ``BATCHES_PER_GROUP`` consecutive batches form an Arrow
    group, whose batches ``fn`` is called with one by one, each in the order of its prompts:
    ``fn`` sees all of it at once, wherever its rows were, so padding to the longest prompt means the
    same as in the run that is reproduced. ``fn`` returns rows of ``schema``; ``batch_id`` is added.

    With ``log`` (a folder on storage that the cluster shares) the rows are appended there by batch
    number, ``batches_per_commit`` batches at a time; a commit of Spark's writer is all or nothing, so a
    batch is in the log with all its rows or not at all. Another run with the same log generates the
    missing batches only. The result is then the log."""
    numbered = prompts.withColumn("batch_id", F.floor((F.col("prompt_id") - F.lit(slice_start)) / F.lit(int(batch_size))).cast("long"))
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([T.StructField("batch_id", T.LongType()), *out.fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns="_group").sort_values(["batch_id", "prompt_id"], kind="stable")
        number = group.pop("batch_id").to_numpy()
        ends = [*(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
        made = [fn(group.iloc[a:b].reset_index(drop=True)).assign(batch_id=int(number[a])) for a, b in zip([0, *ends], ends)]
        return pd.concat(made, ignore_index=True)[full.fieldNames()]

    spark = prompts.sparkSession

    def made(part: DataFrame, batches: int) -> DataFrame:
        # a generator costs time, not bytes: tasks by the number of groups, which adaptive execution keeps
        each = max(min(BATCHES_PER_GROUP, batches // (2 * slots)), 1)
        tasks = max(-(-batches // (each * GROUPS_PER_TASK)), slots)
        grouped = part.withColumn("_group", F.floor(F.col("batch_id") / F.lit(each)))
        return grouped.repartition(tasks, "_group").groupBy("_group").applyInPandas(run, full)

    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if log is None:
        return made(numbered, -(-numbered.count() // int(batch_size)))
    try:
        done = spark.read.schema(full).parquet(log).select("batch_id").distinct()
        numbered = numbered.join(done, "batch_id", "left_anti")
    except AnalysisException:  # no log yet
        pass
    # fixed before the first append, which the anti join would otherwise see
    left = cut_lineage(numbered)
    ends = left.agg(F.min("batch_id"), F.max("batch_id")).first()
    if ends[0] is not None:
        for first in range(ends[0], ends[1] + 1, batches_per_commit):
            part = left.where((F.col("batch_id") >= first) & (F.col("batch_id") < first + batches_per_commit))
            made(part, batches_per_commit).write.mode("append").parquet(log)
    return spark.read.schema(full).parquet(log)


__all__ = [
    "END_TOKEN",
    "bigram_counts",
    "bigram_table",
    "continuation_prompts",
    "decode",
    "decode_arms",
    "diversity",
    "document_prompts",
    "generate_batch",
    "generate_batches",
    "iid_points",
    "shaped_bigram_table",
    "split_documents",
]
