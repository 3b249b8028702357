"""Registered text, dataset, token-array and throughput queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import tokens as tk
from strata.functions.scoring import score_key, score_keys
from strata.functions.text import as_text, last_number, normalize, parse_number
from strata.operators import batching
from strata.operators.decode import words
from strata.plans import sql
from strata.session import cut_lineage
from strata.sources import dataset as ds
from strata.sources.tables import read_table, spread

# Parameters of the registered queries.
SLICE_START, SLICE_COUNT = 100, 500
SPLIT_FRACTIONS = {"train": (0.0, 0.5), "eval": (0.5, 1.0)}  # halves of the whole table
PROMPT_LEN = 4
EOS_IDS = (1, 7)  # a set: whichever comes first ends the sequence
PAD_ID = 0
SPECIAL_IDS = (1, 2)
MAX_PROMPT_IDS = 256
BATCH = 8


def _docs(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _docs_spread(spark, sf_dir) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def token_ids(text) -> F.Column:
    """Toy tokenizer of the token-array queries: one id per word, the id is the word's length."""
    return F.transform(words(text), lambda w: F.length(w))


def normalize_text(spark, sf_dir):
    return _docs_spread(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("norm"))


def last_number_q(spark, sf_dir):
    n = normalize(F.col("text"))
    return (
        _docs_spread(spark, sf_dir)
        .select("doc_id", last_number(n).alias("last_num"))
        .withColumn("value", parse_number(F.col("last_num")))
    )


def score_ladder(spark, sf_dir):
    """Each document scored as a completion against the next document's text as the answer."""
    d = _docs_spread(spark, sf_dir).select("doc_id", score_key(F.col("text")).alias("completion"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("completion").alias("answer"))
    j = d.join(nxt, "doc_id", "left")
    return j.select("doc_id", score_keys(F.col("completion"), F.col("answer")).alias("score"))


def chat_as_text(spark, sf_dir):
    """T8 + T9 + P11 on chat cells, concatenated in two levels: blocks of ``CHAT_BLOCK`` turns
    are joined in parallel, then the block texts of each conversation in block order. Each
    collect holds at most one block of turns or one conversation's block texts."""
    conv = read_table(spark, sf_dir, "conversations")
    return chat_text(conv)


CHAT_BLOCK = 64


def chat_text(conv: DataFrame, block: int = CHAT_BLOCK) -> DataFrame:
    """(conv_id, n_turns, text): each block is a chat cell, flattened by ``as_text``; the blocks'
    non-empty texts are joined by newline in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    cell = F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    cells = conv.groupBy("conv_id", F.floor(F.col("turn") / F.lit(block)).alias("blk")).agg(
        F.count(F.lit(1)).alias("n"), cell.alias("messages")
    )
    blocks = cells.select("conv_id", "blk", "n", as_text(cells, "messages").alias("bt"))
    nonempty = F.when(F.col("bt") != F.lit(""), F.struct("blk", "bt"))
    return blocks.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(nonempty)), lambda x: x["bt"]), "\n").alias("text"),
    )


def mixed_cells(spark, sf_dir):
    """T8 at run time: every turn as one of six kinds of JSON cell (string, chat, nested dict, nested
    list, dict without a text key, null) in a single VARIANT column, flattened to text."""
    conv = read_table(spark, sf_dir, "conversations")
    kind = F.pmod(F.coalesce(F.col("conv_id") + F.col("turn"), F.lit(0)), F.lit(6))
    text, turn = F.coalesce("text", F.lit("")), F.coalesce("turn", F.lit(0))
    quoted = F.to_json(F.array(text))  # ["..."]
    message = F.struct(F.lit("user").alias("role"), text.alias("content"))
    empty = F.struct(F.lit("system").alias("role"), F.lit("").alias("content"))
    nested = F.struct(F.struct(turn.alias("answer")).alias("value"), text.alias("question"))
    cell = (
        F.when(kind == 0, F.expr("substr(q, 2, length(q) - 2)"))
        .when(kind == 1, F.to_json(F.array(empty, message)))
        .when(kind == 2, F.to_json(nested))
        .when(kind == 3, F.concat(F.lit('[{"text": '), F.expr("substr(q, 2, length(q) - 2)"), F.lit("}, ["), turn.cast("string"), F.lit(", true], null]")))
        .when(kind == 4, F.concat(F.lit('{"page": '), turn.cast("string"), F.lit("}")))
        .otherwise(F.lit("null"))
    )
    cells = conv.withColumn("q", quoted).select("conv_id", "turn", F.parse_json(cell).alias("cell"))
    return cells.select("conv_id", "turn", as_text(cells, "cell").alias("text"))


def ordinal_slice_q(spark, sf_dir):
    d = _docs(spark, sf_dir)
    out, _, _ = ds.load_eval_slice(d, ["doc_id"], SLICE_START, SLICE_COUNT, prompt_column="text", answer_column="source", key=["doc_id"])
    return out


def inferred_columns(spark, sf_dir):
    """S6 + P1 + T8 end to end: each turn's chat cell (its text as user message, its role as system
    message) and the turn number, under column names that the resolver has to find."""
    conv = read_table(spark, sf_dir, "conversations")

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    cells = conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
        F.array(message("system", F.col("role")), message("user", F.col("text"))).alias("Messages"),
        F.struct(F.col("turn").alias("value")).alias("my_target"),
    )
    return ds.project_prompts(cells)[0]


def _split(d):
    n = d.count()  # parquet footers
    ranges = {k: (int(a * n) if a < 1 else n, int(b * n) if b < 1 else n) for k, (a, b) in SPLIT_FRACTIONS.items()}
    return ds.holdout_split(d, ["doc_id"], ranges)


def holdout_split_q(spark, sf_dir):
    return _split(_docs(spark, sf_dir).select("doc_id"))


def split_leakage(spark, sf_dir):
    # narrow and written once: the range bounds and both sides of the join would each read the texts again
    d = cut_lineage(_docs_spread(spark, sf_dir).select("doc_id", ds.text_digest(F.col("text")).alias("digest")))
    return ds.leakage(_split(d), "digest", digest=True).select("doc_id", "ordinal")


def _ids(spark, sf_dir):
    return _docs_spread(spark, sf_dir).select("doc_id", "lang", token_ids(F.col("text")).alias("ids"))


def eos_truncate(spark, sf_dir):
    d = (
        _ids(spark, sf_dir)
        .withColumn("comp", tk.drop_prefix("ids", PROMPT_LEN))
        .withColumn("eos_pos", tk.first_eos("comp", EOS_IDS))
        .withColumn("kept", tk.truncate_at_eos("comp", EOS_IDS))
    )
    mask = tk.completion_mask("comp", EOS_IDS)
    full = F.concat(F.slice("ids", 1, PROMPT_LEN), F.col("kept"))
    return d.select(
        "doc_id",
        F.size("ids").alias("n_ids"),
        tk.has_eos("comp", EOS_IDS).alias("has_eos"),
        "eos_pos",
        F.size("kept").alias("n_kept"),
        tk.positional_checksum("kept").alias("kept_sum"),
        F.aggregate(mask, F.lit(0), lambda a, b: a + b).alias("mask_sum"),
        F.size(full).alias("full_len"),
    )


def _padded(spark, sf_dir):
    d = _ids(spark, sf_dir).withColumn("batch_id", F.floor(F.col("doc_id") / F.lit(BATCH)).cast("long"))
    return batching.pad_batches(d, "ids", ["batch_id"], PAD_ID)


def pad_batch(spark, sf_dir):
    p = _padded(spark, sf_dir)
    return p.select(
        "doc_id",
        "batch_id",
        "padded_len",
        (F.col("padded_len") - F.size("ids")).alias("n_pad"),
        tk.positional_checksum("padded").alias("padded_sum"),
        F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("mask_sum"),
    )


def pad_strip(spark, sf_dir):
    p = _padded(spark, sf_dir)
    stripped = tk.strip_padding("padded", "mask")
    return p.select(
        "doc_id", F.size(stripped).alias("n_stripped"), tk.positional_checksum(stripped).alias("stripped_sum"),
        (stripped == F.col("ids")).alias("same"),
    )


def strip_special_q(spark, sf_dir):
    kept = tk.strip_special("ids", SPECIAL_IDS)
    return _ids(spark, sf_dir).select("doc_id", F.size(kept).alias("n_kept"), tk.positional_checksum(kept).alias("kept_sum"))


def truncate_prompt(spark, sf_dir):
    kept = tk.cap_length("ids", MAX_PROMPT_IDS)
    return _ids(spark, sf_dir).select("doc_id", F.size(kept).alias("n_kept"), tk.positional_checksum(kept).alias("kept_sum"))


def batch_token_count(spark, sf_dir):
    return batching.batch_token_counts(_ids(spark, sf_dir), "lang", "ids", [F.col("doc_id")], BATCH)


def throughput_q(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return batching.throughput(ev, "event_type", "ts", F.floor("value"))


#: Rows that positional_slice takes, and those in front of it.
POSITION_START, POSITION_COUNT = 123, 456


def positional_slice(spark, sf_dir):
    """S2 by position: rows of ``documents`` in file order."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return ds.positional_slice(docs, POSITION_START, POSITION_COUNT)


QUERIES = {
    "positional_slice": positional_slice,
    "normalize_text": normalize_text,
    "last_number": last_number_q,
    "score_ladder": score_ladder,
    "chat_as_text": chat_as_text,
    "mixed_cells": mixed_cells,
    "ordinal_slice": ordinal_slice_q,
    "holdout_split": holdout_split_q,
    "split_leakage": split_leakage,
    "eos_truncate": eos_truncate,
    "pad_batch": pad_batch,
    "pad_strip": pad_strip,
    "strip_special": strip_special_q,
    "truncate_prompt": truncate_prompt,
    "batch_token_count": batch_token_count,
    "throughput": throughput_q,
    "inferred_columns": inferred_columns,
}

# --- DuckDB oracle -------------------------------------------------------------------------

_N = sql.normalize("text")
_IDS = f"list_transform({sql.words('text')}, lambda w: CAST(length(w) AS INTEGER))"
_IDS_CTE = f"WITH t AS (SELECT doc_id, lang, {_IDS} AS ids FROM documents)"


def _cks(lst: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform({lst}, lambda x, i: CAST(x AS BIGINT) * i)), 0) AS BIGINT)"


def _in_set(x: str, ids) -> str:
    return f"{x} IN ({', '.join(str(i) for i in ids)})"


_EOS = f"""{_IDS_CTE},
c AS (SELECT doc_id, ids, ids[{PROMPT_LEN + 1}:] AS comp FROM t),
p AS (SELECT *, CAST(coalesce(list_min(list_filter([{', '.join(f'list_position(comp, {e})' for e in EOS_IDS)}], lambda x: x > 0)), 0) AS INTEGER) AS p FROM c),
k AS (SELECT *, CASE WHEN p > 0 THEN comp[1:p] ELSE comp END AS kept FROM p)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, list_has_any(comp, {list(EOS_IDS)}) AS has_eos, p AS eos_pos,
       CAST(len(kept) AS INTEGER) AS n_kept, {_cks('kept')} AS kept_sum,
       CAST(coalesce(list_sum(list_transform(comp, lambda x, j: CASE WHEN p = 0 OR j - 1 < p THEN 1 ELSE 0 END)), 0) AS INTEGER) AS mask_sum,
       CAST(len(list_concat(ids[1:{PROMPT_LEN}], kept)) AS INTEGER) AS full_len
FROM k"""

_PAD_CTE = f"""{_IDS_CTE},
b AS (SELECT *, CAST(floor(doc_id / {BATCH}) AS BIGINT) AS batch_id FROM t),
m AS (SELECT *, CAST(max(len(ids)) OVER (PARTITION BY batch_id) AS INTEGER) AS padded_len FROM b),
q AS (SELECT *, padded_len - CAST(len(ids) AS INTEGER) AS n_pad FROM m)"""

_PAD = f"""{_PAD_CTE}
SELECT doc_id, batch_id, padded_len, n_pad,
       CAST(coalesce(list_sum(list_transform(ids, lambda x, i: CAST(x AS BIGINT) * (n_pad + i))), 0) AS BIGINT) AS padded_sum,
       CAST(len(ids) AS INTEGER) AS mask_sum
FROM q"""

_STRIP = f"""{_PAD_CTE},
r AS (SELECT *, list_concat(list_transform(range(n_pad), lambda x: {PAD_ID}), ids) AS padded,
             list_concat(list_transform(range(n_pad), lambda x: 0), list_transform(ids, lambda x: 1)) AS mask FROM q),
s AS (SELECT *, list_transform(list_filter(range(1, len(padded) + 1), lambda i: mask[i] = 1), lambda i: padded[i]) AS stripped FROM r)
SELECT doc_id, CAST(len(stripped) AS INTEGER) AS n_stripped, {_cks('stripped')} AS stripped_sum, stripped = ids AS same FROM s"""

_N_DOCS = "(SELECT count(*) FROM documents)"
_SPLIT_CASES = " ".join(
    f"WHEN ordinal >= CAST(floor({a!r} * {_N_DOCS}) AS BIGINT) AND ordinal < CAST(floor({b!r} * {_N_DOCS}) AS BIGINT) "
    f"THEN '{n}'"
    for n, (a, b) in sorted(SPLIT_FRACTIONS.items(), key=lambda kv: kv[1][0])
)
_SPLIT_CTE = f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents),
s AS (SELECT *, CASE {_SPLIT_CASES} END AS split FROM o)"""

_INFERRED = """SELECT conv_id * 1000 + turn AS prompt_id,
       concat_ws(chr(10), nullif(role, ''), nullif(text, '')) AS prompt, coalesce(CAST(turn AS VARCHAR), '') AS answer
FROM conversations"""

# The text that the rules give for each kind of cell, written down by kind.
_MIXED = """
SELECT conv_id, turn, CASE kind
    WHEN 0 THEN txt
    WHEN 1 THEN txt
    WHEN 2 THEN CAST(n AS VARCHAR)
    WHEN 3 THEN txt || chr(10) || n || chr(10) || 'true' || chr(10)
    WHEN 4 THEN '{"page":' || n || '}'
    ELSE '' END AS text
FROM (SELECT conv_id, turn, coalesce(text, '') AS txt, coalesce(turn, 0) AS n, coalesce(conv_id + turn, 0) % 6 AS kind FROM conversations)"""

ORACLE = {
    "mixed_cells": _MIXED,
    "positional_slice": f"""
SELECT doc_id, lang, n_chars, n - 1 AS ordinal FROM (SELECT *, row_number() OVER () AS n FROM documents)
WHERE n > {POSITION_START} AND n <= {POSITION_START + POSITION_COUNT}""",
    "inferred_columns": _INFERRED,
    "normalize_text": f"SELECT doc_id, {_N} AS norm FROM documents",
    "last_number": f"SELECT doc_id, {sql.last_number(_N)} AS last_num, try_cast({sql.last_number(_N)} AS DOUBLE) AS value FROM documents",
    "score_ladder": (
        f"SELECT d.doc_id, {sql.score('d.text', 'coalesce(n.text, ' + chr(39) * 2 + ')')} AS score "
        f"FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1"
    ),
    "chat_as_text": (
        "SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, "
        "coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') AS text "
        "FROM conversations GROUP BY conv_id"
    ),
    "ordinal_slice": (
        f"SELECT CAST(ordinal AS BIGINT) AS prompt_id, coalesce(text, '') AS prompt, coalesce(source, '') AS answer "
        f"FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents) "
        f"WHERE ordinal >= {SLICE_START} AND ordinal < least((SELECT count(*) FROM documents), {SLICE_START + SLICE_COUNT})"
    ),
    "holdout_split": _SPLIT_CTE + " SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, split FROM s",
    "split_leakage": _SPLIT_CTE
    + f" SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal FROM s WHERE split = 'eval' AND {_N} IN "
    f"(SELECT {_N} FROM s WHERE split = 'train')",
    "eos_truncate": _EOS,
    "pad_batch": _PAD,
    "pad_strip": _STRIP,
    "strip_special": (
        f"{_IDS_CTE}, k AS (SELECT doc_id, list_filter(ids, lambda x: NOT ({_in_set('x', SPECIAL_IDS)})) AS kept FROM t) "
        f"SELECT doc_id, CAST(len(kept) AS INTEGER) AS n_kept, {_cks('kept')} AS kept_sum FROM k"
    ),
    "truncate_prompt": (
        f"{_IDS_CTE}, k AS (SELECT doc_id, ids[1:{MAX_PROMPT_IDS}] AS kept FROM t) "
        f"SELECT doc_id, CAST(len(kept) AS INTEGER) AS n_kept, {_cks('kept')} AS kept_sum FROM k"
    ),
    "batch_token_count": f"""{_IDS_CTE},
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / {BATCH}) AS BIGINT) AS batch_id FROM t),
pb AS (SELECT lang, batch_id, CAST(max(len(ids)) AS BIGINT) * count(*) AS padded, sum(len(ids)) AS eff, count(*) AS n
       FROM b GROUP BY 1, 2)
SELECT lang, CAST(sum(n) AS BIGINT) AS num_rows, CAST(count(*) AS BIGINT) AS num_batches,
       CAST(sum(padded) AS BIGINT) AS total_new_tokens, CAST(sum(eff) AS BIGINT) AS effective_new_tokens
FROM pb GROUP BY lang""",
    "throughput": """
WITH a AS (SELECT event_type, CAST(count(*) AS BIGINT) AS num_events, CAST(sum(floor(value)) AS BIGINT) AS total_new_tokens,
                  greatest(CAST(datediff('microsecond', min(ts), max(ts)) AS DOUBLE) / 1e6, 1e-9) AS w
           FROM events GROUP BY event_type)
SELECT event_type, num_events, total_new_tokens, w AS wall_time_sec, total_new_tokens / w AS new_tokens_per_sec,
       num_events / w AS prompts_per_sec FROM a""",
}
