"""Registered distribution-shaping, sampling and decoding queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import decode as dec
from strata.operators import distribution as dist
from strata.operators import ngram
from strata.operators import sampling as smp
from strata.operators.evaluate import evaluate
from strata.operators.lookup import interval_table, lookup_intervals
from strata.operators.nucleus import select_top_p
from strata.plans import sql
from strata.sources.tables import read_table

# Parameters of the registered queries (the reference's generation defaults where it has them).
TEMPERATURE = 0.8
TOP_K = 50
TOP_P = 0.7
NUCLEUS_SCALE = 20_000.0  # characters of a document per unit of logit
SEED = 42
LATTICE_G = 8
SYSTEMATIC_G = 16
DECODE_G = 4
# most tokens of a completion; a prompt's own bound is the length of its tail
DECODE_STEPS = dec.MAX_NEW_TOKENS
VARIANCE_G = 8
VARIANCE_SEEDS = 32
ROUND = 9  # order-dependent double sums are compared at 9 decimals


def _r(c: str):
    return F.round(F.col(c), ROUND).alias(c)


def logit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(context, token, logit) from part: context p_type, token p_partkey, logit price / 1000."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_type").alias("context"),
        F.col("p_partkey").alias("token"),
        (F.col("p_retailprice") / F.lit(1000.0)).alias("logit"),
    )


def temperature_dist(spark, sf_dir):
    return dist.apply_temperature(logit_rows(spark, sf_dir), TEMPERATURE)


def top_k_dist(spark, sf_dir):
    d = dist.apply_temperature(logit_rows(spark, sf_dir), TEMPERATURE)
    return dist.apply_top_k(d, ["context"], TOP_K)


def softmax_dist(spark, sf_dir):
    s = dist.softmax(logit_rows(spark, sf_dir), ["context"])
    return s.select("context", "token", _r("prob"))


def top_p_dist(spark, sf_dir):
    s = dist.shape(logit_rows(spark, sf_dir), ["context"], temperature=TEMPERATURE, top_k=TOP_K, top_p=TOP_P)
    return s.select("context", "token", _r("prob"))


def top_p_select(spark, sf_dir):
    """The nucleus of each language's documents, longer ones being likelier, without a sort."""
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select(F.col("lang").alias("context"), F.col("doc_id").alias("token"), (F.col("n_chars") / NUCLEUS_SCALE).alias("logit"))
    return select_top_p(rows, ["context"], TOP_P).select("context", "token", "weight")


def cdf_dist(spark, sf_dir):
    s = dist.shape(
        logit_rows(spark, sf_dir), ["context"], temperature=TEMPERATURE, top_k=TOP_K, top_p=TOP_P, normalize=False
    )
    c = dist.cdf(s, ["context"], weight="weight", token="token", prob="prob")
    return c.select("context", "token", _r("prob"), _r("lo"), _r("hi"))


def lattice_points_q(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"))
    return smp.lattice_points(cust, "group_id", LATTICE_G, SEED).select("group_id", "g", "u", "c")


def systematic_sample_q(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    s = smp.systematic_sample(docs, ["lang"], "n_chars", ["doc_id"], SYSTEMATIC_G, SEED)
    return s.select("lang", "doc_id", "n_chars", "g", "u")


def _bigram(spark, sf_dir, contexts=None) -> DataFrame:
    return dec.bigram_table(read_table(spark, sf_dir, "documents"), contexts=contexts)


def _doc_prompts(spark, sf_dir) -> DataFrame:
    return dec.continuation_prompts(read_table(spark, sf_dir, "documents"))


def bigram_table_q(spark, sf_dir):
    return _bigram(spark, sf_dir).select("context", "token", "cnt", "lo", "hi")


def inverse_cdf_join(spark, sf_dir):
    prompts = _doc_prompts(spark, sf_dir)
    pts = smp.lattice_points(prompts, "group_id", DECODE_G, SEED).select("group_id", "context", "g", "c")
    hit = lookup_intervals(pts, interval_table(_bigram(spark, sf_dir, prompts)))
    hit = hit.withColumn("c_next", smp.renormalise(F.col("c"), F.col("lo"), F.col("hi")))
    return hit.select("group_id", "g", "c", "token", "c_next")


def iid_sample(spark, sf_dir):
    prompts = _doc_prompts(spark, sf_dir)
    pts = smp.iid_points(prompts, "group_id", DECODE_G, SEED, 0).select("group_id", "context", "g", "c")
    hit = lookup_intervals(pts, interval_table(_bigram(spark, sf_dir, prompts)))
    return hit.select("group_id", "g", "c", "token")


def _decode(spark, sf_dir, method):
    out = dec.decode(_doc_prompts(spark, sf_dir), _bigram(spark, sf_dir), num_samples=DECODE_G, max_steps=DECODE_STEPS, method=method, seed=SEED)
    return out.select("group_id", "g", F.array_join("out", " ").alias("completion"), "finished", "steps")


def decode_lattice(spark, sf_dir):
    return _decode(spark, sf_dir, "lattice")


def decode_iid(spark, sf_dir):
    return _decode(spark, sf_dir, "iid")


ARMS = ("iid", "lattice")


def _both_arms(spark, sf_dir, table) -> DataFrame:
    return dec.decode_arms(_doc_prompts(spark, sf_dir), table, num_samples=DECODE_G, max_steps=DECODE_STEPS, methods=ARMS, seed=SEED)


def sampler_diversity(spark, sf_dir):
    return dec.diversity(_both_arms(spark, sf_dir, _bigram(spark, sf_dir)), DECODE_G)


EVAL_BATCH = 8


def decode_eval(spark, sf_dir):
    """The A/B the reference runs, end to end: decode DECODE_G completions per document prompt
    with i.i.d. and with lattice sampling, score each against the whole rest of the document and
    reduce to the per-arm record. The end marker is no part of a completion's text."""
    docs = read_table(spark, sf_dir, "documents")
    prompts = dec.split_documents(docs).select(
        F.col("group_id").alias("prompt_id"), F.array_join("head", " ").alias("prompt"), F.array_join("tail", " ").alias("answer")
    )
    comps = _both_arms(spark, sf_dir, _bigram(spark, sf_dir)).select(
        "arm", F.col("group_id").alias("prompt_id"), F.col("g").alias("sample_idx"),
        F.array_join(F.array_remove("out", dec.END_TOKEN), " ").alias("completion"),
        F.size("out").cast("long").alias("new_tokens"),
    )
    return evaluate(prompts, comps, DECODE_G, ARMS, batch_size=EVAL_BATCH)


def _echo(batch):
    """Example generator: what it says depends on the whole batch (its longest prompt, the place in it)."""
    longest = int(batch["prompt"].str.len().max())
    said = [p.upper().ljust(longest, ".") + f" {i}" for i, p in enumerate(batch["prompt"])]
    return batch[["prompt_id"]].assign(completion=said, padded_len=longest)


def generate_batch(spark, sf_dir):
    """Completions of the parts' names by a deterministic generator, batch by batch."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("prompt"))
    return dec.generate_batches(part, _echo, "prompt_id long, completion string, padded_len long", batch_size=EVAL_BATCH)


SHAPE_T, SHAPE_K, SHAPE_P = 0.8, 20, 0.9


def decode_shaped(spark, sf_dir):
    """Both arms over the bigram table shaped by temperature, top-k and top-p."""
    table = dec.shaped_bigram_table(read_table(spark, sf_dir, "documents"), SHAPE_T, SHAPE_K, SHAPE_P)
    out = _both_arms(spark, sf_dir, table)
    return out.select("arm", "group_id", "g", F.array_join("out", " ").alias("completion"))


# Words of an n-gram, and how often a context of several words must occur to be known.
ORDER, MIN_COUNT = 3, 3


def _ngrams(spark, sf_dir) -> DataFrame:
    return ngram.ngram_counts(read_table(spark, sf_dir, "documents"), ORDER, min_count=MIN_COUNT)


def ngram_table_q(spark, sf_dir):
    """Contexts of one and two words with their intervals and the context that follows each token."""
    return ngram.ngram_table(_ngrams(spark, sf_dir), ORDER, MIN_COUNT)


def decode_ngram(spark, sf_dir):
    """R7 + R8: both arms over the table of one- and two-word contexts, backing off to the longest known."""
    counts = _ngrams(spark, sf_dir)
    prompts = ngram.ngram_prompts(read_table(spark, sf_dir, "documents"), counts, ORDER)
    table = ngram.ngram_table(counts, ORDER, MIN_COUNT)
    out = dec.decode_arms(prompts, table, num_samples=DECODE_G, max_steps=DECODE_STEPS, methods=ARMS, seed=SEED)
    return out.select("arm", "group_id", "g", F.array_join("out", " ").alias("completion"), "finished", "steps")


def sampler_variance(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    pop = docs.join(labels, "doc_id", "inner")
    v = smp.estimator_variance(pop, ["lang"], "n_chars", "quality", "doc_id", VARIANCE_G, VARIANCE_SEEDS, SEED)
    return v.select("lang", "method", _r("mean_estimate"), _r("var_estimate"), F.col("num_seeds").cast("long"), _r("exact_mean"))


QUERIES = {
    "temperature_dist": temperature_dist,
    "top_k_dist": top_k_dist,
    "softmax_dist": softmax_dist,
    "top_p_dist": top_p_dist,
    "top_p_select": top_p_select,
    "cdf_dist": cdf_dist,
    "lattice_points": lattice_points_q,
    "systematic_sample": systematic_sample_q,
    "bigram_table": bigram_table_q,
    "inverse_cdf_join": inverse_cdf_join,
    "iid_sample": iid_sample,
    "decode_lattice": decode_lattice,
    "decode_iid": decode_iid,
    "sampler_diversity": sampler_diversity,
    "sampler_variance": sampler_variance,
    "decode_eval": decode_eval,
    "decode_shaped": decode_shaped,
    "generate_batch": generate_batch,
    "ngram_table": ngram_table_q,
    "decode_ngram": decode_ngram,
}

# --- DuckDB oracle -------------------------------------------------------------------------

_ROWS = f"SELECT p_type AS context, p_partkey AS token, p_retailprice / 1000::DOUBLE AS logit FROM part"
_TEMP = f"SELECT context, token, logit / {TEMPERATURE!r}::DOUBLE AS logit FROM ({_ROWS})"
_TOPK = (
    f"SELECT context, token, logit FROM (SELECT *, rank() OVER (PARTITION BY context ORDER BY logit DESC) AS rk "
    f"FROM ({_TEMP})) WHERE rk <= {TOP_K}"
)


def _softmax(src: str, out: str = "prob") -> str:
    return (
        f"SELECT *, e / sum(e) OVER (PARTITION BY context) AS {out} FROM "
        f"(SELECT *, exp(logit - max(logit) OVER (PARTITION BY context)) AS e FROM ({src}))"
    )


_TOPP = (
    f"SELECT context, token, logit, e FROM (SELECT *, coalesce(sum(e) OVER (PARTITION BY context ORDER BY logit DESC, token "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(e) OVER (PARTITION BY context) AS pe "
    f"FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY context)) AS e FROM ({_TOPK}))) WHERE pe <= {TOP_P!r}"
)
_SHAPED = f"SELECT context, token, e, e / sum(e) OVER (PARTITION BY context) AS prob FROM ({_TOPP})"
_CDF = (
    f"SELECT context, token, e / sum(e) OVER (PARTITION BY context) AS prob, "
    f"coalesce(sum(e) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    f"/ sum(e) OVER (PARTITION BY context) AS lo, "
    f"sum(e) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
    f"/ sum(e) OVER (PARTITION BY context) AS hi FROM ({_TOPP})"
)

_WORDS = sql.words("text")
_BIGRAM_CTES = f"""
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pairs AS (
  SELECT w[i] AS context, coalesce(w[i + 1], '{dec.END_TOKEN}') AS token
  FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE len(w) > 0)
),
bg AS (SELECT context, token, CAST(count(*) AS BIGINT) AS cnt FROM pairs GROUP BY 1, 2),
dist AS MATERIALIZED (
  SELECT context, token, cnt,
    coalesce(sum(cnt) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      / sum(cnt) OVER (PARTITION BY context) AS lo,
    sum(cnt) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      / sum(cnt) OVER (PARTITION BY context) AS hi
  FROM bg
),
prompts AS (SELECT doc_id AS group_id, w[len(w) - len(w) * {dec.TAIL_PERCENT} // 100] AS context,
                   least(len(w) * {dec.TAIL_PERCENT} // 100 + 1, {dec.MAX_NEW_TOKENS}) AS lim FROM docs WHERE len(w) > 0)
"""

_MATCH = "(s.c > d.lo OR d.lo = 0) AND s.c <= d.hi"
_RENORM = "least(greatest((s.c - d.lo) / greatest(d.hi - d.lo, 1e-10), 0.0::DOUBLE), 1.0::DOUBLE)"


def _g_seq(n: int) -> str:
    return f"CAST(unnest(range({n})) AS INTEGER)"


def _lattice_state(G: int) -> str:
    u = sql.keyed_uniform(f"concat_ws(':', '{SEED}', group_id)")
    return f"SELECT group_id, context, g, (g + u) / {float(G)!r} AS c FROM (SELECT group_id, context, {u} AS u, {_g_seq(G)} AS g FROM prompts)"


def _iid_c(step: int | str, alias: str = "s") -> str:
    return sql.keyed_uniform(f"concat_ws(':', '{SEED}', {alias}.group_id, {alias}.g, {step})")


def _decode_sql(methods: tuple[str, ...]) -> str:
    """``dec(arm, group_id, g, out, finished)``: a recursive query whose rows are the tokens, one per
    open sequence and step."""
    u = sql.keyed_uniform(f"concat_ws(':', '{SEED}', group_id)")
    arms = ", ".join(f"'{m}'" for m in methods)
    return "WITH RECURSIVE " + _BIGRAM_CTES.strip() + f""",
points AS (SELECT group_id, context, lim, u, {_g_seq(DECODE_G)} AS g FROM (SELECT *, {u} AS u FROM prompts)),
walk AS (
  SELECT unnest([{arms}]) AS arm, group_id, g, lim, 0 AS step, (g + u) / {float(DECODE_G)!r} AS c, context AS cur, NULL::VARCHAR AS token
  FROM points
  UNION ALL
  SELECT s.arm, s.group_id, s.g, s.lim, s.step + 1 AS step,
         least(greatest((s.x - d.lo) / greatest(d.hi - d.lo, 1e-10), 0.0::DOUBLE), 1.0::DOUBLE) AS c, d.token AS cur, d.token AS token
  FROM (SELECT w.*, CASE WHEN w.arm = 'iid' THEN {_iid_c("w.step", "w")} ELSE w.c END AS x
        FROM walk w WHERE w.step < w.lim AND w.cur <> '{dec.END_TOKEN}') s
  JOIN dist d ON d.context = s.cur AND s.x <= d.hi AND (s.x > d.lo OR (s.x <= 0 AND d.lo = 0))),
dec AS (SELECT arm, group_id, g, coalesce(list(token ORDER BY step) FILTER (token IS NOT NULL), []) AS out,
               max(CASE WHEN token = '{dec.END_TOKEN}' THEN 1 ELSE 0 END) = 1 AS finished
        FROM walk GROUP BY ALL)
"""


def _decode_out(method: str) -> str:
    return _decode_sql((method,)) + (
        "SELECT group_id, g, array_to_string(out, ' ') AS completion, finished, CAST(len(out) AS INTEGER) AS steps FROM dec"
    )


_SYS = f"""
WITH pop AS (SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 0),
cum AS (
  SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS we,
         sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wi,
         sum(n_chars) OVER (PARTITION BY lang) AS wt
  FROM pop),
x AS (SELECT *, {sql.keyed_uniform(f"concat_ws(':', '{SEED}', lang)")} AS u FROM cum),
y AS (SELECT *, CAST(CASE WHEN we = 0 THEN 0 ELSE floor({float(SYSTEMATIC_G)!r} * (we / wt) - u) + 1 END AS INTEGER) AS g0,
             CAST(least(floor({float(SYSTEMATIC_G)!r} * (wi / wt) - u), {SYSTEMATIC_G - 1}) AS INTEGER) AS g1 FROM x)
SELECT lang, doc_id, n_chars, CAST(unnest(range(g0, g1 + 1)) AS INTEGER) AS g, u FROM y WHERE g1 >= g0
"""

_VAR = f"""
WITH pop AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars > 0),
dist AS (
  SELECT lang, quality,
    coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      / sum(n_chars) OVER (PARTITION BY lang) AS lo,
    sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      / sum(n_chars) OVER (PARTITION BY lang) AS hi
  FROM pop),
seeds AS (SELECT lang, CAST(unnest(range({VARIANCE_SEEDS})) AS INTEGER) AS s FROM (SELECT DISTINCT lang FROM pop)),
lat AS (SELECT lang, s, 'lattice' AS method, (g + u) / {float(VARIANCE_G)!r} AS c FROM
        (SELECT lang, s, {sql.keyed_uniform(f"concat_ws(':', '{SEED}', s, lang)")} AS u, {_g_seq(VARIANCE_G)} AS g FROM seeds)),
iid AS (SELECT lang, s, 'iid' AS method, {sql.keyed_uniform(f"concat_ws(':', '{SEED}', s, lang, g, 'iid')")} AS c FROM
        (SELECT lang, s, {_g_seq(VARIANCE_G)} AS g FROM seeds)),
pts AS (SELECT * FROM lat UNION ALL SELECT * FROM iid),
hits AS (SELECT s.lang, s.method, s.s, d.quality FROM pts s JOIN dist d ON d.lang = s.lang AND {_MATCH}),
est AS (SELECT lang, method, s, avg(CAST(quality AS DOUBLE)) AS est FROM hits GROUP BY 1, 2, 3),
per0 AS (SELECT lang, method, sum(est) AS s1, sum(est * est) AS s2, CAST(count(*) AS BIGINT) AS num_seeds FROM est GROUP BY 1, 2),
per AS (SELECT lang, method, s1 / num_seeds AS mean_estimate,
               greatest((s2 - s1 * s1 / num_seeds) / num_seeds, 0.0::DOUBLE) AS var_estimate, num_seeds FROM per0),
exact AS (SELECT lang, CAST(sum(n_chars * quality) AS DOUBLE) / CAST(sum(n_chars) AS DOUBLE) AS exact_mean FROM pop GROUP BY 1)
SELECT lang, method, round(mean_estimate, {ROUND}) AS mean_estimate, round(var_estimate, {ROUND}) AS var_estimate,
       num_seeds, round(exact_mean, {ROUND}) AS exact_mean
FROM per JOIN exact USING (lang)
"""

ORACLE = {
    "temperature_dist": _TEMP,
    "top_k_dist": _TOPK,
    "softmax_dist": f"SELECT context, token, round(prob, {ROUND}) AS prob FROM ({_softmax(_ROWS)})",
    "top_p_dist": f"SELECT context, token, round(prob, {ROUND}) AS prob FROM ({_SHAPED})",
    "top_p_select": f"""
WITH r AS (SELECT lang AS context, doc_id AS token, n_chars / {NUCLEUS_SCALE!r}::DOUBLE AS logit FROM documents),
w AS (SELECT context, token, CAST(floor(exp(logit - max(logit) OVER (PARTITION BY context)) * 1073741824::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS weight
      FROM r WHERE logit IS NOT NULL AND token IS NOT NULL),
c AS (SELECT *, sum(weight) OVER (PARTITION BY context) AS total,
             sum(weight) OVER (PARTITION BY context ORDER BY weight DESC, token RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - sum(weight) OVER (PARTITION BY context, weight, token) AS before FROM w)
SELECT context, token, weight FROM c WHERE before <= floor({TOP_P!r}::DOUBLE * total::DOUBLE)""",
    "cdf_dist": f"SELECT context, token, round(prob, {ROUND}) AS prob, round(lo, {ROUND}) AS lo, round(hi, {ROUND}) AS hi FROM ({_CDF})",
    "lattice_points": (
        f"SELECT group_id, g, u, (g + u) / {float(LATTICE_G)!r} AS c FROM (SELECT c_custkey AS group_id, "
        f"{sql.keyed_uniform(f'concat_ws(' + chr(39) + ':' + chr(39) + ', ' + chr(39) + str(SEED) + chr(39) + ', c_custkey)')} AS u, "
        f"{_g_seq(LATTICE_G)} AS g FROM customer)"
    ),
    "systematic_sample": _SYS,
    "bigram_table": "WITH " + _BIGRAM_CTES.strip() + "\nSELECT context, token, cnt, lo, hi FROM dist",
    "inverse_cdf_join": "WITH " + _BIGRAM_CTES.strip() + f""",
pts AS ({_lattice_state(DECODE_G)})
SELECT s.group_id, s.g, s.c, d.token, {_RENORM} AS c_next
FROM pts s ASOF JOIN dist d ON d.context = s.context AND s.c <= d.hi""",
    "iid_sample": "WITH " + _BIGRAM_CTES.strip() + f""",
pts AS (SELECT group_id, context, g, {_iid_c(0, 'x')} AS c FROM (SELECT group_id, context, {_g_seq(DECODE_G)} AS g FROM prompts) x)
SELECT s.group_id, s.g, s.c, d.token FROM pts s ASOF JOIN dist d ON d.context = s.context AND s.c <= d.hi""",
    "decode_lattice": _decode_out("lattice"),
    "decode_iid": _decode_out("iid"),
    "sampler_variance": _VAR,
}

def _diversity_sql() -> str:
    return _decode_sql(ARMS) + f"""
, per AS (SELECT arm, group_id, count(DISTINCT array_to_string(out, ' ')) AS n_unique FROM dec GROUP BY 1, 2)
SELECT arm, CAST(count(*) AS BIGINT) AS num_prompts, sum(n_unique) / count(*) AS avg_unique_completions,
       1.0::DOUBLE - (sum(n_unique) / count(*)) / {float(DECODE_G)!r} AS duplicate_rate
FROM per GROUP BY arm"""


def _decode_eval_sql() -> str:
    return _decode_sql(ARMS) + f"""
, comp AS (SELECT arm, group_id AS prompt_id, g AS sample_idx, 
                  array_to_string(list_filter(out, lambda t: t <> '{dec.END_TOKEN}'), ' ') AS completion,
                  CAST(len(out) AS BIGINT) AS new_tokens FROM dec),
ans AS (SELECT doc_id AS prompt_id, array_to_string(w[len(w) - len(w) * {dec.TAIL_PERCENT} // 100 + 1:], ' ') AS answer
        FROM docs WHERE len(w) > 0),
scored AS (SELECT c.*, {sql.score("c.completion", "a.answer")} AS score, {sql.normalize("c.completion")} AS norm
           FROM comp c JOIN ans a USING (prompt_id)),
pp AS (SELECT arm, prompt_id,
              max(CASE WHEN sample_idx = 0 AND score > 0.5::DOUBLE THEN 1 ELSE 0 END) AS first_hit,
              max(CASE WHEN score > 0.5::DOUBLE THEN 1 ELSE 0 END) AS any_hit, count(DISTINCT norm) AS n_unique,
              sum(score) AS ssum, count(*) AS n, max(new_tokens) AS mt
       FROM scored GROUP BY 1, 2),
pb AS (SELECT arm, sum(first_hit) AS h1, sum(any_hit) AS hk, sum(n_unique) AS uniq, sum(ssum) AS ssum,
              sum(n) AS n, max(mt) * sum(n) AS bt
       FROM pp GROUP BY arm, floor(prompt_id / {EVAL_BATCH})),
pa AS (SELECT arm, sum(h1) AS h1, sum(hk) AS hk, sum(uniq) AS uniq, sum(ssum) AS ssum, sum(n) AS n,
              CAST(sum(bt) AS BIGINT) AS bt FROM pb GROUP BY arm),
spread AS (SELECT arm, sqrt(count(*) * sum(score * score) - sum(score) * sum(score)) / count(*) AS sd FROM scored GROUP BY arm),
cnt AS (SELECT count(*) AS num_prompts FROM ans),
x AS (SELECT a.arm, c.num_prompts, coalesce(h1, 0) AS h1, coalesce(hk, 0) AS hk, coalesce(uniq, 0) AS uniq,
             coalesce(ssum, 0) AS ssum, sd, coalesce(n, 0) AS n, coalesce(bt, 0) AS bt
      FROM (VALUES ('iid'), ('lattice')) a(arm) CROSS JOIN cnt c LEFT JOIN pa USING (arm) LEFT JOIN spread USING (arm))
SELECT arm AS label, arm AS model_path, CAST(num_prompts AS BIGINT) AS num_prompts, CAST({DECODE_G} AS INTEGER) AS num_samples,
       h1 / num_prompts AS pass_at_1, hk / num_prompts AS pass_at_k,
       CASE WHEN n > 0 THEN ssum / n ELSE 0.0::DOUBLE END AS reward_mean,
       CASE WHEN n > 1 THEN sd ELSE 0.0::DOUBLE END AS reward_std,
       uniq / num_prompts AS avg_unique_completions,
       1.0::DOUBLE - (uniq / num_prompts) / {float(DECODE_G)!r} AS duplicate_rate,
       bt AS total_new_tokens, NULL::DOUBLE AS wall_time_sec, NULL::DOUBLE AS new_tokens_per_sec,
       NULL::DOUBLE AS prompts_per_sec
FROM x"""


ORACLE["generate_batch"] = f"""
WITH b AS (SELECT p_partkey AS prompt_id, p_name AS prompt, CAST(floor(p_partkey / {EVAL_BATCH}) AS BIGINT) AS batch_id FROM part),
n AS (SELECT *, CAST(max(length(prompt)) OVER (PARTITION BY batch_id) AS BIGINT) AS padded_len,
             row_number() OVER (PARTITION BY batch_id ORDER BY prompt_id) - 1 AS i FROM b)
SELECT batch_id, prompt_id, rpad(upper(prompt), CAST(padded_len AS INTEGER), '.') || ' ' || i AS completion, padded_len FROM n"""
ORACLE["sampler_diversity"] = _diversity_sql()
ORACLE["decode_eval"] = _decode_eval_sql()

_SHAPED_DIST = f"""tmp AS (SELECT context, token, ln(cnt) / {SHAPE_T!r}::DOUBLE AS logit FROM bg),
cut AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY context)) AS e
        FROM (SELECT *, rank() OVER (PARTITION BY context ORDER BY logit DESC) AS rk FROM tmp) WHERE rk <= {SHAPE_K}),
nuc AS (SELECT context, token, greatest(round(e * {dec.WEIGHT_UNITS}::DOUBLE), 1)::BIGINT AS e FROM (SELECT *, coalesce(sum(e) OVER (PARTITION BY context ORDER BY logit DESC, token
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(e) OVER (PARTITION BY context) AS pe FROM cut)
        WHERE pe <= {SHAPE_P!r}),
dist AS MATERIALIZED (
  SELECT context, token,
    coalesce(sum(e) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      / sum(e) OVER (PARTITION BY context) AS lo,
    sum(e) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      / max(tot) OVER (PARTITION BY context) AS hi
  FROM (SELECT *, sum(e) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tot FROM nuc)
),
"""
_COUNT_DIST = _BIGRAM_CTES[_BIGRAM_CTES.index("dist AS MATERIALIZED") : _BIGRAM_CTES.index("prompts AS")]
ORACLE["decode_shaped"] = _decode_sql(ARMS).replace(_COUNT_DIST, _SHAPED_DIST) + (
    "SELECT arm, group_id, g, array_to_string(out, ' ') AS completion FROM dec"
)

# Contexts of one and two words; the walk below keeps its last two words and looks the pair up at every
# step, so it does not use the column "next" that the Spark side decodes with.
_NGRAM_CTES = f"""
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT unnest([1, 2]) AS m, w, i FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE len(w) > 0)
),
pairs AS (
  SELECT m, CASE m WHEN 1 THEN w[i] ELSE w[i - 1] || ' ' || w[i] END AS context, coalesce(w[i + 1], '{dec.END_TOKEN}') AS token
  FROM grams WHERE i >= m
),
bg AS (SELECT m, context, token, CAST(count(*) AS BIGINT) AS cnt FROM pairs GROUP BY ALL),
kept AS (SELECT * FROM bg QUALIFY m = 1 OR sum(cnt) OVER (PARTITION BY m, context) >= {MIN_COUNT}),
known AS MATERIALIZED (SELECT DISTINCT context FROM kept WHERE m = 2),
dist AS MATERIALIZED (
  SELECT context, token, cnt,
    coalesce(sum(cnt) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      / sum(cnt) OVER (PARTITION BY context) AS lo,
    sum(cnt) OVER (PARTITION BY context ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      / sum(cnt) OVER (PARTITION BY context) AS hi
  FROM kept
)"""
ORACLE["ngram_table"] = "WITH " + _NGRAM_CTES.strip() + f"""
SELECT d.context, token, cnt, lo, hi,
       CASE WHEN token = '{dec.END_TOKEN}' THEN token ELSE coalesce(k.context, token) END AS "next"
FROM dist d LEFT JOIN known k ON k.context = string_split(d.context, ' ')[-1] || ' ' || token"""
ORACLE["decode_ngram"] = "WITH RECURSIVE " + _NGRAM_CTES.strip() + f""",
prompts AS (SELECT doc_id AS group_id, w[len(w) - len(w) * {dec.TAIL_PERCENT} // 100 - 1] AS w1,
                   w[len(w) - len(w) * {dec.TAIL_PERCENT} // 100] AS w2,
                   least(len(w) * {dec.TAIL_PERCENT} // 100 + 1, {dec.MAX_NEW_TOKENS}) AS lim FROM docs WHERE len(w) > 0),
points AS (SELECT *, {_g_seq(DECODE_G)} AS g FROM (SELECT *, {sql.keyed_uniform(f"concat_ws(':', '{SEED}', group_id)")} AS u FROM prompts)),
walk AS (
  SELECT unnest([{", ".join(f"'{m}'" for m in ARMS)}]) AS arm, group_id, g, lim, 0 AS step, (g + u) / {float(DECODE_G)!r} AS c,
         w1, w2, NULL::VARCHAR AS token
  FROM points
  UNION ALL
  SELECT s.arm, s.group_id, s.g, s.lim, s.step + 1 AS step,
         least(greatest((s.x - d.lo) / greatest(d.hi - d.lo, 1e-10), 0.0::DOUBLE), 1.0::DOUBLE) AS c, s.w2 AS w1, d.token AS w2, d.token AS token
  FROM (SELECT w.*, coalesce(k.context, w.w2) AS known_context, CASE WHEN w.arm = 'iid' THEN {_iid_c("w.step", "w")} ELSE w.c END AS x
        FROM walk w LEFT JOIN known k ON k.context = w.w1 || ' ' || w.w2 WHERE w.step < w.lim AND w.w2 <> '{dec.END_TOKEN}') s
  JOIN dist d ON d.context = s.known_context AND s.x <= d.hi AND (s.x > d.lo OR (s.x <= 0 AND d.lo = 0)))
SELECT arm, group_id, g, coalesce(array_to_string(list(token ORDER BY step) FILTER (token IS NOT NULL), ' '), '') AS completion,
       max(CASE WHEN token = '{dec.END_TOKEN}' THEN 1 ELSE 0 END) = 1 AS finished, CAST(count(token) AS INTEGER) AS steps
FROM walk GROUP BY ALL"""
