"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

1. Documents are pre-aggregated to cells (source, language, topic) with their token counts; the cell
   table is the only thing the fitting moves.
2. The draw is to have ``fraction`` of all tokens. A margin value can give at most what it has, so a
   target beyond ``HEADROOM`` of that is cut to it and what is missing goes to the other values of the
   margin, in proportion (again, until none is beyond).
3. Capped raking: each sweep scales the cell weights to the target share of every source, then
   language, then topic. A cell is never raised above its tokens; full cells stand still while a
   margin rises, and the open ones share what is left of it; they fall with a margin that falls. The
   sweeps end when no margin is off by more than ``TOLERANCE`` of the draw; if ``SWEEPS`` are not
   enough (targets that contradict each other), a warning says how far off they are.
4. Weight over tokens is the probability of a cell's documents. A document is drawn if a uniform number
   from a hash of (seed, id) is below it, so the draw is the same after retries, for any partitioning,
   and document by document.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a margin's value: proportional to its tokens to this power (1: as found).
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.85}
FRACTION, SEED = 0.8, 17
#: Most sweeps, the margin error (share of the draw) at which they end, and the part of a margin
#: value's tokens that may be drawn (at least the fraction).
SWEEPS, TOLERANCE, HEADROOM = 30, 1e-3, 0.9


def form_topic(text: Column) -> Column:
    """A topic for tables without one: the form of the text (fixed rule)."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("!!")), "shouting")
        .when(F.length(t) < 1000, "note")
        .when(F.length(t) < 5000, "article")
        .otherwise("book")
    )


def token_count(text: Column) -> Column:
    """Words between ASCII white space; at least one, so that empty texts have a weight."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(1))


def temperature_targets(cells: DataFrame, powers: dict[str, float] = TEMPERATURE) -> dict[str, DataFrame]:
    """Per dimension (value, share): shares proportional to tokens^power."""
    out = {}
    for d, p in powers.items():
        m = cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(p))).alias("raw"))
        whole = m.agg(F.sum("raw")).first()[0]
        out[d] = m.select("value", (F.col("raw") / F.lit(whole)).alias("share"))
    return out


def _margins(cells: DataFrame, targets: dict[str, DataFrame], amount: str) -> DataFrame:
    """(dimension, value, share, sum of ``amount``) of all margins in one pass; cells carry share_<d>."""
    each = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.coalesce(f"share_{d}", F.lit(0.0)).alias("share")) for d in targets]
    rows = cells.select(F.explode(F.array(*each)).alias("m"), F.col(amount).cast("double").alias("x"))
    return rows.groupBy("m.dimension", "m.value", "m.share").agg(F.sum("x").alias("amount"))


def _with_shares(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    for d, target in targets.items():
        cells = cells.join(target.select(F.col("value").alias(d), F.col("share").alias(f"share_{d}")), d, "left")
    return cut_lineage(cells)


def reachable_targets(cells: DataFrame, targets: dict[str, DataFrame], fraction: float = FRACTION) -> dict[str, DataFrame]:
    """``targets`` cut to what a draw of ``fraction`` of all tokens can reach: (value, share, target).
    With the factor by which uncut shares grow, the cut values are known; the factor only rises."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cap = max(HEADROOM, fraction) / (fraction * total) if fraction * total else 0.0
    out = {}
    for d, target in targets.items():
        there = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
        most = F.coalesce("tokens", F.lit(0.0)) * F.lit(cap)
        m = cut_lineage(target.select("value", "share").join(there, "value", "left").select("value", "share", most.alias("most")))
        factor = 0.0
        while True:
            beyond = F.col("share") * F.lit(factor) >= F.col("most")
            cut, open_ = m.agg(F.sum(F.when(beyond, F.col("most")).otherwise(0.0)), F.sum(F.when(beyond, 0.0).otherwise(F.col("share")))).first()
            if not open_ or (1.0 - cut) / open_ <= factor * (1 + 1e-12):
                break
            factor = (1.0 - cut) / open_
        out[d] = cut_lineage(m.select("value", F.least(F.col("share") * F.lit(factor), F.col("most")).alias("share"), F.col("share").alias("target")))
    return out


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, budget: float | None = None, tolerance: float = TOLERANCE
) -> DataFrame:
    """``cells`` with the column weight, whose margins are the targets' shares of ``budget`` tokens
    (without one: of all tokens, and no cell is capped). A value without a target gets weight zero; a
    target without a cell is not met."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goal, capped = (total, False) if budget is None else (budget, True)
    tokens, weight = F.col("tokens").cast("double"), F.col("weight")
    out = _with_shares(cells, targets).withColumn("weight", tokens * F.lit(goal / total if total else 0.0))
    error = 0.0
    for _ in range(sweeps if total else 0):
        for d in targets:
            full = F.when(weight >= tokens, tokens).otherwise(0.0)
            now = out.groupBy(d).agg(F.sum("weight").alias("now"), F.sum(full).alias("full"))
            need, left = F.coalesce(f"share_{d}", F.lit(0.0)) * F.lit(goal), F.col("now") - F.col("full")
            scaled = F.when(F.col("now") > 0, weight * (need / F.col("now"))).otherwise(0.0)
            if capped:
                raised = F.least(tokens, F.when(left > 0, weight * ((need - F.col("full")) / left)).otherwise(weight))
                scaled = F.when(need <= F.col("now"), scaled).when(weight >= tokens, tokens).otherwise(raised)
            # each step reads its input twice (margin and join), so lineage is cut step by step
            out = cut_lineage(out.join(now, d).withColumn("weight", scaled).drop("now", "full"))
        gap = F.max(F.abs(F.col("amount") - F.col("share") * F.lit(goal)))
        error = _margins(out, targets, "weight").agg(gap).first()[0] / goal
        if error <= tolerance:
            break
    else:
        if total:
            warnings.warn(f"margins are off by up to {error:.3g} of the budget after {sweeps} sweeps", stacklevel=2)
    return out.drop(*[f"share_{d}" for d in targets])


def uniform(seed: int, id_col: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5('seed:id'); a null id counts as ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cell_columns(text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> dict[str, Column]:
    """source, lang, topic and tokens of a document; nulls count as ''."""
    return {
        "source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
        "topic": F.coalesce(form_topic(F.col(text_col)) if topic is None else topic, F.lit("")),
        "tokens": token_count(F.col(text_col)),
    }


def sampling_odds(rows: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, sweeps: int = SWEEPS) -> DataFrame:
    """(source, lang, topic, probability) from rows with ``cell_columns``."""
    cells = cut_lineage(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    goals = reachable_targets(cells, temperature_targets(cells) if targets is None else targets, fraction)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted = rake(cells, goals, sweeps, fraction * total)
    return cut_lineage(fitted.select(*DIMENSIONS, F.round(F.least(F.lit(1.0), F.col("weight") / F.col("tokens")), 9).alias("probability")))


def mix_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
    fraction: float = FRACTION,
    sweeps: int = SWEEPS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: ``id_col``, source, lang, topic, tokens, probability, selected.

    Null sources, languages and topics count as the value ''. Null texts count as empty and weigh
    one token. Rows that repeat an id are drawn alike. ``targets`` maps 'source', 'lang', 'topic' to
    DataFrames (value, share); without it, shares are proportional to powers of the tokens. An empty
    table gives an empty result; other columns are ignored."""
    cols = cell_columns(text_col, source_col, lang_col, topic)
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in cols.items()]))  # narrow: the texts are read once
    drawn = rows.join(sampling_odds(rows, targets, fraction, sweeps), list(DIMENSIONS)).select("id", *DIMENSIONS, "tokens", "probability")
    return drawn.withColumn("selected", uniform(seed, F.col("id")) < F.col("probability")).withColumnRenamed("id", id_col)


def margin_report(mixed: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION) -> DataFrame:
    """(dimension, value, target, reachable, expected, drawn): shares of the tokens in rows of
    ``mix_to_targets``."""
    cells = cut_lineage(
        mixed.groupBy(*DIMENSIONS).agg(
            F.sum("tokens").alias("tokens"),
            F.sum(F.col("tokens") * F.col("probability")).alias("expected"),
            F.sum(F.when(F.col("selected"), F.col("tokens")).otherwise(0)).alias("drawn"),
        )
    )
    goals = reachable_targets(cells, temperature_targets(cells) if targets is None else targets, fraction)
    shared = _with_shares(cells, goals)
    whole = shared.agg(F.sum("expected"), F.sum("drawn")).first()
    asked = None
    for d, g in goals.items():
        part = g.select(F.lit(d).alias("dimension"), "value", "target")
        asked = part if asked is None else asked.unionByName(part)
    out = asked
    for k, c in enumerate(("expected", "drawn")):
        part = _margins(shared, goals, c).select("dimension", "value", "share", (F.col("amount") / (whole[k] or 1)).alias(c))
        out = out.join(part.withColumnRenamed("share", "reachable") if not k else part.drop("share"), ["dimension", "value"])
    return out.select("dimension", "value", "target", "reachable", "expected", "drawn")


def oracle_sql() -> str:
    """The query on ``documents`` in SQL, written out step by step from the definition."""
    ctes = [
        """rows_ AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '!!') THEN 'shouting'
       WHEN length(coalesce(text, '')) < 1000 THEN 'note' WHEN length(coalesce(text, '')) < 5000 THEN 'article' ELSE 'book' END AS topic,
  greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS tokens FROM documents)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(tokens) AS t FROM c)",
    ]
    for d, p in TEMPERATURE.items():
        ctes.append(f"raw_{d} AS (SELECT {d} AS v, pow(sum(tokens), {p}) AS raw FROM c GROUP BY {d})")
        ctes.append(f"goal_{d} AS MATERIALIZED (SELECT v, raw / (SELECT sum(raw) FROM raw_{d}) AS share FROM raw_{d})")
    cap = max(HEADROOM, FRACTION)
    ctes.append(f"budget AS MATERIALIZED (SELECT {FRACTION}::DOUBLE * t AS b, {cap}::DOUBLE / ({FRACTION}::DOUBLE * t) AS cap FROM total)")
    for d in DIMENSIONS:
        ctes.append(
            f"most_{d} AS MATERIALIZED (SELECT v, any_value(share) AS share, sum(tokens) * (SELECT cap FROM budget) AS most FROM c JOIN goal_{d} ON c.{d} = v GROUP BY v)"
        )
        ctes.append(f"f_{d}_0 AS (SELECT 0.0::DOUBLE AS f)")
        for i in range(8):  # enough for every value to be cut in turn on the tables at hand
            beyond = f"share * (SELECT f FROM f_{d}_{i}) >= most"
            ctes.append(
                f"f_{d}_{i + 1} AS MATERIALIZED (SELECT greatest((SELECT f FROM f_{d}_{i}), coalesce((1.0::DOUBLE - sum(CASE WHEN {beyond} THEN most ELSE 0 END)) "
                f"/ nullif(sum(CASE WHEN {beyond} THEN 0 ELSE share END), 0), 0)) AS f FROM most_{d})"
            )
        ctes.append(f"reach_{d} AS MATERIALIZED (SELECT v, least(share * (SELECT f FROM f_{d}_8), most) AS share FROM most_{d})")
    shares = " ".join(f"JOIN reach_{d} ON c.{d} = reach_{d}.v" for d in DIMENSIONS)
    ctes.append(f"cells AS MATERIALIZED (SELECT c.*, {', '.join(f'reach_{d}.share AS g_{d}' for d in DIMENSIONS)} FROM c {shares})")
    step = f"SELECT * FROM walk WHERE err > {TOLERANCE} AND sweep < {SWEEPS}"
    for d in DIMENSIONS:
        summed = f"SELECT *, sum(w) OVER (PARTITION BY {d}) AS now, sum(CASE WHEN w >= tokens THEN tokens ELSE 0 END) OVER (PARTITION BY {d}) AS whole FROM ({step})"
        step = (
            f"SELECT * EXCLUDE (w, now, whole), CASE WHEN g_{d} * b <= now THEN CASE WHEN now > 0 THEN w * (g_{d} * b / now) ELSE 0 END WHEN w >= tokens THEN tokens "
            f"WHEN now - whole > 0 THEN least(tokens, w * ((g_{d} * b - whole) / (now - whole))) ELSE w END AS w FROM ({summed})"
        )
    sums = ", ".join(f"sum(w) OVER (PARTITION BY {d}) AS m_{d}" for d in DIMENSIONS)
    gap = ", ".join(f"abs(m_{d} - g_{d} * b)" for d in DIMENSIONS)
    names = f"source, lang, topic, tokens, {', '.join(f'g_{d}' for d in DIMENSIONS)}, b"
    ctes.append(
        f"walk AS (SELECT 0 AS sweep, {names}, tokens * (b / (SELECT t FROM total)) AS w, 1.0::DOUBLE AS err FROM cells, budget UNION ALL "
        f"SELECT sweep + 1 AS sweep, {names}, w, max(greatest({gap})) OVER () / b AS err FROM (SELECT *, {sums} FROM ({step})))"
    )
    ctes.append(
        "odds AS MATERIALIZED (SELECT source, lang, topic, round(least(1.0, w / tokens), 9) AS probability FROM walk WHERE sweep = (SELECT max(sweep) FROM walk))"
    )
    return (
        "WITH RECURSIVE "
        + ",\n".join(ctes)
        + f"""
SELECT doc_id, source, lang, topic, tokens, probability,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {1 << 52}.0 < probability AS selected
FROM rows_ JOIN odds USING (source, lang, topic)"""
    )
