"""DuckDB SQL fragments for the oracle queries (plain strings; no execution here).

Each helper mirrors one column builder of ``strata.functions`` so that the oracle evaluates the
same rules independently of Spark.
"""

from __future__ import annotations

from strata.functions.text import ABS_TOL, NUMBER_PATTERN, REL_TOL, WS_CLASS

WS_RUN = f"{WS_CLASS}+"
STRIP = f"^{WS_CLASS}+|{WS_CLASS}+$"


def q(s: str) -> str:
    """SQL string literal (standard SQL: only quotes are escaped)."""
    return "'" + s.replace("'", "''") + "'"


def normalize(x: str) -> str:
    s = f"lower(regexp_replace({x}, {q(STRIP)}, '', 'g'))"
    s = f"regexp_replace({s}, {q(WS_RUN)}, ' ', 'g')"
    s = f"replace({s}, {q(chr(92) + 'boxed{')}, '')"
    return f"replace({s}, '}}', '')"


def last_number(x: str) -> str:
    return f"regexp_extract_all({x}, {q(NUMBER_PATTERN)})[-1]"


def is_close(a: str, b: str) -> str:
    inf = "'inf'::DOUBLE"
    return (
        f"(({a}) = ({b}) OR (abs({a}) <> {inf} AND abs({b}) <> {inf} AND "
        f"abs(({a}) - ({b})) <= greatest({REL_TOL!r} * greatest(abs({a}), abs({b})), {ABS_TOL!r})))"
    )


def score(c: str, a: str) -> str:
    cn, an = normalize(c), normalize(a)
    cl, al = last_number(cn), last_number(an)
    close = is_close(f"try_cast({cl} AS DOUBLE)", f"try_cast({al} AS DOUBLE)")
    return (
        f"(CASE WHEN ({cn}) = ({an}) AND ({an}) <> '' THEN 1.0::DOUBLE "
        f"WHEN ({cl}) IS NOT NULL AND ({al}) IS NOT NULL THEN "
        f"(CASE WHEN coalesce({close}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) "
        f"ELSE 0.0::DOUBLE END)"
    )


def keyed_uniform(key_sql: str) -> str:
    """Uniform in [0,1) from the first 52 bits of md5(key) (same bits as the Spark side)."""
    return f"(CAST(('0x' || substr(md5({key_sql}), 1, 13)) AS BIGINT) / 4503599627370496::DOUBLE)"


def words(x: str) -> str:
    """Lower-cased whitespace-separated words, empties dropped."""
    return f"list_filter(string_split_regex(lower({x}), {q(WS_RUN)}), lambda w: w <> '')"
