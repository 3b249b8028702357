"""Text expressions: normalisation, last number, number parsing, tolerance test, flattening.

Everything here returns a ``Column`` built from JVM-side functions, so it runs inside
whole-stage codegen and works unchanged on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the reference's behaviour) ---------------------------------
# Python's whitespace set (str.strip() and the \s class of str patterns): U+0009..U+000D,
# U+001C..U+001F, U+0020, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F,
# U+205F, U+3000. Java's (?U)\s lacks U+001C..U+001F and RE2's \s is ASCII only, so the set
# is spelled out.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex character class (Java and RE2 both read \x{...}).
WS_CLASS = "[" + "".join(f"\\x{{{ord(ch):X}}}" for ch in WS_CHARS) + "]"
# Literal removed from normalised text, then every closing brace.
BOXED_OPEN = "\\boxed{"
CLOSE_BRACE = "}"
# Numbers: optional sign, digits, optional point, digits, optional exponent (ASCII digits).
NUMBER_PATTERN = "[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
# Tolerances of the numeric comparison.
REL_TOL = 1e-9
ABS_TOL = 1e-9
# Keys tried, in order, when a struct/map cell is turned into text.
TEXT_KEYS = ("content", "text", "value", "answer", "solution")
# ------------------------------------------------------------------------------------------

STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"
WS_RUN_PATTERN = f"{WS_CLASS}+"

_INF = float("inf")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(s: Column | str) -> Column:
    """Strip Python whitespace from both ends (works from the ends; no scan of the middle)."""
    return F.btrim(_c(s), F.lit(WS_CHARS))


def collapse_ws(s: Column | str) -> Column:
    """T4: every whitespace run becomes one blank."""
    return F.regexp_replace(_c(s), WS_RUN_PATTERN, " ")


def normalize(s: Column | str) -> Column:
    """Strip, lower, collapse whitespace, drop the boxed opener, drop every '}'.

    The order matters and there is no final strip: ``"  \\boxed{ 5 } "`` becomes ``" 5 "``.
    """
    out = F.lower(strip(s))
    out = collapse_ws(out)
    out = F.replace(out, F.lit(BOXED_OPEN), F.lit(""))
    return F.replace(out, F.lit(CLOSE_BRACE), F.lit(""))


def last_number(s: Column | str) -> Column:
    """The last number-looking substring, or null when there is none."""
    return F.try_element_at(F.regexp_extract_all(_c(s), F.lit(NUMBER_PATTERN), 0), F.lit(-1))


def parse_number(s: Column | str) -> Column:
    """Text to double; null when it cannot be parsed (``1e999`` is +Infinity)."""
    return _c(s).try_cast(T.DoubleType())


def is_close(a: Column, b: Column, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> Column:
    """Equal, or both finite and within max(rel*max(|a|,|b|), abs).

    Equality first so that equal infinities match; infinities are then rejected because
    ``inf - 5 <= rel*inf`` would be true in plain arithmetic.
    """
    inf = F.lit(_INF)
    finite = (F.abs(a) != inf) & (F.abs(b) != inf)
    within = F.abs(a - b) <= F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
    return (a == b) | (finite & within)


# --- T8: schema-directed flattening of a cell to text ---------------------------------------


def _field_names(dt: T.StructType) -> list[str]:
    return [f.name for f in dt.fields]


#: Levels of nesting that ``variant_text`` follows; what lies deeper is given as JSON text.
VARIANT_DEPTH = 8


def variant_text(v: Column, depth: int = VARIANT_DEPTH) -> Column:
    """T8 for a VARIANT: the rules of ``as_text_expr``, chosen by the value of each cell at run time, so
    that strings, chats, dicts, lists and numbers may stand in one column.

    A dict with a text key becomes a list of one, a chat the list of its contents, so each level has
    one nested expression and the plan grows with ``depth``, not with its power."""
    plain = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))  # a dict or list: its JSON text
    if depth <= 0:
        return plain
    kind = F.schema_of_variant(v)
    under_key = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in TEXT_KEYS])
    chat = F.startswith(kind, F.lit("ARRAY")) & F.try_variant_get(v, "$[0].content", "variant").isNotNull()
    items = F.try_variant_get(v, "$", "array<variant>")
    items = F.when(chat, F.transform(items, lambda x: F.try_variant_get(x, "$.content", "variant"))).otherwise(items)
    parts = F.when(F.startswith(kind, F.lit("ARRAY")), items)
    parts = parts.when(F.startswith(kind, F.lit("OBJECT")) & under_key.isNotNull(), F.array(under_key))
    texts = F.transform(parts, lambda x: variant_text(x, depth - 1))
    kept = F.filter(texts, lambda t: ~chat | (t != F.lit("")))
    return F.coalesce(F.array_join(kept, "\n"), plain)


def as_text_expr(col: Column, dt: T.DataType) -> Column:
    """Build a text expression for a column of static type ``dt``.

    Dispatch happens once, at plan time, on the Spark type (no UDF); a VARIANT is dispatched on the
    value of each cell (``variant_text``):

    * null -> ``""``; string -> itself (JSON text is not parsed)
    * array of struct/map holding ``content`` (chat) -> non-empty contents joined by newline
    * struct / map -> first present key of content, text, value, answer, solution, recursively;
      a struct without any of them -> ``to_json``
    * other array -> recursive texts joined by newline, empties kept
    * anything else -> cast to string
    """
    if isinstance(dt, T.StringType):
        return F.coalesce(col, F.lit(""))
    if isinstance(dt, T.NullType):
        return F.lit("")
    if isinstance(dt, T.VariantType):
        return variant_text(col)
    if isinstance(dt, T.StructType):
        names = _field_names(dt)
        for key in TEXT_KEYS:
            if key in names:
                sub = dt[key].dataType
                return F.when(col.isNull(), F.lit("")).otherwise(as_text_expr(col.getField(key), sub))
        return F.coalesce(F.to_json(col), F.lit(""))
    if isinstance(dt, T.MapType) and not isinstance(dt.keyType, T.StringType):
        return F.coalesce(F.to_json(col), F.lit(""))  # no text keys to look up
    if isinstance(dt, T.MapType):
        vt = dt.valueType
        expr = None
        for key in TEXT_KEYS:
            cond = F.map_contains_key(col, F.lit(key))
            val = as_text_expr(F.try_element_at(col, F.lit(key)), vt)
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return F.when(col.isNull(), F.lit("")).otherwise(expr.otherwise(F.coalesce(F.to_json(col), F.lit(""))))
    if isinstance(dt, T.ArrayType):
        et = dt.elementType
        generic = F.array_join(F.transform(col, lambda x: as_text_expr(x, et)), "\n")
        chat = None
        if isinstance(et, T.StructType) and "content" in _field_names(et):
            ct = et["content"].dataType
            chat = F.array_join(
                F.filter(
                    F.transform(col, lambda x: F.coalesce(as_text_expr(x.getField("content"), ct), F.lit(""))),
                    lambda t: t != F.lit(""),
                ),
                "\n",
            )
            out = F.when(F.size(col) > 0, chat).otherwise(F.lit(""))
        elif isinstance(et, T.MapType):
            vt = et.valueType
            chat = F.array_join(
                F.filter(
                    F.transform(
                        col,
                        lambda x: F.when(
                            F.map_contains_key(x, F.lit("content")),
                            as_text_expr(F.try_element_at(x, F.lit("content")), vt),
                        ).otherwise(F.lit("")),
                    ),
                    lambda t: t != F.lit(""),
                ),
                "\n",
            )
            first_is_chat = F.coalesce(F.map_contains_key(F.try_element_at(col, F.lit(1)), F.lit("content")), F.lit(False))
            out = F.when((F.size(col) > 0) & first_is_chat, chat).otherwise(generic)
        else:
            out = generic
        return F.when(col.isNull(), F.lit("")).otherwise(F.coalesce(out, F.lit("")))
    return F.coalesce(col.cast(T.StringType()), F.lit(""))


def as_text(df, column: str) -> Column:
    """T8 for a column of ``df`` (type looked up in the schema)."""
    return as_text_expr(F.col(column), df.schema[column].dataType)
