"""Token-array expressions (P4-P7, P12-P14, A13, A14, T13-T15). All JVM higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def strip_padding(ids, mask) -> Column:
    """Keep the ids whose mask is 1."""
    z = F.arrays_zip(_c(ids).alias("i"), _c(mask).alias("m"))
    return F.transform(F.filter(z, lambda x: x["m"] == 1), lambda x: x["i"])


def first_eos(ids, eos: Sequence[int]) -> Column:
    """1-based position of the first EOS id, 0 when there is none (T13: any id of the set)."""
    pos = [F.array_position(_c(ids), int(e)) for e in eos]
    nz = [F.when(p > 0, p) for p in pos]
    return F.coalesce(F.least(*nz) if len(nz) > 1 else nz[0], F.lit(0)).cast("int")


def has_eos(ids, eos: Sequence[int]) -> Column:
    """A13."""
    return F.exists(_c(ids), lambda x: x.isin(*[int(e) for e in eos]))


def truncate_at_eos(ids, eos: Sequence[int]) -> Column:
    """P5: keep up to and including the first EOS; without EOS keep everything."""
    p = first_eos(ids, eos)
    return F.when(p > 0, F.slice(_c(ids), F.lit(1), p)).otherwise(_c(ids))


def completion_mask(ids, eos: Sequence[int]) -> Column:
    """mask[j] = 1 for j up to and including the first EOS (all ones without EOS)."""
    p, n = first_eos(ids, eos), F.size(_c(ids))
    ones = F.when(p > 0, p).otherwise(n)  # one search an array, not one an element
    return F.when(_c(ids).isNotNull(), F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), n - ones)))


def drop_prefix(ids, prompt_len) -> Column:
    """The ids after the first ``prompt_len`` (the generated part)."""
    n = prompt_len if isinstance(prompt_len, Column) else F.lit(int(prompt_len))
    return F.slice(_c(ids), n + 1, F.greatest(F.size(_c(ids)) - n, F.lit(0)))


def cap_length(ids, max_len: int) -> Column:
    """Keep at most ``max_len`` ids."""
    return F.slice(_c(ids), F.lit(1), F.lit(int(max_len)))


def strip_special(ids, special: Sequence[int]) -> Column:
    """Remove special ids."""
    return F.filter(_c(ids), lambda x: ~x.isin(*[int(s) for s in special]))


def left_pad(ids, length, pad: int) -> Column:
    """P13 (left padding): pad ids on the left to ``length``."""
    n = F.greatest(length - F.size(_c(ids)), F.lit(0))
    return F.concat(F.array_repeat(F.lit(int(pad)), n), _c(ids))


def left_pad_mask(ids, length) -> Column:
    """0 for padding, 1 for real ids."""
    n = F.greatest(length - F.size(_c(ids)), F.lit(0))
    return F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size(_c(ids))))


def positional_checksum(ids) -> Column:
    """Sum of id * (position + 1): an exact order-sensitive fingerprint of an id array."""
    return F.aggregate(
        F.transform(_c(ids), lambda x, i: x.cast("long") * (i + 1).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b
    )


def right_pad(ids, length, pad: int) -> Column:
    """P13 (right padding, the evaluation side): pad ids on the right to ``length``."""
    n = F.greatest(length - F.size(_c(ids)), F.lit(0))
    return F.concat(_c(ids), F.array_repeat(F.lit(int(pad)), n))


def right_pad_mask(ids, length) -> Column:
    """1 for real ids, then 0 for padding."""
    n = F.greatest(length - F.size(_c(ids)), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), F.size(_c(ids))), F.array_repeat(F.lit(0), n))


def pad_id(pad: int | None, eos: int | None) -> int:
    """The pad id falls back to the EOS id when the vocabulary has none."""
    if pad is not None:
        return int(pad)
    if eos is None:
        raise ValueError("neither a pad id nor an EOS id is defined")
    return int(eos)
