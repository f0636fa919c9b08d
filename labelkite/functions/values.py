"""Single-value expressions for parsing and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = "".join(chr(i) for i in range(33))


def trim_blanks(col) -> Column:
    """Drop blanks and control characters (0..32) at both ends."""
    return F.btrim(col, F.lit(_BLANKS))


def safe_int(col) -> Column:
    """Whole number, or null where the text is not one."""
    return F.when(col.rlike(r"^[+-]?\d+$"), col.try_cast("int"))


def safe_double(col) -> Column:
    """Number, or null where the text is not one."""
    return col.try_cast("double")


def missing_token(col, token: str = "?", fill: str | None = None) -> Column:
    """The missing token becomes null, or ``fill`` where one is given."""
    return F.when(col != token, col) if fill is None else F.when(col == token, fill).otherwise(col)


def encode_label(col, rule: str = "positive") -> Column:
    """1.0 / 0.0 label.

    ``rule='positive'``: ``positive`` is 1, all others 0. ``rule='negative'``: ``negative`` is 0,
    all others 1. The two differ for any third label.
    """
    if rule == "positive":
        return F.when(col == "positive", 1.0).otherwise(0.0)
    if rule == "negative":
        return F.when(col == "negative", 0.0).otherwise(1.0)
    raise ValueError(f"unknown rule {rule!r}")


def unit_hash(*keys, seed: int = 42) -> Column:
    """Number in [0, 1) that depends only on the keys and the seed, so a retried task repeats it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
