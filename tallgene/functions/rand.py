"""Deterministic randomness: every draw is a pure function of a seed and row keys.

A draw does not depend on partitioning, task retries or row order, so a lost executor
recomputes exactly the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52  # all of a double's fraction, and more draws than any table has rows
SCALE = float(1 << BITS)


def _col(k) -> Column:
    return k if isinstance(k, Column) else F.col(k)


def hash_text(seed, *keys) -> Column:
    """The 13 hexadecimal digits of :func:`hash_int`, which sort as the number does."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys])
    return F.substring(F.md5(text), 1, 13)


def hash_int(seed, *keys) -> Column:
    """52-bit integer hash of (seed, keys) as bigint."""
    return F.conv(hash_text(seed, *keys), 16, 10).cast("bigint")


def hash_uniform(seed, *keys) -> Column:
    """Uniform draw in [0, 1) from (seed, keys)."""
    return hash_int(seed, *keys) / F.lit(SCALE)


def hash_int_sql(seed, *keys: str) -> str:
    """DuckDB twin of :func:`hash_int`."""
    parts = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT)"


def hash_uniform_sql(seed, *keys: str) -> str:
    """DuckDB twin of :func:`hash_uniform`."""
    return f"({hash_int_sql(seed, *keys)} / {SCALE!r})"
