"""Seeded choices that do not depend on the order of processing: all come from MD5 of seed, row and purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def digest(*parts: Column | str | int, seed: int = SEED) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(p) for p in (seed, *parts)]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def number(hexadecimal: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long")


def pick(n: Column, *parts: Column | str | int, seed: int = SEED) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(number(digest(*parts, seed=seed)), n)
