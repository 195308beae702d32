"""Seeded randomness from row keys.

Every random choice is a function of a row key and a seed, never of the partitioning, so a
retried task, another cluster size or plain SQL gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15  # hex digits that fit a positive BIGINT
SPAN = float(16**DIGITS)


def row_hash(*parts: Column | str | int) -> Column:
    """32 hex digits over the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_number(digest: Column, start: int = 1, length: int = DIGITS) -> Column:
    """Hex digits of a digest as a non-negative BIGINT."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def unit_interval(digest: Column, start: int = 1) -> Column:
    """A double in [0, 1)."""
    return hash_number(digest, start, 13) / F.lit(float(16**13))
