"""Hash orders and hash uniforms: the same for any partitioning, unlike a random generator's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix(text: Column) -> Column:
    """The first 64 bits of the SHA-256, as hex; text order is number order."""
    return F.substring(F.sha2(text.cast("string"), 256), 1, 16)


def seeded(seed: int, key: Column) -> Column:
    return prefix(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from 32 bits of the hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
