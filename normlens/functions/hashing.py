"""Seeded hashes that do not depend on partitioning or row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def key_text(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def seeded_digest(seed: int | str, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def hash_number(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def fold_of(seed: int | str, text: Column, folds: int) -> Column:
    """Fold 1..folds; rows with equal text always share a fold."""
    return (F.pmod(hash_number(seeded_digest(seed, text)), F.lit(folds)) + 1).cast("int")
