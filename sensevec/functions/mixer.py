"""Random numbers that depend on keys only, never on partitioning or task order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the integer mixer.
PRIME = 2147483647
FACTOR_1, FACTOR_2, FACTOR_I, FACTOR_SEED = 7919, 104729, 1299709, 15485863
ROUND_CONSTANTS = (12345, 67891, 24681)


def _reduced(value: Column | int, factor: int) -> Column:
    if isinstance(value, int):
        return F.lit(value % PRIME * factor % PRIME).cast("bigint")
    return F.pmod(value.cast("bigint"), F.lit(PRIME).cast("bigint")) * F.lit(factor).cast("bigint")


def mix(id1: Column | int, id2: Column | int, i: Column | int, seed: int) -> Column:
    """Integer in ``[0, PRIME)``; every term is reduced first, so nothing overflows a BIGINT."""
    a = (
        _reduced(id1, FACTOR_1) + _reduced(id2, FACTOR_2) + _reduced(i, FACTOR_I) + _reduced(seed, FACTOR_SEED)
    ) % F.lit(PRIME)
    for c in ROUND_CONSTANTS:
        a = (a * a + F.lit(c)) % F.lit(PRIME)
    return a


def uniform(id1: Column | int, id2: Column | int, i: Column | int, seed: int) -> Column:
    """Double in ``[0, 1)``."""
    return mix(id1, id2, i, seed) / F.lit(float(PRIME))
