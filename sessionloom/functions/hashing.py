"""Random numbers that depend on a key only, so results do not depend on partitioning.

The digest is MD5: every SQL engine has it, so a result can be checked elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_int(*key) -> Column:
    """A uniform integer in [0, 2**32) from the parts of a key."""
    text = F.concat_ws("|", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*key) -> Column:
    """A uniform double in [0, 1)."""
    return hashed_int(*key) / F.lit(4294967296.0)


def uniform_int(low, high, *key) -> Column:
    """A uniform integer in [low, high]."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.pmod(hashed_int(*key), (high - low + 1).cast("bigint"))).cast("bigint")


def normal(*key) -> Column:
    """A standard normal number (Box-Muller on two uniforms of the key)."""
    first = (hashed_int(*key, "a") + 1) / F.lit(4294967297.0)
    second = uniform(*key, "b")
    return F.sqrt(-2.0 * F.ln(first)) * F.cos(2.0 * F.pi() * second)
