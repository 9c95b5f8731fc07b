"""MinHash signatures of bags, equal to those of a 31-bit universal hash over the first eight bytes of md5."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def parameters(n: int = 128, seed: int = 0) -> tuple[list[int], list[int]]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, size=n, dtype=np.int64).tolist(), rng.integers(0, PRIME, size=n, dtype=np.int64).tolist()


def base_hash(c: Column) -> Column:
    """The first eight bytes of md5, little end first, modulo the prime."""
    m = F.md5(c)
    swapped = F.concat(*[F.substring(m, 15 - 2 * i, 2) for i in range(8)])
    return (F.conv(swapped, 16, 10).cast("decimal(20,0)") % F.lit(PRIME)).cast("bigint")


def signature(bag: Column, n: int = 128, seed: int = 0) -> Column:
    """The least hash of a bag under each of n functions; zeros for an empty bag."""
    a, b = parameters(n, seed)
    pairs = F.array(*[F.struct(F.lit(x).cast("bigint").alias("a"), F.lit(y).cast("bigint").alias("b")) for x, y in zip(a, b)])
    least = lambda hs, p: F.coalesce(F.array_min(F.transform(hs, lambda h: (p["a"] * h + p["b"]) % F.lit(PRIME).cast("bigint"))), F.lit(0).cast("bigint"))
    # the hashes are bound to a variable, so that they are computed once and not for every function
    return F.transform(F.array(F.transform(bag, base_hash)), lambda hs: F.transform(pairs, lambda p: least(hs, p)))[0]
