"""Deterministic draws per row: they depend on a key, a purpose and a seed, never on partitioning or order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, purpose: str, seed: int = 7) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 hash; plain SQL can compute the same."""
    text = F.concat_ws("|", key.cast("string"), F.lit(purpose), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def random_key(key: Column, purpose: str, seed: int = 7) -> Column:
    """A key in [0, 2 ** 60) for random orders, from the first 15 digits of an MD5 hash; plain SQL can order by the digits."""
    text = F.concat_ws("|", key.cast("string"), F.lit(purpose), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def below(key: Column, purpose: str, n: Column | int, seed: int = 7) -> Column:
    """An integer in [0, n)."""
    return F.floor(uniform(key, purpose, seed) * n).cast("int")


def choice(key: Column, purpose: str, options: list, seed: int = 7) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), below(key, purpose, len(options), seed) + 1)


def weighted(key: Column, purpose: str, weights: dict, seed: int = 7) -> Column:
    """One of the keys, with probabilities in proportion to the values."""
    u, total, upto, out = uniform(key, purpose, seed), sum(weights.values()), 0.0, None
    for option, w in list(weights.items())[:-1]:
        upto += w / total
        out = F.when(u < upto, F.lit(option)) if out is None else out.when(u < upto, F.lit(option))
    last = F.lit(list(weights)[-1])
    return last if out is None else out.otherwise(last)
