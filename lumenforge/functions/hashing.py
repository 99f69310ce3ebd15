"""Deterministic fractions, splits, shards and names from digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(salt: str, key: Column, digits: int = 12) -> Column:
    """A number in [0, 1) from the first hex digits of sha256(salt:key)."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("double") / F.lit(float(16**digits))


def split(salt: str, group: Column, train: float = 0.6, calibration: float = 0.2) -> Column:
    """train, calibration or test; all rows of a group fall on one side."""
    f = fraction(salt, group)
    return F.when(f < train, "train").when(f < train + calibration, "calibration").otherwise("test")


def bernoulli(seed: str, key: Column, rate: float) -> Column:
    """True for a share of keys, by the first eight hex digits of sha1(seed:key)."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) < rate


def shard(key: Column, n: int) -> Column:
    """The first eight bytes of sha256(key) modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("long")


def order(seed: str, key: Column) -> Column:
    """Sorting by this is a seeded shuffle that stays the same on any cluster."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def window_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256), 1, 20))


def worker(key: Column, shares: dict[str, int]) -> Column:
    """The worker of a key: as many buckets as the shares add up to, dealt to the workers in order."""
    bucket = shard(key, sum(shares.values()))
    out, upto = F.lit(None).cast("string"), sum(shares.values())
    for name, n in reversed(shares.items()):
        out = F.when(bucket < upto, name).otherwise(out)
        upto -= n
    return out
