"""Strata, allocation, hash samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_strata(rows: DataFrame, strata: dict[str, Column], rest: str) -> DataFrame:
    """``rows`` with ``stratum``: of those that hold, the one with fewest rows (ties by name); else ``rest``. Only the counts reach the driver."""
    flags = rows.select("*", *(c.alias(f"_in_{n}") for n, c in strata.items()))
    counts = flags.agg(*(F.count_if(F.coalesce(F.col(f"_in_{n}"), F.lit(False))).alias(n) for n in strata)).first().asDict()
    chosen = F.coalesce(*(F.when(F.col(f"_in_{n}"), F.lit(n)) for n in sorted(strata, key=lambda n: (counts[n], n))), F.lit(rest))
    return flags.withColumn("stratum", chosen).drop(*(f"_in_{n}" for n in strata))


def allocate(pools: dict[str, int], total: int, floor: int = 30) -> dict[str, int]:
    """Sizes of strata: a floor each, the rest in proportion to the pools by largest remainder (ties by name), never more than a pool has."""
    if any(n < floor for n in pools.values()) or floor * len(pools) > total or total > sum(pools.values()):
        raise ValueError(f"{total} rows with at least {floor} of each do not fit pools of {pools}")
    rest, whole = total - floor * len(pools), sum(pools.values())
    share = {n: rest * p / whole for n, p in pools.items()}
    out = {n: min(pools[n], floor + int(share[n])) for n in pools}
    by_remainder = sorted(pools, key=lambda n: (int(share[n]) - share[n], n))
    while (left := total - sum(out.values())) > 0:
        for n in [n for n in by_remainder if out[n] < pools[n]][:left]:
            out[n] += 1
    return out


#: Parts of a stratum ranked on their own before the strata are.
BLOCKS = 256


def hash_sample(rows: DataFrame, key: str, n: int | dict[str, int], seed: int = 42, stratum: str | None = None) -> DataFrame:
    """``n`` rows (of each stratum) with the least hash of seed and key: the same whatever the partitions.

    A stratum may hold most rows, so each is ranked in blocks first: its ``n`` least are among the ``n`` least of its blocks.
    """
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    if stratum is None:
        return rows.orderBy(*order).limit(n)
    block = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(BLOCKS))
    if isinstance(n, dict):
        quota = F.coalesce(F.create_map(*(F.lit(x) for kv in n.items() for x in kv))[F.col(stratum)], F.lit(0)) if n else F.lit(0)
    else:
        quota = F.lit(n)
    for by in ([F.col(stratum), block], [F.col(stratum)]):
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= quota).drop("_rank")
    return rows


def split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows`` with ``part`` train or validation: by hash order, floor(share * n) validation rows, at least 1 and at most n - 1.

    Counts of the hash's first 16 bits (at most 65,536 rows) tell in which slice the cut lies; only that
    slice is sorted, and a row is placed by comparing it with the cut. Rows of one key stay together, so
    repeated keys at the cut may add a few; rows with a null key train.
    """
    slice_ = F.shiftright("_h", 48)
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    ids = hashed.filter(F.col(key).isNotNull()).select("_h", F.col(key).alias("_k"), slice_.alias("_s"))
    counts = sorted((r["_s"], r["count"]) for r in ids.groupBy("_s").count().collect())
    n = sum(c for _, c in counts)
    left = max(1, min(n - 1, int(share * n))) if n > 1 else 0
    part = F.lit("train")
    for s, c in counts if left else ():
        if left <= c:
            cut = ids.filter(F.col("_s") == s).orderBy("_h", "_k").limit(left).agg(F.max(F.struct("_h", "_k")).alias("x")).first()["x"]
            part = F.when((F.col("_h") < cut["_h"]) | ((F.col("_h") == cut["_h"]) & (F.col(key) <= F.lit(cut["_k"]))), "validation").otherwise("train")
            break
        left -= c
    return hashed.withColumn("part", part).drop("_h")


def mixed_key(key: str, seed: int) -> str:
    """A portable mixing of whole numbers, for samples that another engine has to repeat."""
    return f"(({key} * 2654435761 + {seed} * 40503) % 4294967296)"
