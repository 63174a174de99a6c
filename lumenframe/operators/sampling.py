"""Deterministic samples by hash order, and set relations of splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.errors import EvaluationDataError

SEED = "20260803"


def hash_key(*parts: Column | str, seed: str = SEED) -> Column:
    """SHA-256 in hex of the seed and the parts, joined by the unit separator."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), *(c.cast("string") for c in cols)), 256)


def hash_sample(rows: DataFrame, keys: list[str], n: int, seed: str = SEED) -> DataFrame:
    """The n rows of smallest hash, then key."""
    return rows.orderBy(hash_key(*keys, seed=seed), *keys).limit(n)


def stratified_sample(rows: DataFrame, strata: list[str], keys: list[str], n: int, seed: str = SEED, demand: bool = False) -> DataFrame:
    """The n rows of smallest hash in every stratum; ``demand`` raises where a stratum is short."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_key(*strata, *keys, seed=seed), *keys))
    if demand and rows.groupBy(*strata).count().where(F.col("count") < n).limit(1).count():
        raise EvaluationDataError(f"a stratum has fewer than {n} rows")
    return rows.withColumn("_k", rank).where(F.col("_k") <= n).drop("_k")


def whole_group_fit(groups: DataFrame, key: str, size: str, budget: int, seed: str = SEED) -> DataFrame:
    """(key, size, taken_before): whole groups in hash order, each taken if it still fits the budget.

    The scan is sequential and can stop once the budget is full, so candidates are cut natively to those
    no larger than the budget and streamed in order; a task holds one batch.
    """
    order = hash_key(key, seed=seed)
    kind = f"{key} {groups.schema[key].dataType.simpleString()}, {size} long, taken_before long"
    ranked = groups.where(F.col(size) <= budget).select(key, F.col(size).cast("long").alias(size), order.alias("_h"))

    def scan(batches):
        held = 0
        for part in batches:
            out = []
            for k, n in zip(part[key], part[size], strict=True):
                if held + n <= budget:
                    out.append((k, int(n), held))
                    held += int(n)
            yield pd.DataFrame(out, columns=[key, size, "taken_before"])

    return ranked.repartitionByRange(1, "_h").sortWithinPartitions("_h", key).select(key, size).mapInPandas(scan, kind)


def overlapping_splits(rows: DataFrame, identity: str, split: str) -> DataFrame:
    """(identity, splits): identities in two splits or more; empty where splits are disjoint."""
    return rows.groupBy(identity).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def assert_disjoint(rows: DataFrame, identity: str, split: str) -> None:
    bad = overlapping_splits(rows, identity, split).limit(1).collect()
    if bad:
        raise EvaluationDataError(f"{identity} {bad[0][0]} is in more than one {split}")


def profile_sets(rows: DataFrame, key: str, smoke: int, dev: int, seed: str = SEED) -> DataFrame:
    """Adds profile rows: smoke, the first of dev_a; dev_a, the first by hash; dev_b, all others."""
    a = hash_sample(rows.select(key), [key], dev, seed)
    s = hash_sample(a, [key], smoke, seed)
    b = rows.select(key).join(a, key, "left_anti")
    tag = lambda df, name: df.select(F.lit(name).alias("profile"), key)
    return tag(s, "smoke").union(tag(a, "dev_a")).union(tag(b, "dev_b"))


def same_keys(*tables: DataFrame, key: str) -> None:
    """Raises unless all tables have the same set of keys."""
    first = tables[0].select(key).distinct()
    for other in tables[1:]:
        gap = first.withColumn("_a", F.lit(1)).join(other.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer").where("_a is null or _b is null").limit(1).collect()
        if gap:
            raise EvaluationDataError(f"{key} {gap[0][0]} is not in all tables")


def every_kth(rows: DataFrame, order: list[Column], step: int = 1, limit: int | None = None) -> DataFrame:
    """Every step-th row of an order, from the first; at most ``limit`` of them."""
    from lumenframe.plans.prefix import running_sums

    if step < 1:
        raise EvaluationDataError("step must be positive")
    if step == 1:
        return rows.orderBy(*order).limit(limit) if limit is not None else rows
    placed = running_sums(rows.withColumn("_one", F.lit(1)), order, {"_upto": "_one"})
    out = placed.where((F.col("_upto") - 1) % step == 0)
    out = out if limit is None else out.where(F.col("_upto") <= (limit - 1) * step + 1)
    return out.drop("_one", "_upto")
