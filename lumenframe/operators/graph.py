"""Connected components by alternating large-star and small-star rounds, all on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.staging import Staged


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest node it sees to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its other smaller neighbours and itself."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(low, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.union(low.select("u", F.col("m").alias("v"))).distinct()


#: Edges that one task may solve; more are solved by rounds over all tasks.
ONE_TASK = 1 << 16


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph: each node with the smallest id that it reaches."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    names, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = back[: len(u)], back[len(u) :], np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(names))
    yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(names[label[keep]])], ["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node named by an edge; component is the smallest reachable id.

    Rounds are written to the shared folder, so an executor lost later costs no recomputation of
    earlier rounds. A graph of at most ``ONE_TASK`` edges, by its count, is solved in one task without rounds,
    to the same result. Only one count and one checksum a round reach the driver. Null ends are ignored;
    self loops make their node known.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = pairs.where("a = b").select(F.col("a").alias("id")).distinct()
    now = Staged(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(now.df)
    if 0 < mark[0] <= ONE_TASK and now.df.schema["u"].dataType.simpleString() == "bigint":
        solved = Staged(now.df.coalesce(1).mapInArrow(_solve, "u long, v long"), "cc")
        now.drop()
        now, mark = solved, (0, None)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        nxt = Staged(_small(_large(now.df).distinct()), "cc")
        now.drop()
        now, before, mark = nxt, mark, _mark(nxt.df)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.df.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.df.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    loops = nodes.join(now.df.select(F.col("u").alias("id")).union(now.df.select(F.col("v").alias("id"))).distinct(), "id", "left_anti")
    return found.union(roots).union(loops.select("id", F.col("id").alias("component")))
