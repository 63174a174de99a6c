"""Verification scores: threshold sweeps as running sums, ROC, AUC, EER, TAR at FAR, cross-validation.

Rows have score (double), same (boolean) and, for cross-validation, fold (int). A column weight says how
many pairs a row stands for, so counted scores go in as they come out of a block of pairs; without it each
row is one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.errors import EvaluationDataError
from lumenframe.functions.vectors import dot
from lumenframe.operators.reports import with_prf
from lumenframe.plans.prefix import running_sums
from lumenframe.plans.staging import Staged

FARS = (0.1, 0.01, 0.001, 0.0001)
INF = float("inf")


def pair_scores(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(left, right, same, fold, score): dot products of the pairs' vectors. ``embeddings``: path, vector."""
    a, b = embeddings.select(F.col("path").alias("left"), F.col("vector").alias("_a")), embeddings.select(F.col("path").alias("right"), F.col("vector").alias("_b"))
    return pairs.join(a, "left").join(b, "right").select("left", "right", "same", "fold", dot("_a", "_b").alias("score"))


def _finish(points: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the end points and the rest of the counts to running (tp, fp)."""
    t = F.broadcast(totals)
    grown = points.join(t, keys) if keys else points.crossJoin(t)
    ends = totals.select(*keys, F.explode(F.array(F.struct(F.lit(INF).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp")), F.struct(F.lit(-INF).alias("threshold"), F.col("pos").alias("tp"), F.col("neg").alias("fp")))).alias("e"), "pos", "neg")
    both = grown.select(*keys, "threshold", "tp", "fp", "pos", "neg").union(ends.select(*keys, "e.threshold", "e.tp", "e.fp", "pos", "neg"))
    return with_prf(both.withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")}))


def _tally(rows: DataFrame, keys: list[str], positive: str, negative: str) -> DataFrame:
    """Numbers of same and of different pairs by key."""
    w = (F.col("weight") if "weight" in rows.columns else F.lit(1)).cast("long")
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("same"), w)), F.lit(0)).alias(positive), F.coalesce(F.sum(F.when(~F.col("same"), w)), F.lit(0)).alias(negative))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """(threshold, tp, fp, pos, neg, fn, tn, precision, recall, f1) at every distinct score and at both infinities."""
    by = Staged(_tally(rows.withColumnRenamed("score", "threshold"), ["threshold"], "p", "n"), "scores").df
    totals = by.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("neg"))
    return _finish(running_sums(by, [F.col("threshold").desc()], {"tp": "p", "fp": "n"}), totals, [])


def _folded(rows: DataFrame) -> DataFrame:
    """(fold, score, p, n): the pairs counted once, for every fold and distinct score."""
    return Staged(_tally(rows, ["fold", "score"], "p", "n"), "folds").df


def _train_sweeps(cells: DataFrame, folds: int) -> DataFrame:
    own = cells.select(F.col("fold").alias("held"), F.col("score").alias("threshold"), F.col("p").alias("_p"), F.col("n").alias("_n"))
    every = cells.groupBy(F.col("score").alias("threshold")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    each = every.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).join(own, ["held", "threshold"], "left")
    by = each.select("held", "threshold", (F.col("p") - F.coalesce("_p", F.lit(0))).alias("p"), (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n")).where("p + n > 0")
    w = Window.partitionBy("held").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    points = by.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w)})
    return _finish(points, by.groupBy("held").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg")), ["held"])


def fold_sweeps(rows: DataFrame, folds: int = 10) -> DataFrame:
    """The sweep of each fold's training rows, all rows of the other folds; adds held.

    Pairs are counted once by fold and score; a fold's training counts are all counts less its own.
    """
    return _train_sweeps(_folded(rows), folds)


def _best(sweep: DataFrame, order: Column, keys: list[str]) -> DataFrame:
    cols = [c for c in sweep.columns if c not in keys]
    best = sweep.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("b"))
    return best.where("b is not null").select(*keys, "b.*")


def best_threshold(sweep: DataFrame, min_precision: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """The row of largest f1, then recall, then threshold, among those precise enough."""
    fit = sweep if min_precision is None else sweep.where(F.col("precision") >= min_precision)
    return _best(fit, F.struct("f1", "recall", "threshold"), keys or [])


def best_accuracy_threshold(sweep: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The row of most correct decisions, then f1, then threshold."""
    return _best(sweep, F.struct(F.col("tp") + F.col("tn"), F.col("f1"), F.col("threshold")), keys or [])


def roc_points(sweep: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr); denominators are at least 1."""
    return sweep.select("threshold", (F.col("fp") / F.greatest("neg", F.lit(1))).alias("fpr"), (F.col("tp") / F.greatest("pos", F.lit(1))).alias("tpr"), "neg")


def auc_eer(roc: DataFrame) -> DataFrame:
    """One row (roc_auc, eer): trapezoids under the curve; the rates' mean where they first come closest.

    Points are ordered by falling threshold, in ranges; a range's first point meets the last one of the range
    before, and only these ends, two a range, meet in one task. Ties between distances go to the larger threshold.
    """
    ranged = roc.select("threshold", "fpr", "tpr").repartitionByRange(F.desc("threshold")).withColumn("_part", F.spark_partition_id())
    held = Staged(ranged, "roc").df
    w = Window.partitionBy("_part").orderBy(F.desc("threshold"))
    area = lambda f0, t0, f1, t1: (f1 - f0) * (t1 + t0) / 2
    step = held.withColumn("a", area(F.lag("fpr").over(w), F.lag("tpr").over(w), F.col("fpr"), F.col("tpr")))
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    inner = step.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.min_by((F.col("fpr") + 1 - F.col("tpr")) / 2, F.struct(gap, -F.col("threshold"))).alias("eer"))
    point = F.struct("fpr", "tpr")
    ends = held.groupBy("_part").agg(F.max_by(point, "threshold").alias("first"), F.min_by(point, "threshold").alias("last"))
    before = F.lag("last").over(Window.orderBy("_part"))
    seams = ends.withColumn("_b", before).agg(F.coalesce(F.sum(area(F.col("_b.fpr"), F.col("_b.tpr"), F.col("first.fpr"), F.col("first.tpr"))), F.lit(0.0)).alias("s"))
    return inner.crossJoin(F.broadcast(seams)).select((F.col("a") + F.col("s")).alias("roc_auc"), "eer")


def tar_at_far(roc: DataFrame, fars=FARS) -> DataFrame:
    """(far, tar, low_support): the best true rate within each false rate; support is low below ten expected errors."""
    one = roc.agg(*(F.coalesce(F.max(F.when(F.col("fpr") <= f, F.col("tpr"))), F.lit(0.0)).alias(f"t{i}") for i, f in enumerate(fars)), F.max("neg").alias("neg"))
    each = F.explode(F.array(*(F.struct(F.lit(float(f)).alias("far"), F.col(f"t{i}").alias("tar"), (F.col("neg") * f < 10).alias("low_support")) for i, f in enumerate(fars))))
    return one.select(each.alias("e")).select("e.*")


def cross_validation(rows: DataFrame, folds: int = 10, fold_size: int | None = 600) -> DataFrame:
    """(fold, threshold, tp, fp, fn, tn, accuracy): each fold judged by the threshold that the others choose.

    ``fold_size`` demands that many rows in each fold, half of them positive.
    """
    if fold_size is not None:
        found = rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("same").alias("p"))
        good = found.where((F.col("n") == fold_size) & (F.col("p") * 2 == fold_size) & F.col("fold").between(0, folds - 1)).count()
        if good != folds or found.count() != folds:
            raise EvaluationDataError(f"{folds} balanced folds of {fold_size} rows are needed")
    cells = _folded(rows)
    chosen = best_accuracy_threshold(_train_sweeps(cells, folds), ["held"]).select(F.col("held").alias("fold"), "threshold")
    said = F.col("score") >= F.col("threshold")
    count = lambda side, hit: F.coalesce(F.sum(F.when(hit, F.col(side))), F.lit(0))
    judged = cells.join(F.broadcast(chosen), "fold").groupBy("fold", "threshold")
    out = judged.agg(count("p", said).alias("tp"), count("n", said).alias("fp"), count("p", ~said).alias("fn"), count("n", ~said).alias("tn"))
    return out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the accuracies, median threshold."""
    return folds.agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"), F.median("threshold").alias("verification_threshold"))


def class_means(rows: DataFrame) -> DataFrame:
    """One row: the mean score of same and of different pairs."""
    w = F.col("weight") if "weight" in rows.columns else F.lit(1)
    mean = lambda hit: F.sum(F.when(hit, F.col("score") * w)) / F.sum(F.when(hit, w))
    return rows.agg(mean(F.col("same")).alias("same_mean"), mean(~F.col("same")).alias("different_mean"))
