"""Clustering scores from the contingency table: pairs, B-cubed, adjusted Rand index, merges and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, true: str = "true_label", predicted: str = "predicted") -> DataFrame:
    """(t, p, n, tn, pn): cells with both marginals."""
    cells = rows.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    ts, ps = cells.groupBy("t").agg(F.sum("n").alias("tn"), F.count("*").alias("tk")), cells.groupBy("p").agg(F.sum("n").alias("pn"), F.count("*").alias("pk"))
    return cells.join(ts, "t").join(ps, "p")


def clustering_metrics(rows: DataFrame, true: str = "true_label", predicted: str = "predicted", at_least: int = 1) -> DataFrame:
    """One row of scores. ``at_least`` keeps only the true labels of that many rows or more.

    Without pairs, pair precision and recall are 1; an empty table gives zeros.
    """
    if at_least > 1:
        keep = rows.groupBy(true).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least).select(true)
        rows = rows.join(keep, true, "left_semi")
    cells = contingency(rows, true, predicted)
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    n, sq = F.sum("n"), F.col("n") * F.col("n")
    cell = cells.agg(n.alias("n"), F.sum(pairs("n")).alias("tp"), F.sum(sq / F.col("pn")).alias("bp"), F.sum(sq / F.col("tn")).alias("br"))
    t = cells.groupBy("t").agg(F.max("tn").alias("tn"), F.max("tk").alias("tk"), F.max("pk").alias("worst"))
    t = t.agg(F.sum(pairs("tn")).alias("true_pairs"), F.count("*").alias("labels"), F.count_if(F.col("worst") > 0).alias("_"), F.count_if(F.col("tn") >= 2).alias("large"), F.count_if((F.col("tn") >= 2) & (F.col("tk") > 1)).alias("split"), F.count_if(F.col("worst") > 1).alias("merged")).drop("_")
    p = cells.groupBy("p").agg(F.max("pn").alias("pn")).agg(F.sum(pairs("pn")).alias("predicted_pairs"), F.count("*").alias("predicted_clusters"))
    one = cell.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(p))
    over = lambda a, b, default: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.when(F.col("n") > 0, default).otherwise(0.0))
    f1 = lambda a, b: F.when(F.col(a) + F.col(b) > 0, 2 * F.col(a) * F.col(b) / (F.col(a) + F.col(b))).otherwise(0.0)
    one = one.withColumns({"pair_precision": over("tp", "predicted_pairs", 1.0), "pair_recall": over("tp", "true_pairs", 1.0), "bcubed_precision": over("bp", "n", 0.0), "bcubed_recall": over("br", "n", 0.0)})
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = F.when(total > 0, F.col("true_pairs") * F.col("predicted_pairs") / total).otherwise(0.0)
    best = 0.5 * (F.col("true_pairs") + F.col("predicted_pairs"))
    ari = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(best != expected, (F.col("tp") - expected) / (best - expected)).otherwise(1.0)
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return one.select(
        "pair_precision", "pair_recall", f1("pair_precision", "pair_recall").alias("pair_f1"), "bcubed_precision", "bcubed_recall", f1("bcubed_precision", "bcubed_recall").alias("bcubed_f1"), ari.alias("ari"),
        "predicted_clusters", part("merged", "labels").alias("wrongly_merged_identity_fraction"), part("split", "large").alias("fragmented_identity_fraction"),
    )
