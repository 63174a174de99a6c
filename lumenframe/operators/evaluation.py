"""Evaluation bundles: known identities against clusters, detector scores by difficulty, predictions of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.errors import EvaluationDataError
from lumenframe.operators import cluster_metrics, detection

#: Pair F1 that a run with known identities must reach.
GATE = 0.98


def identity_gate(truth: DataFrame, clustered: DataFrame, least: float = GATE) -> DataFrame:
    """One row: pair precision, recall and F1, persons, split persons, passed.

    ``truth``: face_id, true_person, is_noise (0 or 1); ``clustered``: face_id, cluster_id. Noise is left
    out; passed needs the F1 and one cluster a person. Pairs are counted from the sizes of cells.
    """
    rows = truth.where(F.col("is_noise").cast("int") == 0).join(clustered.select("face_id", "cluster_id"), "face_id", "left")
    if rows.where("cluster_id is null").limit(1).count():
        raise EvaluationDataError("a face of a known person has no cluster")
    scores = cluster_metrics.clustering_metrics(rows.select(F.col("true_person").alias("true_label"), F.col("cluster_id").alias("predicted"))).select("pair_precision", "pair_recall", "pair_f1")
    split = person_clusters(truth, clustered).agg(F.count("*").alias("persons"), F.count_if(F.size("clusters") > 1).alias("split_persons"))
    out = scores.crossJoin(F.broadcast(split))
    return out.withColumn("passed", (F.col("pair_f1") >= least) & (F.col("split_persons") == 0))


def person_clusters(truth: DataFrame, clustered: DataFrame) -> DataFrame:
    """(true_person, clusters): the clusters that hold a person's faces, in order."""
    known = truth.where(F.col("is_noise").cast("int") == 0).join(clustered.select("face_id", "cluster_id"), "face_id")
    return known.groupBy("true_person").agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters"))


def detector_bundle(predictions: DataFrame, truth: DataFrame, subsets: dict[str, DataFrame], threshold: float, iou: float = 0.5) -> DataFrame:
    """One row: average precision for every subset of the truth, and the operating point at a threshold.

    ``subsets`` names the kept boxes (image, gt) of each difficulty.
    """
    point = detection.detector_curve(predictions, truth, [threshold], iou)
    out = point.select(F.struct("*").alias("operating_point"))
    for name, kept in subsets.items():
        out = out.crossJoin(F.broadcast(detection.average_precision(predictions, truth, kept, iou).select(F.col("ap").alias(f"ap_{name}"))))
    return out


def prediction_coverage(images: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: images, processed, errors, detections, images with a detection, and their shares.

    ``images``: image, error (null where it was processed); ``predictions``: image.
    """
    per = predictions.groupBy("image").agg(F.count("*").alias("n"))
    rows = images.join(per, "image", "left")
    found = rows.agg(F.count("*").alias("images"), F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"), F.count_if(F.col("n") > 0).alias("images_with_detections"))
    share = lambda c: F.coalesce(F.try_divide(c, "images"), F.lit(0.0))
    return found.withColumns({"coverage": share("processed"), "share_with_detections": share("images_with_detections")})


def pair_images(pairs: DataFrame) -> DataFrame:
    """(path): the distinct images on either side of verification pairs, in order of their path."""
    return pairs.select(F.col("left").alias("path")).union(pairs.select(F.col("right").alias("path"))).where("path is not null").distinct().orderBy("path")


def pair_predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """(left, right, same, fold, score, predicted, correct): the decision about every pair; a pair without a score is neither."""
    predicted = F.col("score") >= F.lit(float(threshold))
    return scored.select("left", "right", "same", "fold", "score", predicted.alias("predicted"), (predicted == F.col("same")).alias("correct"))
