"""Detector evaluation: matching, curves, average precision, main boxes.

Predictions: image, det (int, the order of ties), box, score. Ground truth: image, gt (int), box.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import area, iou
from lumenframe.operators.reports import with_prf
from lumenframe.plans.groups import solve_groups

IOU = 0.5


def iou_pairs(predictions: DataFrame, truth: DataFrame, closed: bool = True) -> DataFrame:
    """(image, det, score, gt, iou) of all pairs of an image."""
    g = truth.select("image", "gt", F.col("box").alias("_g"))
    return predictions.join(g, "image").select("image", "det", "score", "gt", iou("box", "_g", closed).alias("iou"))


def greedy_matches(predictions: DataFrame, truth: DataFrame, least: float = IOU) -> DataFrame:
    """(image, det, score, matched): predictions by falling score take their best free box.

    Matching at a threshold is a prefix of matching all, so one pass serves every threshold. Ties of
    score go to the later det, ties of overlap to the later box.
    """
    pairs = iou_pairs(predictions, truth).where(F.col("iou") >= least)
    offers = pairs.groupBy("image", "det").agg(F.array_sort(F.collect_list(F.struct("iou", "gt"))).alias("offers"))
    rows = predictions.select("image", "det", "score").join(offers, ["image", "det"], "left")

    def match(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        first, hits = set(starts.tolist()), np.zeros(len(rows), bool)
        taken: set[int] = set()
        for i, offers in enumerate(rows["offers"]):
            if i in first:
                taken = set()
            free = next((int(o["gt"]) for o in reversed(offers) if int(o["gt"]) not in taken), None)
            if free is not None:
                taken.add(free)
                hits[i] = True
        return rows[["image", "det", "score"]].assign(matched=hits)

    kind = f"image {predictions.schema['image'].dataType.simpleString()}, det {predictions.schema['det'].dataType.simpleString()}, score double, matched boolean"
    busy = solve_groups(rows.where("offers is not null"), ["image"], [F.desc("score"), F.desc("det")], match, kind)
    idle = rows.where("offers is null").select("image", "det", F.col("score").cast("double"), F.lit(False).alias("matched"))
    return busy.union(idle)


def detector_curve(predictions: DataFrame, truth: DataFrame, thresholds: list[float], least: float = IOU) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) at each score threshold."""
    marks = sorted(set(map(float, thresholds)))
    total = truth.agg(F.count("*").alias("boxes"))
    kept = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("matched") & (F.col("score") >= t)).alias("tp"), F.count_if(~F.col("matched") & (F.col("score") >= t)).alias("fp")) for t in marks]
    one = greedy_matches(predictions, truth, least).agg(F.array(*kept).alias("k"))
    rows = one.crossJoin(F.broadcast(total)).select(F.explode("k").alias("k"), "boxes").select("k.*", (F.col("boxes") - F.col("k.tp")).alias("fn"))
    return with_prf(rows)


def operating_point(curve: DataFrame, min_precision: float | None = None) -> DataFrame:
    """The curve's row of largest f1, then recall, then threshold, among those precise enough."""
    fit = curve if min_precision is None else curve.where(F.col("precision") >= min_precision)
    return fit.orderBy(F.desc("f1"), F.desc("recall"), F.desc("threshold")).limit(1)


def proposals(predictions: DataFrame, truth: DataFrame, keep: DataFrame, least: float = IOU) -> DataFrame:
    """(image, det, score, proposal, fresh): each prediction's part in average precision.

    A prediction belongs to its best box (the first of ties). On a box outside ``keep`` (image, gt) it
    is no proposal; ``fresh`` marks the first by score that reaches a kept box.
    """
    best = iou_pairs(predictions, truth).groupBy("image", "det", "score").agg(F.max_by(F.struct("gt", "iou"), F.struct("iou", -F.col("gt"))).alias("b"))
    hits = best.where(F.col("b.iou") >= least).select("image", "det", "score", F.col("b.gt").alias("gt"))
    kept = hits.join(keep.select("image", "gt", F.lit(True).alias("kept")), ["image", "gt"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    w = Window.partitionBy("image", "gt").orderBy(F.desc("score"), F.desc("det"))
    first = kept.withColumn("fresh", F.col("kept") & (F.row_number().over(w) == 1)).select("image", "det", "kept", "fresh")
    rows = predictions.select("image", "det", "score").join(first, ["image", "det"], "left")
    return rows.select("image", "det", "score", F.coalesce("kept", F.lit(True)).alias("proposal"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


def precision_recall_points(predictions: DataFrame, truth: DataFrame, keep: DataFrame, least: float = IOU, points: int = 1000) -> DataFrame:
    """(cut, proposals, recalled) at the cutoffs 1 - cut / points of scores scaled to 0..1 over all images."""
    rows = proposals(predictions, truth, keep, least)
    ends = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = rows.crossJoin(F.broadcast(ends)).withColumn("s", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0))
    near = F.ceil((1 - F.col("s")) * points).cast("int")
    exact = lambda c: 1.0 - c / F.lit(float(points))
    cut = F.when(F.col("s") >= exact(near - 1), near - 1).when(F.col("s") >= exact(near), near).otherwise(near + 1)
    by = scaled.withColumn("cut", F.greatest(F.lit(1), cut)).groupBy("cut").agg(F.count_if("proposal").alias("p"), F.count_if("fresh").alias("r"))
    every = rows.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("cut")).join(F.broadcast(by), "cut", "left")
    w = Window.orderBy("cut")
    return every.select("cut", F.coalesce(F.sum("p").over(w), F.lit(0)).alias("proposals"), F.coalesce(F.sum("r").over(w), F.lit(0)).alias("recalled"))


def average_precision(predictions: DataFrame, truth: DataFrame, keep: DataFrame, least: float = IOU, points: int = 1000) -> DataFrame:
    """One row (ap): the area under the precision envelope over the cutoffs' recalls."""
    pr = precision_recall_points(predictions, truth, keep, least, points)
    total = keep.agg(F.greatest(F.count("*"), F.lit(1)).alias("boxes"))
    rows = pr.crossJoin(F.broadcast(total)).select("cut", F.when(F.col("proposals") > 0, F.col("recalled") / F.col("proposals")).otherwise(0.0).alias("precision"), (F.col("recalled") / F.col("boxes")).alias("recall"))
    ahead = Window.orderBy("cut").rowsBetween(0, Window.unboundedFollowing)
    env = rows.select("cut", "recall", F.max("precision").over(ahead).alias("env"), F.lag("recall", 1, 0.0).over(Window.orderBy("cut")).alias("before"))
    return env.agg(F.coalesce(F.sum((F.col("recall") - F.col("before")) * F.col("env")), F.lit(0.0)).alias("ap"))


def main_box(predictions: DataFrame, truth: DataFrame, least: float = 0.3) -> DataFrame:
    """(image, det, iou): the prediction that overlaps an image's one box best, or none below ``least``."""
    best = iou_pairs(predictions, truth, closed=False).groupBy("image").agg(F.max_by(F.struct("det", "iou"), F.struct("iou", -F.col("det"))).alias("b"))
    return best.where(F.col("b.iou") >= least).select("image", "b.det", "b.iou")


def largest_box(predictions: DataFrame) -> DataFrame:
    """(image, det, area): the largest box of each image, the first of ties."""
    sized = predictions.withColumn("area", area("box"))
    return sized.groupBy("image").agg(F.max_by(F.struct("det", "area"), F.struct("area", -F.col("det"))).alias("b")).select("image", "b.det", "b.area")
