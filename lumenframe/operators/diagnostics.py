"""Diagnostics of a validated run: pair similarities, neighbours, frame mates, suspicious faces, threshold sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.coerce import lenient_int, with_columns
from lumenframe.operators import clustering, quality, reports, similarity
from lumenframe.operators.policy import suspicious_reasons
from lumenframe.plans.config import SWEEP

#: Vectors up to which the threshold sweep is made, fixed by the report's contract; larger sets are left to clustering.
SWEEP_VECTORS = 4000


def run_diagnostics(faces: DataFrame, max_pairs: int = 1_000_000, thresholds: list[float] | None = None, sheet_faces: int = 1000) -> dict[str, DataFrame]:
    """The report's tables, by name, and ``summary``, one row. ``faces`` is a validated run with embedding."""
    rows = with_columns(faces, "face_width", "face_height", "pitch", "yaw", "roll")
    rows = rows.withColumns({"id": F.col("embedding_index").cast("long"), "vector": F.col("embedding"), "frame_number": lenient_int("frame_number", -1)})
    scored = quality.with_override(quality.quality_score(rows))
    vectors = rows.select("id", "vector")
    pairs, mode = similarity.pair_similarities(vectors, max_pairs)
    names = rows.select("id", "face_id", "video_name", "frame_number")
    other = names.select(*(F.col(c).alias(f"n_{c}") for c in names.columns))
    near = similarity.nearest(vectors).join(names, "id").join(other, F.col("neighbor") == F.col("n_id"))
    near = near.select("face_id", F.col("n_face_id").alias("neighbor_face_id"), F.round("similarity", 7).alias("similarity"), (F.col("video_name") == F.col("n_video_name")).cast("int").alias("same_video"), F.abs(F.col("frame_number") - F.col("n_frame_number")).alias("frame_gap"))
    mates = similarity.group_pairs(rows.select("video_name", "frame_number", "id", "vector"), ["video_name", "frame_number"])
    mates = mates.join(names.select(F.col("id").alias("src"), F.col("face_id").alias("face_id_a")), "src").join(names.select(F.col("id").alias("dst"), F.col("face_id").alias("face_id_b")), "dst")
    mates = mates.select("video_name", "frame_number", "face_id_a", "face_id_b", F.round("similarity", 7).alias("similarity"))
    suspects = scored.withColumn("_r", suspicious_reasons()).where(F.size("_r") > 0).select("face_id", "source_frame", F.round("quality_score", 6).alias("quality_score"), F.array_join("_r", ";").alias("reasons"))
    out = {"similarity_histogram": reports.histogram(pairs, "similarity") if mode == "sampled" else similarity.pair_histogram(vectors), "nearest_neighbors": near, "same_frame_pairs": mates, "suspicious_faces": suspects}
    n = vectors.count()
    if n <= SWEEP_VECTORS:
        out["threshold_sweep"] = clustering.component_sizes(clustering.component_sweep(vectors, thresholds or SWEEP))
    order = [F.col("video_name").asc(), F.col("frame_number").asc(), lenient_int("face_index", 0).asc() if "face_index" in rows.columns else F.col("id").asc()]
    out["contact_sheets"] = reports.contact_layout(scored.orderBy(*order).limit(sheet_faces).select("face_id", "aligned_path", "video_name", "frame_number", *(c for c in ("face_index",) if c in rows.columns), "id", "quality_score"), order)
    six = lambda c: F.round(c, 6).alias(c)
    stats = similarity.quantiles(pairs, "similarity").select(*(six(c) for c in ("min", "q50", "q95", "q99", "max")))
    counted = mates.agg(F.count("*").alias("same_frame_pairs"), F.round(F.max("similarity"), 6).alias("same_frame_max_similarity"))
    odd = suspects.agg(F.count("*").alias("suspicious_faces"))
    head = rows.agg(F.count("*").alias("faces"), F.max(F.size("vector")).alias("embedding_dimension")).withColumns({"pair_statistics_mode": F.lit(mode), "threshold_sweep_mode": F.lit("exact" if n <= SWEEP_VECTORS else "skipped")})
    summary = head.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(odd))
    return out | {"summary": summary}
