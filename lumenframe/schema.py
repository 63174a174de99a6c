"""Schemas of the engine's tables, as DDL text."""

from __future__ import annotations

# The columns that every face table must have, and those of the pose, which it may lack.
FACE_REQUIRED = (
    "face_id", "source_frame", "video_name", "frame_number", "face_index", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2",
    "face_width", "face_height", "det_score", "blur_score", "aligned_path", "embedding_index",
)
FACE_POSE = ("pitch", "yaw", "roll")

# Column names of the tables.
FACE = (
    "face_id string, source_frame string, video_name string, frame_number int, face_index int, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, "
    "face_width double, face_height double, frame_width int, frame_height int, border_margin double, det_score double, pitch double, yaw double, roll double, "
    "blur_score double, aligned_path string, embedding_index long, cluster_id string, rejection_reason string"
)
TRACK = (
    "track_id string, video_name string, start_frame int, end_frame int, num_faces int, mean_quality double, mean_intra_similarity double, min_intra_similarity double, "
    "best_face_id string, track_embedding_index long, centroid array<double>"
)
CORRECTION = ("track_id string, identity_label string")
PAIR = ("left string, right string, same boolean, fold int")
IDENTITY_RECORD = ("filename string, identity int, partition string, bbox struct<x1:double,y1:double,x2:double,y2:double>")
BOXES = ("relative_path string, boxes array<struct<x1:double,y1:double,x2:double,y2:double>>")
SELECTION_DECISION = (
    "cluster_id string, face_id string, selected boolean, selection_decision string, not_selected_reasons array<string>, selection_value double, quality_score double, rank int"
)
