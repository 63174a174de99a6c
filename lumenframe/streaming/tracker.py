"""The tracker over a stream of detections: one keyed state a video.

Each micro-batch's detections of a video are sorted by frame; the state holds the open tracks. Track
numbers are local to the video. Frames must arrive in order within a video, as the batch tracker reads them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenframe.operators.tracking import Tracks

OUT = "face_id string, video_name string, frame_number int, local long, track_similarity double, track_iou double"


def track_stream(faces: DataFrame, max_frame_gap: int = 8, min_similarity: float = 0.38, appearance_weight: float = 0.85, quality_weight_offset: float = 0.5, idle_ms: int | None = None) -> DataFrame:
    """``faces``: a stream of face_id, video_name, frame_number, x1, y1, x2, y2, quality, row, vector.

    ``idle_ms`` drops the state of a video that has been quiet that long (Spark then triggers without
    pause); by default a video keeps its open tracks, which expire by frames alone.
    """

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracks = pickle.loads(state.get[0]) if state.exists else Tracks(max_frame_gap, min_similarity, appearance_weight, quality_weight_offset)
        rows = pd.concat(list(parts)).sort_values(["frame_number", "row"], ignore_index=True)
        out = []
        for frame, part in rows.groupby("frame_number", sort=True):
            number, sim, over = tracks.step(int(frame), np.stack(part["vector"].to_numpy()).astype(float), part[["x1", "y1", "x2", "y2"]].to_numpy(float), part["quality"].to_numpy(float))
            out.append(pd.DataFrame({"face_id": part["face_id"].to_numpy(), "video_name": key[0], "frame_number": int(frame), "local": number, "track_similarity": sim, "track_iou": over}))
        state.update((pickle.dumps(tracks),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.concat(out)

    return faces.groupBy("video_name").applyInPandasWithState(step, OUT, "tracks binary", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
