"""Image features as pandas UDFs over Spark's image structs (BGR bytes) or grey byte arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.errors import ConfigError

FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("brightness_mean", "dark_fraction", "bright_fraction", "derived_sharpness")])


def grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Integer luma of an image: 0.299 R + 0.587 G + 0.114 B in 16-bit fixed point."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0].astype(np.float64)
    b, g, r = (x[:, :, k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.float64)


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian over inner pixels; 0 below three pixels a side."""
    if image.ndim != 2 or min(image.shape, default=0) < 3:
        return 0.0
    inner = image[1:-1, 1:-1]
    around = image[:-2, 1:-1] + image[2:, 1:-1] + image[1:-1, :-2] + image[1:-1, 2:]
    return float(np.var(around - 4 * inner))


def average_hash(image: np.ndarray, size: int = 8) -> int:
    """Bits (row by row) of block means at or above the overall mean, as a signed 64-bit integer for size 8."""
    rows = np.linspace(0, image.shape[0], size + 1).round().astype(int)
    cols = np.linspace(0, image.shape[1], size + 1).round().astype(int)
    small = np.array([[image[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)])
    bits = (small >= small.mean()).ravel()
    value = sum(1 << i for i, on in enumerate(bits) if on)
    return value - (1 << 64) if value >= 1 << 63 else value


def image_features(dark: int = 30, bright: int = 225):
    """A pandas UDF from an image struct to brightness, dark and bright fractions and sharpness."""
    if not 0 <= dark < bright <= 255:
        raise ConfigError("0 <= dark < bright <= 255 is needed")

    @F.pandas_udf(FEATURES)
    def features(image: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
            g = grey(h, w, c, data)
            out.append((g.mean() if g.size else 0.0, (g <= dark).mean() if g.size else 0.0, (g >= bright).mean() if g.size else 0.0, laplacian_variance(g)))
        return pd.DataFrame(out, columns=["brightness_mean", "dark_fraction", "bright_fraction", "derived_sharpness"])

    return features


@F.pandas_udf(T.LongType())
def image_hash(image: pd.DataFrame) -> pd.Series:
    return pd.Series([average_hash(grey(h, w, c, d)) for h, w, c, d in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True)])
