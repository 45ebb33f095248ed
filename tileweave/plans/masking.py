"""Masking a collection with a model: shrink, normalise, predict, grow the mask back, composite."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.images import score_images
from ..operators.pixels import from_pixels, to_pixels
from ..operators.resample import resample
from ..operators.tone import CHANNEL_MEAN, CHANNEL_STD

# Fixed value: side of the square the model sees.
INPUT_SIDE = 1024


def predict_masks(
    rasters: DataFrame, open_session: Callable[[], object], predict: Callable[[object, np.ndarray], np.ndarray]
) -> DataFrame:
    """One gray raster per image from ``predict(session, tensor)``.

    The tensor is 1 × 3 × height × width in single precision, normalised per channel; the answer is
    height × width with values that are clamped to [0, 1] and truncated to 0–255.
    """
    mean, std = (np.array(v, dtype="float32").reshape(3, 1, 1) for v in (CHANNEL_MEAN, CHANNEL_STD))

    def score(session, batch: pd.DataFrame) -> pd.DataFrame:
        masks = []
        for width, height, data in zip(batch["width"], batch["height"], batch["data"]):
            bgr = np.frombuffer(data, dtype="uint8").reshape(height, width, 3)
            tensor = (bgr[:, :, ::-1].transpose(2, 0, 1).astype("float32") / np.float32(255) - mean) / std
            mask = np.clip(predict(session, tensor[None]).reshape(height, width), 0.0, 1.0) * 255
            masks.append(mask.astype("uint8").tobytes())
        return batch[["image_id", "width", "height"]].assign(nChannels=1, data=masks)

    schema = "image_id bigint, width int, height int, nChannels int, data binary"
    return score_images(rasters.select("image_id", "width", "height", "data"), open_session, score, schema)


def mask_images(
    px: DataFrame, open_session: Callable[[], object], predict: Callable[[object, np.ndarray], np.ndarray],
    side: int = INPUT_SIDE,
) -> DataFrame:
    """Pixels with the model's mask as alpha. ``px`` is read three times: give a table or a checkpoint."""
    squares = from_pixels(resample(px, side, side), alpha=False)
    masks = predict_masks(squares, open_session, predict)
    extents = px.groupBy("image_id").agg(F.max("width").alias("_width"), F.max("height").alias("_height"))
    small = to_pixels(masks).join(extents, "image_id")
    # A gray raster has its value in every channel. It is a byte already, so it is alpha as it stands.
    grown = resample(small, F.col("_width"), F.col("_height")).select("image_id", "x", "y", F.col("r").alias("a"))
    return px.drop("a").join(grown.hint("merge"), ["image_id", "x", "y"]).select(*px.columns)
