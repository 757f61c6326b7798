"""Embedding of window texts by a pluggable model; a table that already has embeddings needs none."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def embed(windows: DataFrame, make_model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """windows with ``embedding`` (array<float>). make_model runs once in a worker, which keeps the model for the batches
    and tasks that follow, and returns a function from texts to a matrix; a null text is embedded as the empty string."""

    def make_predict() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()
        return lambda texts: np.asarray(model([str(t) for t in texts]), np.float32)

    vector = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch)
    return windows.drop("embedding").withColumn("embedding", vector(F.coalesce("text", F.lit(""))))
