"""Stateless scoring of streams.

Cleaning, cross features and coefficient scoring are plain expressions and joins to
small static tables, so a stream goes through the same functions as a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import PRED, ROW, TYPE
from ..operators.linear import predict_full
from ..operators.output import clip_predictions


def score_stream(stream: DataFrame, models: DataFrame, features: Sequence[str], name: str, bounds: DataFrame) -> DataFrame:
    """``row_id, target_type, pred`` of each arriving row, clipped to its type's bounds."""
    scored = predict_full(stream, features, models, [name]).withColumnRenamed(f"pred_{name}", PRED)
    return clip_predictions(scored, bounds).select(ROW, TYPE, PRED)


def write_stream(scored: DataFrame, path: str, checkpoint: str):
    """Append scored rows to parquet; processes what is there and stops."""
    return (scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
