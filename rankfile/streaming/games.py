"""Replay is row by row, so the batch operator runs in a stream as it is; windows and watermarks follow on its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.replay import replay


def replay_stream(stream: DataFrame, movetext: str = "movetext", **options) -> DataFrame:
    """The games of a streaming table. Global indices have no meaning in a stream: key rows by columns of your own."""
    return replay(stream, movetext, **options)


def windowed_outcomes(games: DataFrame, time: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Games and moves by event-time window and outcome; rows later than `delay` are dropped by the watermark."""
    return (
        games.withWatermark(time, delay)
        .groupBy(F.window(time, width), "outcome")
        .agg(F.count("*").alias("games"), F.sum("num_moves").alias("moves"))
        .select(F.col("window.start").alias("window_start"), "outcome", "games", "moves")
    )
