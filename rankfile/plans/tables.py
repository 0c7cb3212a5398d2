"""Positions, moves and legal moves as tables of their own: generators over `games`, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uci


def positions_table(games: DataFrame, key: str = "game_index", offset: str | None = "position_offset") -> DataFrame:
    """One row per position: key, ply (from 0; the state before move ply), position_index if offsets are there."""
    has = offset is not None and offset in games.columns
    rows = games.select(key, *([offset] if has else []), F.posexplode("positions").alias("ply", "p"))
    return rows.select(key, "ply", *([(F.col(offset) + F.col("ply")).alias("position_index")] if has else []), "p.*")


def moves_table(games: DataFrame, key: str = "game_index", offset: str | None = "move_offset") -> DataFrame:
    """One row per move: key, ply, move_index if offsets are there, the move's fields and its uci text."""
    has = offset is not None and offset in games.columns
    rows = games.select(key, *([offset] if has else []), F.posexplode("moves").alias("ply", "m"))
    rows = rows.select(key, "ply", *([(F.col(offset) + F.col("ply")).alias("move_index")] if has else []), "m.*")
    return rows.withColumn("uci", uci(F.col("from_sq"), F.col("to_sq"), F.col("promotion")))


def legal_moves_table(games: DataFrame, key: str = "game_index") -> DataFrame:
    """One row per legal move of each position: key, ply, from_sq, to_sq, promotion."""
    rows = games.select(key, F.posexplode("positions").alias("ply", "p"))
    return rows.select(key, "ply", F.explode("p.legal_moves").alias("l")).select(key, "ply", "l.*")


def game_totals(games: DataFrame, *by: str) -> DataFrame:
    """num_games, num_moves and num_positions, of all games or by columns (a partition id, say)."""
    sums = (F.count("*").alias("num_games"), F.coalesce(F.sum("num_moves"), F.lit(0)).alias("num_moves"), F.coalesce(F.sum("num_positions"), F.lit(0)).alias("num_positions"))
    return games.groupBy(*by).agg(*sums) if by else games.agg(*sums)
