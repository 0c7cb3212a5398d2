"""Global order of games and lookups from flat indices to games."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stored import stored

#: Width of a block of ordinals in numbering, and of flat indices in a lookup's join key (some games' worth).
BLOCK, LOOKUP_BLOCK = 1 << 16, 512


def offsets(counts: DataFrame, order: str, **sums: str) -> DataFrame:
    """Adds for each name=column the sum of the column over all rows before (an exclusive prefix sum by `order`).

    order: a unique non-negative long. Rows are summed within blocks of BLOCK ordinals; only the block totals (a row
    a block) meet in one window, so the prefix sum is not a single-task pass over all rows.
    """
    block = F.floor(F.col(order) / BLOCK)
    rows = counts.withColumn("_block", block)
    total = rows.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(F.col("_block").alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()])
    out = rows.join(total, F.col("_block") == F.col("_b"))
    return out.select(*counts.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def game_index_table(counts: DataFrame, ordinal: str = "input_ordinal", sizes: bool = False) -> DataFrame:
    """(_ordinal, game_index, move_offset, position_offset): game_index is 0, 1, ... by ordinal over the rows that are
    games. counts: ordinal, num_moves, num_positions; nothing wider takes part. sizes: with both numbers, as longs."""
    narrow = counts.select(F.col(ordinal).alias("_ordinal"), F.lit(1).cast("long").alias("_one"), F.col("num_moves").cast("long").alias("_m"), F.col("num_positions").cast("long").alias("_p"))
    narrow = stored(narrow, "counts")  # a replay in `counts` runs once
    out = offsets(narrow, "_ordinal", game_index="_one", move_offset="_m", position_offset="_p").drop("_one")
    return out.withColumnsRenamed({"_m": "num_moves", "_p": "num_positions"}) if sizes else out.drop("_m", "_p")


def numbered_games(rows: DataFrame, ordinal: str = "input_ordinal", counts: DataFrame | None = None) -> DataFrame:
    """Adds game_index, move_offset and position_offset by a join on the ordinal; rows that are no games go.

    counts: where rows are texts yet to be replayed, their (ordinal, num_moves, num_positions). Joining texts and
    replaying afterwards moves a fraction of what joining boards would. The counts are written once; the ordinals of
    `rows` must be the same whenever they are read.
    """
    index = game_index_table(rows if counts is None else counts, ordinal)
    return rows.join(index, F.col(ordinal) == F.col("_ordinal")).drop("_ordinal")


def _lookup(queries: DataFrame, games: DataFrame, index: str, offset: str, size: str) -> DataFrame:
    """Backward as-of match: the game that holds a flat index. Below 0: -1; at or past the end: the last game.

    A game's range is spread over the blocks it touches (one or two), so that the match is an equality join on the
    block with a range test among its few games; a game without entries is never met. `games` is read three times and
    should be a written table.
    """
    ranges = games.where(F.col(size) > 0).select(F.col("game_index").alias("_g"), F.col(offset).alias("_a"), (F.col(offset) + F.col(size)).alias("_z"))
    ranges = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / LOOKUP_BLOCK), F.floor((F.col("_z") - 1) / LOOKUP_BLOCK))))
    ends = games.agg((F.max(F.col(offset) + F.col(size))).alias("end"), F.max("game_index").alias("last"))
    end, last = (ends.select(c).scalar() for c in ("end", "last"))
    i = F.col(index).cast("long")
    rows = queries.withColumn("_i", i)
    hit = rows.join(ranges, (F.floor(F.col("_i") / LOOKUP_BLOCK) == F.col("_block")) & (F.col("_i") >= F.col("_a")) & (F.col("_i") < F.col("_z")), "left")
    found = F.when(F.col("_i") < 0, F.lit(-1)).when(F.col("_i") >= end, last).otherwise(F.col("_g"))
    return hit.select(*queries.columns, F.coalesce(found, F.lit(-1)).cast("long").alias("game_index"))


def position_to_game(queries: DataFrame, games: DataFrame, index: str = "position_index") -> DataFrame:
    """Adds game_index to each row of `queries`, by its flat position index into numbered games."""
    return _lookup(queries, games, index, "position_offset", "num_positions")


def move_to_game(queries: DataFrame, games: DataFrame, index: str = "move_index") -> DataFrame:
    """Adds game_index to each row of `queries`, by its flat move index into numbered games."""
    return _lookup(queries, games, index, "move_offset", "num_moves")
