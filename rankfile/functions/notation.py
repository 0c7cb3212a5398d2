"""Squares and moves as text, and what follows from a game's status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def square_name(square: Column) -> Column:
    s = square.cast("int")
    return F.concat(F.substr(F.lit("abcdefgh"), s % 8 + 1, F.lit(1)), (F.floor(s / 8) + 1).cast("string"))


def uci(from_sq: Column, to_sq: Column, promotion: Column) -> Column:
    """e2e4, a7a8q: promotion is -1 for none, 2 knight, 3 bishop, 4 rook, 5 queen."""
    p = promotion.cast("int")
    piece = F.when(p == 2, "n").when(p == 3, "b").when(p == 4, "r").when(p == 5, "q").when(p < 0, "").otherwise("_")
    return F.concat(square_name(from_sq), square_name(to_sq), piece)


def uci_list(moves: Column) -> Column:
    return F.transform(moves, lambda m: uci(m["from_sq"], m["to_sq"], m["promotion"]))


def game_over(is_checkmate: Column, is_stalemate: Column, is_insufficient: Column) -> Column:
    """Mate, stalemate, or neither side can mate; resignation and the outcome do not count."""
    return is_checkmate | is_stalemate | (is_insufficient["white"] & is_insufficient["black"])
