"""Tables derived from replayed games, their order and their lookups."""

from .index import game_index_table, move_to_game, numbered_games, offsets, position_to_game
from .tables import game_totals, legal_moves_table, moves_table, positions_table

__all__ = ["game_index_table", "game_totals", "legal_moves_table", "move_to_game", "moves_table", "numbered_games", "offsets", "position_to_game", "positions_table"]
