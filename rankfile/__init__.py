"""Chess game analytics on Spark: PGN text in, games, positions, moves and legal moves as tables out."""

from .api import ChunkView, GameView, ParsedGames, parse_game, parse_games, parse_games_from_strings, view_game
from .operators.replay import rejected, replay

__all__ = ["ChunkView", "GameView", "ParsedGames", "parse_game", "parse_games", "parse_games_from_strings", "rejected", "replay", "view_game"]
