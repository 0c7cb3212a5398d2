"""Sources of movetext: Parquet columns, Python strings and .pgn files."""

from .frames import from_arrow, from_parquet, from_strings, from_table
from .pgn import PgnDataSource, read_pgn, split_games

__all__ = ["PgnDataSource", "from_arrow", "from_parquet", "from_strings", "from_table", "read_pgn", "split_games"]
