"""Entry points: parse_games, parse_games_from_strings, parse_game (over Spark), view_game, and views on results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .functions import game_over, uci_list
from .operators.lex import read_game
from .operators.replay import columns, replay, replayed
from .plans import game_index_table, legal_moves_table, move_to_game, moves_table, position_to_game, positions_table
from .plans.tables import game_totals
from .sources import from_arrow, from_strings, from_table
from .stored import stored

#: Positions of a chunk, if no number of chunks is asked for, and of a replaying task; a chunk ends with its last game.
CHUNK_POSITIONS, TASK_POSITIONS = 1 << 18, 1 << 20

_PROMOTION = {2: "n", 3: "b", 4: "r", 5: "q"}


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _uci(frm: int, to: int, promotion: int) -> str:
    name = lambda s: f"{'abcdefgh'[s % 8]}{s // 8 + 1}"
    return name(frm) + name(to) + ("" if promotion < 0 else _PROMOTION.get(promotion, "_"))


class GameView:
    """One game: its arrays in NumPy form (missing clocks and evaluations are NaN) and its facts."""

    def __init__(self, row: dict, stored_comments: bool = False):
        self._row, self._stored = row, stored_comments

    def _position(self, name: str, dtype: str) -> np.ndarray:
        return np.asarray([p[name] for p in self._row["positions"]], dtype=dtype)

    def _move(self, name: str, dtype: str) -> np.ndarray:
        return np.asarray([np.nan if m[name] is None else m[name] for m in self._row["moves"]], dtype=dtype)

    boards = cached_property(lambda self: self._position("board", "uint8").reshape(-1, 8, 8))
    castling = cached_property(lambda self: self._position("castling", "bool").reshape(-1, 4))
    en_passant = cached_property(lambda self: self._position("en_passant", "int8"))
    halfmove_clock = cached_property(lambda self: self._position("halfmove_clock", "uint8"))
    turn = cached_property(lambda self: self._position("turn", "bool"))
    from_squares = cached_property(lambda self: self._move("from_sq", "uint8"))
    to_squares = cached_property(lambda self: self._move("to_sq", "uint8"))
    promotions = cached_property(lambda self: self._move("promotion", "int8"))
    clocks = cached_property(lambda self: self._move("clock", "float32"))
    evals = cached_property(lambda self: self._move("eval", "float32"))

    def __len__(self) -> int:
        return self._row["num_moves"]

    @property
    def num_positions(self) -> int:
        return self._row["num_positions"]

    @property
    def initial_board(self) -> np.ndarray:
        return self.boards[0]

    @property
    def final_board(self) -> np.ndarray:
        return self.boards[-1]

    @property
    def headers(self) -> dict[str, str]:
        return dict(self._row["headers"] or {})

    is_checkmate = property(lambda self: self._row["is_checkmate"])
    is_stalemate = property(lambda self: self._row["is_stalemate"])
    legal_move_count = property(lambda self: self._row["legal_move_count"])
    is_valid = property(lambda self: self._row["is_valid"])
    outcome = property(lambda self: self._row["outcome"])
    parse_error = property(lambda self: self._row["parse_error"])

    @property
    def is_insufficient(self) -> tuple[bool, bool]:
        return self._row["is_insufficient"]["white"], self._row["is_insufficient"]["black"]

    @property
    def is_game_over(self) -> bool:
        return self.is_checkmate or self.is_stalemate or all(self.is_insufficient)

    @property
    def comments(self) -> list[str | None]:
        return [m["comment"] for m in self._row["moves"]] if self._stored else []

    @property
    def legal_moves(self) -> list[list[tuple[int, int, int]]]:
        stored = self._row["positions"] and "legal_moves" in self._row["positions"][0]
        return [[(x["from_sq"], x["to_sq"], x["promotion"]) for x in p["legal_moves"]] for p in self._row["positions"]] if stored else []

    def move_uci(self, i: int) -> str:
        if not 0 <= i < len(self):
            raise IndexError(f"Move index {i} out of range [0, {len(self)})")
        m = self._row["moves"][i]
        return _uci(m["from_sq"], m["to_sq"], m["promotion"])

    def moves_uci(self) -> list[str]:
        return [_uci(m["from_sq"], m["to_sq"], m["promotion"]) for m in self._row["moves"]]

    def __repr__(self) -> str:
        h = self.headers
        return f"<PyGameView {h.get('White', '?')} vs {h.get('Black', '?')}, {len(self)} moves, valid={self.is_valid}>"


class ChunkView:
    """A run of games as flat NumPy arrays with offsets (n + 1, from 0; 64 bits, as a chunk may be any size).

    Its rows are fetched, as Arrow, when an array is first asked for; other chunks are not.
    """

    def __init__(self, fetch: Callable[[], pa.Table], stored_comments: bool, stored_legal: bool, index: int = 0):
        self._fetch, self.stored_comments, self.stored_legal, self.index = fetch, stored_comments, stored_legal, index

    @cached_property
    def _table(self) -> pa.Table:
        return self._fetch().sort_by("game_index").combine_chunks()

    def _of(self, *path: str) -> pa.Array:
        """The values of a field, lists on the way to it laid end to end."""
        column = self._table[path[0]].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        for name in path[1:]:
            if pa.types.is_list(column.type):
                column = column.flatten()
            column = column.field(name)
        return column

    def _array(self, dtype: str, *path: str, missing: float | None = None) -> np.ndarray:
        column = self._of(*path)
        column = column.flatten() if pa.types.is_list(column.type) else column
        return (column if missing is None else column.fill_null(missing)).to_numpy(zero_copy_only=False).astype(dtype)

    num_games = property(lambda self: self._table.num_rows)
    num_moves = property(lambda self: int(self.move_offsets[-1]))
    num_positions = property(lambda self: int(self.position_offsets[-1]))

    def _offsets(self, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    move_offsets = property(lambda self: self._offsets(self._array("int64", "num_moves")))
    position_offsets = property(lambda self: self._offsets(self._array("int64", "num_positions")))
    boards = property(lambda self: self._array("uint8", "positions", "board").reshape(-1, 8, 8))
    castling = property(lambda self: self._array("bool", "positions", "castling").reshape(-1, 4))
    en_passant = property(lambda self: self._array("int8", "positions", "en_passant"))
    halfmove_clock = property(lambda self: self._array("uint8", "positions", "halfmove_clock"))
    turn = property(lambda self: self._array("bool", "positions", "turn"))
    from_squares = property(lambda self: self._array("uint8", "moves", "from_sq"))
    to_squares = property(lambda self: self._array("uint8", "moves", "to_sq"))
    promotions = property(lambda self: self._array("int8", "moves", "promotion"))
    clocks = property(lambda self: self._array("float32", "moves", "clock", missing=np.nan))
    evals = property(lambda self: self._array("float32", "moves", "eval", missing=np.nan))
    is_checkmate = property(lambda self: self._array("bool", "is_checkmate"))
    is_stalemate = property(lambda self: self._array("bool", "is_stalemate"))
    is_insufficient = property(lambda self: np.stack([self._array("bool", "is_insufficient", side) for side in ("white", "black")], axis=1))
    legal_move_count = property(lambda self: self._array("uint16", "legal_move_count"))
    valid = property(lambda self: self._array("bool", "is_valid"))
    headers = property(lambda self: [dict(h or []) for h in self._table["headers"].to_pylist()])
    outcome = property(lambda self: self._table["outcome"].to_pylist())
    parse_errors = property(lambda self: self._table["parse_error"].to_pylist())
    comments = property(lambda self: self._of("moves", "comment").to_pylist() if self.stored_comments else [])

    def _legal(self, name: str, dtype: str) -> np.ndarray:
        return self._array(dtype, "positions", "legal_moves", name) if self.stored_legal else np.zeros(0, dtype=dtype)

    legal_move_from_squares = property(lambda self: self._legal("from_sq", "uint8"))
    legal_move_to_squares = property(lambda self: self._legal("to_sq", "uint8"))
    legal_move_promotions = property(lambda self: self._legal("promotion", "int8"))

    @property
    def legal_move_offsets(self) -> np.ndarray:
        """Offsets by position; of length 0 if legal moves were not stored."""
        return self._offsets(self._of("positions", "legal_moves").value_lengths().to_numpy(zero_copy_only=False)) if self.stored_legal else np.zeros(0, dtype=np.int64)

    def __repr__(self) -> str:
        return f"<PyChunkView chunk={self.index}, {self.num_games} games, {self.num_moves} moves, {self.num_positions} positions>"


class ParsedGames:
    """A result: DataFrames for work in Spark (games, positions, moves, legal_moves), and indexing as of a sequence.

    Indexing, iteration and NumPy chunks bring rows to the caller; the DataFrames and map_chunks() do not. What is kept
    are numbered texts (cached when first used) and counts (written once): boards are some hundred times as large, and
    are replayed from the texts that are asked for. keep() caches them where they are to be read often.
    """

    def __init__(self, texts: DataFrame, ranges: DataFrame, parts: int | None = None, comments: bool = False, legal_moves: bool = False):
        self._texts, self._ranges, self._asked, self.stored_comments, self.stored_legal = texts, ranges, parts, comments, legal_moves
        self.games = self._replay(texts)

    def _replay(self, texts: DataFrame) -> DataFrame:
        return replay(texts, comments=self.stored_comments, legal_moves=self.stored_legal).drop("movetext")

    @property
    def positions(self) -> DataFrame:
        return positions_table(self.games)

    @property
    def moves(self) -> DataFrame:
        return moves_table(self.games)

    @property
    def legal_moves(self) -> DataFrame:
        return legal_moves_table(self.games)

    @property
    def with_status(self) -> DataFrame:
        """games with is_game_over and uci (a list)."""
        return self.games.withColumns({"is_game_over": game_over(F.col("is_checkmate"), F.col("is_stalemate"), F.col("is_insufficient")), "uci": uci_list(F.col("moves"))})

    @cached_property
    def _totals(self):
        return game_totals(self._ranges).first()

    num_games = property(lambda self: self._totals["num_games"])
    num_moves = property(lambda self: self._totals["num_moves"])
    num_positions = property(lambda self: self._totals["num_positions"])

    num_chunks = property(lambda self: max(1, len(self._chunks)))

    def __len__(self) -> int:
        return self.num_games

    def _view(self, row) -> GameView:
        return GameView(row.asDict(recursive=True), self.stored_comments)

    def __getitem__(self, key: int | slice) -> GameView | list[GameView]:
        if isinstance(key, slice):
            at = range(*key.indices(len(self)))
            if not at:
                return []
            low, high = min(at[0], at[-1]), max(at[0], at[-1])
            rows = self._replay(self._texts.where(F.col("game_index").between(low, high) & (F.pmod(F.col("game_index") - at[0], F.lit(abs(at.step))) == 0)))
            found = sorted(rows.collect(), key=lambda r: r["game_index"], reverse=at.step < 0)
            return [self._view(r) for r in found]
        if isinstance(key, (int, np.integer)) and not isinstance(key, bool):
            n = len(self)
            i = int(key) + (n if key < 0 else 0)
            if not 0 <= i < n:
                raise IndexError(f"Game index {key} out of range [0, {n})")
            return self._view(self._replay(self._texts.where(F.col("game_index") == i)).first())
        raise TypeError(f"Invalid index type: expected int or slice, got {type(key).__name__}")

    def __iter__(self) -> Iterator[GameView]:
        for low, high in self._chunks:
            for row in self._between(low, high).orderBy("game_index").toLocalIterator():
                yield self._view(row)

    @cached_property
    def _chunks(self) -> list[tuple[int, int]]:
        """First and last game of each chunk: one row a chunk. As many chunks as were asked for, of equal counts of games;
        else of CHUNK_POSITIONS, so that the caller's memory does not grow with the input."""
        part = F.floor(F.col("position_offset") / CHUNK_POSITIONS) if self._asked is None else F.floor(F.col("game_index") * self._asked / max(1, self.num_games))
        rows = self._ranges.groupBy(part.alias("part")).agg(F.min("game_index").alias("low"), F.max("game_index").alias("high")).orderBy("low").collect()
        return [(r["low"], r["high"]) for r in rows]

    def _between(self, low: int, high: int) -> DataFrame:
        return self._replay(self._texts.where(F.col("game_index").between(low, high)))

    @property
    def chunks(self) -> list[ChunkView]:
        """The result in runs of games, in order; an empty result has one empty chunk."""
        view = lambda k, low, high: ChunkView(lambda: self._between(low, high).toArrow(), self.stored_comments, self.stored_legal, k)
        return [view(k, low, high) for k, (low, high) in enumerate(self._chunks or [(0, -1)])]

    def map_chunks(self, function: Callable[[ChunkView], dict], schema: str) -> DataFrame:
        """function(chunk), a row each, where the chunk is replayed: its arrays stay in the task. Chunks are runs of games
        of one task and may be smaller than those of `chunks`; together they hold each game once."""
        names = self._texts.columns
        place, comments, legal = names.index("movetext"), self.stored_comments, self.stored_legal
        make = lambda games: columns(games, True, comments, legal, True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, batch in enumerate(replayed(batches, place, make)):
                table = pa.Table.from_batches([batch])
                yield pa.RecordBatch.from_pylist([function(ChunkView(lambda t=table: t, comments, legal, k))], schema=form)

        form = to_arrow_schema(StructType.fromDDL(schema))
        return self._texts.mapInArrow(run, schema)

    def _map(self, index: Iterable[int], lookup, name: str) -> np.ndarray:
        values = np.asarray(index).ravel().astype(np.int64)
        spark = self.games.sparkSession
        queries = spark.createDataFrame(list(enumerate(values.tolist())), f"k long, {name} long")
        rows = lookup(queries, self._ranges, name).orderBy("k").collect()
        return np.asarray([r["game_index"] for r in rows], dtype=np.int64)

    def position_to_game(self, index: Iterable[int]) -> np.ndarray:
        return self._map(index, position_to_game, "position_index")

    def move_to_game(self, index: Iterable[int]) -> np.ndarray:
        return self._map(index, move_to_game, "move_index")

    def keep(self) -> ParsedGames:
        """Caches the replayed games when `games` is first used."""
        self.games.cache()
        return self

    def close(self) -> None:
        """Frees what is cached; what is asked for afterwards is made anew."""
        self.games.unpersist()
        self._texts.unpersist()

    def __enter__(self) -> ParsedGames:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"<ParsedGames: {self.num_games} games, {self.num_moves} moves, {self.num_positions} positions, {self.num_chunks} chunks>"


def _parts(spark: SparkSession, num_threads: int | None, chunk_multiplier: int | None) -> int | None:
    for name, value in (("num_threads", num_threads), ("chunk_multiplier", chunk_multiplier)):
        if value is not None and value < 1:
            raise ValueError(f"{name} must be at least 1")
    if num_threads is None and chunk_multiplier is None:
        return None
    return (num_threads or spark.sparkContext.defaultParallelism) * (chunk_multiplier or 1)


def _run(rows: DataFrame, parts: int | None, comments: bool, legal_moves: bool) -> ParsedGames:
    """Counts moves (a pass that makes no boards), numbers the texts, and deals them out in the order of game_index to
    tasks of TASK_POSITIONS, however many chunks are asked for. Only texts are shuffled, and only they are cached."""
    counts = replay(rows, positions=False, status=False).select("input_ordinal", "num_moves", "num_positions")
    ranges = stored(game_index_table(counts, sizes=True), "ranges")
    total = ranges.agg(F.sum("num_positions")).first()[0] or 0
    tasks = max(parts or 1, -(-total // TASK_POSITIONS))
    texts = rows.join(ranges.drop("num_moves", "num_positions"), F.col("input_ordinal") == F.col("_ordinal")).drop("_ordinal")
    place = F.least(F.floor(F.col("position_offset") * tasks / max(1, total)), F.lit(tasks - 1)).cast("int")
    texts = texts.repartitionById(tasks, place).sortWithinPartitions("game_index").cache()
    return ParsedGames(texts, ranges.drop("_ordinal"), parts, comments, legal_moves)


def parse_games(data: DataFrame | pa.ChunkedArray | pa.Array, num_threads: int | None = None, chunk_multiplier: int | None = None, store_comments: bool = False, store_legal_moves: bool = False, column: str = "movetext") -> ParsedGames:
    """Parses a string column: of a DataFrame (a file, a table) or in memory. Nulls and non-games leave no index."""
    spark = data.sparkSession if isinstance(data, DataFrame) else _session()
    parts = _parts(spark, num_threads, chunk_multiplier)
    rows = from_table(data, column) if isinstance(data, DataFrame) else from_arrow(spark, data)
    return _run(rows, parts, store_comments, store_legal_moves)


def parse_games_from_strings(pgns: list[str], num_threads: int | None = None, store_comments: bool = False, store_legal_moves: bool = False) -> ParsedGames:
    spark = _session()
    return _run(from_strings(spark, pgns), _parts(spark, num_threads, None), store_comments, store_legal_moves)


def _checked(pgn: str):
    game = read_game(pgn)
    if game is None:
        raise ValueError("no game found in PGN")
    return game


def parse_game(pgn: str, store_comments: bool = False, store_legal_moves: bool = False) -> ParsedGames:
    """A result of one game. Raises ValueError if the text holds none or breaks off."""
    _checked(pgn)
    spark = _session()
    return _run(from_strings(spark, [pgn]).coalesce(1), None, store_comments, store_legal_moves)


def view_game(pgn: str, store_comments: bool = False, store_legal_moves: bool = False) -> GameView:
    """The one game of a text, replayed here and now without Spark. Raises as parse_game() does."""
    row = pa.table(dict(columns([_checked(pgn)], True, store_comments, store_legal_moves))).to_pylist()[0]
    row["headers"] = dict(row["headers"] or [])
    return GameView(row, store_comments)
