"""Registered queries of the chess operators, with their SQL.

The tables hold no chess text, so it is made from their integers by built-in expressions: openings of two pawn moves
whose squares follow from the key (the SQL computes them by arithmetic), annotated comments, tags, and a fixed list of
games of which the facts are listed in the SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api
from .. import functions as C
from ..operators.replay import legal_summary, replay
from ..sources import from_parquet, read_pgn
from ..stored import shared_path, stored
from .index import move_to_game, numbered_games, position_to_game
from .tables import game_totals, moves_table, positions_table

#: Games with known facts, chosen by o_orderkey modulo their number.
GOLDEN = [
    "1. e4 e5 2. Bc4 Bc5 3. Qh5 Nf6 4. Qxf7# 1-0",
    "1. f3 e5 2. g4 Qh4# 0-1",
    '[Event "Opera"]\n[White "Morphy"]\n\n1. e4 e5 2. Nf3 d6 3. d4 Bg4 4. dxe5 Bxf3 5. Qxf3 dxe5 6. Bc4 Nf6 7. Qb3 Qe7 8. Nc3 c6 9. Bg5 b5 10. Nxb5 cxb5 11. Bxb5+ Nbd7 12. O-O-O Rd8 13. Rxd7 Rxd7 14. Rd1 Qe6 15. Bxd7+ Nxd7 16. Qb8+ Nxb8 17. Rd8# 1-0',
    "1. e3 a5 2. Qh5 Ra6 3. Qxa5 h5 4. h4 Rah6 5. Qxc7 f6 6. Qxd7+ Kf7 7. Qxb7 Qd3 8. Qxb8 Qh7 9. Qxc8 Kg6 10. Qe6 1/2-1/2",
    "1. e4 Nf6 2. e5 d5 3. exd6 *",
    "1. d4 d5 2. Qd5 1-0",
    '[FEN "7k/P7/8/8/8/8/8/K7 w - - 0 1"]\n\n1. a8=N *',
    '[Variant "Chess960"]\n[FEN "4k3/8/8/8/8/8/8/1R1K2R1 w BG - 0 1"]\n\n1. O-O 1/2-1/2',
    "1. e4 {[%eval 0.3] [%clk 0:03:00]} e5 (1... c5 (1... e6) 2. Nf3 {no}) 2. Nf3 {good [%eval #3]} Nc6 3. Bb5 {} a6 4. O-O",
    '[FEN "not a position"]\n\n1. e4 e5 1-0',
    "   ",
]
#: Texts that show how single games are read: no game, two games, no move, white space in tags, moves after the end, and
#: what castling rights and the halfmove clock become. Chosen by o_orderkey modulo their number.
SINGLE = [
    None,
    "",
    "1. e4 e5 1-0\n\n1. d4 *",
    "1. e4 -- 2. d4 *",
    "1. e4 {[%eval\t1.5]} e5 {[%clk\n0:00:09]} *",
    "1. e4 e5 2. Ke2 Ke7 3. Ke1 Ke8 1/2-1/2",
    "1. a4 h5 2. Ra3 Rh6 *",
    "1. f3 e5 2. g4 Qh4# 3. e4 0-1",
    "1. Nf3 Nc6 2. Ng1 Nb8 3. Nc3 {open",
    "1. Nf3 Nf6 2. g3 g6 3. Bg2 Bg7 4. O-O O-O *",
]
_SINGLE_FACTS = """(VALUES
 (2, 'White', true, 2, false, 29, 0, 'KQkq', 1, 4, NULL, NULL), (3, 'Unknown', false, 1, false, 20, 0, 'KQkq', 0, 4, NULL, NULL),
 (4, 'Unknown', true, 2, false, 29, 0, 'KQkq', 1, 4, 1.5, 9.0), (5, 'Draw', true, 6, false, 29, 4, '', 1, -1, NULL, NULL),
 (6, 'Unknown', true, 4, false, 27, 2, 'Kq', 1, -1, NULL, NULL), (7, 'Black', false, 4, true, 0, 1, 'KQkq', 1, -1, NULL, NULL),
 (9, 'Unknown', true, 8, false, 25, 4, '', 1, -1, NULL, NULL)
) g(k, outcome, is_valid, num_moves, is_checkmate, legal_move_count, halfmove_clock, castling, white_to_move, en_passant, eval, clock)"""
_FACTS = """(VALUES
 (0, 'White', true, 7, true, false, 0, false, 'e2e4', 'h5f7'), (1, 'Black', true, 4, true, false, 0, false, 'f2f3', 'd8h4'),
 (2, 'White', true, 33, true, false, 0, false, 'e2e4', 'd1d8'), (3, 'Draw', true, 19, false, true, 0, false, 'e2e3', 'c8e6'),
 (4, 'Unknown', true, 5, false, false, 32, false, 'e2e4', 'e5d6'), (5, 'White', false, 2, false, false, 27, false, 'd2d4', 'd7d5'),
 (6, 'Unknown', true, 1, false, false, 3, true, 'a7a8n', 'a7a8n'), (7, 'Draw', true, 1, false, false, 3, false, 'd1g1', 'd1g1'),
 (8, NULL, true, 7, false, false, 32, false, 'e2e4', 'e1g1'), (9, 'White', false, 0, false, false, 20, false, NULL, NULL)
) g(k, outcome, is_valid, num_moves, is_checkmate, is_stalemate, legal_move_count, both_insufficient, first_uci, last_uci)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where rows are dealt out.
TASK_ROWS = 1 << 18


def _spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt out to all cores, and to tasks of TASK_ROWS however many there are, where a scan has fewer tasks
    (a file of few row groups): what follows costs far more than moving them. The count reads no column."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def _opening(key) -> tuple:
    letter = lambda n: F.substr(F.lit("abcdefgh"), n + 1, F.lit(1))
    f1, d1, f2, d2 = F.pmod(key, F.lit(8)), F.pmod(F.floor(key / 8), F.lit(2)), F.pmod(F.floor(key / 16), F.lit(8)), F.pmod(F.floor(key / 128), F.lit(2))
    end = F.element_at(F.array(*[F.lit(x) for x in ("1-0", "0-1", "1/2-1/2", "*")]), F.pmod(key, F.lit(4)).cast("int") + 1)
    cast = lambda c: c.cast("int")
    f1, f2 = cast(f1), cast(f2)
    return letter(f1), F.when(d1 == 1, "4").otherwise("3"), letter(f2), F.when(d2 == 1, "5").otherwise("6"), end


def opening_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, movetext: one white and one black pawn move that follow from the key."""
    a, b, c, d, end = _opening(F.col("o_orderkey"))
    return _spread(_read(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.concat(F.lit("1. "), a, b, F.lit(" "), c, d, F.lit(" "), end).alias("movetext"))


_OPEN = """
o AS (SELECT o_orderkey, o_orderkey % 8 AS f1, (o_orderkey // 8) % 2 AS d1, (o_orderkey // 16) % 8 AS f2, (o_orderkey // 128) % 2 AS d2,
  CASE o_orderkey % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'Black' WHEN 2 THEN 'Draw' ELSE 'Unknown' END AS outcome FROM orders),
m AS (SELECT o_orderkey, 0 AS ply, 8 + f1 AS from_sq, 16 + 8 * d1 + f1 AS to_sq, d1 AS d, f1 AS f FROM o
  UNION ALL SELECT o_orderkey, 1, 48 + f2, 40 - 8 * d2 + f2, d2, f2 FROM o)
"""
_NAME = "substr('abcdefgh', CAST({0} % 8 AS INTEGER) + 1, 1) || CAST({0} // 8 + 1 AS VARCHAR)"


def golden_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, k, movetext: one of GOLDEN a row."""
    texts = F.array(*[F.lit(g) for g in GOLDEN])
    k = F.pmod("o_orderkey", F.lit(len(GOLDEN))).cast("int")
    return _spread(_read(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", k.alias("k"), F.element_at(texts, k + 1).alias("movetext"))


def moves_of_openings(spark, sf_dir):
    games = replay(opening_texts(spark, sf_dir), positions=False, status=False)
    moves = moves_table(games, key="o_orderkey", offset=None)
    return moves.select("o_orderkey", F.col("ply").cast("long").alias("ply"), *[F.col(c).cast("long").alias(c) for c in ("from_sq", "to_sq", "promotion")], "uci")


def positions_of_openings(spark, sf_dir):
    games = replay(opening_texts(spark, sf_dir), status=False)
    p = positions_table(games, key="o_orderkey", offset=None)
    pieces = F.size(F.filter("board", lambda x: x > 0))
    pawn_rows = F.aggregate(F.sequence(F.lit(9), F.lit(16)), F.lit(0), lambda a, i: a + (F.element_at("board", i) == 1).cast("int"))
    return p.select("o_orderkey", F.col("ply").cast("long").alias("ply"), F.col("en_passant").cast("long").alias("en_passant"), F.col("halfmove_clock").cast("long").alias("halfmove_clock"), "turn", pieces.cast("long").alias("pieces"), pawn_rows.cast("long").alias("home_pawns"), F.forall("castling", lambda x: x).alias("all_castling"))


def outcomes_of_openings(spark, sf_dir):
    return replay(opening_texts(spark, sf_dir), positions=False, status=False).groupBy("outcome").agg(F.count("*").alias("games"), F.sum("num_moves").alias("moves"))


def _legal_facts(texts: DataFrame) -> DataFrame:
    """A row per game and ply: games are not brought together again by their key, so nothing is shuffled."""
    return legal_summary(texts).select("o_orderkey", F.inline("legal"))


def legal_moves_of_first_moves(spark, sf_dir):
    """Games of one pawn move: both positions have 20 moves, whatever it was."""
    a, b, _, _, end = _opening(F.col("o_orderkey"))
    texts = _spread(_read(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.concat(F.lit("1. "), a, b, F.lit(" "), end).alias("movetext"))
    return _legal_facts(texts)


def legal_moves_of_games(spark, sf_dir):
    """All positions of the openings and of the golden games; held against a plain implementation, not SQL."""
    texts = opening_texts(spark, sf_dir).union(golden_texts(spark, sf_dir).select(-F.col("o_orderkey") - 1, "movetext"))
    return _legal_facts(texts)


def status_of_golden_games(spark, sf_dir):
    g = replay(golden_texts(spark, sf_dir), positions=False)
    last = F.try_element_at("moves", F.lit(-1))
    first = F.try_element_at("moves", F.lit(1))
    name = lambda m: C.uci(m["from_sq"], m["to_sq"], m["promotion"])
    return g.select(
        "o_orderkey", "outcome", "is_valid", F.col("num_moves").cast("long").alias("num_moves"), "is_checkmate", "is_stalemate", F.col("legal_move_count").cast("long").alias("legal_move_count"),
        (F.col("is_insufficient.white") & F.col("is_insufficient.black")).alias("both_insufficient"), name(first).alias("first_uci"), name(last).alias("last_uci"),
        C.game_over(F.col("is_checkmate"), F.col("is_stalemate"), F.col("is_insufficient")).alias("is_game_over"),
    )


def errors_of_golden_games(spark, sf_dir):
    g = replay(golden_texts(spark, sf_dir), positions=False, status=False).where(~F.col("is_valid"))
    return g.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.bool_and(F.contains("parse_error", F.lit("illegal move")) | F.contains("parse_error", F.lit("FEN"))).alias("told"))


def totals_of_golden_games(spark, sf_dir):
    t = game_totals(replay(golden_texts(spark, sf_dir), positions=False, status=False), "k")
    return t.select(F.col("k").cast("long").alias("k"), "num_games", "num_moves", "num_positions")


def invariants_of_golden_games(spark, sf_dir):
    """Counts of broken rules: none in any game."""
    g = replay(golden_texts(spark, sf_dir))
    turns = F.exists(F.sequence(F.lit(2), F.greatest(F.size("positions"), F.lit(2))), lambda i: F.try_element_at("positions", i)["turn"] == F.element_at("positions", i - 1)["turn"])
    return g.agg(
        F.count_if(F.size("positions") != F.size("moves") + 1).alias("bad_counts"), F.count_if(turns).alias("bad_turns"), F.count_if(F.col("is_checkmate") & (F.col("legal_move_count") > 0)).alias("bad_mates"),
        F.count_if((F.size("moves") > 0) & (F.element_at("positions", 1)["board"] == F.element_at("positions", -1)["board"])).alias("unmoved"),
    )


def single_games(spark, sf_dir):
    """What is read of each text of SINGLE, and the state of its last position."""
    k = F.pmod("o_orderkey", F.lit(len(SINGLE))).cast("int")
    rows = _spread(_read(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", k.alias("k"), F.element_at(F.array(*[F.lit(t) for t in SINGLE]), k + 1).alias("movetext"))
    last = F.element_at("positions", -1)
    rights = F.array_join(F.filter(F.zip_with(last["castling"], F.array(*[F.lit(c) for c in "KQkq"]), lambda has, c: F.when(has, c)), lambda c: c.isNotNull()), "")
    long = lambda c: F.col(c).cast("long").alias(c)
    return replay(rows, comments=True).select(
        "o_orderkey", "outcome", "is_valid", long("num_moves"), "is_checkmate", long("legal_move_count"), last["halfmove_clock"].cast("long").alias("halfmove_clock"), rights.alias("castling"), last["turn"].cast("long").alias("white_to_move"),
        last["en_passant"].cast("long").alias("en_passant"), F.try_element_at("moves", F.lit(1))["eval"].cast("double").alias("eval"), F.try_element_at("moves", F.lit(2))["clock"].cast("double").alias("clock"),
    )


def _in_file_order(spark, sf_dir, texts: list[str]) -> DataFrame:
    k = F.pmod("o_orderkey", F.lit(len(texts))).cast("int")
    return _read(spark, sf_dir, "orders").select(F.element_at(F.array(*[F.lit(t) for t in texts]), k + 1).alias("movetext"))


def parsed_games(spark, sf_dir):
    """parse_games() over a file, by chunks: games in the order of the input, with offsets."""
    parsed = api.parse_games(_in_file_order(spark, sf_dir, GOLDEN), num_threads=3, chunk_multiplier=2, store_comments=True, store_legal_moves=True)
    return parsed.games.select("game_index", "outcome", "is_valid", F.col("num_moves").cast("long").alias("num_moves"), "move_offset", "position_offset", F.size("positions").cast("long").alias("positions"), (F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + F.size(p["legal_moves"])) > 0).alias("has_legal_moves"))


def _parsed_openings(spark, sf_dir):
    a, b, c, d, end = _opening(F.col("o_orderkey"))
    return api.parse_games(_read(spark, sf_dir, "orders").select(F.concat(F.lit("1. "), a, b, F.lit(" "), c, d, F.lit(" "), end).alias("movetext")))


def _chunk_sums(chunk: api.ChunkView) -> dict[str, int]:
    weights = np.arange(1, 65, dtype=np.int64)
    return {
        name: int(value)
        for name, value in (
            ("games", chunk.num_games), ("from_sum", chunk.from_squares.sum(dtype="int64")), ("to_sum", chunk.to_squares.sum(dtype="int64")), ("promotion_sum", chunk.promotions.sum(dtype="int64")),
            ("missing", np.isnan(chunk.clocks).sum() + np.isnan(chunk.evals).sum()), ("offset_gaps", (np.diff(chunk.move_offsets) - 2).sum() + (np.diff(chunk.position_offsets) - 3).sum()),
            ("board_digest", (chunk.boards.reshape(-1, 64) @ weights).sum()), ("white_turns", chunk.turn.sum()), ("rights", chunk.castling.sum()), ("comments", len(chunk.comments)), ("replies", chunk.legal_move_count.astype("int64").min()),
        )
    }


def chunk_arrays(spark, sf_dir):
    """Totals of the result, and sums over the NumPy arrays of its chunks, made where the chunks are replayed."""
    names = ["games", "from_sum", "to_sum", "promotion_sum", "missing", "offset_gaps", "board_digest", "white_turns", "rights", "comments", "replies"]
    with _parsed_openings(spark, sf_dir) as parsed:
        sums = parsed.map_chunks(_chunk_sums, ", ".join(f"{name} long" for name in names))
        sums = sums.agg(*[(F.min if name == "replies" else F.sum)(name).alias(name) for name in names]).first().asDict()
        sums |= {"num_games": len(parsed), "num_moves": parsed.num_moves, "num_positions": parsed.num_positions}
        return spark.range(1).select(*[F.lit(v).cast("long").alias(name) for name, v in sums.items()])


def game_views(spark, sf_dir):
    """Single games by index, negative index and slice, as views."""
    with _parsed_openings(spark, sf_dir) as parsed:
        n = len(parsed)
        at = {0: parsed[0], n - 1: parsed[-1], n // 2: parsed[n // 2]} | dict(zip(range(1, n, n // 5), parsed[1 :: n // 5]))
        rows = [(k, " ".join(g.moves_uci()), g.move_uci(1), repr(g), len(g), g.outcome, bool(g.is_game_over)) for k, g in at.items()]
    return spark.createDataFrame(rows, "game_index long, moves string, second string, shown string, moves_made long, outcome string, is_game_over boolean")


def arrays_in_memory(spark, sf_dir):
    """Arrow string, large_string and Python strings in memory, of the customers' keys."""
    key = F.col("c_custkey")
    a, b, c, d, end = _opening(key)
    texts = _read(spark, sf_dir, "customer").select(key, F.concat(F.lit("1. "), a, b, F.lit(" "), c, d, F.lit(" "), end).alias("t")).orderBy(key).toArrow()["t"]
    parts = [api.parse_games(texts.cast(pa.string())), api.parse_games(texts.cast(pa.large_string()).combine_chunks()), api.parse_games_from_strings(texts.to_pylist())]
    rows = [p.games.select(F.lit(k).cast("long").alias("source"), "game_index", "outcome", F.col("num_moves").cast("long").alias("num_moves")) for k, p in enumerate(parts)]
    return rows[0].union(rows[1]).union(rows[2])


def refusals(spark, sf_dir):
    """Errors of the API: their kinds and texts."""
    parsed = api.parse_games(pa.array(GOLDEN[:2]))
    cases = {
        "no game": lambda: api.parse_game(""), "broken off": lambda: api.parse_game("1. e4 {"), "integers": lambda: api.parse_games(_read(spark, sf_dir, "orders"), column="o_orderkey"), "no column": lambda: api.parse_games(_read(spark, sf_dir, "orders")),
        "index": lambda: parsed[2], "negative index": lambda: parsed[-3], "key": lambda: parsed["x"], "move index": lambda: parsed[0].move_uci(7),
    }
    rows = []
    for name, case in cases.items():
        try:
            case()
        except (ValueError, IndexError, TypeError) as e:
            rows.append((name, type(e).__name__, str(e)))
    return spark.createDataFrame(rows, "name string, kind string, message string")


def optional_columns(spark, sf_dir):
    """What is made only if asked for, by game: legal moves and comments."""
    rows = golden_texts(spark, sf_dir).where("k = 8")
    off, on = replay(rows), replay(rows, comments=True, legal_moves=True)
    has = lambda df, outer, name: F.lit(name in df.schema[outer].dataType.elementType.names)
    facts = lambda df: df.select("o_orderkey", has(df, "moves", "comment").alias("comments"), has(df, "positions", "legal_moves").alias("legal_moves"))
    return facts(off).union(facts(on))


def parquet_files(spark, sf_dir):
    """Games in Parquet files beside another column: one column is read, in row groups."""
    path = shared_path(spark, "games")
    opening_texts(spark, sf_dir).withColumn("other", F.lit("x")).write.option("parquet.block.size", 1 << 16).parquet(path)
    games = replay(from_parquet(spark, path), positions=False, status=False)
    read = games._jdf.queryExecution().executedPlan().toString()
    return games.groupBy("outcome").agg(F.count("*").alias("games"), F.lit("other" in read).alias("reads_other"))


def annotations_in_games(spark, sf_dir):
    g = replay(golden_texts(spark, sf_dir), positions=False, status=False, comments=True)
    m = g.select("o_orderkey", F.posexplode("moves").alias("ply", "m"))
    return m.select("o_orderkey", F.col("ply").cast("long").alias("ply"), F.round(F.col("m.eval").cast("double"), 4).alias("eval"), F.col("m.clock").cast("double").alias("clock"), F.col("m.comment").alias("comment"))


def _comment():
    n = F.col("l_orderkey")
    number = F.concat(F.pmod(n, F.lit(17)).cast("string"), F.lit("."), F.lpad(F.pmod(F.floor(n / 3), F.lit(100)).cast("string"), 2, "0"))
    value = F.when(n % 5 == 0, F.concat(F.lit("[%eval #"), F.pmod(n, F.lit(9)).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[%eval "), F.when(n % 2 == 0, "-").otherwise(""), number, F.lit("]")))
    clock = F.concat(F.lit("[%clk "), F.col("l_linenumber").cast("string"), F.lit(":"), F.pmod("l_partkey", F.lit(60)).cast("string"), F.lit(":"), F.pmod("l_suppkey", F.lit(60)).cast("string"), F.lit("]"))
    return F.concat(F.lit("a "), value, F.lit(" b[x] "), clock, F.when(n % 7 == 0, "[%note 1]").otherwise(""))


def annotation_functions(spark, sf_dir):
    rows = _spread(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), C.annotation(_comment()).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("a.eval").cast("double"), 4).alias("eval"), F.col("a.clock").cast("double").alias("clock"), F.col("a.text").alias("text"), F.size("a.items").cast("long").alias("items"))


_COMMENT_SQL = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CASE WHEN l_orderkey % 5 <> 0 THEN (CASE WHEN l_orderkey % 2 = 0 THEN -1 ELSE 1 END) * round(CAST(l_orderkey % 17 AS DOUBLE) + CAST((l_orderkey // 3) % 100 AS DOUBLE) / 100, 4) END AS eval,
  CAST(l_linenumber * 3600 + (l_partkey % 60) * 60 + l_suppkey % 60 AS DOUBLE) AS clock,
  'a ' || CASE WHEN l_orderkey % 5 = 0 THEN '[Mate ' || CAST(l_orderkey % 9 AS VARCHAR) || ']' ELSE '' END || '  b[x] ' || CASE WHEN l_orderkey % 7 = 0 THEN ' [%note 1]' ELSE '' END AS text,
  CAST(4 + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS items
FROM lineitem"""


def uci_function(spark, sf_dir):
    promotion = F.when(F.pmod("l_suppkey", F.lit(7)) < 2, -1).otherwise(F.pmod("l_suppkey", F.lit(4)) + 2)
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), C.uci(F.pmod("l_orderkey", F.lit(64)), F.pmod("l_partkey", F.lit(64)), promotion).alias("uci"))


def header_functions(spark, sf_dir):
    text = F.concat(F.lit('[Event "'), F.col("c_name"), F.lit('"]\n[White "w'), F.col("c_nationkey").cast("string"), F.lit('"]\n[white "other"]\n[White "last"]\n\n1. e4 {[Not "a tag"]} '), F.when(F.col("c_custkey") % 2 == 0, "1-0").otherwise("*"))
    rows = _spread(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")).select("c_custkey", text.alias("t"))
    rows = rows.select("c_custkey", C.tag_list(F.col("t")).alias("tags"), C.termination(F.col("t")).alias("outcome"))
    rows = rows.select("*", C.tags_map(F.col("tags")).alias("map"))
    value = lambda key: C.tag_value(F.col("tags"), key)
    return rows.select("c_custkey", value("event").alias("event"), value("WHITE").alias("white"), F.try_element_at("map", F.lit("White")).alias("last_white"), F.map_keys("map").getItem(0).alias("first_key"), F.size("map").cast("long").alias("tags"), "outcome", value("Site").alias("site"))


def _numbered(spark, sf_dir):
    games = replay(golden_texts(spark, sf_dir), positions=False, status=False).select("o_orderkey", "k", "num_moves", "num_positions")
    return numbered_games(stored(games, "golden"), "o_orderkey")


def game_offsets(spark, sf_dir):
    return _numbered(spark, sf_dir).select("o_orderkey", "game_index", "move_offset", "position_offset")


def position_lookup(spark, sf_dir):
    asked = _read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 13 - 5).alias("position_index"))
    return position_to_game(asked, stored(_numbered(spark, sf_dir), "numbered")).select("event_id", "game_index")


def move_lookup(spark, sf_dir):
    asked = _read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 11 - 5).alias("move_index"))
    return move_to_game(asked, stored(_numbered(spark, sf_dir), "numbered")).select("event_id", "game_index")


def slice_of_games(spark, sf_dir):
    """game_index from 10 in steps of 3: as result[10::3]."""
    return _numbered(spark, sf_dir).where((F.col("game_index") >= 10) & (F.pmod(F.col("game_index") - 10, F.lit(3)) == 0)).select("game_index", "o_orderkey")


_NUMBERED = f"""
n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS game_index, num_moves AS m, num_moves + 1 AS p FROM orders JOIN {_FACTS} ON o_orderkey % {len(GOLDEN)} = g.k),
x AS (SELECT *, coalesce(sum(m) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS move_offset,
  coalesce(sum(p) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position_offset FROM n)
"""


def _lookup_sql(factor: int, offset: str, size: str) -> str:
    return f"""WITH {_NUMBERED}, e AS (SELECT event_id, event_id * {factor} - 5 AS i FROM events),
t AS (SELECT max({offset} + {size}) AS total, max(game_index) AS last FROM x)
SELECT event_id, CAST(CASE WHEN i < 0 THEN -1 WHEN i >= total THEN last ELSE x.game_index END AS BIGINT) AS game_index
FROM e CROSS JOIN t LEFT JOIN x ON i >= x.{offset} AND i < x.{offset} + x.{size}"""


def boards_of_openings(spark, sf_dir):
    """First and last boards as digests of their codes, by square."""
    g = replay(opening_texts(spark, sf_dir), status=False)
    weigh = lambda b: F.aggregate(F.transform(b, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return g.select("o_orderkey", weigh(F.element_at("positions", 1)["board"]).alias("first_digest"), weigh(F.element_at("positions", -1)["board"]).alias("last_digest"))


def outcome_by_segment(spark, sf_dir):
    """Games joined to customers, rolled up."""
    g = replay(golden_texts(spark, sf_dir), positions=False, status=False).select("o_orderkey", "outcome", "num_moves")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = g.join(orders, "o_orderkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.rollup("c_mktsegment", "outcome").agg(F.count("*").alias("games"), F.sum("num_moves").alias("moves"), F.grouping_id().alias("level"))


def eval_swings(spark, sf_dir):
    """Largest change of evaluation from line to line of an order, by a window over parsed comments."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("[%eval "), F.pmod("l_partkey", F.lit(40)).cast("string"), F.lit("]")).alias("c"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    value = C.comment_eval(F.col("c")).cast("double")
    swings = rows.select("l_orderkey", F.abs(value - F.lag(value).over(order)).alias("swing"))
    return swings.groupBy("l_orderkey").agg(F.max("swing").alias("swing"))


def pgn_files(spark, sf_dir):
    """Games written to .pgn text, read back by the splitter and replayed."""
    from pyspark.sql.types import StringType

    path = shared_path(spark, "pgn")
    text = opening_texts(spark, sf_dir).select(F.concat(F.lit('[Event "'), F.col("o_orderkey").cast("string"), F.lit('"]\n[Site "x"]\n\n'), F.col("movetext"), F.lit("\n")).cast(StringType()).alias("value"))
    text.write.option("lineSep", "\n").text(path)
    games = replay(read_pgn(spark, path), positions=False, status=False)
    return games.select(F.element_at("headers", "Event").cast("long").alias("o_orderkey"), "outcome", F.col("num_moves").cast("long").alias("num_moves"))


def streamed_openings(spark, sf_dir):
    """The same games through a file stream into a table in the shared folder, one pass over what is there."""
    path = shared_path(spark, "stream")
    schema = _read(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/order[s].parquet")  # a pattern: file or folder
    a, b, c, d, end = _opening(F.col("o_orderkey"))
    texts = orders.select("o_orderkey", F.concat(F.lit("1. "), a, b, F.lit(" "), c, d, F.lit(" "), end).alias("movetext"))
    games = replay(texts, positions=False, status=False).select("o_orderkey", "outcome", F.col("num_moves").cast("long").alias("num_moves"))
    query = games.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


_FLAGS = f"SELECT o_orderkey, outcome, is_valid, CAST(num_moves AS BIGINT) AS num_moves, is_checkmate, is_stalemate, CAST(legal_move_count AS BIGINT) AS legal_move_count, both_insufficient, first_uci, last_uci, is_checkmate OR is_stalemate OR both_insufficient AS is_game_over FROM orders JOIN {_FACTS} ON o_orderkey % {len(GOLDEN)} = g.k"
_COUNTS = "SELECT o_orderkey, outcome, CAST(2 AS BIGINT) AS num_moves FROM o"
_START_DIGEST = "(SELECT sum(c * (i + 1)) FROM (SELECT unnest([4,2,3,5,6,3,2,4,1,1,1,1,1,1,1,1]) AS c, unnest(range(16)) AS i) UNION ALL SELECT sum(c * (i + 1)) FROM (SELECT unnest([7,7,7,7,7,7,7,7,10,8,9,11,12,9,8,10]) AS c, unnest(range(48, 64)) AS i))"

#: name: (query, SQL or None). Names begin with the identifiers of the operators that they show.
TABLE = {
    "s1_r4_r5_r14_v14_moves": (moves_of_openings, f"WITH {_OPEN} SELECT o_orderkey, CAST(ply AS BIGINT) AS ply, CAST(from_sq AS BIGINT) AS from_sq, CAST(to_sq AS BIGINT) AS to_sq, CAST(-1 AS BIGINT) AS promotion, {_NAME.format('from_sq')} || {_NAME.format('to_sq')} AS uci FROM m"),
    "r9_r13_positions": (
        positions_of_openings,
        f"""WITH {_OPEN} SELECT o_orderkey, CAST(0 AS BIGINT) AS ply, CAST(-1 AS BIGINT) AS en_passant, CAST(0 AS BIGINT) AS halfmove_clock, true AS turn, CAST(32 AS BIGINT) AS pieces, CAST(8 AS BIGINT) AS home_pawns, true AS all_castling FROM o
UNION ALL SELECT o_orderkey, CAST(ply + 1 AS BIGINT), CAST(CASE WHEN d = 1 THEN f ELSE -1 END AS BIGINT), CAST(0 AS BIGINT), ply = 1, CAST(32 AS BIGINT), CAST(7 AS BIGINT), true FROM m""",
    ),
    "v9_boards": (boards_of_openings, f"WITH {_OPEN}, s AS (SELECT CAST(sum(x) AS BIGINT) AS d FROM {_START_DIGEST} t(x)) SELECT o_orderkey, d AS first_digest, CAST(d + (8 + 8 * d1) + 7 * (-8 - 8 * d2) AS BIGINT) AS last_digest FROM o CROSS JOIN s"),
    "l8_a6_outcomes": (outcomes_of_openings, f"WITH {_OPEN} SELECT outcome, count(*) AS games, CAST(2 * count(*) AS BIGINT) AS moves FROM o GROUP BY outcome"),
    "g1_g3_legal_moves": (
        legal_moves_of_first_moves,
        f"""WITH {_OPEN} SELECT o_orderkey, CAST(0 AS BIGINT) AS ply, CAST(20 AS BIGINT) AS n, CAST(2 * (8+9+10+11+12+13+14+15) + 2 * (1 + 6) AS BIGINT) AS from_sum, CAST(16+17+18+19+20+21+22+23+24+25+26+27+28+29+30+31 + 16+18+21+23 AS BIGINT) AS to_sum, CAST(-1 AS BIGINT) AS promotion FROM o
UNION ALL SELECT o_orderkey, CAST(1 AS BIGINT), CAST(20 AS BIGINT), CAST(2 * (48+49+50+51+52+53+54+55) + 2 * (57 + 62) AS BIGINT), CAST(32+33+34+35+36+37+38+39+40+41+42+43+44+45+46+47 + 40+42+45+47 AS BIGINT), CAST(-1 AS BIGINT) FROM o""",
    ),
    "g1_g3_legal_moves_of_games": (legal_moves_of_games, None),
    "a1_a5_r1_r6_status": (status_of_golden_games, _FLAGS),
    "r2_r6_errors": (errors_of_golden_games, f"SELECT CAST(g.k AS BIGINT) AS k, count(*) AS n, true AS told FROM orders JOIN {_FACTS} ON o_orderkey % {len(GOLDEN)} = g.k WHERE NOT is_valid GROUP BY g.k"),
    "a7_totals": (totals_of_golden_games, f"SELECT CAST(g.k AS BIGINT) AS k, count(*) AS num_games, CAST(sum(num_moves) AS BIGINT) AS num_moves, CAST(sum(num_moves + 1) AS BIGINT) AS num_positions FROM orders JOIN {_FACTS} ON o_orderkey % {len(GOLDEN)} = g.k GROUP BY g.k"),
    "r13_invariants": (invariants_of_golden_games, "SELECT CAST(0 AS BIGINT) AS bad_counts, CAST(0 AS BIGINT) AS bad_turns, CAST(0 AS BIGINT) AS bad_mates, CAST(0 AS BIGINT) AS unmoved"),
    "c8_c11_l6_l7_comments": (
        annotations_in_games,
        f"""WITH r AS (SELECT o_orderkey, g.k, unnest(range(num_moves)) AS ply FROM orders JOIN {_FACTS} ON o_orderkey % {len(GOLDEN)} = g.k)
SELECT o_orderkey, CAST(r.ply AS BIGINT) AS ply, CAST(eval AS DOUBLE) AS eval, CAST(clock AS DOUBLE) AS clock, comment
FROM r LEFT JOIN (VALUES (8, 0, 0.3, 180, ''), (8, 2, NULL, NULL, 'good [Mate 3]'), (8, 4, NULL, NULL, '')) t(k, ply, eval, clock, comment) ON r.k = t.k AND r.ply = t.ply""",
    ),
    "c1_c12_annotations": (annotation_functions, _COMMENT_SQL),
    "v12_uci": (uci_function, f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_NAME.format('(l_orderkey % 64)')} || {_NAME.format('(l_partkey % 64)')} || CASE WHEN l_suppkey % 7 < 2 THEN '' ELSE substr('nbrq', CAST(l_suppkey % 4 AS INTEGER) + 1, 1) END AS uci FROM lineitem"),
    "l1_l3_headers": (header_functions, "SELECT c_custkey, c_name AS event, 'w' || CAST(c_nationkey AS VARCHAR) AS white, 'last' AS last_white, 'Event' AS first_key, CAST(3 AS BIGINT) AS tags, CASE WHEN c_custkey % 2 = 0 THEN 'White' ELSE 'Unknown' END AS outcome, CAST(NULL AS VARCHAR) AS site FROM customer"),
    "a8_x1_offsets": (game_offsets, f"WITH {_NUMBERED} SELECT o_orderkey, CAST(game_index AS BIGINT) AS game_index, CAST(move_offset AS BIGINT) AS move_offset, CAST(position_offset AS BIGINT) AS position_offset FROM x"),
    "x2_x4_position_to_game": (position_lookup, _lookup_sql(13, "position_offset", "p")),
    "x3_x4_move_to_game": (move_lookup, _lookup_sql(11, "move_offset", "m")),
    "v1_v2_slice": (slice_of_games, f"WITH {_NUMBERED} SELECT CAST(game_index AS BIGINT) AS game_index, o_orderkey FROM x WHERE game_index >= 10 AND (game_index - 10) % 3 = 0"),
    "s4_s8_l9_c6_r8_r10_r12_a4_single_games": (single_games, f"SELECT o_orderkey, outcome, is_valid, CAST(num_moves AS BIGINT) AS num_moves, is_checkmate, CAST(legal_move_count AS BIGINT) AS legal_move_count, CAST(halfmove_clock AS BIGINT) AS halfmove_clock, castling, CAST(white_to_move AS BIGINT) AS white_to_move, CAST(en_passant AS BIGINT) AS en_passant, CAST(eval AS DOUBLE) AS eval, CAST(clock AS DOUBLE) AS clock FROM orders JOIN {_SINGLE_FACTS} ON o_orderkey % {len(SINGLE)} = g.k"),
    "s1_v16_e1_e2_e3_e4_parse_games": (
        parsed_games,
        f"WITH {_NUMBERED}, g AS (SELECT o_orderkey, outcome, is_valid FROM orders JOIN {_FACTS} ON o_orderkey % {len(GOLDEN)} = g.k) SELECT CAST(game_index AS BIGINT) AS game_index, outcome, is_valid, CAST(m AS BIGINT) AS num_moves, CAST(move_offset AS BIGINT) AS move_offset, CAST(position_offset AS BIGINT) AS position_offset, CAST(p AS BIGINT) AS positions, true AS has_legal_moves FROM x JOIN g ON x.o_orderkey = g.o_orderkey",
    ),
    "k1_k2_v5_v6_v7_v8_chunks": (
        chunk_arrays,
        f"""WITH {_OPEN}, s AS (SELECT CAST(sum(x) AS BIGINT) AS d FROM {_START_DIGEST} t(x)), b AS (SELECT sum(3 * d + 2 * (8 + 8 * d1) + 7 * (-8 - 8 * d2)) AS digest FROM o CROSS JOIN s), t AS (SELECT count(*) AS n FROM o)
SELECT n AS games, CAST((SELECT sum(from_sq) FROM m) AS BIGINT) AS from_sum, CAST((SELECT sum(to_sq) FROM m) AS BIGINT) AS to_sum, -2 * n AS promotion_sum, 4 * n AS missing, CAST(0 AS BIGINT) AS offset_gaps, CAST(digest AS BIGINT) AS board_digest, 2 * n AS white_turns, 12 * n AS rights, CAST(0 AS BIGINT) AS comments,
  CAST(19 AS BIGINT) AS replies, n AS num_games, 2 * n AS num_moves, 3 * n AS num_positions FROM t CROSS JOIN b""",
    ),
    "v1_v2_v4_v13_v15_x5_views": (
        game_views,
        f"""WITH {_OPEN}, r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM o), u AS (SELECT o_orderkey, ply, {_NAME.format('from_sq')} || {_NAME.format('to_sq')} AS uci FROM m)
SELECT CAST(i AS BIGINT) AS game_index, a.uci || ' ' || b.uci AS moves, b.uci AS second, '<PyGameView ? vs ?, 2 moves, valid=True>' AS shown, CAST(2 AS BIGINT) AS moves_made, outcome, false AS is_game_over
FROM r JOIN u a ON r.o_orderkey = a.o_orderkey AND a.ply = 0 JOIN u b ON r.o_orderkey = b.o_orderkey AND b.ply = 1 WHERE i IN (0, n - 1, n // 2) OR (i - 1) % (n // 5) = 0 AND i >= 1""",
    ),
    "s2_s3_s6_arrays": (arrays_in_memory, "SELECT CAST(s AS BIGINT) AS source, row_number() OVER (PARTITION BY s ORDER BY c_custkey) - 1 AS game_index, CASE c_custkey % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'Black' WHEN 2 THEN 'Draw' ELSE 'Unknown' END AS outcome, CAST(2 AS BIGINT) AS num_moves FROM customer CROSS JOIN (VALUES (0), (1), (2)) t(s)"),
    "s5_s7_s11_v3_refusals": (
        refusals,
        """SELECT * FROM (VALUES ('no game', 'ValueError', 'no game found in PGN'), ('broken off', 'LexError', 'unterminated comment'), ('integers', 'ValueError', 'Unsupported array type in ChunkedArray: bigint'), ('no column', 'ValueError', 'Unsupported array type in ChunkedArray: no column movetext'),
 ('index', 'IndexError', 'Game index 2 out of range [0, 2)'), ('negative index', 'IndexError', 'Game index -3 out of range [0, 2)'), ('key', 'TypeError', 'Invalid index type: expected int or slice, got str'), ('move index', 'IndexError', 'Move index 7 out of range [0, 7)')) t(name, kind, message)""",
    ),
    "g2_v11_optional_columns": (optional_columns, "SELECT o_orderkey, b AS comments, b AS legal_moves FROM orders CROSS JOIN (VALUES (true), (false)) t(b) WHERE o_orderkey % 11 = 8"),
    "s9_s10_parquet": (parquet_files, f"WITH {_OPEN} SELECT outcome, count(*) AS games, false AS reads_other FROM o GROUP BY outcome"),
    "rel_rollup": (
        outcome_by_segment,
        f"SELECT c_mktsegment, outcome, count(*) AS games, CAST(sum(num_moves) AS BIGINT) AS moves, CAST(grouping(c_mktsegment, outcome) AS BIGINT) AS level FROM orders JOIN {_FACTS} ON o_orderkey % {len(GOLDEN)} = g.k JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, outcome)",
    ),
    "rel_eval_swings": (
        eval_swings,
        "SELECT l_orderkey, max(swing) AS swing FROM (SELECT l_orderkey, CAST(abs(l_partkey % 40 - lag(l_partkey % 40) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) AS DOUBLE) AS swing FROM lineitem) GROUP BY l_orderkey",
    ),
    "s12_pgn_files": (pgn_files, f"WITH {_OPEN} {_COUNTS}"),
    "stream_replay": (streamed_openings, f"WITH {_OPEN} {_COUNTS}"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TABLE.items() if sql}
