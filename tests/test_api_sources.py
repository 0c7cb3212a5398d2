import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import rankfile
from rankfile.operators.generate import random_games
from rankfile.plans import offsets
from rankfile.sources import PgnDataSource, from_parquet, from_table, read_pgn, split_games
from rankfile.streaming import replay_stream, windowed_outcomes

TEXTS = ["1. e4 e5 1-0", None, "1. d4 {[%eval 0.2] [%clk 0:01:30] fine} 0-1", "", '[White "A"]\n[Black "B"]\n\n1. e4 e5 2. Bc4 Bc5 3. Qh5 Nf6 4. Qxf7# 1-0', "*", "1. e4 {open"]


@pytest.fixture(scope="module")
def parsed(spark):
    return rankfile.parse_games(pa.chunked_array([TEXTS[:3], TEXTS[3:]]), num_threads=2, store_comments=True, store_legal_moves=True)


def test_totals_and_order(parsed):
    assert (len(parsed), parsed.num_moves, parsed.num_positions) == (4, 10, 14)
    assert [len(g) for g in parsed] == [2, 1, 7, 0] and [g.outcome for g in parsed] == ["White", "Black", "White", "Unknown"]
    assert repr(parsed).startswith("<ParsedGames: 4 games, 10 moves, 14 positions, ") and repr(parsed[2]) == "<PyGameView A vs B, 7 moves, valid=True>"
    assert "? vs ?" in repr(parsed[0]) and repr(parsed.chunks[0]).startswith("<PyChunkView chunk=0, ")


def test_views(parsed):
    g = parsed[1]
    assert g.evals.tolist() == [np.float32(0.2)] and g.clocks.tolist() == [90] and g.comments == [" fine"] and g.moves_uci() == ["d2d4"]
    assert np.isnan(parsed[0].evals).all() and parsed[0].comments == [None, None]
    assert g.boards.shape == (2, 8, 8) and g.boards.dtype == np.uint8 and g.initial_board[0, 4] == 6 and g.final_board[3, 3] == 1
    assert g.castling.shape == (2, 4) and g.turn.tolist() == [True, False] and g.en_passant.tolist() == [-1, 3] and g.halfmove_clock.tolist() == [0, 0]
    assert [len(x) for x in g.legal_moves] == [20, 20] and (12, 28, -1) in g.legal_moves[0]
    mate = parsed[2]
    assert mate.is_checkmate and mate.is_game_over and mate.legal_move_count == 0 and not mate.is_stalemate and mate.is_insufficient == (False, False) and mate.is_valid and mate.parse_error is None
    assert mate.headers == {"White": "A", "Black": "B"} and mate.move_uci(6) == "h5f7"
    with pytest.raises(IndexError, match=r"Move index 7 out of range \[0, 7\)"):
        mate.move_uci(7)


def test_indexing(parsed):
    assert [len(g) for g in parsed[1:4:2]] == [1, 0] and [len(g) for g in parsed[::-1]] == [0, 7, 1, 2] and parsed[9:] == []
    assert len(parsed[-2]) == 7
    for bad in (4, -5):
        with pytest.raises(IndexError, match="Game index"):
            parsed[bad]
    with pytest.raises(TypeError, match="expected int or slice, got str"):
        parsed["x"]


def test_lookups(parsed):
    assert parsed.position_to_game(np.arange(-1, 16, dtype=np.int32)).tolist() == [-1] + [0] * 3 + [1] * 2 + [2] * 8 + [3] + [3, 3]
    assert parsed.move_to_game(np.asarray([0, 1, 2, 3, 9], dtype=np.uint64)).tolist() == [0, 0, 1, 2, 2]


def test_chunks(parsed):
    chunks = parsed.chunks
    assert sum(c.num_games for c in chunks) == 4 and np.concatenate([c.from_squares for c in chunks]).tolist()[:3] == [12, 52, 11]
    for c in chunks:
        assert len(c.boards) == c.num_positions == c.position_offsets[-1] == len(c.legal_move_offsets) - 1
        assert c.legal_move_offsets[-1] == len(c.legal_move_from_squares) == len(c.legal_move_promotions) and "games" in repr(c)


def test_tables(parsed):
    moves, positions = parsed.moves.orderBy("move_index").collect(), parsed.positions
    assert [r["uci"] for r in moves[:3]] == ["e2e4", "e7e5", "d2d4"] and [r["move_index"] for r in moves] == list(range(10))
    assert sorted(r["position_index"] for r in positions.select("position_index").collect()) == list(range(14))
    assert parsed.legal_moves.where("ply = 0").groupBy("game_index").count().where("count = 20").count() == 4
    assert parsed.with_status.where("is_game_over").count() == 1


def test_strings_empty_and_single(spark):
    empty = rankfile.parse_games_from_strings([])
    assert len(empty) == 0 and empty.num_moves == 0 and list(empty) == [] and len(empty.chunks) == 1 and empty.chunks[0].num_games == 0
    assert empty.position_to_game([0]).tolist() == [-1] and len(empty.chunks[0].legal_move_offsets) == 0
    one = rankfile.parse_game("1. e4 {hi} 1-0", store_comments=True, store_legal_moves=True)
    assert len(one) == 1 and one.num_moves == 1
    for g in (one[0], rankfile.view_game("1. e4 {hi} 1-0", store_comments=True, store_legal_moves=True)):
        assert g.comments == ["hi"] and len(g.legal_moves) == 2 and g.outcome == "White" and g.moves_uci() == ["e2e4"]
    assert rankfile.view_game("1. e4 {hi}").comments == [] and rankfile.view_game("*").legal_moves == []
    for bad in ("", "1. e4 {"):
        with pytest.raises(ValueError):
            rankfile.parse_game(bad)
        with pytest.raises(ValueError):
            rankfile.view_game(bad)
    with pytest.raises(ValueError, match="Unsupported array type"):
        rankfile.parse_games(pa.chunked_array([[1, 2]]))
    with pytest.raises(ValueError, match="Unsupported array type"):
        rankfile.parse_games(spark.range(3), column="id")
    with pytest.raises(ValueError, match="num_threads"):
        rankfile.parse_games_from_strings(["*"], num_threads=0)
    assert len(rankfile.parse_games(pa.array(["*", "1. e4"], pa.large_string()))) == 2


def test_result_does_not_depend_on_partitions(spark):
    texts = random_games(40, 50, seed=11)
    one, many = (rankfile.parse_games_from_strings(texts, num_threads=n) for n in (1, 7))
    key = lambda p: [(r["game_index"], r["move_offset"], r["outcome"], str(r["moves"])) for r in p.games.orderBy("game_index").collect()]
    assert key(one) == key(many)
    at = np.arange(-2, one.num_moves + 3, 7)
    assert one.move_to_game(at).tolist() == many.move_to_game(at).tolist()


def test_offsets_over_blocks(spark):
    rows = spark.range(0, 700_000, 7).select("id", (F.col("id") % 5).alias("n"))
    got = offsets(rows, "id", at="n").orderBy("id").toPandas()
    assert (got["at"].to_numpy() == np.concatenate(([0], np.cumsum(got["n"].to_numpy())[:-1]))).all()


FILE = '[Event "a"]\n[Site "?"]\n\n1. e4\ne5 1-0\n\n\n[Event "b"]\n\n1. d4 {x\n[y] z} *\n\n[Event "c"]\n\n\n1. c4 0-1\n'


def test_pgn(spark, tmp_path):
    want = ['[Event "a"]\n[Site "?"]\n\n1. e4\ne5 1-0', '[Event "b"]\n\n1. d4 {x\n[y] z} *', '[Event "c"]\n\n\n1. c4 0-1']
    assert [g.strip() for g in split_games(FILE.splitlines(True))] == want
    assert list(split_games(["1. e4\n", "\n", " \n", "1. d4"])) == ["1. e4", "1. d4"] and list(split_games([])) == []
    (tmp_path / "x.pgn").write_text(FILE)
    (tmp_path / "y.pgn").write_text("1. e4 *\n")
    spark.dataSource.register(PgnDataSource)
    one = spark.read.format("pgn").load(str(tmp_path)).orderBy("path", "input_ordinal").collect()
    assert [r["movetext"].strip() for r in one] == [*want, "1. e4 *"]
    two = read_pgn(spark, str(tmp_path)).orderBy("path", "input_ordinal").collect()
    assert [r["movetext"].strip() for r in two] == [*want, "1. e4 *"] and len({r["input_ordinal"] for r in two}) == 4
    games = rankfile.replay(read_pgn(spark, str(tmp_path)), positions=False, status=False)
    assert sorted((r["outcome"], r["num_moves"]) for r in games.collect()) == [("Black", 1), ("Unknown", 1), ("Unknown", 1), ("White", 2)]


def test_parquet_and_plan(spark, tmp_path):
    spark.createDataFrame([(t, i) for i, t in enumerate(TEXTS)], "movetext string, other long").write.parquet(str(tmp_path / "g"))
    rows = from_parquet(spark, str(tmp_path / "g"))
    games = rankfile.replay(rows, positions=False)
    plan = games._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<movetext:string" in plan and "other" not in plan and "IsNotNull(movetext)" in plan and "Exchange hash" not in plan
    assert games.count() == 4 and "positions" not in games.columns


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(t, "2020-01-01 00:0%d:00" % i) for i, t in enumerate(TEXTS)], "movetext string, at string").selectExpr("movetext", "CAST(at AS TIMESTAMP) AS at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = windowed_outcomes(replay_stream(stream, positions=False, status=False), "at")
    q = out.writeStream.format("memory").queryName("outcomes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["outcome"], r["games"], r["moves"]) for r in spark.table("outcomes").collect()} == {("White", 2, 9), ("Black", 1, 1), ("Unknown", 1, 0)}


def test_order_over_files_of_unlike_size(spark, tmp_path):
    """Games are numbered by file name and row, whatever the files' sizes and tasks, and alike in every reading."""
    folder = str(tmp_path / "g")
    for k, n in enumerate((3, 4000, 5)):
        texts = pa.table({"movetext": [f'[Event "{k}-{i}"]\n\n1. e4 *' for i in range(n)]})
        (tmp_path / "g").mkdir(exist_ok=True)
        pq.write_table(texts, f"{folder}/part-0000{k}.parquet", row_group_size=700)
    df = spark.read.parquet(folder)
    rows = from_table(df).orderBy("input_ordinal").collect()
    names = [r["movetext"].split('"')[1] for r in rows]
    want = [f"{k}-{i}" for k, n in enumerate((3, 4000, 5)) for i in range(n)]
    assert names == want and len({r["input_ordinal"] for r in rows}) == len(want)
    parsed = rankfile.parse_games(df)
    assert parsed[0].headers["Event"] == "0-0" and parsed[3].headers["Event"] == "1-0" and parsed[-1].headers["Event"] == "2-4"
    shuffled = rankfile.parse_games(df.repartition(5))  # no order of its own, but counts and texts belong together
    assert len(shuffled) == len(want) and {g.headers["Event"] for g in shuffled[:5000:500]} <= set(want)
    parsed.close()


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_pgn_line_ends_and_parts(spark, tmp_path, end):
    """Files of many parts, games without an Event tag, any line ends: as the sequential splitter gives them."""
    rng = np.random.default_rng(3)
    games = []
    for k in range(1200):
        head = f'[White "{k}"]\n[Black "é"]\n\n' if k % 3 else ""
        games.append(head + "\n".join(f"{i}. e4 e5" for i in range(int(rng.integers(1, 9)))) + (" 1-0" if k % 2 else "") + "\n\n" * int(rng.integers(1, 3)))
    text = ("".join(games)).replace("\n", end)
    (tmp_path / "b.pgn").write_bytes(text.encode())
    (tmp_path / "a.pgn").write_bytes(("1. d4 *" + end).encode())
    want = list(split_games(text.splitlines()))
    assert len(want) == 1200
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = read_pgn(spark, str(tmp_path)).orderBy("input_ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["movetext"].strip() for r in got] == ["1. d4 *", *[w.strip() for w in want]]
    assert len({r["input_ordinal"] for r in got}) == 1201 and got[0]["path"].endswith("a.pgn")


def test_many_games_without_tags_have_ordinals_of_their_own(spark, tmp_path):
    (tmp_path / "x.pgn").write_text("\n\n".join(f"1. e4 e5 {k}. d4" for k in range(2, 10_003)))
    got = read_pgn(spark, str(tmp_path)).collect()
    assert len(got) == len({r["input_ordinal"] for r in got}) == 10_001


def test_rejected_rows(spark):
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(TEXTS)], "movetext string, k long")
    got = {r["k"]: r["reason"] for r in rankfile.rejected(rows).collect()}
    assert got == {1: "null", 3: "no game", 6: "unterminated comment"}
    assert rankfile.replay(rows).count() + len(got) == len(TEXTS)
