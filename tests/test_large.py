"""What keeps large tables within the limits: equal texts are replayed once, rows are dealt into tasks of bounded size."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import rankfile
from rankfile import api
from rankfile.functions import annotation_items
from rankfile.operators import replay as replaying
from rankfile.operators.generate import random_games
from rankfile.operators.replay import LOCKSTEP, columns, legal_counts, read_batch, replay, replayed
from rankfile.plans import legal_moves_table
from rankfile.plans import queries as chess

SF = "/root/testdata/sf0.001"


def test_equal_texts_are_replayed_once_and_all_rows_come_out():
    texts = [t for g in chess.GOLDEN for t in (g, "1. e4 {open")] + [None]
    rows = (texts * (3 * LOCKSTEP // len(texts)))[: 3 * LOCKSTEP - 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, min(k + 5000, len(rows)))), pa.array(rows[k : k + 5000], pa.string())], names=["id", "t"]) for k in range(0, len(rows), 5000)]
    made = []

    def make(games):
        made.append(len(games))
        return columns(games, comments=True, legal_moves=True)

    got = pa.Table.from_batches(list(replayed(iter(batches), 1, make)))
    assert sum(made) == len(chess.GOLDEN) - 1  # the blank text holds no game
    at, games = read_batch(rows[:200])
    want = pa.table(dict(columns(games, comments=True, legal_moves=True)))
    assert got["id"].to_pylist() == [k for k, t in enumerate(rows) if t and t.strip() and t != "1. e4 {open"]
    assert got.drop_columns(["id", "t"]).slice(0, len(at)).to_pylist() == want.to_pylist()


def test_many_unlike_texts_among_equal_ones(monkeypatch):
    """More texts than are kept: those kept are forgotten, and every row still gets its own game."""
    monkeypatch.setattr(replaying, "LOCKSTEP", 50)
    texts = random_games(120, 12, seed=5)
    rows = [texts[(k * k + k // 7) % 120] if k % 3 else "1. e4 e5 *" for k in range(400)]
    got = pa.Table.from_batches(list(replayed(iter([pa.RecordBatch.from_arrays([pa.array(rows)], names=["t"])]), 0, columns)))
    want = pa.table(dict(columns(read_batch(rows)[1])))
    assert got.drop_columns(["t"]).to_pylist() == want.to_pylist()


def test_tasks_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(chess, "TASK_ROWS", 100)
    texts = chess.golden_texts(spark, SF)
    n = texts.count()
    assert n > 100 * spark.sparkContext.defaultParallelism
    assert texts.rdd.getNumPartitions() == -(-n // 100) and max(texts.rdd.glom().map(len).collect()) <= 110


def test_legal_moves_are_summed_without_a_shuffle_of_single_moves(spark):
    """As the table of single legal moves gives them, but neither it nor a grouping by game is made."""
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(chess.GOLDEN + random_games(30, 60, seed=8))], "o_orderkey long, movetext string")
    single = legal_moves_table(replay(texts, legal_moves=True, status=False), key="o_orderkey")
    want = single.groupBy("o_orderkey", "ply").agg(F.count("*"), F.sum("from_sq"), F.sum("to_sq"), F.max("promotion"))
    got = chess._legal_facts(texts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = chess.legal_moves_of_games(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    none = pa.table(dict(legal_counts(read_batch(["1. f3 e5 2. g4 Qh4# 0-1"])[1])))["legal"].to_pylist()[0]
    assert [r["ply"] for r in none] == [0, 1, 2, 3]  # the mate has no legal move and no row


def test_parsed_games_keep_texts_and_replay_in_tasks_of_bounded_size(spark, monkeypatch):
    """However few chunks are asked for; boards are kept only on demand, and a lookup replays what it asks for."""
    monkeypatch.setattr(api, "TASK_POSITIONS", 500)
    texts = random_games(300, 20, seed=2)
    with rankfile.parse_games_from_strings(texts, num_threads=2, store_legal_moves=True) as parsed:
        plan = parsed.games._jdf.queryExecution().executedPlan().toString()
        assert not parsed.games.is_cached and "InMemoryRelation" in plan and "positions" not in plan.split("InMemoryRelation")[1]
        assert parsed.games.rdd.getNumPartitions() == -(-parsed.num_positions // 500) > 2
        assert [c.num_games for c in parsed.chunks] == [150, 150] and [len(g) for g in parsed] == [len(g) for g in parsed[:]]
        assert parsed.keep().games.is_cached
    assert not parsed.games.is_cached


def test_chunks_are_bounded_and_their_sums_are_made_in_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(api, "CHUNK_POSITIONS", 100)
    monkeypatch.setattr(api, "TASK_POSITIONS", 700)
    texts = random_games(200, 15, seed=4)
    with rankfile.parse_games_from_strings(texts) as parsed:
        chunks = parsed.chunks
        assert len(chunks) == parsed.num_chunks == -(-parsed.num_positions // 100) and max(c.num_positions for c in chunks) < 100 + 16
        assert np.concatenate([c.boards for c in chunks]).shape == (parsed.num_positions, 8, 8)
        facts = lambda c: {"games": c.num_games, "squares": int(c.to_squares.sum(dtype="int64")), "pieces": int((c.boards > 0).sum())}
        rows = parsed.map_chunks(facts, "games long, squares long, pieces long").collect()
        assert len(rows) > 1
        assert [sum(r[k] for r in rows) for k in range(3)] == [sum(facts(c)[name] for c in chunks) for name in ("games", "squares", "pieces")]

    def refuse(self):
        raise AssertionError("a chunk was fetched")

    monkeypatch.setattr(type(spark.range(1)), "toArrow", refuse)
    assert chess.chunk_arrays(spark, SF).first()["games"] == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_an_item_of_a_comment_is_matched_by_each_pattern_once(spark):
    """Within lambdas an expression that is written twice runs twice: the prefix, and five parts of the tags' patterns."""
    rows = spark.createDataFrame([("a [%eval 1.5] b",)], "c string")
    plan = rows.select(annotation_items(F.col("c")).alias("items"))._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        assert plan.toString().count("regexp_extract(") == 6
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
