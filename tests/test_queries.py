import pytest

import __spark_entry__ as entry
from rankfile.operators.lex import read_game
from rankfile.operators.replay import Replay
from rankfile.plans import queries as chess

from .naive import Naive
from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entry.oracle_sql().keys() & chess.TABLE.keys()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def plain_legal_moves(text):
    game = read_game(text)
    r = Replay([game], positions=False, status=False)
    at, out = Naive(), []
    for k in range(len(r.frm) + 1):
        out.append(at.legal())
        if k < len(r.frm):
            at = at.play(int(r.frm[k]), int(r.to[k]), int(r.promo[k]))
    return out


def test_legal_moves_of_all_positions(spark):
    """Each position's legal moves against the plain implementation."""
    texts = {r["o_orderkey"]: r["movetext"] for r in chess.opening_texts(spark, SF).limit(60).collect()}
    texts |= {-r["o_orderkey"] - 1: r["movetext"] for r in chess.golden_texts(spark, SF).where(f"o_orderkey < {4 * len(chess.GOLDEN)}").collect()}
    texts = {k: t for k, t in texts.items() if t.strip() and "[FEN" not in t}
    got = {}
    for r in chess.legal_moves_of_games(spark, SF).collect():
        if r["o_orderkey"] in texts:
            got[(r["o_orderkey"], r["ply"])] = tuple(r)[2:]
    assert {k for k, _ in got} == set(texts)
    want = {}
    for key, text in texts.items():
        for ply, moves in enumerate(plain_legal_moves(text)):
            if moves:
                want[(key, ply)] = (len(moves), sum(m[0] for m in moves), sum(m[1] for m in moves), max(m[2] for m in moves))
    assert got == want
