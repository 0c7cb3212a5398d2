import numpy as np
import pytest

from rankfile.operators.board import Boards
from rankfile.operators.fen import FenError, PositionError, parse_fen
from rankfile.operators.generate import random_games
from rankfile.operators.lex import LexError, read_game
from rankfile.operators.replay import Replay

from .naive import Naive


def boards_of(fen, chess960=False):
    s = parse_fen(fen, chess960)
    b = Boards(1)
    b.codes[0], b.turn[0], b.rooks[0], b.ep[0] = s.codes, s.turn, s.rooks, s.ep
    b.refresh(np.arange(1))
    return b


def perft(b, depth):
    which, f, t, p = b.legal_moves()
    if depth == 1:
        return len(which)
    c = b.take(which)
    role = c.codes[np.arange(len(which)), f] % 6
    castle = np.where((role == 0) & (np.abs(f - t) == 2), np.where(t % 8 == 6, 1, 2), 0)
    c.play(np.arange(len(which)), f, t, np.maximum(p, 0), castle)
    return perft(c, depth - 1)


@pytest.mark.parametrize(
    "fen, counts",
    [
        ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", [20, 400, 8902, 197281]),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039, 97862]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812, 43238]),
        ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", [6, 264, 9467]),
        ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", [44, 1486, 62379]),
    ],
)
def test_perft(fen, counts):
    assert [perft(boards_of(fen), d + 1) for d in range(len(counts))] == counts


def test_random_games_equal_plain_rules():
    texts = random_games(25, 140, seed=7)
    r = Replay([read_game(t) for t in texts], legal_moves=True)
    assert r.errors == [None] * 25 and len(set(texts)) == 25
    at, move = 0, 0
    offsets, lf, lt, lp = r.legal
    promoted = 0
    for g in range(25):
        n = Naive()
        for ply in range(int(r.played[g]) + 1):
            assert r.board[at].tolist() == n.codes()
            assert r.turn[at] == n.white and r.half[at] == min(255, n.half) and r.ep[at] == (-1 if n.ep is None else n.ep % 8)
            assert r.castling[at].tolist() == [c in n.rights for c in "KQkq"]
            legal = n.legal()
            a, z = offsets[at], offsets[at + 1]
            assert list(zip(lf[a:z].tolist(), lt[a:z].tolist(), lp[a:z].tolist())) == legal
            at += 1
            if ply < r.played[g]:
                m = (int(r.frm[move]), int(r.to[move]), int(r.promo[move]))
                promoted += m[2] > 0
                assert m in legal
                n = n.play(*m)
                move += 1
        assert r.legal_count[g] == len(legal) and r.mate[g] == (not legal and n.check(n.white)) and r.stale[g] == (not legal and not n.check(n.white))
    assert at == len(r.board) and move == len(r.frm)


def one(text, **kw):
    return Replay([read_game(text)], **kw)


def ucis(r):
    name = lambda s: "abcdefgh"[s % 8] + str(s // 8 + 1)
    return [name(f) + name(t) for f, t in zip(r.frm.tolist(), r.to.tolist())]


def test_chess960_castling():
    head = '[Variant "CHESS960"]\n[FEN "{}"]\n\n'
    r = one(head.format("4k3/8/8/8/8/8/8/1R1K2R1 w BG - 0 1") + "1. O-O-O *")
    assert r.errors == [None] and ucis(r) == ["d1c1"] and r.board[1, 3] == 4 and r.board[1, 2] == 6
    assert r.castling[0].tolist() == [False] * 4  # shown only for corner rooks
    r = one(head.format("rk5r/8/8/8/8/8/8/RK5R w KQkq - 0 1") + "1. O-O O-O-O")
    assert r.errors == [None] and r.castling[0].all() and ucis(r) == ["b1g1", "b8c8"]
    blocked = one(head.format("4k3/8/8/8/8/8/8/1R1KN1R1 w BG - 0 1") + "1. O-O *")
    assert "illegal move" in blocked.errors[0] and blocked.played[0] == 0
    attacked = one(head.format("4k3/8/8/8/8/8/5r2/1R1K2R1 w BG - 0 1") + "1. O-O *")
    assert "illegal move" in attacked.errors[0]
    # an 8th-rank rook that castling would uncover
    uncovered = one(head.format("4k3/8/8/8/8/8/8/qR1K4 w B - 0 1") + "1. O-O-O *")
    assert "illegal move" in uncovered.errors[0]


@pytest.mark.parametrize("fen, kind", [("x", FenError), ("8/8/8/8/8/8/8/8 w - - 0 1", PositionError), ("4k3/8/8/8/8/8/8/8 w - - 0 1", PositionError), ("kk6/8/8/8/8/8/8/K7 w - - 0 1", PositionError), ("4k3/8/8/8/8/8/4R3/4K3 w - - 0 1", PositionError), ("4k2P/8/8/8/8/8/8/4K3 w - - 0 1", PositionError), ("4k3/8/8/8/8/8/8/4K3 w K - 0 1", PositionError), ("4k3/8/8/8/8/8/8/4K3 w - e6 0 1", PositionError), ("4k3/8/8/8/8/8/8/4K3 z - - 0 1", FenError), ("4k3/8/8/8/8/8/PPPPPPPP/RNBQKBNQ w - - 0 1", PositionError), ("4k3/8/8/8/8/8/8/BBB1K3 w - - 0 1", None), ("4k3/8/8/8/8/PPPPPPPP/B1B1B3/4K3 w - - 0 1", PositionError), ("4k3/8/8/4r3/8/3n1n2/8/4K3 w - - 0 1", PositionError), ("8/8/4r3/k7/4K3/8/8/4r3 w - - 0 1", PositionError), ("8/8/4r3/k7/4K3/8/5n2/8 w - - 0 1", None), ("4k3/8/8/8/8/8/8/4K3 w - - x 1", FenError)])
def test_bad_positions(fen, kind):
    if kind is None:
        assert parse_fen(fen)
        return
    with pytest.raises(kind):
        parse_fen(fen)
    r = one(f'[fen "{fen}"]\n\n1. e4 *')
    assert "FEN" in r.errors[0] and r.played[0] == 0 and r.legal_count[0] == 20 and len(r.board) == 1
    assert r.errors[0].startswith("failed to parse FEN: " if kind is FenError else "invalid FEN position: ")


def test_errors_keep_the_prefix_and_stop_moves():
    r = one("1. e4 e5 2. Nf6 Nf3 {[%eval 1.5] late}")
    assert r.errors == ["illegal move: illegal san Nf6"] and r.played[0] == 2
    value, has, _, _, text = r.annotations()
    assert value[1] == 1.5 and has.tolist() == [False, True] and text.tolist() == [None, " late"]
    assert "ambiguous" in one('[FEN "4k3/8/8/8/8/8/8/RN2KN2 w - - 0 1"]\n\n1. Nd2 *').errors[0]
    assert one('[FEN "4k3/8/8/8/8/4q3/3N4/R3KN2 w - - 0 1"]\n\n1. Nxe3 *').errors == [None]  # the other is no candidate
    assert "illegal" in one("1. e4 e5 2. exd5 *").errors[0] and "illegal" in one("1. e4 d5 2. ed5 *").errors[0]
    assert "illegal" in one("1. e4 -- 2. d4 *").errors[0]


def test_insufficient_material():
    for fen, white, black in (("4k3/8/8/8/8/8/8/4K3", 1, 1), ("4k3/8/8/8/8/8/8/3NK3", 1, 1), ("3qk3/8/8/8/8/8/8/3NK3", 1, 0), ("3nk3/8/8/8/8/8/8/3NK3", 0, 0), ("2b1k3/8/8/8/8/8/8/2B1K3", 0, 0), ("3bk3/8/8/8/8/8/8/2B1K3", 1, 1), ("4k3/8/8/8/8/8/P7/4K3", 0, 1), ("4k3/8/8/8/8/8/8/2NNK3", 0, 1)):
        b = boards_of(fen + " w - - 0 1")
        assert (int(b.insufficient(0)[0]), int(b.insufficient(1)[0])) == (white, black), fen


def test_reading():
    g = read_game('[Event "a \\" b"]\n[event "second"]\n[Event "last"]\n\n1.e4 $1 e5!? (1... c5 {x) y} (1... e6)) 2. Nf3?! ; to the end 2. h4\n{two\n\nlines} Nc6 1/2-1/2 3. d4\n\n1. a4 *')
    assert g.sans == ["1.e4", "e5!?", "Nf3?!", "Nc6"] and g.outcome == "Draw" and g.comments == [(3, "two\n\nlines")]
    assert dict(g.tags) == {"Event": "last", "event": "second"} and g.first("event") == 'a \\" b'
    assert read_game("") is None and read_game(" \n ") is None and read_game('[A "b"]').sans == []
    assert read_game("1. e4\n\n1. d4 *").sans == ["e4"] and read_game("1. e4").outcome is None and read_game("0-1").outcome == "Black"
    assert read_game("1. e4 e5 2. O-O-O 0-0 e8=Q+ e8q axb1=N# R1a3 *").outcome == "Unknown"
    with pytest.raises(LexError):
        read_game("1. e4 {never closed")


def test_lockstep_is_order_free():
    texts = random_games(12, 60, seed=3) + ["1. e4 e5 2. Ke3 *", '[FEN "bad"]\n\n1. e4', ""]
    games = [read_game(t) for t in texts if t]
    whole = Replay(games)
    back = Replay(games[::-1])
    first = np.concatenate(([0], np.cumsum(whole.played)))
    again = np.concatenate(([0], np.cumsum(back.played)))
    for k in range(len(games)):
        j = len(games) - 1 - k
        assert whole.errors[k] == back.errors[j]
        assert whole.frm[first[k] : first[k + 1]].tolist() == back.frm[again[j] : again[j + 1]].tolist()
