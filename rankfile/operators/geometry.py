"""Bitboard tables. Square 0 is a1, 7 is h1, 63 is h8; bit s of a word is square s."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
BIT = ONE << np.arange(64, dtype=np.uint64)
FILE = np.arange(64) % 8
RANK = np.arange(64) // 8
#: East, north, north-east, north-west; then their opposites.
STEPS = [(1, 0), (0, 1), (1, 1), (-1, 1), (-1, 0), (0, -1), (-1, -1), (1, -1)]
#: Of each square the neighbour in each direction, or -1.
NEXT = np.full((8, 64), -1, dtype=np.int64)
#: Squares seen from a square in each direction of an empty board.
RAY = np.zeros((8, 64), dtype=np.uint64)
KNIGHT = np.zeros(64, dtype=np.uint64)
KING = np.zeros(64, dtype=np.uint64)
#: Squares that a white (0) or black (1) pawn attacks.
PAWN = np.zeros((2, 64), dtype=np.uint64)
#: Squares strictly between two squares of one line.
BETWEEN = np.zeros((64, 64), dtype=np.uint64)

_LEAPS = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]


def _square(f: int, r: int) -> int:
    return 8 * r + f if 0 <= f < 8 and 0 <= r < 8 else -1


for _s in range(64):
    _f, _r = _s % 8, _s // 8
    for _d, (_df, _dr) in enumerate(STEPS):
        NEXT[_d, _s] = _square(_f + _df, _r + _dr)
        _between = np.uint64(0)
        for _n in range(1, 8):
            _t = _square(_f + _n * _df, _r + _n * _dr)
            if _t < 0:
                break
            RAY[_d, _s] |= BIT[_t]
            BETWEEN[_s, _t] = _between
            _between |= BIT[_t]
            if _n == 1:
                KING[_s] |= BIT[_t]
    for _df, _dr in _LEAPS:
        if (_t := _square(_f + _df, _r + _dr)) >= 0:
            KNIGHT[_s] |= BIT[_t]
    for _color, _dr in enumerate((1, -1)):
        for _df in (-1, 1):
            if (_t := _square(_f + _df, _r + _dr)) >= 0:
                PAWN[_color, _s] |= BIT[_t]

ROOK = RAY[0] | RAY[1] | RAY[4] | RAY[5]
BISHOP = RAY[2] | RAY[3] | RAY[6] | RAY[7]
#: By role: none, pawn (not used), knight, bishop, rook, queen, king.
REACH = np.stack([np.zeros(64, np.uint64), np.zeros(64, np.uint64), KNIGHT, BISHOP, ROOK, BISHOP | ROOK, KING])
DARK = np.uint64(0xAA55AA55AA55AA55)
LIGHT = ~DARK
FILES = np.asarray([sum(1 << s for s in range(64) if s % 8 == f) for f in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
RANKS = np.asarray([sum(1 << s for s in range(64) if s // 8 == r) for r in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def lowest(x: np.ndarray) -> np.ndarray:
    """The lowest set bit alone."""
    return x & (~x + ONE)


def highest(x: np.ndarray) -> np.ndarray:
    """The highest set bit alone."""
    x = x | (x >> np.uint64(1))
    for n in (2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(n))
    return x ^ (x >> ONE)


def index(bit: np.ndarray) -> np.ndarray:
    """The square of a single bit."""
    return np.bitwise_count(bit - ONE).astype(np.int64)
