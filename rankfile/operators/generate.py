"""Random legal games in lockstep: distinct inputs for benchmarks and tests."""

from __future__ import annotations

import numpy as np

from .board import Boards
from .geometry import FILE


def random_games(n: int, plies: int, seed: int) -> list[str]:
    """n texts of up to `plies` random legal moves each, every move written with its origin square."""
    rng = np.random.default_rng(seed)
    boards = Boards(n)
    texts: list[list[str]] = [[] for _ in range(n)]
    alive = np.arange(n)
    name = [f"{'abcdefgh'[s % 8]}{s // 8 + 1}" for s in range(64)]
    for ply in range(plies):
        which, frm, to, promo = boards.take(alive).legal_moves()
        counts = np.bincount(which, minlength=len(alive))
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        going = counts > 0
        pick = first[going] + (rng.random(int(going.sum())) * counts[going]).astype(np.int64)
        alive = alive[going]
        if not len(alive):
            break
        f, t, p = frm[pick], to[pick], promo[pick]
        code = boards.codes[alive, f].astype(np.int64)
        role = (code - 1) % 6 + 1
        castle = np.where((role == 6) & (np.abs(FILE[f] - FILE[t]) == 2), np.where(FILE[t] == 6, 1, 2), 0)
        takes = (boards.codes[alive, t] > 0) | ((role == 1) & (FILE[f] != FILE[t]))
        for k, g in enumerate(alive.tolist()):
            number = f"{ply // 2 + 1}. " if ply % 2 == 0 else ""
            if castle[k]:
                san = "O-O" if castle[k] == 1 else "O-O-O"
            else:
                piece = "" if role[k] == 1 else " PNBRQK"[role[k]]
                san = piece + name[f[k]] + ("x" if takes[k] else "") + name[t[k]] + ("=" + " PNBRQ"[p[k]] if p[k] > 1 else "")
            texts[g].append(number + san)
        boards.play(alive, f, t, np.maximum(p, 0), castle)
    over = (" 1-0", " 0-1", " 1/2-1/2", " *", "")
    return [" ".join(t) + over[k] for t, k in zip(texts, rng.integers(0, 5, size=n).tolist())]
