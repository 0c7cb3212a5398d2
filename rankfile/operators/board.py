"""Many boards at once: every operation works on arrays with one element per game (or per candidate move).

Games of a batch are replayed in lockstep, ply by ply, so that the interpreter's cost is paid once for thousands of
moves. Boards are kept twice, as 64 codes (what the tables show) and as 13 bitboards (what the rules need).
"""

from __future__ import annotations

import numpy as np

from .geometry import BETWEEN, BISHOP, BIT, DARK, FILE, FILES, KING, KNIGHT, LIGHT, NEXT, PAWN, RANK, RANKS, RAY, REACH, ROOK, highest, index, lowest

PAWN_ROLE, KNIGHT_ROLE, BISHOP_ROLE, ROOK_ROLE, QUEEN_ROLE, KING_ROLE = range(1, 7)
START_CODES = np.zeros(64, dtype=np.uint8)
START_CODES[:8] = [4, 2, 3, 5, 6, 3, 2, 4]
START_CODES[8:16] = 1
START_CODES[48:56] = 7
START_CODES[56:] = START_CODES[:8] + 6
#: Squares by whose rooks the four castling flags are shown: h1, a1, h8, a8.
CORNERS = np.asarray([7, 0, 63, 56])


class Boards:
    """n positions: codes (n, 64), bits (n, 13; 0 is unused), turn (0 white), rooks (n, 4: castling rooks' squares of
    K, Q, k, q or -1), ep (square or -1), half (halfmove clock), kings (n, 2)."""

    __slots__ = ("codes", "bits", "turn", "rooks", "ep", "half", "kings")

    def __init__(self, n: int):
        self.codes = np.tile(START_CODES, (n, 1))
        self.turn = np.zeros(n, dtype=np.int64)
        self.rooks = np.tile(CORNERS, (n, 1))
        self.ep = np.full(n, -1, dtype=np.int64)
        self.half = np.zeros(n, dtype=np.int64)
        self.bits = np.zeros((n, 13), dtype=np.uint64)
        self.kings = np.zeros((n, 2), dtype=np.int64)
        self.refresh(np.arange(n))

    def refresh(self, at: np.ndarray) -> None:
        """Bitboards and king squares from the codes."""
        for code in range(1, 13):
            self.bits[at, code] = ((self.codes[at] == code) * BIT).sum(axis=1, dtype=np.uint64)
        self.kings[at, 0] = index(self.bits[at, 6])
        self.kings[at, 1] = index(self.bits[at, 12])

    def take(self, at: np.ndarray) -> Boards:
        out = object.__new__(Boards)
        for name in self.__slots__:
            setattr(out, name, getattr(self, name)[at])
        return out

    def side(self, color: np.ndarray) -> np.ndarray:
        """Occupancy of one side."""
        white = np.bitwise_or.reduce(self.bits[:, 1:7], axis=1)
        black = np.bitwise_or.reduce(self.bits[:, 7:13], axis=1)
        return np.where(color == 0, white, black)

    def occupied(self) -> np.ndarray:
        return np.bitwise_or.reduce(self.bits[:, 1:], axis=1)

    def show_castling(self) -> np.ndarray:
        """Flags K, Q, k, q as shown: true only for rooks on the corner squares."""
        return self.rooks == CORNERS

    # --- attacks

    def attacked(self, at: np.ndarray, square: np.ndarray, by: np.ndarray, occupied: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Whether `square` of board `at` is attacked by side `by`, given the occupancy; `gone`: pieces to leave out."""
        base = by * 6
        piece = lambda role: self.bits[at, base + role] & ~gone
        hit = (KNIGHT[square] & piece(KNIGHT_ROLE)) | (KING[square] & piece(KING_ROLE)) | (PAWN[1 - by, square] & piece(PAWN_ROLE))
        queens = piece(QUEEN_ROLE)
        straight, diagonal = piece(ROOK_ROLE) | queens, piece(BISHOP_ROLE) | queens
        out = hit != 0
        # only squares that share a line with a slider need its rays
        for reach, sliders, rays in ((ROOK, straight, (0, 1, 4, 5)), (BISHOP, diagonal, (2, 3, 6, 7))):
            some = np.flatnonzero(~out & ((reach[square] & sliders) != 0))
            if not len(some):
                continue
            sq, occ, own = square[some], occupied[some], sliders[some]
            seen = np.zeros(len(some), dtype=np.uint64)
            for d in rays:
                block = RAY[d, sq] & occ
                seen |= lowest(block) if d < 4 else highest(block)
            out[some] = (seen & own) != 0
        return out

    def in_check(self) -> np.ndarray:
        n = np.arange(len(self.turn))
        return self.attacked(n, self.kings[n, self.turn], 1 - self.turn, self.occupied(), np.zeros(len(n), dtype=np.uint64))

    def safe(self, at: np.ndarray, frm: np.ndarray, to: np.ndarray, role: np.ndarray, occupied: np.ndarray) -> np.ndarray:
        """Whether the mover's king is not attacked after a normal move or an en-passant capture."""
        us = self.turn[at]
        passing = (role == PAWN_ROLE) & (to == self.ep[at]) & (FILE[frm] != FILE[to])
        victim = np.where(passing, to + np.where(us == 0, -8, 8), to)
        gone = BIT[victim]
        after = (occupied[at] & ~BIT[frm] & ~gone) | BIT[to]
        king = np.where(role == KING_ROLE, to, self.kings[at, us])
        return ~self.attacked(at, king, 1 - us, after, gone)

    # --- castling

    def castling(self, at: np.ndarray, wing: np.ndarray) -> np.ndarray:
        """Whether castling to the king's (0) or queen's (1) wing is legal."""
        us = self.turn[at]
        rook = self.rooks[at, us * 2 + wing]
        king = self.kings[at, us]
        ok = rook >= 0
        rook = np.maximum(rook, 0)
        king_to, rook_to = us * 56 + np.where(wing == 0, 6, 2), us * 56 + np.where(wing == 0, 5, 3)
        occ = self.occupied()[at]
        path = BETWEEN[king, king_to] | BIT[king_to] | BETWEEN[rook, rook_to] | BIT[rook_to] | BETWEEN[king, rook]
        free = occ & ~BIT[king] & ~BIT[rook]
        ok &= (path & free) == 0
        none = np.zeros(len(at), dtype=np.uint64)
        todo = (BETWEEN[king, king_to] | BIT[king]) & np.where(ok, ~none, none)
        while todo.any():  # the squares that the king leaves and crosses, one of each board at a time
            bit = lowest(todo)
            some = np.flatnonzero(bit)
            bad = self.attacked(at[some], index(bit[some]), 1 - us[some], occ[some] & ~BIT[king[some]], none[some])
            ok[some] &= ~bad
            todo ^= bit
            todo[~ok] = 0
        some = np.flatnonzero(ok)
        if len(some):
            ok[some] = ~self.attacked(at[some], king_to[some], 1 - us[some], free[some] | BIT[king_to[some]] | BIT[rook_to[some]], none[some])
        return ok

    # --- moves from notation

    def resolve(self, role, to, file, rank, promotion, capture, castle) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From square, to square (castling: the king's), and 0 where exactly one legal move fits (1 none, 2 several).

        One element per board: role and target; disambiguating file and rank (8: none); promotion role (0: none);
        whether a capture is written; castle 0 no, 1 king's, 2 queen's wing.
        """
        n = len(self.turn)
        every = np.arange(n)
        us = self.turn
        occ, own = self.occupied(), self.side(us)
        frm = np.zeros(n, dtype=np.int64)
        count = np.zeros(n, dtype=np.int64)
        plain = castle == 0
        target_free = (BIT[to] & own) == 0
        takes = (BIT[to] & occ) != 0
        pawn = plain & (role == PAWN_ROLE)
        pieces = plain & ~pawn & target_free & (takes == capture) & (promotion == 0)
        cand = np.where(pieces, self.bits[every, us * 6 + role] & REACH[role, to], np.uint64(0))
        pawns = self.bits[every, us * 6 + 1]
        passing = (to == self.ep) & (self.ep >= 0)
        last = RANK[to] == np.where(us == 0, 7, 0)
        pawn &= (last == (promotion > 1)) & (capture == (takes | (passing & capture)))
        cand = np.where(pawn & capture & target_free, pawns & PAWN[1 - us, to], cand)
        back = np.where(us == 0, -8, 8)
        one, two = to + back, to + 2 * back
        on_board = (one >= 0) & (one < 64)
        one_bit = np.where(on_board, BIT[np.clip(one, 0, 63)], np.uint64(0))
        double = (RANK[to] == np.where(us == 0, 3, 4)) & ((one_bit & occ) == 0)
        push = np.where((pawns & one_bit) != 0, one_bit, np.where(double, BIT[np.clip(two, 0, 63)] & pawns, np.uint64(0)))
        cand = np.where(pawn & ~capture & ~takes, push, cand)
        cand &= FILES[file] & RANKS[rank]
        at = np.flatnonzero(cand)
        while len(at):
            bit = lowest(cand[at])
            cand[at] ^= bit
            f, t, r = index(bit), to[at], role[at]
            clear = ((BETWEEN[f, t] & occ[at]) == 0) | (r == KNIGHT_ROLE)
            x, f, t, r = at[clear], f[clear], t[clear], r[clear]
            good = self.safe(x, f, t, r, occ)
            x, f = x[good], f[good]
            frm[x] = f
            count[x] += 1
            at = at[cand[at] != 0]
        at = np.flatnonzero(~plain)
        to = to.copy()
        if len(at):
            wing = castle[at] - 1
            frm[at] = self.kings[at, us[at]]
            to[at] = us[at] * 56 + np.where(wing == 0, 6, 2)
            count[at] = self.castling(at, wing)
        return frm, to, np.where(count == 1, 0, np.where(count == 0, 1, 2))

    def play(self, at: np.ndarray, frm: np.ndarray, to: np.ndarray, promotion: np.ndarray, castle: np.ndarray) -> None:
        """Plays one legal move on each board of `at`, in place."""
        us = self.turn[at]
        base = us * 6
        code = self.codes[at, frm].astype(np.int64)
        role = code - base
        normal = castle == 0
        passing = normal & (role == PAWN_ROLE) & (to == self.ep[at]) & (FILE[frm] != FILE[to])
        victim = np.where(passing, to + np.where(us == 0, -8, 8), to)
        taken = np.where(normal, self.codes[at, victim], 0).astype(np.int64)
        x = np.flatnonzero(taken)
        if len(x):
            self.bits[at[x], taken[x]] &= ~BIT[victim[x]]
            self.codes[at[x], victim[x]] = 0
        x = np.flatnonzero(normal)
        lands = np.where(promotion > 1, base + promotion, code)
        a, f, t = at[x], frm[x], to[x]
        self.bits[a, code[x]] &= ~BIT[f]
        self.codes[a, f] = 0
        self.bits[a, lands[x]] |= BIT[t]
        self.codes[a, t] = lands[x]
        rights = self.rooks[at]
        x = np.flatnonzero(~normal)
        if len(x):
            a, u, wing = at[x], us[x], castle[x] - 1
            rook, rook_to = rights[x, u * 2 + wing], u * 56 + np.where(wing == 0, 5, 3)
            for where, piece in ((frm[x], 6), (rook, 4)):
                self.bits[a, u * 6 + piece] &= ~BIT[where]
                self.codes[a, where] = 0
            for where, piece in ((to[x], 6), (rook_to, 4)):
                self.bits[a, u * 6 + piece] |= BIT[where]
                self.codes[a, where] = u * 6 + piece
        king = role == KING_ROLE
        self.kings[at[king], us[king]] = to[king]
        lost = (rights == frm[:, None]) | ((rights == to[:, None]) & normal[:, None])
        lost |= king[:, None] & (np.asarray([0, 0, 1, 1]) == us[:, None])
        self.rooks[at] = np.where(lost, -1, rights)
        double = (role == PAWN_ROLE) & (np.abs(to - frm) == 16)
        self.ep[at] = np.where(double, (frm + to) // 2, -1)
        self.half[at] = np.where((role == PAWN_ROLE) | (taken > 0), 0, self.half[at] + 1)
        self.turn[at] = 1 - us

    # --- all moves

    def legal_moves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All legal moves: board, from, to, promotion (-1 none), ordered by board, from, to, promotion.

        Castling is given as the king's move to its own target square.
        """
        occ = self.occupied()
        own = self.side(self.turn)
        b0, s0 = np.nonzero((self.codes > 0) & ((self.codes > 6) == (self.turn[:, None] == 1)))
        role0 = self.codes[b0, s0].astype(np.int64) - 6 * self.turn[b0]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def spread(b: np.ndarray, s: np.ndarray, targets: np.ndarray) -> None:
            while len(b):
                bit = lowest(targets)
                some = bit != 0
                b, s, targets, bit = b[some], s[some], targets[some], bit[some]
                if len(b):
                    found.append((b, s, index(bit)))
                targets = targets ^ bit

        for role, reach in ((KNIGHT_ROLE, KNIGHT), (KING_ROLE, KING)):
            x = role0 == role
            spread(b0[x], s0[x], reach[s0[x]] & ~own[b0[x]])
        for d in range(8):
            x = (role0 == QUEEN_ROLE) | (role0 == (ROOK_ROLE if d in (0, 1, 4, 5) else BISHOP_ROLE))
            b, s = b0[x], s0[x]
            t = NEXT[d, s]
            while True:
                on = t >= 0
                b, s, t = b[on], s[on], t[on]
                on = (own[b] & BIT[t]) == 0
                b, s, t = b[on], s[on], t[on]
                if not len(b):
                    break
                found.append((b, s, t))
                on = (occ[b] & BIT[t]) == 0
                b, s, t = b[on], s[on], NEXT[d, t[on]]
        x = role0 == PAWN_ROLE
        b, s = b0[x], s0[x]
        us = self.turn[b]
        passing = np.where(self.ep[b] >= 0, BIT[np.maximum(self.ep[b], 0)], np.uint64(0))
        spread(b, s, PAWN[us, s] & ((occ[b] & ~own[b]) | passing))
        ahead = np.where(us == 0, 8, -8)
        t = s + ahead
        ok = (t >= 0) & (t < 64)
        b, s, t, us, ahead = b[ok], s[ok], t[ok], us[ok], ahead[ok]
        on = (occ[b] & BIT[t]) == 0
        found.append((b[on], s[on], t[on]))
        on &= RANK[s] == np.where(us == 0, 1, 6)
        b, s, t = b[on], s[on], t[on] + ahead[on]
        on = (occ[b] & BIT[t]) == 0
        found.append((b[on], s[on], t[on]))
        b, s, t = (np.concatenate([f[k] for f in found]) for k in range(3))
        role = self.codes[b, s].astype(np.int64) - 6 * self.turn[b]
        ok = self.safe(b, s, t, role, occ)
        b, s, t, role = b[ok], s[ok], t[ok], role[ok]
        promo = np.full(len(b), -1, dtype=np.int64)
        last = (role == PAWN_ROLE) & (RANK[t] == np.where(self.turn[b] == 0, 7, 0))
        parts = [(b[~last], s[~last], t[~last], promo[~last])] + [(b[last], s[last], t[last], np.full(int(last.sum()), p)) for p in (2, 3, 4, 5)]
        every = np.arange(len(self.turn))
        for wing in (0, 1):
            can = self.rooks[every, self.turn * 2 + wing] >= 0
            at = every[can]
            at = at[self.castling(at, np.full(len(at), wing))]
            us = self.turn[at]
            parts.append((at, self.kings[at, us], us * 56 + (6 if wing == 0 else 2), np.full(len(at), -1)))
        b, s, t, promo = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((promo, t, s, b))
        return b[order], s[order], t[order], promo[order]

    def insufficient(self, color: int) -> np.ndarray:
        """Whether the side can't mate by any sequence of legal moves."""
        mine, theirs = self.bits[:, 1 + 6 * color : 7 + 6 * color], self.bits[:, 7 - 6 * color : 13 - 6 * color]
        strong = (mine[:, 0] | mine[:, 3] | mine[:, 4]) != 0
        own = np.bitwise_count(np.bitwise_or.reduce(mine, axis=1))
        helpers = (theirs[:, 0] | theirs[:, 1] | theirs[:, 2] | theirs[:, 3]) != 0
        bishops, minor = mine[:, 2] | theirs[:, 2], mine[:, 0] | theirs[:, 0] | mine[:, 1] | theirs[:, 1]
        one_color = ((bishops & DARK) == 0) | ((bishops & LIGHT) == 0)
        by_bishop = one_color & (minor == 0)
        by_knight = (own <= 2) & ~helpers
        return ~strong & np.where(mine[:, 1] != 0, by_knight, np.where(mine[:, 2] != 0, by_bishop, True))
