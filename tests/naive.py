"""Chess rules written plainly, one square at a time: what the lockstep kernel is tested against."""

ROOK, BISHOP = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
KNIGHT = [(1, 2), (2, 1), (-1, 2), (-2, 1), (1, -2), (2, -1), (-1, -2), (-2, -1)]


class Naive:
    def __init__(self):
        self.b = list("RNBQKBNR" + "P" * 8 + "." * 32 + "p" * 8 + "rnbqkbnr")
        self.white, self.rights, self.ep, self.half = True, {"K", "Q", "k", "q"}, None, 0

    def copy(self):
        out = Naive()
        out.b, out.white, out.rights, out.ep, out.half = list(self.b), self.white, set(self.rights), self.ep, self.half
        return out

    def mine(self, p):
        return p != "." and p.isupper() == self.white

    def rays(self, s, steps, far):
        for df, dr in steps:
            f, r = s % 8 + df, s // 8 + dr
            while 0 <= f < 8 and 0 <= r < 8:
                yield 8 * r + f
                if self.b[8 * r + f] != "." or not far:
                    break
                f, r = f + df, r + dr

    def attacked(self, s, by_white):
        own = lambda kinds: (lambda t: self.b[t] != "." and self.b[t].isupper() == by_white and self.b[t].upper() in kinds)
        pawns = [(-1, -1), (1, -1)] if by_white else [(-1, 1), (1, 1)]
        return (
            any(map(own("RQ"), self.rays(s, ROOK, True))) or any(map(own("BQ"), self.rays(s, BISHOP, True)))
            or any(map(own("N"), self.rays(s, KNIGHT, False))) or any(map(own("K"), self.rays(s, ROOK + BISHOP, False))) or any(map(own("P"), self.rays(s, pawns, False)))
        )

    def check(self, white):
        return self.attacked(self.b.index("K" if white else "k"), not white)

    def pseudo(self):
        up = 8 if self.white else -8
        for s in range(64):
            p = self.b[s]
            if not self.mine(p):
                continue
            kind = p.upper()
            if kind == "P":
                ends = []
                if self.b[s + up] == ".":
                    ends.append(s + up)
                    if s // 8 == (1 if self.white else 6) and self.b[s + 2 * up] == ".":
                        ends.append(s + 2 * up)
                for df in (-1, 1):
                    if 0 <= s % 8 + df < 8:
                        t = s + up + df
                        if t == self.ep or self.b[t] != "." and not self.mine(self.b[t]):
                            ends.append(t)
                for t in ends:
                    for q in (2, 3, 4, 5) if t // 8 in (0, 7) else (-1,):
                        yield s, t, q
                continue
            steps = {"R": ROOK, "B": BISHOP, "N": KNIGHT}.get(kind, ROOK + BISHOP)
            for t in self.rays(s, steps, kind in "RBQ"):
                if not self.mine(self.b[t]):
                    yield s, t, -1
        k = 4 if self.white else 60
        for wing, free, cross, to in (("K", (1, 2), (0, 1, 2), 2), ("Q", (-1, -2, -3), (0, -1, -2), -2)):
            if (wing if self.white else wing.lower()) in self.rights and all(self.b[k + d] == "." for d in free) and not any(self.attacked(k + d, not self.white) for d in cross):
                yield k, k + to, -1

    def play(self, s, t, q):
        out = self.copy()
        p, b = self.b[s], out.b
        out.half = 0 if p in "Pp" or b[t] != "." else self.half + 1
        if p in "Pp" and t == self.ep:
            b[t + (-8 if self.white else 8)] = "."
        b[s], b[t] = ".", p
        if q > 1:
            b[t] = "  NBRQ"[q] if self.white else "  nbrq"[q]
        if p in "Kk" and abs(s - t) == 2:
            rook, to = (t + 1, t - 1) if t > s else (t - 2, t + 1)
            b[to], b[rook] = b[rook], "."
        out.ep = (s + t) // 2 if p in "Pp" and abs(s - t) == 16 else None
        gone = {4: "KQ", 60: "kq", 7: "K", 0: "Q", 63: "k", 56: "q"}
        out.rights -= set(gone.get(s, "")) | set(gone.get(t, ""))
        out.white = not self.white
        return out

    def legal(self):
        return sorted(m for m in self.pseudo() if not self.play(*m).check(self.white))

    def codes(self):
        return [".PNBRQKpnbrqk".index(p) for p in self.b]
