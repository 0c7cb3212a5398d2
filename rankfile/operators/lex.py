"""Reading one game's text: tag pairs, moves, comments, variations and the termination marker."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

OUTCOMES = {"1-0": "White", "0-1": "Black", "1/2-1/2": "Draw", "*": "Unknown"}
_ROLES = " PNBRQK"
#: Lines that begin with % are no part of a game.
_ESCAPED = r"(?:\s*(?<![^\n])%[^\n]*(?:\n|\Z))*"
_TAG = re.compile(_ESCAPED + r'\s*\[\s*([^\s\]"]+)\s*"((?:[^"\\\n]|\\.)*)"\s*\][ \t]*\r?(?:\n|\Z)?')
_SAN = re.compile(r"([NBRQK])?([a-h])?([1-8])?[-:]?(x)?([a-h])([1-8])(?:=?([NBRQnbrq]))?")
_NUMBER = re.compile(r"\d+\.*")
_PART = re.compile(r"(?<![^\n])%[^\n]*|\{([^}]*)(\}?)|;[^\n]*|[()]|\n(?=[ \t\r]*\n|\[)|[^\s(){};]+")

#: Values of a token that is no move.
SKIP, OUTCOME, ILLEGAL = -1, -2, -3
_KNOWN_LIMIT = 200_000


@dataclass
class Game:
    tags: list[tuple[str, str]]
    #: Tokens of the main line, among them the moves (codes of the others are not kept).
    tokens: list[str] = field(default_factory=list)
    codes: list[int] = field(default_factory=list)
    #: (moves written before it, text) of each comment of the main line.
    comments: list[tuple[int, str]] = field(default_factory=list)
    outcome: str | None = None

    @property
    def sans(self) -> list[str]:
        """The moves as written."""
        return [t for t in self.tokens if code_of(t) != SKIP][: len(self.codes)]

    def first(self, key: str) -> str | None:
        """The first tag of that name in any case."""
        return next((v for k, v in self.tags if k.lower() == key), None)


class LexError(ValueError):
    """The text breaks off within a comment."""


def pack(role: int, to: int, file: int = 8, rank: int = 8, promotion: int = 0, capture: bool = False, castle: int = 0) -> int:
    return role | to << 3 | file << 9 | rank << 13 | promotion << 17 | capture << 20 | castle << 21


def _code(token: str) -> int:
    if token in OUTCOMES:
        return OUTCOME
    text = _NUMBER.sub("", token, count=1) if token[0].isdigit() and token[:3] not in ("0-0",) else token
    text = text.lstrip(".").rstrip("!?+#")
    if not text:
        return SKIP
    if text in ("O-O", "0-0"):
        return pack(6, 0, castle=1)
    if text in ("O-O-O", "0-0-0"):
        return pack(6, 0, castle=2)
    if text == "--" or "@" in text:
        return ILLEGAL
    m = _SAN.fullmatch(text)
    if not m:
        return SKIP
    role, f, r, x, tf, tr, p = m.groups()
    promotion = _ROLES.index(p.upper()) if p else 0
    return pack(_ROLES.index(role) if role else 1, "abcdefgh".index(tf) + 8 * (int(tr) - 1), "abcdefgh".index(f) if f else 8, int(r) - 1 if r else 8, promotion, bool(x))


class _Known(dict):
    """Codes of the tokens met so far, up to a limit."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _KNOWN_LIMIT:
            self.clear()
        code = self[token] = _code(token)
        return code


#: A move packed into an int (0 or more), or what else the token is.
code_of = _Known().__getitem__


def read_tags(text: str) -> tuple[list[tuple[str, str]], int]:
    """Tag pairs (values as written) and where the movetext begins."""
    tags: list[tuple[str, str]] = []
    at = 0
    while m := _TAG.match(text, at):
        tags.append((m[1], m[2]))
        at = m.end()
    return tags, at


def read_game(text: str) -> Game | None:
    """The first game in the text; None if there is none."""
    tags, at = read_tags(text) if "[" in text else ([], 0)
    body = text[at:].strip() if at else text.strip()
    if not body and not tags:
        return None
    game = Game(tags)
    if not any(c in body for c in "{(;") and "\n\n" not in body and "\n[" not in body and "\r" not in body and "\n%" not in body and body[:1] != "%":
        game.tokens = body.split()
        codes = list(map(code_of, game.tokens))
        if OUTCOME in codes:
            end = codes.index(OUTCOME)
            game.outcome = OUTCOMES[game.tokens[end]]
            del codes[end:]
        game.codes = [c for c in codes if c != SKIP]
        return game
    depth = 0
    for m in _PART.finditer(body):
        part = m[0]
        head = part[0]
        if head == "{":
            if not m[2]:
                raise LexError("unterminated comment")
            if not depth:
                game.comments.append((len(game.codes), m[1]))
        elif head == "(":
            depth += 1
        elif head == ")":
            depth = max(0, depth - 1)
        elif head == "\n":
            break
        elif head in ";$%" or depth:
            continue
        else:
            code = code_of(part)
            if code == OUTCOME:
                game.outcome = OUTCOMES[part]
                break
            if code != SKIP:
                game.tokens.append(part)
                game.codes.append(code)
    return game


def san_text(token: str) -> str:
    """The move of a token without its number, as written."""
    return _NUMBER.sub("", token, count=1).lstrip(".").rstrip("!?+#") if token[0].isdigit() and token[:3] != "0-0" else token.rstrip("!?+#")
