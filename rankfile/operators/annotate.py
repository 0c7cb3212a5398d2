"""Annotations in comments: [%eval ...] and [%clk ...] are values, all else is text."""

from __future__ import annotations

import re
from typing import NamedTuple

#: What is read of a comment: whole bracketed tags and text; it ends at the first place that is neither.
PREFIX = re.compile(r"(?:\[%[^\]]++\]|[^\[]++|\[(?!%))*+")
ITEMS = re.compile(r"\[%[^\]]+\]|(?:[^\[]++|\[(?!%))++")
TAG = re.compile(r"\[%(?:eval[ \t\n\f\r]+(?:#(-?[0-9]+)|([+-]?[0-9]+(?:\.[0-9]+)?))|clk[ \t\n\f\r]+([0-9]+):([0-9]+):([0-9]+(?:\.[0-9]+)?))\]")


class Item(NamedTuple):
    kind: str  # text, eval, mate or clk
    text: str | None = None
    eval: float | None = None
    mate: int | None = None
    hours: int | None = None
    minutes: int | None = None
    seconds: float | None = None


def parse_comment(comment: str) -> list[Item]:
    out = []
    for item in ITEMS.findall(PREFIX.match(comment)[0]):
        m = TAG.fullmatch(item) if item.startswith("[%") else None
        if m and m[1] and -(1 << 31) <= int(m[1]) < 1 << 31:
            out.append(Item("mate", mate=int(m[1])))
        elif m and m[2]:
            out.append(Item("eval", eval=float(m[2])))
        elif m and m[3] and int(m[3]) < 1 << 32 and int(m[4]) < 256:
            out.append(Item("clk", hours=int(m[3]), minutes=int(m[4]), seconds=float(m[5])))
        else:
            out.append(Item("text", text=item))
    return out


class Annotation(NamedTuple):
    text: str
    eval: float | None
    clock: tuple[int, int, float] | None


def fold(comment: str) -> Annotation:
    """A comment's text with mates written out, its last evaluation and its last clock."""
    if "[" not in comment:
        return Annotation(comment if comment.strip() else "", None, None)
    text, value, clock = "", None, None
    for item in parse_comment(comment):
        if item.kind == "eval":
            value = item.eval
        elif item.kind == "clk":
            clock = (item.hours, item.minutes, item.seconds)
        elif item.kind == "mate":
            text += (" " if text and not text.endswith(" ") else "") + f"[Mate {item.mate}]"
        elif item.text.strip():
            text += (" " if text else "") + item.text
    return Annotation(text, value, clock)
