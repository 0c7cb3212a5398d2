"""Tag pairs and the termination marker as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_TAG = r'(?m)^\s*\[\s*([^\s\]"]+)\s*"((?:[^"\\\n]|\\.)*)"\s*\]'
#: The tag section at the head of a game.
_HEAD = r'^(?:\s*\[\s*[^\s\]"]+\s*"(?:[^"\\\n]|\\.)*"\s*\][ \t]*\r?(?:\n|$))*+'


def tag_list(movetext: Column) -> Column:
    """All tag pairs in order, as written: array of (key, value)."""

    def pairs(head: Column) -> Column:
        keys, values = (F.regexp_extract_all(head, F.lit(_TAG), F.lit(k)) for k in (1, 2))
        return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))

    return let(F.regexp_extract(movetext, _HEAD, 0), pairs)


def tags_map(tags: Column) -> Column:
    """Tags as a map, in the order of last mention; of a repeated key (case counts) the last value holds."""

    def last(back: Column) -> Column:  # the tags from the last to the first
        keys = F.transform(back, lambda t: t["key"])
        return let(keys, lambda all_keys: let(F.reverse(F.array_distinct(all_keys)), lambda names: F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(back, F.array_position(all_keys, k).cast("int"))["value"]))))

    return let(F.reverse(tags), last)


def header_map(movetext: Column) -> Column:
    """tags_map() of a text's tags. Needs no session setting."""
    return tags_map(tag_list(movetext))


def tag_value(tags: Column, key: str) -> Column:
    """The first value of a tag, its name in any case; null without one."""
    return F.try_element_at(F.filter(tags, lambda t: F.lower(t["key"]) == key.lower()), F.lit(1))["value"]


def header(movetext: Column, key: str) -> Column:
    """tag_value() of a text's tags; where more of them are asked for, tag_list() reads them once."""
    return tag_value(tag_list(movetext), key)


def termination(movetext: Column) -> Column:
    """White, Black, Draw or Unknown by the marker that ends a plain movetext; the Result tag is not asked."""
    body = F.regexp_replace(F.regexp_replace(movetext, _HEAD, ""), r"\{[^}]*\}", " ")
    mark = F.regexp_extract(body, r"(?:^|\s)(1-0|0-1|1/2-1/2|\*)(?:\s|$)", 1)
    return let(mark, lambda m: F.when(m == "1-0", "White").when(m == "0-1", "Black").when(m == "1/2-1/2", "Draw").when(m == "*", "Unknown"))
