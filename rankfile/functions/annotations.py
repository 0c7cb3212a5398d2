"""The annotation grammar as Catalyst expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: The same patterns as in operators.annotate, in Java syntax; the tag's, by its name.
PREFIX = r"^(?:\[%[^\]]++\]|[^\[]++|\[(?!%))*+"
ITEMS = r"\[%[^\]]+\]|(?:[^\[]++|\[(?!%))++"
MATE = r"^\[%eval[ \t\n\f\r]+#(-?[0-9]+)\]$"
EVAL = r"^\[%eval[ \t\n\f\r]+([+-]?[0-9]+(?:\.[0-9]+)?)\]$"
CLOCK = r"^\[%clk[ \t\n\f\r]+([0-9]+):([0-9]+):([0-9]+(?:\.[0-9]+)?)\]$"


def _item(x: Column) -> Column:
    """Lambdas are interpreted, node by node and without common subexpressions: an item is matched only by the patterns
    of its tag, each once, and text by none. A pattern that does not match gives an empty text, which casts to null."""
    part = lambda pattern, k=1: F.regexp_extract(x, pattern, k)

    def read(kind: str, **found: Column) -> Column:
        types = (("text", "string"), ("eval", "double"), ("mate", "int"), ("hours", "bigint"), ("minutes", "int"), ("seconds", "double"))
        return F.struct(F.lit(kind).alias("kind"), *[found.get(name, F.lit(None).cast(type_)).alias(name) for name, type_ in types])

    text = read("text", text=x)
    mate = let(part(MATE).try_cast("int"), lambda n: F.when(n.isNotNull(), read("mate", mate=n)).otherwise(text))
    value = let(part(EVAL).try_cast("double"), lambda v: F.when(v.isNotNull(), read("eval", eval=v)).otherwise(text))
    time = F.struct(part(CLOCK, 1).try_cast("bigint").alias("h"), part(CLOCK, 2).try_cast("int").alias("m"), part(CLOCK, 3).try_cast("double").alias("s"))
    clock = let(time, lambda t: F.when((t["h"] < (1 << 32)) & (t["m"] < 256), read("clk", hours=t["h"], minutes=t["m"], seconds=t["s"])).otherwise(text))
    return F.when(~x.startswith("[%"), text).when(x.startswith("[%eval"), F.when(x.contains("#"), mate).otherwise(value)).when(x.startswith("[%clk"), clock).otherwise(text)


def annotation_items(comment: Column) -> Column:
    """The comment's items in order: array of (kind, text, eval, mate, hours, minutes, seconds); null stays null."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(comment, PREFIX, 0), F.lit(ITEMS), F.lit(0)), _item)


def _last(items: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(items, lambda i: i["kind"] == kind), F.lit(-1))


def clock_seconds(hours: Column, minutes: Column, seconds: Column) -> Column:
    """h * 3600 + m * 60 + s, each step in 32-bit floats."""
    f = lambda c: c.cast("float")
    return f(hours) * f(F.lit(3600)) + f(minutes) * f(F.lit(60)) + f(seconds)


def items_eval(items: Column) -> Column:
    """The last evaluation in pawns as a float; null without one (mates are text)."""
    return _last(items, "eval")["eval"].cast("float")


def items_clock(items: Column) -> Column:
    """The last clock in seconds as a float; null without one."""
    return let(_last(items, "clk"), lambda i: clock_seconds(i["hours"], i["minutes"], i["seconds"]))


def items_text(items: Column) -> Column:
    """What is left of a comment as text: values go, mates are written [Mate n], pieces are joined by one blank."""

    def put(acc: Column, i: Column) -> Column:
        mate = F.concat(acc, F.when((acc != "") & ~acc.endswith(" "), " ").otherwise(""), F.lit("[Mate "), i["mate"].cast("string"), F.lit("]"))
        text = F.concat(acc, F.when(acc != "", " ").otherwise(""), i["text"])
        return F.when(i["kind"] == "mate", mate).when((i["kind"] == "text") & i["text"].rlike(r"(?U)\S"), text).otherwise(acc)

    return F.aggregate(items, F.lit(""), put)


def annotation(comment: Column) -> Column:
    """(eval, clock, text, items) of a comment, read once; null stays null."""
    return let(annotation_items(comment), lambda i: F.when(i.isNotNull(), F.struct(items_eval(i).alias("eval"), items_clock(i).alias("clock"), items_text(i).alias("text"), i.alias("items"))))


def comment_eval(comment: Column) -> Column:
    """items_eval() of a comment; where more of it is asked for, annotation() reads it once."""
    return let(annotation_items(comment), items_eval)


def comment_clock(comment: Column) -> Column:
    """items_clock() of a comment."""
    return let(annotation_items(comment), items_clock)


def comment_text(comment: Column) -> Column:
    """items_text() of a comment."""
    return let(annotation_items(comment), items_text)
