"""Column expressions that are evaluated once and used many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which `value` is a lambda's variable: made once a row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]
