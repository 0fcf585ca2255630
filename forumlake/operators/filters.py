"""Filters of search: equality or membership by the kind of value, and ranges with open ends, all of which must hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(equal: dict[str, object] | None = None, ranges: dict[str, tuple[object, object]] | None = None) -> Column:
    """A condition: columns equal to a value, or one of a list; columns between two bounds, None for none.

    A value of None asks nothing. Rows with a null where something is asked don't match."""
    asked = []
    for name, value in (equal or {}).items():
        if isinstance(value, (list, tuple, set)):
            asked.append(F.col(name).isin(*value))
        elif value is not None:
            asked.append(F.col(name) == F.lit(value))
    for name, (least, most) in (ranges or {}).items():
        asked += [F.col(name) >= F.lit(least)] * (least is not None) + [F.col(name) <= F.lit(most)] * (most is not None)
    return reduce(lambda a, b: a & b, asked, F.lit(True))
