"""Evaluating a column once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, where ``value`` is worked out once per row.

    A column named several times in a filter or in branches is worked out each time; for whole
    texts and parsed JSON that is most of the cost.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
