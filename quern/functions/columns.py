"""Building blocks for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it.

    The optimizer may put a column's expression into a lambda, where it would be computed
    again for every element; a lambda's own variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
