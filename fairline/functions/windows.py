"""Window frames shared by the rolling, form, streak and schedule operators.

Every frame is partitioned by an entity and runs over rows that were first
aggregated to one row per (entity, day[, group]); a partition therefore holds
at most as many rows as the calendar has days, however hot the entity is.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

START = Window.unboundedPreceding


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def rows_before(keys: list[str], order: list[str], n: int, lag: int = 1) -> WindowSpec:
    """The ``n`` rows that end ``lag`` rows before the current one."""
    return ordered(keys, order).rowsBetween(-n - lag + 1, -lag)


def all_before(keys: list[str], order: list[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(START, -1)


def days_before(keys: list[str], day_number: str, n: int, until: int = 1) -> WindowSpec:
    """Rows of days ``[d-n, d-until]``; ``day_number`` is an integer column."""
    return ordered(keys, [day_number]).rangeBetween(-n, -until)


def days_through(keys: list[str], day_number: str, n: int) -> WindowSpec:
    """Rows of the ``n`` days ending with the current one, ``(d-n, d]``."""
    return ordered(keys, [day_number]).rangeBetween(-(n - 1), 0)
