"""Independent plans written side by side: planning, code generation and small jobs of one overlap with those of others."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from fairline.functions.durable import materialise


def written_side_by_side(plans: dict[str, Callable[[], DataFrame]], threads: int = 8, by: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Build and write each plan in a thread of its own, in folders of a column of ``by``; the caller's job group and pool hold."""
    def write(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return materialise(build(), (by or {}).get(name))

    inherits = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=threads) as pool:
        running = {name: pool.submit(inherits(write), name, build) for name, build in plans.items()}
        return {name: job.result() for name, job in running.items()}


#: Rows that one task gets, so that its hash tables and sorts are as large for any input.
ROWS_OF_A_TASK = 250_000


def parts_of(df: DataFrame) -> int:
    """Tasks for ``df``, a stored table, by its number of rows."""
    return -(-df.count() // ROWS_OF_A_TASK) or 1


def dealt_out(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` over ``parts`` tasks; adaptive execution doesn't join them to larger ones. None: as it is."""
    return df if parts is None else df.repartition(parts, *keys)
