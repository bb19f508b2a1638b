"""Cut a plan by writing it to the shared folder named in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_SCRATCH: dict[str, str] = {}
_SCOPES: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets a scratch folder."""
    folder = spark.conf.get(_FOLDER, None) or spark.sparkContext.getConf().get(_FOLDER)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_FOLDER} to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _SCRATCH:
        _SCRATCH[application] = tempfile.mkdtemp(prefix="fairline-")
    return _SCRATCH[application]


def materialise(df: DataFrame, by: str | None = None, kept: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet (a folder for each value of ``by``) and read it back; ``kept`` leaves it to the scope around.

    Used where two branches must see the very same rows (range-partition
    numbers depend on sampling) and where iteration would grow the lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if scopes := _SCOPES[:-1] if kept else _SCOPES:
        scopes[-1].append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cuts_removed(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are removed on leaving; results must be written or read before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside are removed when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
