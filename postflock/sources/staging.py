"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder of this machine is used if all
    of Spark runs in this process, as in local tests; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="postflock-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if "://" in found else "file://" + os.path.abspath(found)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted by ``release`` or at exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(name: str) -> Callable:
    """Decorates an operator that returns one table: the result is written as
    ``name``, and what the operator staged on its way is deleted at once."""

    def of(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(*args, **kwargs) -> DataFrame:
            before = len(_made)
            try:
                out = stage(operator(*args, **kwargs), name)
            except BaseException:
                _drop(before, None)
                raise
            _drop(before, out.staged_path)
            return out

        return run

    return of


def _drop(before: int, keep: str | None) -> None:
    """Deletes the folders made since there were ``before``, all but one."""
    made, _made[before:] = _made[before:], [x for x in _made[before:] if x[1] == keep]
    for spark, path in made:
        if path != keep:
            delete(spark, path)


def release() -> None:
    """Deletes all that ``stage`` and ``new_folder`` made; results read from it end."""
    while _made:
        spark, path = _made.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended: its folder stays
            if path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)


atexit.register(release)


#: While a table is written, so many rows of long texts are held at a time.
LONG_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "1024"}
#: Executors delete what they shuffled once a table is written, not when the driver
#: next happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def stage(df: DataFrame, name: str, long_rows: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut there,
    and the loss of an executor loses nothing of it. ``staged_path`` names it. What
    was shuffled for it is deleted.
    Rows pass to Python in small batches unless ``long_rows`` is off."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    meanwhile = TIDY | LONG_ROWS if long_rows else TIDY
    before = {k: spark.conf.get(k) for k in meanwhile}
    try:
        for k, v in meanwhile.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out
