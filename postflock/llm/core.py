"""Plumbing that the operators share: column choice, shared storage, folds."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import delete, new_folder, settled, stage

__all__ = ["broadcast_if_small", "delete", "key_crc", "most_frequent", "new_folder", "once_per_worker", "partitions", "pick", "settled", "stage", "table", "without"]


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``df`` cut down to ``new name = column of df``, by exact name.

    Other columns may have any names, also ones that differ only in case or
    occur twice: columns are addressed by position. Of two columns with exactly
    the wanted name the first is taken; a missing one raises ``KeyError``.
    """
    columns = df.columns
    for old in names.values():
        if old not in columns:
            raise KeyError(f"no column {old!r} among {columns}")
    plain = df.toDF(*[f"c{i}_" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{columns.index(old)}_").alias(new) for new, old in names.items()])


def without(docs: DataFrame, gone: DataFrame, key: str, text: str, small: int) -> DataFrame:
    """``docs``, all columns, without the rows of ``gone``, which has the key and
    rid = xxhash64(key, text) of each; rows of one key with other texts stay. Null
    keys are keys like any other, repeated rows go together, and other columns may
    have any names."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = [rows[names[docs.columns.index(x)]] for x in (key, text)]
    gone, _ = broadcast_if_small(stage(gone.select(F.col("key").alias("gone_key"), F.col("rid").alias("gone_rid")).distinct(), "gone"), small)
    kept = rows.join(gone, (F.xxhash64(at[0].cast("bigint"), at[1]) == gone["gone_rid"]) & at[0].eqNullSafe(gone["gone_key"]), "left_anti")
    return kept.toDF(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict = {}


def once_per_worker(name, make):
    """What a worker process keeps from task to task for the operator at work,
    made when first asked for. Only one thing is kept: a worker that goes on to
    another operator drops what the one before it needed."""
    if name not in _own:
        _own.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)
        _own[name] = make()
    return _own[name]


def key_crc(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as remainder -1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1).cast("bigint"))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of the highest counts, ``most`` at most: all from some count on.
    That count is found from a histogram of the counts' twelve leading bits, so
    that no task or driver sorts, or is sent, more than what is returned."""
    beyond = f"greatest(0, length(bin({column})) - 12)"
    step = F.expr(f"shiftleft(shiftright({column}, {beyond}), {beyond})")
    least, total = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row.step
    return counts.where(F.lit(False)) if least is None else counts.where(F.col(column) >= least)


#: Bytes, as written, of a table that is sent to every task at most.
SMALL_BYTES = 24 << 20


def broadcast_if_small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """A broadcast hint for a staged table of at most ``rows`` rows and SMALL_BYTES
    bytes, else none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size <= SMALL_BYTES and df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small
