"""Assembly of the feature matrix, and its exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage


def sort_features(features: DataFrame) -> DataFrame:
    return features.orderBy("user_name")


def local_ids(users: DataFrame) -> DataFrame:
    """(user_name, local_id): places 1, 2, ... in the order of names. Users are
    dealt into ranges of names and written, so that a name's range is settled; each
    range adds what the ranges before it hold."""
    n = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(users.select("user_name").distinct().repartitionByRange(n, "user_name").withColumn("part", F.spark_partition_id()), "users")
    place = F.row_number().over(Window.partitionBy("part").orderBy("user_name"))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # one row for each range
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.withColumn("place", place).join(before, "part").select("user_name", (F.col("place") + F.col("before")).cast("bigint").alias("local_id"))


def complete(users: DataFrame, features: DataFrame) -> DataFrame:
    """(local_id, user_name, features ...) for each user of the dictionary, zeros
    for those without a row. A feature row of another user is an error."""
    names = [c for c in features.columns if c != "user_name"]
    own = features.withColumn("_there", F.lit(True))
    rows = local_ids(users).join(own, "user_name", "full")
    known = F.when(F.col("local_id").isNotNull(), F.col("local_id")).otherwise(F.raise_error(F.concat(F.lit("a user that is not in the dictionary: "), F.col("user_name"))).cast("bigint"))
    return rows.select(known.alias("local_id"), "user_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def combine(users: DataFrame, *tables: DataFrame) -> DataFrame:
    """All tables' features side by side, by user; zero where a user has none."""
    wide = reduce(lambda a, b: a.join(b, "user_name", "left"), tables, users.select("user_name").distinct())
    return wide.na.fill(0)


def normalise(matrix: DataFrame, flagged: list[str], others: list[str]) -> DataFrame:
    """(local_id, user_name, global_id, features ...): NaN becomes 0, and flagged
    columns are divided by their greatest value over all rows (0 stays 0 if that is
    not positive). The maxima are one row, joined to all."""
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(0.0))
    tops = matrix.agg(*[F.max(clean(c)).alias(f"_top_{c}") for c in flagged])
    rows = matrix.crossJoin(F.broadcast(tops)) if flagged else matrix
    scaled = [F.when(F.col(f"_top_{c}") > 0, clean(c) / F.col(f"_top_{c}")).otherwise(F.lit(0.0)).alias(c) for c in flagged]
    return rows.select("local_id", "user_name", "global_id", *scaled, *[clean(c).alias(c) for c in others])


def _listed(matrix: DataFrame, users: DataFrame, order: str) -> DataFrame:
    rows = users.select(F.col(order).alias("_at"), F.col("user_name")).join(matrix, "user_name", "left")
    missing = F.raise_error(F.concat(F.lit("no features of user "), F.col("user_name")))
    return rows.withColumn("user_name", F.when(F.col("local_id").isNotNull(), F.col("user_name")).otherwise(missing.cast("string")))


def export_cluster(matrix: DataFrame, users: DataFrame, order: str, names: list[str], n_rows: int) -> DataFrame:
    """(place, line): a header "rows columns" at place -1, then the features of the
    listed users in the list's order."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in names])
    rows = _listed(matrix, users, order).select(F.col("_at").cast("bigint").alias("place"), line.alias("line"))
    head = rows.sparkSession.createDataFrame([(-1, f"{n_rows} {len(names)}")], "place bigint, line string")
    return head.unionByName(rows)


def export_lda(matrix: DataFrame, users: DataFrame, order: str, names: list[str]) -> DataFrame:
    """(place, line): "1 f1:v ... fn:v # user"."""
    values = [F.concat(F.lit(f"f{i}:"), F.col(c).cast("string")) for i, c in enumerate(names, 1)]
    return _listed(matrix, users, order).select(F.col("_at").cast("bigint").alias("place"), F.concat_ws(" ", F.lit("1"), *values, F.lit("#"), "user_name").alias("line"))


def export_random(users: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(line): "1 x1:r ... xn:r # user" with random numbers from 0 to 1 that depend
    on the user and the seed alone: 40 bits of an md5 each."""

    def draw(i: int) -> Column:
        text = F.concat(F.col("user_name"), F.lit(f"#{i}#{seed}")).cast("binary")
        return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("bigint") / float(1 << 40)

    values = [F.concat(F.lit(f"x{i}:"), draw(i).cast("string")) for i in range(1, n + 1)]
    return users.select(F.concat_ws(" ", F.lit("1"), *values, F.lit("#"), "user_name").alias("line"))


def lookup(users: DataFrame, values: DataFrame, value: str, last: Column | str | None = None) -> DataFrame:
    """Each user's value, null if it has none. Of several values of a user that with
    the greatest ``last`` is taken, by default the greatest."""
    chosen = values.groupBy("user_name").agg(F.max_by(value, last if last is not None else value).alias(value))
    return users.select("user_name").join(chosen, "user_name", "left")
