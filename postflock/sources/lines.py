"""Tab-separated lines: posts, dictionaries, key-value files, adjacency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_posts(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """``lines`` (value) -> (ts, user_name, text). The text is all that follows the
    second tab; lines with fewer tabs are skipped. A first field that is no number
    fails the query, or with ``mode="drop"`` its line is skipped."""
    if mode not in ("failfast", "drop"):
        raise ValueError(f"mode is {mode!r}")
    parts = lines.select(F.split("value", "\t", 3).alias("p")).where(F.size("p") == 3)
    ts = F.col("p")[0].cast("bigint") if mode == "failfast" else F.col("p")[0].try_cast("bigint")
    posts = parts.select(ts.alias("ts"), F.col("p")[1].alias("user_name"), F.col("p")[2].alias("text"))
    return posts if mode == "failfast" else posts.where(F.col("ts").isNotNull())


def read_posts(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    return parse_posts(spark.read.text(path), mode)


def parse_dict(lines: DataFrame, at_space: bool = False, name: str = "user_name") -> DataFrame:
    """Distinct keys: each line up to its first tab (or first space, if asked for);
    blank lines are skipped."""
    key = F.split("value", "[ \t]" if at_space else "\t", 2)[0]
    return lines.where(F.trim("value") != "").select(key.alias(name)).distinct()


def read_dict(spark: SparkSession, path: str, at_space: bool = False, name: str = "user_name") -> DataFrame:
    return parse_dict(spark.read.text(path), at_space, name)


def parse_pairs(lines: DataFrame, value: str, kind: str, key: str = "user_name") -> DataFrame:
    """Lines of a key and one value."""
    parts = lines.select(F.split("value", "\t", 2).alias("p")).where(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias(key), F.trim(F.col("p")[1]).cast(kind).alias(value))


def parse_adjacency(lines: DataFrame) -> DataFrame:
    """``user \\t n \\t u1 ... un`` -> (user_name, n, nbrs)."""
    parts = lines.select(F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    n = F.col("p")[1].cast("int")
    return parts.select(F.col("p")[0].alias("user_name"), n.cast("bigint").alias("n"), F.filter(F.slice("p", F.lit(3), n), lambda x: x != "").alias("nbrs"))


def parse_numbers(lines: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """Lines of ``n`` numbers between blanks -> (features). A column of ``lines``
    that gives their order is carried along; lines alone have none."""
    values = F.transform(F.filter(F.split("value", "[ \t]+"), lambda x: x != ""), lambda x: x.cast("double"))
    keep = [order] if order else []
    return lines.select(*keep, values.alias("features")).select(*keep, F.when(F.size("features") == n, F.col("features")).otherwise(F.raise_error(F.lit(f"a line does not hold {n} numbers"))).alias("features"))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): the lines of one small file with their places, from 0. Spark's
    own reader of lines keeps no order."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("place", "value"))
    return rows.select(F.col("place").cast("bigint").alias("place"), "value")


def parse_link_stats(lines: DataFrame) -> DataFrame:
    """``user \\t 7 numbers`` -> (user_name, uniq_out, uniq_in): the fields at 2 and
    4. Lines of fewer than five fields are skipped."""
    parts = lines.select(F.split("value", "\t").alias("p")).where(F.size("p") >= 5)
    return parts.select(F.col("p")[0].alias("user_name"), F.col("p")[2].cast("bigint").alias("uniq_out"), F.col("p")[4].cast("bigint").alias("uniq_in"))


def parse_features(lines: DataFrame, names: list[str]) -> DataFrame:
    """``user \\t f1 \\t ...`` -> (user_name, named doubles). An empty field at a line's
    end is dropped; blank lines are skipped; a line without a tab, or of another
    number of features, is an error."""
    parts = lines.where("value <> ''").select(F.split(F.regexp_replace("value", "\t\\z", ""), "\t").alias("p"), "value")
    right = F.size("p") == len(names) + 1
    user = F.when(right, F.col("p")[0]).otherwise(F.raise_error(F.concat(F.lit(f"not {len(names)} features: "), F.col("value"))).cast("string"))
    return parts.select(user.alias("user_name"), *[F.get("p", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names, 1)])


def parse_flags(ordered: DataFrame, names: list[str]) -> DataFrame:
    """(place, value) -> (place, name, flag): whether the line of each feature starts
    with 1. Lines beyond the features are ignored; features without a line are not
    flagged."""
    known = ordered.sparkSession.createDataFrame(list(enumerate(names)), "place bigint, name string")
    flag = F.coalesce(F.startswith("value", F.lit("1")), F.lit(False))
    return known.join(ordered, "place", "left").select("place", "name", flag.alias("flag"))


def parse_matrix(lines: DataFrame, names: list[str]) -> DataFrame:
    """``id user global_id f1 ... fn`` between blanks -> (local_id, user_name,
    global_id, named doubles). Of n features, too many or too few are an error."""
    parts = lines.where("value <> ''").select(F.split("value", " ").alias("p"), "value")
    right = F.size("p") == len(names) + 3
    place = F.when(right, F.col("p")[0].cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"not {len(names)} features: "), F.col("value"))).cast("bigint"))
    return parts.select(place.alias("local_id"), F.col("p")[1].alias("user_name"), F.get("p", F.lit(2)).cast("bigint").alias("global_id"), *[F.get("p", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names, 3)])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def to_lines(df: DataFrame) -> DataFrame:
    """All columns of a row, arrays spread out, joined by tabs: (value)."""
    parts = [F.array_join(F.transform(c, lambda x: x.cast("string")), "\t") if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    return df.select(F.concat_ws("\t", *parts).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    to_lines(df).write.text(path)
