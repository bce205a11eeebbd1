"""Shaping of a corpus of posts (ts, user_name, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions_user


def sort_posts(posts: DataFrame, total: bool = False) -> DataFrame:
    """Posts of a user together in order of ts; with ``total``, users in order too."""
    if total:
        return posts.orderBy("user_name", "ts")
    return posts.repartition("user_name").sortWithinPartitions("user_name", "ts")


def count_users(posts: DataFrame, least: int) -> DataFrame:
    counts = posts.groupBy("user_name").agg(F.count(F.lit(1)).alias("n_posts"))
    return counts.where(F.col("n_posts") >= least)


def active_users_posts(posts: DataFrame, least: int) -> DataFrame:
    """All posts of the users with so many. The users are counted on their own, so
    that no user's posts meet in one task."""
    return posts.join(count_users(posts, least).select("user_name"), "user_name", "left_semi")


def posts_of(posts: DataFrame, users: DataFrame) -> DataFrame:
    return posts.join(users.select("user_name").distinct(), "user_name", "left_semi")


def sample_users(posts: DataFrame, total: int, select: int, seed: int = 0) -> DataFrame:
    """All posts of a share of ``select`` / ``total`` of the users, drawn by a hash
    of name and seed: the same users each time."""
    # 40 bits of md5
    place = F.conv(F.substring(F.md5(F.concat(F.col("user_name"), F.lit(f"#{seed}")).cast("binary")), 1, 10), 16, 10).cast("bigint")
    return posts.where(place < int(select / total * (1 << 40)))


def merge_posts(posts: DataFrame) -> DataFrame:
    """(user_name, text): a user's texts in order of ts, a space after each. A user
    and all that the user wrote is one row; equal ts go by text."""
    texts = posts.groupBy("user_name").agg(F.array_sort(F.collect_list(F.struct("ts", "text"))).alias("x"))
    return texts.select("user_name", F.concat(F.array_join(F.transform("x", lambda s: s["text"]), " "), F.lit(" ")).alias("text"))


def merge_posts_of(posts: DataFrame, users: DataFrame) -> DataFrame:
    return merge_posts(posts_of(posts, users))


def posts_about(posts: DataFrame, user: str) -> DataFrame:
    """Posts by a user or with a mention of it, in order. The name is trimmed and
    lowered; authors are compared as they are."""
    name = F.lit(user.strip().lower())
    return posts.where((F.col("user_name") == name) | mentions_user(F.col("text"), name)).orderBy("user_name", "ts")


def numbered(posts: DataFrame) -> DataFrame:
    """Posts with their place among those of their user."""
    return posts.withColumn("place", F.row_number().over(Window.partitionBy("user_name").orderBy("ts", "text")))
