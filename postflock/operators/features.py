"""Statistics of each user's posts, all from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import murmur64_of

#: Name of a statistic -> (its function of a text, whether it has a variance).
COUNTS = {
    "word": (T.count_words, True),
    "char": (T.count_chars, True),
    "hashtag": (T.count_hashtags, False),
    "url": (T.count_urls, False),
    "mention_sent": (T.count_mentions, False),
}
FLAGS = {"retweet_sent": T.is_retweet, "original": T.is_original}


def variance(n: Column, total: Column, squares: Column) -> Column:
    """Population variance from whole sums, exact up to the last division."""
    return (n * squares - total * total).cast("double") / (n * n).cast("double")


def _measures(names: list[str]) -> tuple[list[Column], list[Column]]:
    sums, out, n = [], [], F.col("n")
    for name in names:
        total = F.col(f"{name}_sum")
        if name in COUNTS:
            squared = COUNTS[name][1]
            sums += [F.sum(name).alias(f"{name}_sum")] + [F.sum(F.col(name) * F.col(name)).alias(f"{name}_squares")] * squared
            out += [total, (total / n).alias(f"{name}_avg")] + [variance(n, total, F.col(f"{name}_squares")).alias(f"{name}_var")] * squared
        else:
            sums.append(F.count_if(name).alias(f"{name}_sum"))
            out += [total.alias(f"{name}_count"), (total / n).alias(f"{name}_ratio")]
    return sums, out


def text_features(posts: DataFrame, *names: str) -> DataFrame:
    """user_name and, for each named statistic (all by default): sum and avg, for
    words and characters the population variance; count and ratio of retweets and
    of original posts. One scan and one aggregate for all of them."""
    chosen = list(names or [*COUNTS, *FLAGS])
    cut = posts.select("user_name", "text", T.tokens(F.col("text")).alias("t"))
    values = [(COUNTS[x][0] if x in COUNTS else FLAGS[x])(F.col("text"), F.col("t")).alias(x) for x in chosen]
    sums, out = _measures(chosen)
    return cut.select("user_name", *values).groupBy("user_name").agg(F.count(F.lit(1)).alias("n"), *sums).select("user_name", *out)


def retweet_counts(posts: DataFrame, users: DataFrame) -> DataFrame:
    """(user_name, letters, hash, n, sample): how often each original was retweeted
    by users in ``users``, by its author, in ``users`` too, and its first letters.
    The sample is the greatest text among them."""
    known = users.select("user_name").distinct()
    parts = posts.join(known, "user_name", "left_semi").select(F.explode(F.array_compact(F.array(T.retweeted_part(F.col("text"))))).alias("x")).select("x.*")
    groups = parts.groupBy("user", "letters").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("sample"))
    mine = groups.join(known, groups["user"] == known["user_name"], "left_semi")
    return mine.select(F.col("user").alias("user_name"), "letters", murmur64_of("letters").alias("hash"), "n", "sample")
