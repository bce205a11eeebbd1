"""Cleaning of posts, and the dictionary of terms.

Tokens are cut once. Words are counted or made distinct before they are stemmed, so
that the stemmer, whose cost is by far the greatest, sees each word of the corpus once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import is_mention, is_url, tokens

LEAST_TOKENS = 3
LEAST_LETTERS = 3


def hashtag(token: Column) -> Column:
    """A hashtag in lower case; one last character that is no letter or digit is
    dropped, and what is nothing then is null."""
    low = F.lower(token)
    plain = F.rlike(F.right(low, F.lit(1)), F.lit("[a-zA-Z0-9]"))
    cut = F.when(F.length(low) > 2, F.substr(low, F.lit(1), F.length(low) - 1))
    return F.when(F.length(low) > 1, F.when(plain, low).otherwise(cut))


def _stems(word: Column) -> Column:
    """The stem of a word in an array, which is empty if it is too short. Exploded,
    it is computed once: what is asked of it later is not pushed below."""
    return F.filter(F.array(stem(word)), lambda s: F.length(s) >= LEAST_LETTERS)


def raw_terms(posts: DataFrame) -> DataFrame:
    """(ts, user_name, h1, h2, pos, tag, word) of the tokens of all posts of enough
    tokens: the cleaned hashtag, or the letters of a word before stemming. h1 and h2
    are 128 bits that stand for the whole post."""
    whole = [F.xxhash64("ts", "user_name", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "user_name", "ts").alias("h2")]
    found = posts.select("ts", "user_name", *whole, tokens(F.col("text")).alias("t")).where(F.size("t") >= LEAST_TOKENS)
    each = found.select("ts", "user_name", "h1", "h2", F.posexplode("t").alias("pos", "token")).where(~is_mention(F.col("token")))
    tagged = F.startswith("token", F.lit("#"))
    low = F.lower("token")
    word = F.when(~tagged & ~is_url(low), F.regexp_replace(low, "[^a-z]", ""))
    return each.select("ts", "user_name", "h1", "h2", "pos", F.when(tagged, hashtag(F.col("token"))).alias("tag"), word.alias("word")).where("tag IS NOT NULL OR length(word) > 0")


def clean_posts(posts: DataFrame, terms: DataFrame | None = None, term: str = "term") -> DataFrame:
    """(ts, user_name, text) with each text's cleaned terms joined by spaces: no
    mentions and addresses, words as stemmed letters, hashtags whole. Posts of
    fewer than three tokens, or of which nothing is left, are dropped. With
    ``terms``, only words among them stay; hashtags always do. Repeated posts
    each give their row.

    A post is known by its content, not by a number: rows of equal posts meet in
    one group, and the group's row is repeated as often as they stood there.
    """
    raw = raw_terms(posts)
    stems = raw.where("word IS NOT NULL").select(F.col("word").alias("w")).distinct().select("w", F.explode(_stems(F.col("w"))).alias("s"))
    if terms is not None:
        stems = stems.join(terms.select(F.col(term).alias("known")).distinct(), F.col("s") == F.col("known"), "left_semi")
    # a hashtag is its own key, which no word equals
    kept = raw.join(stems, F.coalesce("word", "tag") == F.col("w"), "left").select("ts", "user_name", "h1", "h2", "pos", F.coalesce("tag", "s").alias("term")).where("term IS NOT NULL")
    lists = kept.groupBy("ts", "user_name", "h1", "h2").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("all"))
    # each place stands there once for each of the equal posts
    copies = lists.withColumn("n", F.size(F.filter("all", lambda x: x["pos"] == F.col("all")[0]["pos"])))
    once = F.filter("all", lambda x, i: i % F.col("n") == 0)
    rows = copies.select("ts", "user_name", F.array_join(F.transform(once, lambda x: x["term"]), " ").alias("text"), F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    return rows.select("ts", "user_name", "text")


def term_counts(posts: DataFrame, stopwords: DataFrame | None = None, term: str = "term") -> DataFrame:
    """(term, cf) of all terms but the words among ``stopwords``, which are stemmed.
    One scan; each distinct word is stemmed once, after it has been counted."""
    raw = raw_terms(posts)
    counted = raw.groupBy("tag", "word").agg(F.count(F.lit(1)).alias("n"))
    stemmed = counted.select(F.explode(F.when(F.col("tag").isNotNull(), F.array("tag")).otherwise(_stems(F.col("word")))).alias("term"), "n")
    found = stemmed.groupBy("term").agg(F.sum("n").alias("cf"))
    if stopwords is not None:
        stop = stopwords.select(F.col(term).alias("stop")).where("stop NOT LIKE '#%'").distinct()
        found = found.join(stop, F.col("term") == F.col("stop"), "left_anti")
    return found


def sort_terms(counts: DataFrame) -> DataFrame:
    """By falling count, then by term."""
    return counts.orderBy(F.desc("cf"), "term")


def term_dictionary(posts: DataFrame, stopwords: DataFrame, least: int) -> DataFrame:
    """Terms that occur ``least`` times, and all hashtags, by falling count."""
    return sort_terms(term_counts(posts, stopwords).where((F.col("cf") >= least) | F.startswith("term", F.lit("#"))))
