"""Benchmark decontamination by winnowing, in SQL operations alone.

Of each text the hashes of all runs of ``GRAM`` words are taken and, of every
``SPAN`` neighbouring hashes, the least is kept as a fingerprint. A span of
``WINDOW`` words that a document shares with a benchmark item holds SPAN
neighbouring runs, so that both keep the same least hash: no such span is
missed. Documents meet items on fingerprints; a hit is extended to the windows
of words around it, and these are compared word for word with the items'.
Items of fewer words have one window, and all runs of their length are their
fingerprints. Fingerprints are taken from words in full lower case, which can
only add hits for the comparison to reject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import broadcast_if_small, pick, settled, stage, without

WINDOW = 13
GRAM = 6
SPAN = WINDOW - GRAM + 1
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Larger sides of a join are not broadcast.
SMALL_BENCH = 500_000
SMALL_DOCS = 30_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR), lambda x: x != "")


def words(text: Column) -> Column:
    """The words that are compared: A to Z in lower case, others as they are."""
    return split_words(F.translate(text, UPPER, LOWER))


def folded(text: Column) -> Column:
    """Lower case by Unicode, without the one form that depends on what follows."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


#: A run of words: its place, the length of the window it is looked up for, its hash.
RUN = "array<struct<at:int,length:int,fp:bigint>>"


def upto(last: Column, body, kind: str = "array<bigint>") -> Column:
    """``body`` of 0, 1, ..., ``last``; an empty array if that is negative."""
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), body)).otherwise(F.array().cast(kind))


def gram(hashes: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(hashes, at + j) for j in range(length)])


def grams(hashes: Column, length: int) -> Column:
    return upto(F.size(hashes) - length, lambda i: gram(hashes, i, length))


def fingerprints(hashes: Column, whole: bool, short: list[int]) -> Column:
    """Distinct fingerprints of a text, given its words' hashes."""

    def winnowed(g: Column) -> Column:
        return upto(F.size(g) - SPAN, lambda i: F.least(*[F.get(g, i + j) for j in range(SPAN)]))

    kinds = [let(grams(hashes, GRAM), winnowed)] if whole else []
    kinds += [grams(hashes, n) for n in short]
    return F.array_distinct(F.concat(*kinds)) if kinds else F.array().cast("array<bigint>")


def word_hashes(text: Column) -> Column:
    return F.transform(split_words(folded(text)), lambda x: F.xxhash64(x))


@settled("judged")
def _judge(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """key, rid (of key and text), and the columns of ``contamination``."""
    rows = pick(docs, key=key, text=text).withColumn("key", F.col("key").cast("bigint")).withColumn("rid", F.xxhash64("key", "text"))
    counted = rows.select("key", "rid", F.coalesce(F.size(split_words(folded(F.col("text")))), F.lit(0)).cast("bigint").alias("n_words"))

    items = pick(benchmark, item=item, text=item_text).where(F.col("text").isNotNull()).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = stage(items.withColumn("length", F.least(F.size("w"), F.lit(WINDOW))), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # 13 at most
    short, whole = [n for n in lengths if n < WINDOW], WINDOW in lengths
    own = F.transform("w", lambda x: F.xxhash64(folded(x)))

    def prints_of(n: int) -> Column:
        return let(own, lambda h: fingerprints(h, n == WINDOW, [] if n == WINDOW else [n]))

    tests = [items.where(F.col("length") == n).select(F.explode(prints_of(n)).alias("fp")) for n in lengths]
    if not tests:
        return _finish(counted, None, None)
    prints, _ = broadcast_if_small(stage(reduce(DataFrame.unionByName, tests).distinct(), "prints"), SMALL_BENCH)
    windows = items.select("item", "length", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("length")), lambda s: F.array_join(F.slice("w", s + 1, F.col("length")), " "))).alias("window")).distinct()
    windows = stage(windows, "windows")

    # documents that share a fingerprint, and which
    found = rows.select("rid", F.explode(let(word_hashes(F.col("text")), lambda h: fingerprints(h, whole, short))).alias("fp"))
    found = stage(found.join(prints, "fp", "left_semi").distinct(), "candidates")
    shared, _ = broadcast_if_small(found.select("rid").distinct(), SMALL_DOCS)
    near = stage(rows.join(shared, "rid", "left_semi").select("rid", "key", words(F.col("text")).alias("w")).dropDuplicates(["rid", "key"]), "near")

    # where in them: all runs of words meet the document's fingerprints in a join
    kinds = ([(GRAM, WINDOW)] if whole else []) + [(n, n) for n in short]
    run = lambda h, n, length: upto(F.size(h) - n, lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), gram(h, i, n).alias("fp")), RUN)
    runs = near.select("rid", "key", F.explode(let(own, lambda h: F.concat(*[run(h, *x) for x in kinds]))).alias("x")).select("rid", "key", "x.*")
    pairs, _ = broadcast_if_small(found, SMALL_BENCH)
    hits = runs.join(pairs, ["rid", "fp"], "left_semi").groupBy("rid", "key", "length").agg(F.collect_set("at").alias("at"))
    hits = stage(hits, "at")

    # each hit extended to the windows around it, and these to words
    last = F.size("w") - F.col("length")
    back = F.when(F.col("length") == WINDOW, F.lit(WINDOW - GRAM)).otherwise(F.lit(0)) if whole else F.lit(0)
    around = F.array_distinct(F.flatten(F.transform("at", lambda i: F.when(last >= 0, F.sequence(F.greatest(F.lit(0), i - back), F.greatest(F.lit(0), F.least(i, last)))).otherwise(F.array().cast("array<int>")))))
    known_at = hits.withColumnRenamed("rid", "r").withColumnRenamed("key", "k")
    both = near.join(known_at, (near["rid"] == known_at["r"]) & near["key"].eqNullSafe(known_at["k"]))
    seen = both.select("rid", "key", "length", "w", F.explode(around).alias("start")).select("rid", "key", "start", "length", F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ").alias("window"))
    seen = stage(seen, "seen")
    on = ["length", "window"]
    known, _ = broadcast_if_small(windows, SMALL_BENCH)
    hits = seen.join(known.select(*on).distinct(), on, "left_semi")
    hits = hits.groupBy("rid", "key").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))))).cast("bigint").alias("n_hit"))
    named = seen.select("rid", "key", *on).distinct().join(known, on).groupBy("rid", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return _finish(counted, hits, named)


def _finish(counted: DataFrame, hits: DataFrame | None, named: DataFrame | None) -> DataFrame:
    if hits is None:
        out = counted.withColumns({"n_hit": F.lit(0).cast("bigint"), "items": F.array().cast("array<string>")})
    else:
        same = lambda a, b: (a["rid"] == b["rid"]) & a["key"].eqNullSafe(b["key"])
        both = hits.join(named, same(hits, named)).select(hits["rid"], hits["key"], "n_hit", "items")
        both, _ = broadcast_if_small(stage(both, "hits"), SMALL_DOCS)
        out = counted.join(both, same(counted, both), "left").select(counted["key"], counted["rid"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("key", "rid", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, n_words, n_hit (words inside any
    occurrence of an item's window), n_items, items_sha256 (of their ids, sorted
    as strings, joined by commas), contaminated.

    A null text has no words and an item without words no window. Repeated rows
    of ``docs`` each get their row; rows of one key with other texts are judged
    by their own. Repeated items count once; a null item id is named by the empty
    string. Either table may be empty. Other columns may have any names.
    """
    return _judge(docs, benchmark, key, text, item, item_text).drop("rid").withColumnRenamed("key", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the contaminated rows.

    Rows without words are never contaminated and stay. Repeated rows go together,
    rows of one key with other texts each by their own; null keys are keys like any
    other. Either table may be empty, and other columns may have any names."""
    gone = _judge(docs, benchmark, key, text, item, item_text).where("contaminated")
    return without(docs, gone, key, text, SMALL_BENCH)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[s : s + least(len(w), 13) - 1] AS x
       FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, s, w[s : s + n - 1] AS x FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
h AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, x)),
k AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM h, unnest(range(s, s + n)) AS t(i) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
