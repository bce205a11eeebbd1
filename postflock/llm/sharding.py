"""Shards of bounded bytes by extendible hashing, in SQL operations alone.

A row's path is a string of bits: those of its key's hash, then those of its
text's. The directory is a set of bit prefixes, none the prefix of another; a
shard holds the rows whose path starts with its prefix. Only a prefix whose rows
are too many bytes is split on another bit. Bytes are summed once at a depth
somewhat beyond what even hashing would need, all shorter prefixes come from
these sums, and only what is still too large there is looked at more deeply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import broadcast_if_small, pick, stage

#: Bits of the key's hash, and as many of the text's.
BITS = 60
#: Small enough that tables of every size are split.
LIMIT_BYTES = 256 << 10
#: Depth beyond the even one in the first round, and added by each later one.
MORE = 4
#: A directory of at most so many rows is broadcast.
SMALL = 200_000
#: Prefixes, if all occur, that one task writes at least.
PREFIXES = 500


def bits(text: F.Column) -> F.Column:
    """60 bits of md5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 2), BITS, "0")


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """``rows`` (path, bytes) -> for each round its depth and the table of its fine
    prefixes that have a shard: fine, and ``at``: the shard's prefix, bytes, docs."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    base, depth = 0, min(2 * BITS, max(0, (total // limit).bit_length()) + MORE)
    parts, inside, over = [], rows, 1
    while True:
        # a table of few prefixes is not written as a file for each shuffle partition
        tasks = -(-min(over << (depth - max(0, base - 1)), 1 << 30) // PREFIXES)
        sums = inside.groupBy(F.substring("path", 1, depth).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        sums = stage(sums.coalesce(tasks), "sums")
        nodes = sums.select(F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"), "fine", "bytes", "docs")
        nodes = nodes.groupBy("d", F.expr("substring(fine, 1, d)").alias("shard")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        last = depth == 2 * BITS
        fitting = nodes.where((F.col("bytes") <= limit) | ((F.col("d") == depth) if last else F.lit(False)))
        # above the first depth where something fits, all fine prefixes would meet at a few keys
        least = fitting.agg(F.coalesce(F.min("d"), F.lit(depth))).first()[0]
        # the shard of a fine prefix is the shortest of its prefixes that fits
        found = (
            sums.select("fine", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("d"))
            .withColumn("shard", F.expr("substring(fine, 1, d)"))
            .join(fitting.select("d", "shard", F.struct("shard", "bytes", "docs").alias("at")), ["d", "shard"], "left")
            .groupBy("fine")
            .agg(F.min_by("at", F.when(F.col("at").isNotNull(), F.col("d"))).alias("at"))
        )
        found = stage(found.coalesce(tasks), "directory")
        parts.append((depth, found.where("at IS NOT NULL")))
        left = found.where("at IS NULL").select("fine")
        over = left.count()
        if last or not over:
            return parts
        inside = rows.join(F.broadcast(left) if over <= SMALL else left, F.substring(rows["path"], 1, depth) == left["fine"], "left_semi")
        base, depth = depth + 1, min(2 * BITS, depth + 2 * MORE)


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, *, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """A row for each row of ``docs``: key, n_bytes of the text in UTF-8, shard
    (its bit prefix; empty if one shard holds all), depth, shard_docs,
    shard_bytes, over_limit, and with ``keep_text`` the text.

    A null text has no bytes, a null key hashes as the empty string. Rows with
    one key are told apart by their text's hash after the key's 60 bits, so that
    a key with very many rows still splits; rows equal in both, and a text longer
    than the limit, cannot be, and their shard says over_limit. An empty table
    gives no row. Of columns with clashing names those with exactly these names are
    read. Ties cannot occur: a row's path says where it goes.
    """
    source = pick(docs, key=key, text=text)
    rows = source.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"), F.concat(bits(F.coalesce(F.col("key").cast("string"), F.lit(""))), bits(F.coalesce("text", F.lit("")))).alias("path"), *(["text"] if keep_text else []))
    placed, places = rows, []
    for depth, part in directory(rows.select("path", "bytes"), limit):  # a row is in one round's table; all are looked up in one pass
        part, _ = broadcast_if_small(part.select(F.col("fine").alias(f"fine{depth}"), F.col("at").alias(f"at{depth}")), SMALL)
        placed = placed.join(part, F.substring("path", 1, depth) == F.col(f"fine{depth}"), "left").drop(f"fine{depth}")
        places.append(f"at{depth}")
    placed = placed.withColumn("at", F.coalesce(*places))
    shard, size = F.col("at.shard"), F.col("at.bytes")
    return placed.select(F.col("key").alias(key), F.col("bytes").alias("n_bytes"), shard.alias("shard"), F.length(shard).cast("bigint").alias("depth"), F.col("at.docs").alias("shard_docs"), size.alias("shard_bytes"), (size > limit).alias("over_limit"), *([F.col("text").alias(text)] if keep_text else []))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, *, key: str = "doc_id", text: str = "text") -> None:
    """Writes key and text as Parquet, a folder ``shard=<bits>`` for each shard;
    a shard is one task's and no larger than its limit."""
    rows = assign(docs, limit, key=key, text=text, keep_text=True).select(key, text, F.concat(F.lit("b"), "shard").alias("shard"))
    rows.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)


ORACLE = f"""
WITH p AS (SELECT doc_id, coalesce(strlen(text), 0) AS n,
             lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), {BITS}, '0')
             || lpad(bin(CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT)), {BITS}, '0') AS path FROM documents),
g AS (SELECT d, substr(path, 1, d) AS shard, sum(n) AS b, count(*) AS c FROM p, range(0, {BITS}) AS r(d) GROUP BY 1, 2),
q AS (SELECT p.doc_id, p.n, p.path, min(g.d) AS d FROM p, g
      WHERE g.b <= {LIMIT_BYTES} AND g.shard = substr(p.path, 1, g.d) GROUP BY 1, 2, 3)
SELECT q.doc_id, CAST(q.n AS BIGINT) AS n_bytes, g.shard, CAST(q.d AS BIGINT) AS depth, CAST(g.c AS BIGINT) AS shard_docs,
       CAST(g.b AS BIGINT) AS shard_bytes, FALSE AS over_limit
FROM q JOIN g ON g.d = q.d AND g.shard = substr(q.path, 1, q.d)
"""
