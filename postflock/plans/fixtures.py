"""Posts, users, scores and clusters derived from the test tables.

A post is made from every row of ``events`` and from every row of ``documents``, with
its whole text; what is put before it (retweet markers, mentions, hashtags, addresses)
follows from the row's number. Nothing is left out. The SQL runs unchanged on both
engines; ``{events}`` and ``{documents}`` stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSTS = """
SELECT ts, concat('u', CAST(uid AS STRING)) AS user_name,
       concat(
         CASE WHEN id % 5 = 0 AND uid % 10 = 7 THEN 'RT @u9000: '
              WHEN id % 5 = 0 AND uid % 10 <> 6 THEN concat('RT @U', CAST((id * 7) % 150 AS STRING), ': ')
              ELSE '' END,
         CASE WHEN id % 15 = 0 THEN concat('RT: @u', CAST((id * 11) % 150 AS STRING), ' ') ELSE '' END,
         CASE WHEN id % 85 = 0 THEN 'RT RT @u1 ' ELSE '' END,
         CASE WHEN id % 3 = 0 AND uid % 10 = 8 THEN '@u9000 '
              WHEN id % 3 = 0 AND uid % 10 <> 9 THEN concat('@u', CAST((id * 13) % 200 AS STRING), ': ')
              ELSE '' END,
         CASE WHEN id % 97 = 0 THEN '@ ' ELSE '' END,
         CASE WHEN id % 4 = 0 THEN concat('#', tag, '! ') ELSE '' END,
         CASE WHEN id % 6 = 0 THEN 'http://t.co/x '
              WHEN id % 7 = 0 THEN 'Example.COM/y site.org ' ELSE '' END,
         body
       ) AS text
FROM (SELECT CAST(event_id * 2 AS BIGINT) AS ts, CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS uid, event_type AS tag,
             CASE WHEN value < 1 THEN 'ok' ELSE concat(event_type, 's were seen ', props) END AS body FROM {events}
      UNION ALL
      SELECT CAST(doc_id * 2 + 1 AS BIGINT), CAST(doc_id AS BIGINT), CAST(floor(doc_id / 8) AS BIGINT), coalesce(lang, 'none'),
             replace(replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' '), chr(9), ' ') FROM {documents}) AS source
"""
#: Users with so many purchases: the dictionary that programs are given.
USERS = "SELECT concat('u', CAST(user_id AS STRING)) AS user_name FROM {events} GROUP BY user_id HAVING sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) >= 12"
SCORES = """
SELECT concat('u', CAST(user_id AS STRING)) AS user_name, CAST(user_id AS BIGINT) AS global_id,
       CAST(count(*) AS BIGINT) AS n_events, CAST(max(value) AS DOUBLE) AS pr
FROM {events} GROUP BY user_id
"""
CLUSTERS = "SELECT DISTINCT concat('u', CAST(user_id AS STRING)) AS user_name, CAST(user_id % 4 AS INT) AS cluster_id FROM {events}"
STOPWORDS = ["the", "and", "thi"]
REPORT = ["8-way clustering", "Cluster   0, Size: 10", "  Descriptive:  col1 20.0%, col3 11.5%", "  Discriminating:  col2  9.0%, col12 4.1%", "", "Cluster   1, Size: 7", "  Descriptive:  col64 50.0%", "  Discriminating:  col1 2.5%", ""]


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(events=f"parquet.`{sf_dir}/events.parquet`", documents=f"parquet.`{sf_dir}/documents.parquet`"))


def posts(spark, sf_dir):
    """All posts. What Spark reads in fewer tasks than it has cores, as small files
    in one piece, is dealt out to them."""
    rows, cores = view(spark, sf_dir, POSTS), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def users(spark, sf_dir):
    return view(spark, sf_dir, USERS)


def scores(spark, sf_dir):
    return view(spark, sf_dir, SCORES)


def clusters(spark, sf_dir):
    return view(spark, sf_dir, CLUSTERS)


def stopwords(spark):
    return spark.createDataFrame([(x,) for x in STOPWORDS], "term string")


def report(spark):
    return spark.createDataFrame(list(enumerate(REPORT)), "place int, line string")
