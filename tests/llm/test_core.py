import random
import time

import pytest
from pyspark.sql import functions as F

from postflock.llm import core
from postflock.sources import staging


def test_columns_by_exact_name(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, A int, b int, text int").toDF("a", "A", "a", "Text")
    assert core.pick(df, x="A", y="a").collect() == [(2, 1)]
    with pytest.raises(KeyError):
        core.pick(df, x="text")


def test_most_frequent(spark):
    rng = random.Random(1)
    values = [rng.choice([1, 1, 1, 2, 3, rng.randint(1, 10**7)]) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c long")
    for most in (0, 1, 50, 130, 500, 10_000):
        got = sorted((r.c for r in core.most_frequent(df, "c", most).collect()), reverse=True)
        assert len(got) <= most and got == sorted(values, reverse=True)[: len(got)]
    assert len(core.most_frequent(df, "c", 500).collect()) == 500
    assert core.most_frequent(df.limit(0), "c", 5).count() == 0


def test_without_tells_texts_of_one_key_apart(spark):
    rows = [(1, "a", 0), (1, "b", 1), (None, "a", 2), (None, None, 3), (2, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT int")
    gone = core.pick(df, key="doc_id", text="text", n="TEXT").where("n IN (0, 3)").selectExpr("key", "xxhash64(key, text) AS rid")
    for small in (0, 100):
        left = core.without(df, gone, "doc_id", "text", small)
        assert left.columns == df.columns and sorted(r[2] for r in left.collect()) == [1, 2, 4]


def test_stage_leaves_settings_alone(spark):
    before = {k: spark.conf.get(k) for k in staging.LONG_ROWS}
    out = staging.stage(spark.range(5), "test")
    assert out.count() == 5 and {k: spark.conf.get(k) for k in staging.LONG_ROWS} == before
    staging.delete(spark, out.staged_path)


def test_one_thing_is_kept_per_worker():
    first = core.once_per_worker("x", list)
    assert core.once_per_worker("x", list) is first
    core.once_per_worker("y", list)
    assert core.once_per_worker("x", list) is not first


def test_a_written_table_leaves_nothing_shuffled(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffled()
    out = core.stage(held, "counts")
    assert sorted(r["count"] for r in out.collect()) == [142] + [143] * 6
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
