import hashlib
import random
from collections import defaultdict
from glob import glob

import duckdb

from postflock.llm import sharding
from postflock.sources import staging


def path(key, text):
    bits = lambda x: bin(int(hashlib.md5(x.encode()).hexdigest()[:15], 16))[2:].zfill(60)
    return bits("" if key is None else str(key)) + bits(text or "")


def brute(rows, limit):
    """Splits buckets one bit at a time, from a single one on."""
    out, todo = [], [("", [(path(k, t), k, len((t or "").encode())) for k, t, *_ in rows])]
    while todo:
        prefix, inside = todo.pop()
        size = sum(x[2] for x in inside)
        if size <= limit or len(prefix) == 120:
            out += [(-1 if k is None else k, n, prefix, len(prefix), len(inside), size, size > limit) for _, k, n in inside]
        else:
            parts = defaultdict(list)
            for x in inside:
                parts[x[0][: len(prefix) + 1]].append(x)
            todo += parts.items()
    return sorted(out)


def test_against_splitting_one_by_one(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 60), 0) for i in range(400)] + [(None, None, 0), (1, "big" * 900, 0), (77, "", 0)]
    rows += [(5, "copy" * rng.randint(1, 9), 0) for _ in range(200)] + [(6, "same" * 9, 0)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, DOC_ID int")
    for limit in (1, 500, 3000, 10**6):
        out = sharding.assign(docs, limit).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.shard, r.depth, r.shard_docs, r.shard_bytes, r.over_limit) for r in out)
        assert got == brute(rows, limit)


def test_empty_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    assert sharding.assign(docs.limit(0)).count() == 0
    sharding.write_shards(docs, f"{tmp_path}/out", 200)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(i, "x" * i) for i in range(50)]
    sizes = back.selectExpr("shard", "length(text) n").groupBy("shard").sum("n").collect()
    assert len(sizes) > 4 and all(r[1] <= 200 for r in sizes)


def test_sql(spark, tmp_path):
    rows = [(i, "x" * (i % 7)) for i in range(300)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(sharding.ORACLE.replace(str(sharding.LIMIT_BYTES), "100")).fetchall()
    got = sharding.assign(docs, 100).select("doc_id", "n_bytes", "shard", "depth", "shard_docs", "shard_bytes", "over_limit").collect()
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order) and len({x[2] for x in want}) > 3


def test_one_pass_and_few_files(spark):
    """Several rounds give no further pass over the rows, and small tables few files."""
    rows = [(i, "x" * 50) for i in range(500)] + [(7, f"hot {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    made = len(staging._made)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = sharding.assign(docs, 300)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tables = [path[7:] for _, path in staging._made[made:]]
    assert len(tables) > 4 and out.rdd.getNumPartitions() == 7
    assert all(len(glob(f"{x}/*.parquet")) <= 60 // 2 for x in tables)
    got = sorted((r.doc_id, r.n_bytes, r.shard, r.depth, r.shard_docs, r.shard_bytes, r.over_limit) for r in out.collect())
    assert got == brute(rows, 300)
