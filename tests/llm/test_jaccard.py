import os
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from postflock.llm import core, jaccard
from postflock.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    """(key, size, least key of the group) by comparing all pairs."""
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").encode().lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 90 * len(a | b):
            group[root(i)] = root(j)
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted((-1 if r[0] is None else r[0], len(s), -1 if (c := least.get(root(i))) is None or (not s and r[0] is None) else c) for i, (r, s) in enumerate(zip(rows, sets)))


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT int")
    none = lambda x: -1 if x is None else x
    return sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in jaccard.similar_groups(docs).collect())


def corpus(rng, n):
    pool = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choices(pool, k=40))
    rows = []
    while len(rows) < n:
        words = rng.choices(pool, k=rng.choice([1, 2, 3, 5, 8, 11, 12, 13, 20, 21, 22, 28, 40, 90, 200]))
        if rng.random() < 0.3:
            words = words[: len(words) // 2] + common.split() + words[len(words) // 2 :]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [rng.choice(pool)]
            rows.append((len(rows) * 3 % 1999, " ".join(copy), 0))
    return rows


def test_against_all_pairs(spark):
    rng = random.Random(11)
    rows = corpus(rng, 700)
    rows += [(5000, None, 0), (5001, "", 0), (5002, " \n\t ", 0), (None, "alone here now", 0), (None, rows[0][1], 0), (None, None, 0), (5003, "Upper CASE words é É", 0), (5004, "upper case words é É", 0), (5005, "upper case words é é", 0)]
    rows += [rows[1], (6000, "long " * 30_000 + " ".join(f"z{i}" for i in range(3000)), 0), (6001, "long " * 30_000 + " ".join(f"z{i}" for i in range(2900)), 0)]
    got, want = run(spark, rows), brute(rows)
    assert got == want
    assert len({c for *_, c in want}) < len(want) - 100


def test_lists_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = corpus(random.Random(5), 300)
    assert run(spark, rows) == brute(rows)


def test_boundaries(spark, monkeypatch):
    rows = [r for r in corpus(random.Random(6), 500) if len(r[1].split()) < 30]
    for b in (0, 12, 20):
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, b=b: b)
        assert run(spark, rows) == brute(rows)


def test_postings_are_dealt_out_once(spark):
    rows = [(b, i, 9, b % 4, 0) for i in range(40) for b in range(i % 7, 60, 5)] + [(1, 1, 9, 0, 1)]
    found = jaccard.light_lists(jaccard.stage(spark.createDataFrame(rows, jaccard.POSTINGS), "postings"))
    of = Counter(b for b, *_, kind in rows if kind == 0)
    first = {b: min((p, i, n) for x, i, n, p, kind in rows if x == b and kind == 0) for b in of}
    want = sorted((b, i, n, p, kind, first[b], of[b]) for b, i, n, p, kind in rows if kind == 0 and of[b] > 1)
    assert sorted((r.b, r.id, r.n, r.pos, r.kind, tuple(r.p), r.size) for r in found.collect()) == want
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_tables_go_when_they_are_read(spark, monkeypatch):
    real, made, there = jaccard.stage, {}, {}

    def stage(df, name, *more):
        there[name] = {x for x, paths in made.items() if any(os.path.exists(p) for p in paths)}
        out = real(df, name, *more)
        made.setdefault(name, []).append(out.staged_path.removeprefix("file://"))
        return out

    monkeypatch.setattr(jaccard, "stage", stage)
    rows = corpus(random.Random(8), 200)
    assert run(spark, rows) == brute(rows)
    assert "sketches" in there["classes"] and "sketches" not in there["postings"]
    assert "postings" in there["lists"] and not {"postings", "sketches"} & there["best"]
    assert "lists" in there["members"] and not {"lists", "sets"} & there["mixed"]


def test_texts_of_few_sets_are_not_dealt_out(spark, monkeypatch):
    """Sets that need more than their first elements are found by their number, however
    many postings there are."""
    monkeypatch.setattr(core, "SMALL_BYTES", 8_000)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(400)), 0) for i in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "key long, text string")
    classes = jaccard.stage(docs.withColumn("rid", F.lit(0).cast("long")).transform(jaccard.sketch, jaccard.OP8), "classes").withColumn("id", F.col("key"))
    heavy = np.sort(np.concatenate([jaccard.shingles(t, 3)[:60] for _, t, _ in rows[:3]]))
    plans, real = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: (plans.append((name, df)), real(df, name))[1])
    first, more = jaccard.postings(classes, docs, heavy, 0, jaccard.OP8)
    assert first.where("kind = -1").count() == 3 and {r.id for r in more.collect()} == {0, 1, 2}
    assert int(str(first._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 8_000
    assert "ResolvedHint (strategy=broadcast)" in plans[-1][1]._jdf.queryExecution().analyzed().toString()


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, "", 0)]) == [(1, 0, 1)]


def test_overlap_is_least():
    for s in range(1, 80):
        for t in range(1, 80):
            c = jaccard.least_overlap(s, t)
            assert 10 * c >= 9 * (s + t - c) and not 10 * (c - 1) >= 9 * (s + t - c + 1)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, x) for x in range(5001, 5300)]
    group = {x: x for e in edges for x in e}
    for _ in range(500):
        changed = False
        for a, b in edges:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
        if not changed:
            break
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.id: r.component for r in got} == {k: v for k, v in group.items() if k not in loops} and len(got) == len({r.id for r in got})
