import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from postflock.llm import lm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def corpus(rng, n):
    rows = []
    for i in range(n):
        pool = [["the", "of", "And", "thing"], ["der", "eine", "UND", "keit"]][i % 2]
        rows.append((i, " ".join(rng.choice(pool) if rng.random() < 0.8 else f"x{rng.randint(0, 900)}" for _ in range(rng.randint(0, 60))), 0))
    return rows


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, Text int")
    return lm.score_corpus(docs).collect()


def test_counts_and_base(spark, monkeypatch):
    rng = random.Random(1)
    rows = corpus(rng, 300) + [(900, None, 0), (901, "", 0), (None, "the of", 0), (902, "long " * 50_000, 0)]
    rows += [rows[3]] * 3
    monkeypatch.setattr(lm, "COMMON", 40)
    monkeypatch.setattr(lm, "CLASSES", 1)
    monkeypatch.setattr(lm, "CHUNK", 7)
    out = run(spark, rows)
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for k, t, _ in rows if not held(k) for w in words(t))
    texts = sum(not held(k) for k, *_ in rows)
    total, distinct = sum(counts.values()) + texts, len(counts) + 1
    assert len(out) == len(rows)
    by = {r[0]: words(r[1]) for r in rows}
    for r in out:
        cs = [counts[w] for w in by[r.doc_id]] + [texts]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(cs), sum(c > 0 for c in cs), total)
        assert math.isclose(r.base_score, sum(math.log10((c + 1) / (total + distinct + 1)) for c in cs), rel_tol=1e-9)
        assert r.score < 0
    # neighbours tell the language, which single words do not
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_probabilities_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 1)
    monkeypatch.setattr(lm, "CHUNK", 5)
    docs = spark.createDataFrame(corpus(random.Random(2), 60), "doc_id long, text string, other int").select("text")
    model, counts = lm.learn(docs, 60)
    size = model.classes.size
    after = [sum(10 ** model.logs(np.array([h, w]))[1] for w in range(size)) for h in range(size)]
    assert np.allclose(after, 1, atol=1e-4)
    inside = Counter()
    for r in counts.collect():
        k = model.classes.get(bytes(r.word))
        inside[k] += 1.0 if k < model.classes.first else (r.c + 1) / 10 ** model.share[k]
    unseen = {k: 1 / 10 ** model.share[k] for k in range(model.classes.first, model.classes.end)}
    assert all(abs(inside[k] + unseen.get(k, 0) - 1) < 1e-9 for k in range(model.classes.end))


def test_words_are_looked_up_in_one_pass():
    words = b"b a zz b y zz c".split()
    logs, rare = lm.look_up(words, {b"a": 0.5, b"b": 2.0, b"c": 0.0})
    assert logs.tolist() == [2.0, 0.5, 0, 2.0, 0, 0, 0] and rare == {b"zz": 2, b"y": 1}
    logs, rare = lm.look_up([], {b"a": 0.5})
    assert logs.tolist() == [] and rare == {}


def test_training_finds_neighbours():
    h, w = np.array([0, 1, 2, 3] * 64), np.array([1, 0, 3, 2] * 64)
    net = lm.NoiseContrastive(np.ones(4), 8)
    net.begin(1)
    for _ in range(800):
        net.learn(h, w, noise=16)
    s = (net.p["R"] @ net.p["C"]) @ net.p["Q"].T + net.p["b"][:, 0] - net.log_sums()[:, None]
    assert (s[h[:4], w[:4]] > np.log(0.8)).all() and np.allclose(np.exp(s).sum(1), 1)


def test_average_of_tasks_is_by_what_they_met():
    start = lm.NoiseContrastive(np.ones(6), 4)
    nets = []
    for seed, h, w in ((1, [0, 1], [1, 2]), (2, [0, 0, 3], [4, 4, 4])):
        net = lm.NoiseContrastive(np.ones(6), 4)
        net.begin(seed)
        net.learn(np.array(h), np.array(w), noise=2)
        nets.append(net)
    total = {}
    for net in nets:
        for chunk, sums in net.rows():
            total[chunk] = total.get(chunk, 0) + sums
    out = lm.NoiseContrastive(np.ones(6), 4)
    for chunk, sums in total.items():
        out.take(chunk, sums)
    a, b = nets
    assert np.allclose(out.p["R"][0], (a.p["R"][0] + 2 * b.p["R"][0]) / 3, atol=1e-6)
    assert np.allclose(out.p["R"][1], a.p["R"][1], atol=1e-6) and np.allclose(out.p["R"][3], b.p["R"][3], atol=1e-6)
    assert (out.p["R"][5] == start.p["R"][5]).all()
    assert np.allclose(out.p["C"], (2 * a.p["C"] + 3 * b.p["C"]) / 5, atol=1e-6)


def test_the_model_grows_with_the_corpus():
    sizes = [sum(lm.classes_for(n)) for n in (10**4, 10**6, 10**8, 10**10, 10**13)]
    assert all(b > 5 * a for a, b in zip(sizes, sizes[1:]))


def test_held_out_texts_of_the_test_tables(spark):
    """Texts that were not learnt from are more probable than by their words alone, by
    more than half a power of ten for every two tokens."""
    out = lm.score_corpus(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert (out.s - out.b) / out.n > 0.2


def test_empty(spark):
    assert run(spark, []) == []
    only_held = [(k, "a b", 0) for k in range(300) if zlib.crc32(str(k).encode()) % 7 == 2]
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in run(spark, only_held))


def test_a_word_is_looked_up_once():
    """One look-up gives class and count; there were two, and a third in texts with a
    new word."""

    class Asked(bytes):
        times = 0

        def __hash__(self):
            Asked.times += 1
            return bytes.__hash__(self)

    classes = lm.Classes([b"a", b"b"], 3)
    places, class_of, log_of = {b"a": 1, b"b": 2, b"c": 3}, np.array([0, 0, 1, classes.get(b"c")]), np.array([0, 0.5, 2.0, 0.25])
    words = [Asked(x) for x in (b"b", b"a", b"c", b"a")]
    seq, logs, rare = lm.classes_and_logs(words, places, class_of, log_of, classes)
    assert (seq.tolist(), logs.tolist(), rare, Asked.times) == ([1, 0, classes.get(b"c"), 0, classes.end], [2.0, 0.5, 0.25, 0.5], {}, 4)
    seq, logs, rare = lm.classes_and_logs([b"new", b"a", b"new"], places, class_of, log_of, classes)
    assert (seq.tolist(), logs.tolist(), rare) == ([classes.get(b"new"), 0, classes.get(b"new"), classes.end], [0, 0.5, 0], {b"new": 2})
    assert lm.classes_and_logs([], {}, class_of[:1], log_of[:1], classes)[0].tolist() == [classes.end]


def test_what_a_task_remembers_is_bounded():
    known = lm.Known({b"a": 7}, len, 3)
    assert known.values_of([b"a", b"bb", b"ccc", b"bb", b"dddd", b"a"]).tolist() == [7, 2, 3, 2, 4, 7]
    assert dict(known) == {b"a": 7, b"dddd": 4}
