"""The pipeline's near-copy stage: five words, four fifths."""

import random
from itertools import combinations

import corpus_pipeline
from postflock.llm import jaccard

from tests.llm import test_jaccard


def sets_of(rows, words):
    split = [test_jaccard.WORD.findall(t.encode().lower()) for _, t, *_ in rows]
    return [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in split]


def first_of_each(rows, words, num, den):
    """Least keys of the groups, by comparing all pairs."""
    sets, group = sets_of(rows, words), {k: k for k, *_ in rows}
    keys = [k for k, *_ in rows]
    for i, j in combinations(range(len(rows)), 2):
        if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = group[keys[i]], group[keys[j]]
            group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    return sorted(set(group.values()))


def kept(spark, rows):
    docs = spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())


def test_scattered_edits_and_a_cut_tail(spark):
    words = [f"w{i}" for i in range(100)]
    edited = ["x" if i in (25, 75) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:82])), (4, " ".join(words[:70]) + " y" * 30)]
    assert first_of_each(rows, 5, 4, 5) == [1, 4] and first_of_each(rows, 3, 9, 10) != [1, 4]
    assert kept(spark, rows) == [1, 4]


def test_against_all_pairs(spark):
    rows = list({k: (k, t) for k, t, *_ in test_jaccard.corpus(random.Random(21), 400)}.values())
    want = first_of_each(rows, 5, 4, 5)
    assert want != first_of_each(rows, 3, 9, 10)
    assert kept(spark, rows) == want


def test_small_sets_by_subsets(spark, monkeypatch):
    rows = [(k, t) for k, t, *_ in test_jaccard.corpus(random.Random(22), 300) if len(t.split()) < 20]
    monkeypatch.setattr(jaccard, "boundary", lambda cost: 10)
    assert kept(spark, rows) == first_of_each(rows, 5, 4, 5)
