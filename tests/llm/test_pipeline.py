import base64
import random

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from tests.llm import test_decontam, test_jaccard, test_near_copies


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def full(rows):
    return [(k, t, "xx", "s", len(t or "")) for k, t, *_ in rows]


def test_near_copies_keep_the_first_of_each_group(spark):
    """Five words and four fifths, as the task has it for stages on word shingles."""
    # of rows with one key and other texts, which brute force here does not know, none
    rows = list({k: (k, t) for k, t, *_ in test_jaccard.corpus(random.Random(3), 200)}.values())
    first = test_near_copies.first_of_each(rows, 5, 4, 5)
    odd = [(9000, None), (9001, ""), rows[0], rows[0], (None, "no key at all here"), (None, "no key at all here")]
    docs = docs_of(spark, full(rows + odd))
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.schema == docs.schema
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert kept == sorted([*first, 9000, 9001]) and out.where("doc_id IS NULL").count() == 1


def test_benchmarks_take_the_contaminated(spark, tmp_path):
    bench = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 0)]
    spark.createDataFrame(bench, "item_id long, text string, x int").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "before " + bench[0][1], 0), (2, "clean words here", 0), (3, None, 0), (None, bench[0][1], 0), (2, bench[0][1], 0), (4, "far " * 400 + bench[0][1], 0)]
    out = corpus_pipeline.benchmarks(spark, docs_of(spark, full(rows)), str(tmp_path))
    clean = {(k, t) for (k, t, _), j in zip(rows, [0, 1, 1, 0, 0, 1]) if j}
    assert {(r.doc_id, r.text) for r in out.collect()} == clean
    assert sum(r[5] for r in test_decontam.brute(rows, bench)) == 3


def test_language_rejects_what_has_none(spark):
    rows = [(i, "the thing and of " * 5, "en", "s", 1) for i in range(30)] + [(50, None, "en", "s", 0), (51, "12 345", "en", "s", 0), (52, "", None, "s", 0), (53, "the and", None, "s", 0)]
    out = corpus_pipeline.language(spark, docs_of(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == [*range(30), 53]
    nothing = corpus_pipeline.language(spark, docs_of(spark, rows).where("lang IS NULL"), "")
    assert [r.doc_id for r in nothing.collect()] == [53]


def test_language_rejects_noise_and_reads_whole_texts(spark):
    words = "the thing and of hand with other".split()
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words, k=40)), "en", "s", 1) for i in range(60)]
    noise = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(50))
    # row 71 is noise from its third word on
    odd = [(60, noise, None, "s", 1), (61, noise, None, "s", 1), (60, noise, None, "s", 1), (62, "the thing", None, "s", 1), (62, "the thing", None, "s", 1), (62, noise, None, "s", 1), (None, noise, None, "s", 1), (None, "and the other thing", None, "s", 1)]
    odd += [(70, "the thing and " * 20_000, None, "s", 1), (71, "the thing " + " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(40_000)), None, "s", 1)]
    out = corpus_pipeline.language(spark, docs_of(spark, rows + odd), "")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text[:30]) for r in out.collect())
    assert got == sorted([(k, t[:30]) for k, t, *_ in rows] + [(62, "the thing")] * 2 + [(-1, "and the other thing"), (70, ("the thing and " * 3)[:30])])


def test_tokens(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(corpus_pipeline.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Été the  end\n"), (2, None), (3, ""), (None, "a b"), (1, "Été the  end\n"), (4, "thing ing " * 30_000 + "a" * 2000)]
    out = corpus_pipeline.tokens(spark, docs_of(spark, full(rows)), "").collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(k, len(ids), ids) for k, t in rows for ids in [library.encode_ordinary(t or "")]]
    assert sorted([(r.doc_id, r.n_tokens, list(r.ids)) for r in out], key=order) == sorted(want, key=order)


@pytest.fixture
def bench(spark, tmp_path):
    spark.createDataFrame([(1, "one two three", 0)], "item_id long, text string, other int").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_columns(spark, bench, name):
    """Columns that differ in case only, or occur twice: those of exactly the wanted
    name are read, and the first of two."""
    plain = spark.createDataFrame([(1, "the thing and one two three", "en", "X", 5, "y"), (2, "the thing and of other", "en", "Z", 6, "w"), (None, None, None, None, None, None)], "a long, b string, c string, d string, e long, f string")
    docs = plain.toDF("doc_id", "text", "lang", "TEXT", "Doc_Id", "text")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, bench)
    rows = [tuple(r) for r in out.collect()]
    if name == "tokens":
        assert len(rows) == 3 and out.columns[:2] == ["doc_id", "n_tokens"]
        return
    assert out.columns == docs.columns
    everything = {tuple(r) for r in docs.collect()}
    gone = {"language": {None}, "near_copies": set(), "benchmarks": {1}}[name]
    assert set(rows) == {r for r in everything if r[0] not in gone}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_empty_tables(spark, bench, name):
    docs = docs_of(spark, [])
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, bench)
    assert out.count() == 0 and (name == "tokens" or out.schema == docs.schema)


def test_stages_leave_the_session_alone(spark, bench):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    docs = docs_of(spark, full([(1, "the thing and other"), (2, "of the hand")]))
    for _, step in corpus_pipeline.STAGES:
        step(spark, docs, bench).count()
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    # every document here with letters is in one of four languages
    texts = [(r.doc_id, r.text, 0) for r in docs if any(c.isalpha() for c in r.text or "")]
    items = [(r.item_id, r.text, 0) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r[0] for r in test_decontam.brute(texts, items) if r[5]}
    assert ids == set(test_near_copies.first_of_each(texts, 5, 4, 5)) - dirty
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmarks", "tokens"]
