import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers as P

from postflock.llm import langid

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def cuts(word: bytes):
    for n in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), n):
            yield [word[a:b] for a, b in zip((0, *at), (*at, len(word)))]


def test_sums_over_all_segmentations():
    trie, size = langid.pieces(PATH)
    ranks = langid.Vocabulary.load(PATH).ranks
    p = np.random.default_rng(1).dirichlet(np.ones(size), 2)
    words = [b" the", b" thing", b" \xc3\xa9t\xc3\xa9", b"a"]
    got = langid.Lattice(trie, words).totals(p)
    for word, row in zip(words, got):
        want = sum(np.prod([p[:, ranks[x]] for x in cut], axis=0) for cut in cuts(word) if all(x in ranks for x in cut))
        assert np.allclose(row, want, rtol=1e-9)
        assert np.allclose(langid.long_log(trie, word, p), np.log(want), rtol=1e-9)
    lattice = langid.Lattice(trie, words)
    assert np.allclose(lattice.backward(p)[0], got)
    long = b" " + b"thing" * 2000
    assert np.isfinite(langid.long_log(trie, long, p)).all()
    some = b" " + b"th\xc3\xa9ing" * 40
    logs = langid.Lattice(trie, [some, *words]).totals(np.log(p), True)
    assert np.allclose(logs[0], langid.long_log(trie, some, p)) and np.allclose(logs[1:], np.log(got))


def test_shares_of_pieces_against_all_segmentations():
    """Of short words, of long ones, and of ones whose sums are below all numbers."""
    trie, size = langid.pieces(PATH)
    ranks = langid.Vocabulary.load(PATH).ranks
    words = [b" the", b" thing", b"ing"]
    of = np.array([0, 1, 1])
    for p in (np.random.default_rng(2).dirichlet(np.ones(size), 2), np.full((2, size), 1e-290)):
        lattice = langid.Lattice(trie, words)
        got = langid.shares(lattice, p, of)
        for i, word in enumerate(words):
            ways = [cut for cut in cuts(word) if all(x in ranks for x in cut)]
            # in units of the most probable way, which no number is too small for
            logs = [sum(math.log(p[of[i], ranks[x]]) for x in cut) for cut in ways]
            weight = [math.exp(x - max(logs)) for x in logs]
            for start, end, piece, share in zip(*(x[lattice.word == i] for x in (lattice.start, lattice.end, lattice.piece)), got[lattice.word == i]):
                here = [x for x, cut in zip(weight, ways) if any(sum(map(len, cut[:n])) == start and ranks[y] == piece and start + len(y) == end for n, y in enumerate(cut))]
                assert math.isclose(share, sum(here) / sum(weight), rel_tol=1e-9, abs_tol=1e-12)


def test_scripts_without_spaces(spark):
    """A sentence is one word of any number of bytes, and all of it is learnt from."""
    rng = random.Random(4)
    pools = {"zz": "山水火木金土日月", "ww": "あいうえおかきくけ"}
    rows = [(i, "".join(rng.choices(pools[lang], k=rng.choice([40, 300, 3000]))), lang) for i in range(80) for lang in [rng.choice(["zz", "ww"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, PATH)
    out = {r.doc_id: r for r in langid.identify(docs, model, PATH).collect()}
    assert all(out[k].lang_pred == lang and out[k].gain > 1 for k, _, lang in rows)
    counts = [("zz", "山水" * 4000, 1)]
    p = langid.fit(counts, ["zz"], PATH)
    assert p[0].argmax() in {langid.Vocabulary.load(PATH).ranks.get(x.encode()) for x in "山水"} | set(range(256)) and p[0].max() > 0.1


def test_what_no_language_explains(spark):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    noise = [(10_000 + i, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(rng.choice([1, 3, 30, 300]))), None) for i in range(60)]
    other = [(20_000 + i, "".join(rng.choices("қҳӣӯғҷўєіїґћђљњџ ", k=rng.choice([10, 200]))), None) for i in range(40)]
    docs = spark.createDataFrame(rows + noise + other, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.accept(docs, PATH).collect()}
    assert not kept & {k for k, *_ in noise + other}
    lettered = {k for k, t, _ in rows if t and any(c.isalpha() for c in t)}
    assert kept == lettered


def test_held_out_accuracy_on_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(docs, PATH), PATH).collect()}
    truth = [(r.doc_id, r.lang) for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(truth) > 1000 and sum(out[k] == lang for k, lang in truth) >= 0.995 * len(truth)


def test_documents(spark):
    rng = random.Random(1)
    pools = {"xx": "the and thing ofth hand".split(), "yy": "öung eine keit ßein und".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(["xx", "yy"])
        rows.append((i, " ".join(rng.choices(pools[lang], k=30)), lang, 1))
    odd = [(300, None, "xx", 1), (301, "", "xx", 1), (302, "12 + 34 !", "yy", 1), (None, "eine und", None, 1), (303, "a" * 40_000, None, 1), (7, "the and", None, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, LANG long")
    model = langid.learn(docs, PATH, sample=60)
    assert model[0] == ["xx", "yy"] and np.allclose(model[1].sum(1), 1)
    out = langid.identify(docs, model, PATH).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in out if r.doc_id in truth and r.doc_id != 7)
    by = {r.doc_id: r for r in out}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (300, 301, 302))
    assert by[None].lang_pred == "yy" and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in out)
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30
    empty = docs.limit(0)
    assert langid.identify(empty, langid.learn(empty, PATH), PATH).count() == 0
    assert langid.identify(docs, langid.learn(empty, PATH), PATH).where("lang_pred <> 'und'").count() == 0


def test_same_model_again(spark):
    docs = spark.createDataFrame([(i, "the thing and", "xx") for i in range(40)], "doc_id long, text string, lang string")
    assert (langid.learn(docs, PATH)[1] == langid.learn(docs.repartition(5), PATH)[1]).all()
