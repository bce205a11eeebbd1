import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from postflock.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(library):
    coder, rng = bpe.encoder(PATH, P.PATTERN), random.Random(3)
    pool = "abé ß's \n\t日本語😀…12'rethe \x1c\x85  "
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert list(coder.encode(text)) == library.encode_ordinary(text)


def test_append_and_edit_equal_a_fresh_table():
    vocabulary, rng = bpe.encoder(PATH, P.PATTERN).v, random.Random(5)
    draw = lambda n: bytes(rng.choice(b"abcthe rin") for _ in range(n))
    for _ in range(150):
        data = draw(rng.randint(0, 300))
        grown = bpe.PrefixEncoder(vocabulary)
        for at in range(0, len(data), 7):
            grown.append(data[at : at + 7])
        assert grown.last == bpe.PrefixEncoder(vocabulary, data).last
        start = rng.randint(0, len(data))
        stop, new = rng.randint(start, min(len(data), start + 9)), draw(rng.randint(0, 9))
        grown.replace(start, stop, new)
        whole = data[:start] + new + data[stop:]
        assert grown.data == whole and grown.last == bpe.PrefixEncoder(vocabulary, whole).last


def test_appends_go_on_after_an_edit():
    vocabulary = bpe.encoder(PATH, P.PATTERN).v
    for start in (0, 3, 60, 290):
        table = bpe.PrefixEncoder(vocabulary, b" the thing and" * 21)
        table.replace(start, start + 2, b"inher")
        table.append(b"ing of things")
        assert table.last == bpe.PrefixEncoder(vocabulary, table.data).last


def test_a_worker_with_other_things_to_hold_keeps_little():
    """130,000 distinct words, each once: their chunks were kept twice, as pieces too."""
    coder = bpe.Encoder(bpe.encoder(PATH, P.PATTERN).v, P.PATTERN, bpe.SMALL_LIMITS)
    for at in range(0, 130_000, 1000):
        words = ["".join("abcdefghij"[int(d)] for d in str(i)) for i in range(at, at + 1000)]
        assert coder.decode(coder.encode("x " + " ".join(words)).tolist()).decode() == "x " + " ".join(words)
        assert len(coder.kept) + len(coder.pieces) <= 120_000
    assert not coder.pieces


def test_documents(spark, library):
    long = "thin ing " * 20000 + "a" * 3000
    rows = [(1, "Été the  end\n", "x"), (None, "a", "y"), (2, None, None), (3, "", "z"), (1, "Été the  end\n", "x"), (4, long, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string")
    out = bpe.encode_documents(docs, PATH, P.PATTERN, with_ids=True).collect()
    assert len(out) == len(rows)
    for (key, text, _), row in zip(rows, out):
        ids = library.encode_ordinary(text or "")
        assert (row.doc_id, row.n_tokens, list(row.ids)) == (key, len(ids), ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
