import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from postflock.llm import files, tokenfile
from postflock.llm.huffman import Code, code_lengths

PATH = P.path("byte_bpe_50k.json")


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 300):
        counts = rng.zipf(1.3, n).clip(max=10**9)
        free, tight = code_lengths(counts, 30), code_lengths(counts, max(1, (n - 1).bit_length()))
        assert n == 1 or abs(sum(2.0 ** -float(x) for x in free) - 1) < 1e-9
        assert tight.max() <= max(1, (n - 1).bit_length()) and sum(2.0 ** -float(x) for x in tight) <= 1
        assert (counts * free).sum() <= (counts * tight).sum()
    # Huffman's own cost, by merging the two least again and again
    counts = [5, 9, 12, 13, 16, 45]
    assert (np.array(counts) * code_lengths(np.array(counts), 18)).sum() == 224


def test_round_trip_of_files():
    rng = np.random.default_rng(2)
    for tokens in (0, 1, 255, 256, 257, tokenfile.BLOCK, 2 * tokenfile.BLOCK + 77):
        ids = (rng.zipf(1.2, tokens) % 5000).astype("<u2")
        code = Code(code_lengths(np.bincount(ids, minlength=5000) if tokens else np.zeros(5000, int)))
        cut = sorted(rng.integers(0, tokens + 1, 3).tolist())
        lengths = np.diff([0, *cut, tokens]).tolist()
        keys, of_doc, back = tokenfile.unpack(b"".join(tokenfile.pack(code, [None, 4, -1, 9], lengths, ids)))
        assert keys == [None, 4, -1, 9] and of_doc.tolist() == lengths and (back == ids).all()


@pytest.mark.parametrize("as_text", [False, True])
def test_corpus(spark, as_text):
    rng = random.Random(4)
    texts = ["", None, "Hello  world\n ok", "été 日本 12's", "a" * 5000, "x \t y", " lead", "trail ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c  <|endoftext|>\n<|endoftext|>.", "x <|endoftext|", *(" ".join(rng.choice(["thin", "on,", "<|endoftext|>s", "ed.\nAt", "€5"]) for _ in range(rng.randint(1, 400))) for _ in range(60))]
    rows = [(None if i == 5 else i // 2 * 2, x, "n") for i, x in enumerate(texts)] + [(2, "same", "n")] * 3
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, Doc_ID string")
    manifest = tokenfile.write_corpus(docs, PATH, 2, file_tokens=2000, special_as_text=as_text)
    out = tokenfile.read_files(manifest).collect()
    model = Tokenizer.from_file(PATH)
    if as_text:  # else as the library has it
        model.encode_special_tokens = True
    want = sorted((k if k is not None else -1, zlib.crc32(np.array([*model.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for k, x, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in out) == want
    out.sort(key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in out] == sorted(k for k, _ in want)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:])) and out[0].start == 0
    assert manifest.count() > 3 and all(files.read(r.path)[:8] == tokenfile.MAGIC for r in manifest.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.read_files(tokenfile.write_corpus(docs, PATH, 2)).count() == 0


def test_learnt_words_and_stops():
    """Chunks are sorted into words, words with stops and others on whole arrays."""
    coder = tokenfile.Library(PATH)
    chunks = ["thin", "thin,", "on?!", "été", "étés.", "a.b", "...", "", "x1", "x\n", "x.\n", "ÿ:", "×", "÷.", "ɏ;", "ɐ", "日本.", "été", "é", "don't", "a\x00", "thin.,"]
    coder._learn(pa.array(chunks))
    model = Tokenizer.from_file(PATH)
    for chunk in chunks:
        assert np.frombuffer(coder.kept[chunk], coder.wide).tolist() == model.encode(" " + chunk, add_special_tokens=False).ids
    assert tokenfile._objects(pa.array(chunks)) == chunks and tokenfile._objects(pa.array([], pa.string())) == []
    assert coder.encode(pa.array(["", ""])) == [b"", b""] and coder.encode(pa.array([], pa.string())) == []
    assert coder.encode(pa.array(["a  b"])) == coder._encode(["a  b"])
