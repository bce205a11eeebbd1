"""Token ids in compact binary files: encode, code by global counts, read back.

Layout of a file, integers little-endian::

    b"PFTOK1\\0\\0"  blocks of bits, one after the other  zlib(footer)  u32 footer length  b"PFTOK1\\0\\0"

The footer is JSON for the sizes and then arrays: code lengths (u8 a symbol),
keys (i64) with a byte each that tells null ones, tokens of each document (u32),
and for each block its byte length (u64), then all bit offsets (u32). A block
can be decoded without any other, from any of its offsets on.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .core import delete, new_folder, once_per_worker, partitions, pick, stage
from .huffman import BLOCK, LIMIT, STRIDE, Code, code_lengths

MAGIC = b"PFTOK1\0\0"
#: A file is closed when it holds this many tokens.
FILE_TOKENS = 1 << 24
#: Whitespace-delimited chunks whose ids one worker keeps; when there are more,
#: those seen last stay, up to as many again.
CACHE = 700_000
#: Bytes of text encoded at a time.
SLICE = 24_000_000

#: Words that are one piece each, and what may stand after one as a second piece.
WORD, STOPS = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$", ".,:;!?"
#: A space before white space of any kind, or at the end.
SPACED = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
#: Stands before the first chunk of a text; texts that have it are encoded whole.
FIRST = "\x00"


def _objects(values: pa.Array) -> list:
    """What ``to_pylist`` gives, without an Arrow scalar for each."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Library:
    """The tokenizers library behind a cache of chunks.

    Byte-level pre-tokenizing ends a piece before every space that no white
    space follows, so text is cut there, each distinct chunk is encoded by the
    library and the ids are joined. Texts with other runs of white space go to
    the library whole.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self.size = self.model.get_vocab_size()
        self.wide = "<u2" if self.size <= 1 << 16 else "<u4"
        # the same model for words that are known to be one piece each: their bytes
        # are written in the model's characters here, and it cuts at spaces only
        self.words = Tokenizer.from_file(path)
        self.words.encode_special_tokens = True
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
        rest = [b for b in range(256) if b not in set(shown)]
        self.drawn = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spaced = np.zeros(self.size, bool)  # tokens whose first byte is a space
        for token, i in self.model.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")

    def _runs(self, chunks: list[str], encode) -> list[bytes]:
        """Ids of each chunk with a space before it. They are encoded in long
        runs: a chunk has its only space in front, so that exactly the first
        token of each begins with one."""
        out = []
        for at in range(0, len(chunks), 20_000):
            run = chunks[at : at + 20_000]
            ids = np.array(encode(run), self.wide)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(run):
                out += self._encode([" " + x for x in run])
                continue
            data, step = ids.tobytes(), ids.itemsize
            ends = (step * np.append(starts[1:], len(ids))).tolist()
            out += [data[a:b] for a, b in zip((step * starts).tolist(), ends)]
        return out

    def _any_run(self, run: list[str]) -> list[int]:
        return self.model.encode_batch_fast([" " + " ".join(run)], add_special_tokens=False)[0].ids

    def _word_run(self, run: list[str]) -> list[int]:
        # of ASCII letters only the space in front is drawn as another character
        drawn = " ".join(["\u0120" + x if x.isascii() else (" " + x).encode().decode("latin-1").translate(self.drawn) for x in run])
        return self.words.encode_batch_fast([drawn], add_special_tokens=False)[0].ids

    def _learn(self, new: pa.Array) -> None:
        """A word with stops after it is two pieces; others are left to the library."""
        kept, older, tailed, words, others = self.kept, self.older, [], [], []
        bare = pc.utf8_rtrim(new, STOPS)
        for chunk, word, plain in zip(_objects(new), _objects(bare), _objects(pc.match_substring_regex(bare, WORD))):
            if not plain:
                others.append(chunk)
            elif len(word) < len(chunk):
                tailed.append((chunk, word, chunk[len(word) :]))
            else:
                words.append(chunk)
        stems = {x[1] for x in tailed if x[1] not in kept}
        again = {x for x in stems if x in older}
        kept.update(zip(again, map(older.__getitem__, again)))
        words += stems.difference(again, words)
        kept.update(zip(words, self._runs(words, self._word_run)))
        tails = {x[2] for x in tailed}
        tails = dict(zip(tails, self._encode(list(tails))))
        for chunk, word, tail in tailed:
            kept[chunk] = kept[word] + tails[tail]
        kept.update(zip(others, self._runs(others, self._any_run)))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.wide).tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text. The chunks of all texts are numbered, the distinct
        ones looked up or encoded, and their ids copied to where they occur."""
        whole = pc.or_(pc.match_substring_regex(texts, SPACED), pc.match_substring(texts, FIRST)).to_numpy(zero_copy_only=False)
        out: list[bytes | None] = [None] * len(texts)
        odd = np.flatnonzero(whole)
        for i, ids in zip(odd, self._encode(texts.take(pa.array(odd)).to_pylist())):
            out[i] = ids
        plain = np.flatnonzero(~whole)
        if not len(plain):
            return out
        # the first chunk, which has no space before it, is marked
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(""), texts.take(pa.array(plain)), FIRST), " ")
        numbered = cut.values.dictionary_encode()
        chunks = _objects(numbered.dictionary)
        if len(self.kept) > CACHE:
            self.kept, self.older = {}, self.kept
        found = list(map(self.kept.get, chunks))
        new, firsts = [], []
        for i, ids in enumerate(found):
            if ids is None:
                chunk = chunks[i]
                ids = found[i] = self.older.get(chunk)
                if ids is not None:
                    self.kept[chunk] = ids
                elif chunk[:1] == FIRST:
                    firsts.append(i)
                else:
                    new.append(i)
        for i, ids in zip(firsts, self._encode([chunks[i][1:] for i in firsts])):
            found[i] = ids
        self._learn(numbered.dictionary.take(pa.array(new, pa.int64())))
        for i in new:
            found[i] = self.kept[chunks[i]]
        copied = pa.array(found, pa.large_binary()).take(numbered.indices)
        _, ends, data = copied.buffers()
        last = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        for i, begin, end in zip(plain.tolist(), last, last[1:]):
            out[i] = bytes(data[begin:end])
        return out


def library(path: str, special_as_text: bool = False) -> Library:
    return once_per_worker(("library", path, special_as_text), lambda: Library(path, special_as_text))


def _slices(column: pa.Array):
    """A column's texts, null as empty, in runs of about SLICE bytes."""
    column = pc.fill_null(column, "")
    before = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(before, before[at] + SLICE, "right")) - 1)
        yield column.slice(at, end - at)
        at = end


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int, *, key: str = "doc_id", text: str = "text", special_as_text: bool = False) -> DataFrame:
    """key and ids (binary: 16-bit ids where the vocabulary allows, else 32-bit),
    ``end_id`` last. A null text is as an empty one: the end id alone. One more
    row a task has null ids and, in ``counts``, how often each id came in it."""
    source = pick(docs, key=key, text=text).withColumn("key", F.col("key").cast("bigint"))

    def run(batches):
        coder = library(tokenizer, special_as_text)
        end = np.array([end_id], coder.wide).tobytes()
        total = np.zeros(coder.size, np.int64)

        def rows(keys, ids, counts):
            return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["key", "ids", "counts"])

        for batch in batches:
            ids = []
            for texts in _slices(batch.column(1)):
                found = [x + end for x in coder.encode(texts)]
                total += np.bincount(np.frombuffer(b"".join(found), coder.wide), minlength=coder.size)
                ids += found
            yield rows(batch.column(0), ids, [None] * len(ids))
        yield rows(pa.array([None], pa.int64()), [None], [total.astype("<i8").tobytes()])

    return source.mapInArrow(run, "key bigint, ids binary, counts binary")


def count_ids(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all rows, from the tasks' counts. They are
    added up in Spark; the driver gets a row for each id that occurs."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_py(), "<i8")
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for row in encoded.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def pack(code: Code, keys: list, lengths: list[int], ids: np.ndarray) -> list[bytes]:
    """The parts of a file that holds these documents, one after another."""
    parts, points = [MAGIC], []
    for at in range(0, len(ids), BLOCK):
        bits, offsets = code.encode(ids[at : at + BLOCK])
        parts.append(bits)
        points.append(offsets)
    head = json.dumps({"symbols": len(code.lengths), "docs": len(keys), "tokens": len(ids), "blocks": len(points), "block": BLOCK, "stride": STRIDE}).encode()
    null = np.array([x is None for x in keys], np.uint8)
    footer = struct.pack("<I", len(head)) + head + code.lengths.tobytes() + np.array([x or 0 for x in keys], "<i8").tobytes() + null.tobytes() + np.array(lengths, "<u4").tobytes()
    footer += np.array([len(x) for x in parts[1:]], "<u8").tobytes() + b"".join(x.astype("<u4").tobytes() for x in points)
    footer = zlib.compress(footer, 6)
    return [*parts, footer, struct.pack("<I", len(footer)), MAGIC]


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, tokens of each document and all ids of a file."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token file, or cut off")
    (size,) = struct.unpack("<I", data[-12:-8])
    footer = zlib.decompress(data[-12 - size : -12])
    (size,) = struct.unpack("<I", footer[:4])
    head, at = json.loads(footer[4 : 4 + size]), 4 + size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(footer, kind, n, at)
        at += found.nbytes
        return found

    lengths = take("u1", head["symbols"])
    keys, null, of_doc = take("<i8", head["docs"]), take("u1", head["docs"]), take("<u4", head["docs"])
    of_block = take("<u8", head["blocks"]).astype(np.int64)
    block, stride, tokens = head["block"], head["stride"], head["tokens"]
    in_block = np.minimum(block, tokens - block * np.arange(head["blocks"]))
    lanes = -(-in_block // stride)
    points = take("<u4", int(lanes.sum())).astype(np.int64) + 8 * np.repeat(np.cumsum(of_block) - of_block, lanes)
    if not tokens:
        return [None if x else int(k) for k, x in zip(keys, null)], of_doc, np.zeros(0, np.uint32)
    bits = np.frombuffer(data, np.uint8, int(of_block.sum()), len(MAGIC))
    found = Code(lengths).decode(bits, points, min(stride, tokens))
    # only the last point of a block may have fewer tokens than the stride
    full = np.full(len(points), found.shape[1])
    full[np.cumsum(lanes) - 1] = in_block - (lanes - 1) * stride
    ids = found.reshape(-1) if full.min() == found.shape[1] else found[np.arange(found.shape[1]) < full[:, None]]
    return [None if x else int(k) for k, x in zip(keys, null)], of_doc, ids


def write_files(encoded: DataFrame, code: Code, wide: str, folder: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes all documents in ascending key order; the staged manifest has a row
    for each file: part, seq, path, docs, tokens. Rows are range-partitioned by
    the key and, among equal keys, by what they hold, so that one key cannot
    fill a partition."""
    lengths = code.lengths.tobytes()
    spark = encoded.sparkSession
    n = partitions(spark)
    ranged = encoded.where("counts IS NULL").select("key", "ids").withColumn("tie", F.xxhash64("ids")).repartitionByRange(n, F.asc_nulls_first("key"), "tie").sortWithinPartitions(F.asc_nulls_first("key"), "tie", "ids").select("key", "ids")
    files.make_folder(folder)

    def run(batches):
        own, part, seq = Code(np.frombuffer(lengths, np.uint8)), TaskContext.get().partitionId(), 0
        keys, rows, held = [], [], 0

        def close():
            nonlocal keys, rows, held, seq
            path = f"{folder}/part-{part:06d}-{seq:06d}.tok"
            step = np.dtype(wide).itemsize
            files.write(path, pack(own, keys, [len(x) // step for x in rows], np.frombuffer(b"".join(rows), wide)))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "docs": len(keys), "tokens": held}], schema=MANIFEST)
            keys, rows, held, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for key, ids in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                rows.append(ids.as_py())
                held += len(rows[-1]) // np.dtype(wide).itemsize
                if held >= file_tokens:
                    yield close()
        if keys:
            yield close()

    return stage(ranged.mapInArrow(run, "part bigint, seq bigint, path string, docs bigint, tokens bigint"), "manifest")


MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def read_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decodes every file of the manifest: key, start (tokens before the
    document in the whole corpus), n_tokens, ids_crc32 of the ids as
    little-endian unsigned 32-bit integers."""
    # a row for each part that wrote, as many as there are partitions
    before, total = {}, 0
    for row in sorted(manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()):
        before[row.part], total = total, total + row.tokens
    from pyspark.sql import Window

    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(in_part), F.lit(0)).alias("start"))
    n_files = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for part, path, start in zip(*(x.to_pylist() for x in batch.columns)):
                keys, of_doc, ids = unpack(files.read(path))
                data = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(of_doc, dtype=np.int64)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), of_doc.tolist())]
                columns = [pa.array(keys, pa.int64()), pa.array(ends - of_doc + start + before[part]), pa.array(of_doc.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids_crc32"])

    return placed.repartition(n_files, "path").mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_corpus(docs: DataFrame, tokenizer: str, end_id: int, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT, file_tokens: int = FILE_TOKENS, special_as_text: bool = False) -> DataFrame:
    """Encodes whole texts with the tokenizers library, appends ``end_id``, codes
    the ids by their counts in the whole corpus and writes them in ascending key
    order. Returns the staged manifest of the files.

    A null text is as an empty one. Null keys come first; rows with equal keys
    (repeated rows too) all stay, in an order fixed by their ids. An empty table
    makes no file. Keys are integers. Other columns are not looked at, whatever
    their names. Memory of a task: one file's ids, or one document's if that is
    longer.

    Strings of special tokens in a text become those tokens' ids, as the library has
    it by default; with ``special_as_text`` they are text like any other, which is
    what a corpus from untrusted sources should have.
    """
    spark = docs.sparkSession
    coder = library(tokenizer)
    encoded = stage(encode_ids(docs, tokenizer, end_id, key=key, text=text, special_as_text=special_as_text), "ids", long_rows=False)
    code = Code(code_lengths(count_ids(encoded, coder.size), max(limit, (coder.size - 1).bit_length())))
    manifest = write_files(encoded, code, coder.wide, new_folder(spark, "tokens"), file_tokens)
    delete(spark, encoded.staged_path)
    return manifest
