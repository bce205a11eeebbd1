"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one: the byte strings of a tiktoken file. Each
language has a probability for each piece, and a word's probability under a
language is the sum over all ways to cut the word into pieces, by the forward
algorithm; no segmentation is chosen. The probabilities are fitted by a few
rounds of expectation-maximisation, whose expected piece counts come from the
forward and backward sums.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .core import key_crc, once_per_worker, pick, without

#: Documents of each language that the model is fitted on, at most; those with
#: the least hash of their key.
SAMPLE = 500
ROUNDS = 3
#: Added to each piece's expected count in each language.
SMOOTH = 0.02
#: Words of more bytes are summed in logarithms, and so are those of which a sum is
#: less than TINY: no word is too long or too rare.
LONG, TINY = 48, 1e-280
#: Words of more bytes are scored byte by byte, and cut there before they are learnt
#: from, so that no table grows with a word.
CUT = 4096
#: Distinct words whose probabilities a worker keeps.
CACHE = 300_000
#: Bytes of words, all as long as the longest, whose lattices are built at a time.
STEP = 250_000
UNKNOWN = "und"
#: Nats a letter by which a text in a learnt language is above the background.
LEAST_GAIN = 0.0
#: More rejected documents than this are not broadcast.
SMALL = 300_000

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[dict, int]:
    """The trie of the vocabulary's pieces, and their number."""
    v = Vocabulary.load(path)
    trie: dict = {}
    for number, word in enumerate(v.bytes_of):
        node = trie
        for byte in word[:-1]:
            node = node.setdefault(byte, [-1, {}])[1]
        if word:
            node.setdefault(word[-1], [-1, {}])[0] = number
    return trie, len(v.bytes_of)


class Lattice:
    """All pieces in each of many words: edges (word, start, end, piece)."""

    def __init__(self, trie: dict, words: list[bytes]):
        word_of, starts, ends, piece = (array("i") for _ in range(4))
        for w, data in enumerate(words):
            for start in range(len(data)):
                node, end = trie, start
                for byte in data[start:]:
                    found = node.get(byte)
                    if found is None:
                        break
                    end += 1
                    token, node = found
                    if token >= 0:
                        word_of.append(w)
                        starts.append(start)
                        ends.append(end)
                        piece.append(token)
        self.n, self.length = len(words), np.array([len(x) for x in words], np.int64)
        self.word, self.start, self.end, self.piece = (np.array(x, np.int32) for x in (word_of, starts, ends, piece))

    def _sums(self, p: np.ndarray, at: np.ndarray, come: np.ndarray, first: np.ndarray, places, logs: bool) -> np.ndarray:
        """Adds up paths place by place: the edges with ``at`` == place, each with
        the sum where it comes from. With ``logs``, p and sums are logarithms."""
        shape = (self.length.max(initial=0) + 1, self.n, p.shape[0])
        out = np.full(shape, -np.inf) if logs else np.zeros(shape)
        out[first, np.arange(self.n)] = 0 if logs else 1
        order = np.lexsort((self.word, at))
        cuts = np.searchsorted(at[order], np.arange(len(out) + 1))
        for place in places(len(out)):
            edges = order[cuts[place] : cuts[place + 1]]
            if len(edges):
                word = self.word[edges]
                firsts = np.flatnonzero(np.diff(word, prepend=-1))
                before, step = out[come[edges], word], p[:, self.piece[edges]].T
                # an edge never ends where its word begins, so that nothing is there yet
                out[place, word[firsts]] = np.logaddexp.reduceat(before + step, firsts) if logs else np.add.reduceat(before * step, firsts)
        return out

    def forward(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        return self._sums(p, self.end, self.start, np.zeros(self.n, np.int64), lambda n: range(1, n), logs)

    def backward(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        return self._sums(p, self.start, self.end, self.length, lambda n: range(n - 2, -1, -1), logs)

    def totals(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        return self.forward(p, logs)[self.length, np.arange(self.n)]

    def is_long(self) -> bool:
        return bool(self.length.max(initial=0) > LONG)


def batches_of(words: list[bytes]) -> list[np.ndarray]:
    """Places of words, short ones first, in batches of bounded size."""
    order = np.argsort([len(x) for x in words], kind="stable")
    out, at = [], 0
    while at < len(order):
        # all are as long as the batch's last: find how many fit
        end = at + 1
        limit = LONG if len(words[order[at]]) <= LONG else CUT
        while end < len(order) and len(words[order[end]]) <= limit and (end + 1 - at) * len(words[order[end]]) <= STEP:
            end += 1
        out.append(order[at:end])
        at = end
    return out


def long_log(trie: dict, data: bytes, p: np.ndarray) -> np.ndarray:
    """log of the forward sum of one word of any length; sums are rescaled at
    each byte and only as many kept as the longest piece needs. Each single byte is
    a piece, so that every place is reached."""
    n, scale = p.shape[0], np.zeros(p.shape[0])
    waiting: dict[int, np.ndarray] = {0: np.ones(n)}
    for start in range(len(data)):
        here = waiting.pop(start, np.zeros(n))
        most = np.where(here > 0, here, 1)
        scale += np.log(most)
        here = here / most
        for x in waiting:
            waiting[x] = waiting[x] / most
        node, end = trie, start
        for byte in data[start : start + 256]:
            found = node.get(byte)
            if found is None:
                break
            end += 1
            token, node = found
            if token >= 0:
                waiting[end] = waiting.get(end, 0) + here * p[:, token]
    return scale + np.log(waiting[len(data)])


def shares(lattice: Lattice, p: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How probable it is that each edge is on the way of its word, in the language
    that ``of`` gives for the word."""
    edge, words = of[lattice.word], np.arange(lattice.n)
    if not lattice.is_long():
        a, b = lattice.forward(p), lattice.backward(p)
        total = a[lattice.length, words, of]
        if (total > TINY).all():
            return a[lattice.start, lattice.word, edge] * p[edge, lattice.piece] * b[lattice.end, lattice.word, edge] / total[lattice.word]
    logs = np.log(p)
    a, b = lattice.forward(logs, True), lattice.backward(logs, True)
    return np.exp(a[lattice.start, lattice.word, edge] + logs[edge, lattice.piece] + b[lattice.end, lattice.word, edge] - a[lattice.length, words, of][lattice.word])


def fit(counts: list[tuple[str, str, int]], languages: list[str], vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (languages, pieces) from counts of (language, word)."""
    trie, size = pieces(vocabulary)
    place = {x: i for i, x in enumerate(languages)}
    rows = [(place[lang], data[at : at + CUT], n) for lang, word, n in counts for data in [(" " + word).encode()] for at in range(0, len(data), CUT)]
    language, weight = np.array([x[0] for x in rows], np.int64), np.array([x[2] for x in rows], float)
    p = np.full((len(languages), size), 1 / size)
    lattices = [(some, Lattice(trie, [rows[i][1] for i in some])) for some in batches_of([x[1] for x in rows])]
    for turn in range(rounds + 1):
        expected = np.zeros_like(p)
        for some, lattice in lattices:
            of = language[some]
            if turn == 0:  # from all pieces alike: how often each occurs, by its length
                share = (lattice.end - lattice.start).astype(float)
            else:
                share = shares(lattice, p, of)
            expected += np.bincount(of[lattice.word] * size + lattice.piece, share * weight[some][lattice.word], len(languages) * size).reshape(expected.shape)
        p = (expected + SMOOTH) / (expected.sum(1, keepdims=True) + SMOOTH * size)
    return p


class Scorer:
    def __init__(self, languages: list[str], p: np.ndarray, vocabulary: str):
        trie, size = pieces(vocabulary)
        # after the languages: all pieces alike, the background of texts in none of them
        self.languages, self.p, self.trie = languages, np.concatenate([p, np.full((1, size), 1 / size)]), trie
        self.kept: dict[str, int] = {}
        self.logs = np.zeros((1 << 14, len(self.p)))

    def _learn(self, words: list[str]) -> None:
        if len(self.kept) + len(words) > CACHE:
            self.kept.clear()
        while len(self.kept) + len(words) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        data = [(" " + x).encode() for x in words]
        logs = np.empty((len(words), len(self.p)))
        inside = np.flatnonzero([len(x) <= CUT for x in data])
        for batch in batches_of([data[i] for i in inside]):
            lattice, some = Lattice(self.trie, [data[i] for i in inside[batch]]), inside[batch]
            found = None if lattice.is_long() else lattice.totals(self.p)
            if found is None or (found <= TINY).any():
                logs[some] = lattice.totals(np.log(self.p), True)
            else:
                logs[some] = np.log(found)
        for i, x in enumerate(data):
            if len(x) > CUT:
                logs[i] = long_log(self.trie, x, self.p)
        base = len(self.kept)
        self.logs[base : base + len(words)] = logs
        self.kept.update(zip(words, range(base, base + len(words))))

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, posterior, gain) of each text; the gain is by how much its
        logarithm is above the background's, for each letter."""
        found = [words_of(x) for x in texts]
        out = []
        new = {x for row in found for x in row if x not in self.kept}
        if len(self.kept) + len(new) > CACHE:
            new = {x for row in found for x in row}
        self._learn(list(new))
        for row in found:
            if not row or not self.languages:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            sums = self.logs[np.fromiter(map(self.kept.__getitem__, row), np.int64, len(row))].sum(0)
            of, background = sums[:-1], sums[-1]
            weights = np.exp(of - of.max())
            best = int(of.argmax())
            out.append((self.languages[best], float(weights[best] / weights.sum()), float(of[best] - background) / sum(map(len, row))))
        return out


def learn(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, held_out: tuple[int, int] | None = (4, 2), rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities, from at most about
    ``sample`` documents of each language (a share of each by the hash of key and
    text, so that copies and one key's rows count like any other). With
    ``held_out`` (m, r), documents whose crc32 of the key is r modulo m are not
    learnt from, nor are those without text or language. Repeated rows count as
    often as they stand there, null keys are never held out, and a word counts
    whatever its length. An empty table gives no language."""
    source = pick(docs, key=key, text=text, lang=lang).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if held_out:
        source = source.where(key_crc(F.col("key"), held_out[0]) != held_out[1])
    sizes = {r.lang: r.n for r in source.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, pieces(vocabulary)[1]))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample / n))) for x, n in sizes.items()])
    # 30 bits of a hash, against the language's share
    chosen = source.where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < share * float(1 << 30)).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs, words = [], []
            for of, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words_of(value.as_py())
                langs += [of] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    counts = chosen.mapInArrow(count, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "word")
    return languages, fit([tuple(r) for r in counts.collect()], languages, vocabulary, rounds)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str, *, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs``: key, the columns ``also``, lang_pred, score
    (the posterior of the predicted language under equal priors, 0 to 1) and gain
    (how far the text's log-probability under that language is above that under
    all pieces alike, in nats a letter).

    A text that is null or has no letter, and any text if no language was learnt,
    gets ``und`` and zeros. Texts count whole, whatever their length. Of languages
    that are equally probable the first by name is predicted. Keys are handed on as
    they are, null or not; repeated rows each get their row, and an empty table
    gives none. Other columns are not looked at, whatever their names."""
    languages, p = model
    name = f"langid {hash((tuple(languages), p.tobytes()))}"
    shared = docs.sparkSession.sparkContext.broadcast((languages, p.astype(np.float32)))
    rows = pick(docs, text_=text, **{x: x for x in (key, *also)})
    fields = rows.schema.fields[1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, gain double"
    names = [f.name for f in fields] + ["lang_pred", "score", "gain"]

    def run(batches):
        learnt, values = shared.value
        scorer = once_per_worker(name, lambda: Scorer(learnt, values.astype(float), vocabulary))
        for batch in batches:
            found, waiting, size = [], [], 0
            for value in batch.column(0):
                waiting.append(value.as_py())
                size += len(waiting[-1] or "")
                if size > 4_000_000:
                    found += scorer.score(waiting)
                    waiting, size = [], 0
            found += scorer.score(waiting)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], names=names)

    return rows.mapInArrow(run, schema)


def accept(docs: DataFrame, vocabulary: str, *, least: float = 0.5, gain: float = LEAST_GAIN, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``docs``, all columns, without the rows that have no letter, whose best language
    is less probable than ``least``, or that no language explains better by ``gain``
    than the background does: letters of scripts that were not learnt, and noise. The
    model is learnt from ``docs``; if no row has a language, only rows without letters
    go.

    Null and empty texts have no letter. Repeated rows stay or go together, rows of
    one key with other texts each by their own; null keys are keys like any other.
    Other columns may have any names. An empty table stays empty."""
    model = learn(docs, vocabulary, key=key, text=text, lang=lang, held_out=None)
    rows = pick(docs, key=key, text=text).withColumn("key", F.col("key").cast("bigint")).withColumn("rid", F.xxhash64("key", "text"))
    found = identify(rows, model, vocabulary, key="key", also=("rid",))
    # texts themselves do not pass through Python again: what goes is few
    gone = found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least) | (F.col("gain") < gain)) if model[0] else rows.where(~F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    return without(docs, gone, key, text, SMALL)
