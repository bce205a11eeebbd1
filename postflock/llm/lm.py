"""A log-bilinear language model, trained by noise-contrastive estimation.

Words fall into classes: each of the most frequent words is one of its own,
others share one by the hash of their last letters; the end of a text is a
class too. The neural model gives the class of the next token from that of the
token before it: the context's vector, through a matrix, times each class's
vector, plus a bias. Inside a class a word has its share of the class's tokens
by the counts of the whole training corpus, with one added to each word and one
more for unseen ones, so that all probabilities add up to one.

The model grows with the corpus: it has more classes, by a power of the number of
tokens, and each token of each training text is learnt from once. Tasks read their
texts in rounds; in each, every task goes on from the same parameters, and their
results are averaged, a class's by how often the task met it. The normalising sums
after all contexts come from batched matrix products; scoring a text then takes
one product of two vectors a token.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import key_crc, most_frequent, partitions, pick, settled, stage

#: Classes are CLASSES * tokens ** GROWTH; three in four are words of their own.
CLASSES, GROWTH = 16, 0.4
#: Words whose counts every task holds; more only if more have classes.
COMMON = 200_000
#: Width, noise samples of a batch, pairs of a batch, rate.
WIDTH, NOISE, BATCH, RATE = 32, 64, 1024, 0.1
#: Shares of the texts, of a hundred, that are learnt from in each round.
ROUNDS = (10, 30, 60)
#: Classes whose parameters are one row of a table.
CHUNK = 512
LN10 = float(np.log(10))


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.encode().lower().split() if text else []


class Classes:
    def __init__(self, frequent: list[bytes], endings: int):
        self.of = {w: i for i, w in enumerate(frequent)}
        self.first, self.endings = len(frequent), endings
        self.end = self.first + endings
        self.size = self.end + 1

    def other(self, word: bytes) -> int:
        return self.first + zlib.crc32(word[-3:]) % self.endings

    def get(self, word: bytes) -> int:
        found = self.of.get(word)
        return self.other(word) if found is None else found


def classes_for(tokens: int) -> tuple[int, int]:
    """Words with classes of their own, and classes of endings."""
    size = max(8, int(CLASSES * tokens**GROWTH))
    return size * 3 // 4, size - size * 3 // 4 - 1


class NoiseContrastive:
    """s(h, w) = (R[h] C) . Q[w] + b[w], trained to tell pairs from noise. ``unigram``
    has each class's share of all tokens. Each row keeps the sum of its squared
    gradients, by which its steps get smaller."""

    def __init__(self, unigram: np.ndarray, width: int = WIDTH, seed: int = 1):
        rng, size = np.random.default_rng(seed), len(unigram)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.unigram = unigram / unigram.sum()
        self.p = {"R": draw(size, width), "Q": draw(size, width), "b": np.log(self.unigram).astype(np.float32)[:, None], "C": np.eye(width, dtype=np.float32)}
        self.squares = {k: np.full(len(v) if k != "C" else v.shape, 1e-6, np.float32) for k, v in self.p.items()}
        self.met = {k: np.zeros(size) for k in "RQ"}

    def begin(self, seed: int) -> None:
        """Ready to learn: noise is drawn by ``seed``, what is met is counted anew."""
        self.rng, self.words = np.random.default_rng(seed), np.cumsum(self.unigram)
        self.log_unigram = np.log(self.unigram).astype(np.float32)
        for x in self.met.values():
            x[:] = 0

    def learn(self, h: np.ndarray, w: np.ndarray, noise: int = NOISE, rate: float = RATE) -> None:
        """One step on pairs of a context and the class after it."""
        p = self.p
        k = np.minimum(np.searchsorted(self.words, self.rng.random(noise)), len(self.words) - 1)
        c = p["R"].take(h, 0)
        v, qw, qk = c @ p["C"], p["Q"].take(w, 0), p["Q"].take(k, 0)
        # probability that a pair is data, of the pairs and of the shared noise
        bias = lambda x: p["b"][x, 0] - self.log_unigram[x] - np.float32(np.log(noise))
        up = 1 / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", v, qw) + bias(w), 30)))
        down = v @ qk.T
        down += bias(k)
        np.negative(down, down)
        np.minimum(down, 30, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        dv = up[:, None] * qw + down @ qk
        both = np.concatenate([w, k])
        grads = [(h, {"R": dv @ p["C"].T}), (both, {"Q": np.concatenate([up[:, None] * v, down.T @ v]), "b": np.concatenate([up, down.sum(0)])[:, None]})]
        of_c = c.T @ dv / len(h)
        for where, of in grads:
            order = np.argsort(where, kind="stable")
            firsts = np.flatnonzero(np.diff(where[order], prepend=-1))
            rows = where[order[firsts]]
            for name, g in of.items():
                total = np.add.reduceat(g.take(order, 0), firsts, axis=0) / len(h)
                self.squares[name][rows] += np.einsum("ij,ij->i", total, total) / total.shape[1]
                p[name][rows] += rate * total / np.sqrt(self.squares[name][rows])[:, None]
                if name in self.met:
                    self.met[name][rows] += np.diff(np.append(firsts, len(where)))
        self.squares["C"] += of_c**2
        p["C"] += rate * of_c / np.sqrt(self.squares["C"])

    def log_sums(self, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        """ln of the sum over all classes of exp s(h, w), for some contexts h."""
        out = []
        for context in np.array_split(self.p["R"][some], max(1, len(self.p["R"][some]) // 256)):
            s = (context @ self.p["C"]) @ self.p["Q"].T + self.p["b"][:, 0]
            most = s.max(1, keepdims=True, initial=-np.inf)
            out.append((most + np.log(np.exp(s - most).sum(1, keepdims=True)))[:, 0])
        return np.concatenate(out)

    # a task's result, and the average of all tasks', as rows of CHUNK classes

    def rows(self):
        """(chunk, weighted sums of parameters); the last row is the matrix's."""
        size, times = len(self.unigram), {"R": self.met["R"], "Q": self.met["Q"], "b": self.met["Q"]}
        for at in range(0, size, CHUNK):
            part = slice(at, at + CHUNK)
            cells = [times[x][part, None] * np.concatenate([np.ones_like(self.squares[x][part, None]), self.squares[x][part, None], self.p[x][part]], 1) for x in "RQb"]
            yield at // CHUNK, np.concatenate(cells, 1).astype("<f8")
        total = self.met["R"].sum()
        yield -1, total * np.concatenate([np.ones((len(self.p["C"]), 1)), self.squares["C"], self.p["C"]], 1).astype("<f8")

    def take(self, chunk: int, sums: np.ndarray) -> None:
        """The average in place of a chunk's parameters; what no task met stays."""
        width = len(self.p["C"])
        if chunk < 0:
            if sums[0, 0] > 0:
                self.squares["C"], self.p["C"] = ((sums[:, a:b] / sums[:, :1]).astype(np.float32) for a, b in ((1, 1 + width), (1 + width, None)))
            return
        at = 0
        for name, n in (("R", width), ("Q", width), ("b", 1)):
            some = np.flatnonzero(sums[:, at] > 0)
            mean = sums[some, at : at + 2 + n] / sums[some, at, None]
            self.squares[name][chunk * CHUNK + some], self.p[name][chunk * CHUNK + some] = mean[:, 1], mean[:, 2:]
            at += 2 + n


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all texts; each task sums up what it reads."""

    def run(batches):
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for value in batch.column(0):
                counts.update(split(value.as_py()))
                if len(counts) > 1_000_000:
                    yield rows(counts)
                    counts = Counter()
            yield rows(counts)

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Known(dict):
    """Words' values as far as a task remembers them: those of ``fixed``, and of each
    other word what ``of`` gives, found when the word is first asked for."""

    def __init__(self, fixed: dict[bytes, int], of: Callable[[bytes], int], most: int = 600_000):
        super().__init__(fixed)
        self.fixed, self.of, self.most = fixed, of, max(most, len(fixed) + 1)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.fixed)
        found = self[word] = self.of(word)
        return found

    def values_of(self, words: list[bytes]) -> np.ndarray:
        """All words are looked up by one map, not by loops."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def look_up(words: list[bytes], logs: dict[bytes, float]) -> tuple[np.ndarray, dict[bytes, int]]:
    """The words' values in ``logs``, 0 where there is none, and how often each word
    without one occurs. All words are looked up by one map, not by loops."""
    found = np.fromiter(map(logs.get, words, repeat(-1.0)), float, len(words))
    rare: dict[bytes, int] = {}
    for i in np.flatnonzero(found < 0).tolist():
        rare[words[i]] = rare.get(words[i], 0) + 1
    return np.maximum(found, 0), rare


def classes_and_logs(words: list[bytes], places: dict[bytes, float], class_of: np.ndarray, log_of: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Classes of the words of a text and of its end, the words' logarithms, and how often
    each rare word occurs: ``places``, from 1 on, are those of common words in the two
    arrays, so that a word is looked up once. Rare words are given classes of endings."""
    found, rare = look_up(words, places)
    at = found.astype(np.int64)
    seq = np.append(class_of.take(at), classes.end)
    if rare:
        others = np.flatnonzero(at == 0)
        of = {w: classes.other(w) for w in rare}
        seq[others] = [of[words[i]] for i in others.tolist()]
    return seq, log_of.take(at), rare


def train_round(docs: DataFrame, classes: Classes, net: NoiseContrastive, number: int) -> None:
    """Lets tasks go on from ``net`` on their part of the texts ``docs`` (text), each
    token once, and takes the average. Tasks are as many as cores, and some more, so
    that what they send back is small against what they read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((classes, net))

    def run(batches):
        own, start = shared.value
        start.begin(1_000_003 * number + TaskContext.get().partitionId())
        known, held, size = Known(own.of, own.other), [], 0

        def steps(all_of_them: bool):
            nonlocal held, size
            pairs = np.concatenate(held, 1)
            end = pairs.shape[1] if all_of_them else pairs.shape[1] // BATCH * BATCH
            for at in range(0, end, BATCH):
                start.learn(*pairs[:, at : min(at + BATCH, end)])
            held, size = [pairs[:, end:]], pairs.shape[1] - end

        for batch in batches:
            for value in batch.column(0):
                words = split(value.as_py())
                pairs = np.full((2, len(words) + 1), own.end)
                pairs[0, 1:] = pairs[1, :-1] = known.values_of(words)
                held.append(pairs)
                size += len(words) + 1
                if size > 100 * BATCH:
                    steps(False)
        if size:
            steps(True)
            found = list(start.rows())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["chunk", "sums"])

    def add(batches):
        here, total = None, None
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(data.as_buffer(), "<f8")
                if chunk != here:
                    if here is not None:
                        yield row(here, total)
                    here, total = chunk, np.zeros(len(values))
                total = total + values
        if here is not None:
            yield row(here, total)

    def row(chunk, total):
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "sums"])

    schema = "chunk int, sums binary"
    tasks = 2 * spark.sparkContext.defaultParallelism
    made = stage(docs.select("text").coalesce(tasks).mapInArrow(run, schema), "steps")
    # rows of a chunk are as many as tasks, and are added up one by one
    for r in stage(made.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(add, schema), "round").collect():
        sums = np.frombuffer(bytes(r.sums), "<f8")
        width = 2 * len(net.p["C"]) + 1 if r.chunk < 0 else 2 * len(net.p["C"]) + 7
        net.take(r.chunk, sums.reshape(-1, width))


def normalise(docs: DataFrame, net: NoiseContrastive) -> np.ndarray:
    """ln of the normalising sum after each context, computed by all tasks."""
    spark, size = docs.sparkSession, len(net.unigram)
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                sums = shared.value.log_sums(slice(at, at + CHUNK))
                yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(sums))), pa.array(sums.astype(float))], names=["h", "z"])

    out = np.zeros(size)
    for r in stage(spark.range(0, size, CHUNK, partitions(spark)).mapInArrow(run, "h bigint, z double"), "sums").collect():
        out[r.h] = r.z
    return out


class Model:
    """What scoring needs and every task holds. Its size is a power of the corpus's
    less than a half, and the counts of the COMMON words."""

    def __init__(self, classes, net, sums, common, total, distinct, share):
        self.classes, self.common, self.total, self.distinct, self.share = classes, common, total, distinct, share
        # natural logarithms: before[h] . after[w] + bias[w] - sums[h]
        self.before, self.after, self.bias, self.sums = net.p["R"] @ net.p["C"], net.p["Q"], net.p["b"][:, 0], sums

    def logs(self, seq: np.ndarray) -> np.ndarray:
        """log10 P(class | class before) of the classes of a text, from its start on."""
        out = np.empty(len(seq))
        for at in range(0, len(seq), 1 << 16):  # long texts piece by piece
            w = seq[at : at + (1 << 16)]
            h = np.concatenate([seq[at - 1 : at] if at else [self.classes.end], w[:-1]])
            out[at : at + len(w)] = np.einsum("ij,ij->i", self.before.take(h, 0), self.after.take(w, 0)) + self.bias[w] - self.sums[h]
        return out / LN10


def learn(docs: DataFrame, texts: int) -> tuple[Model, DataFrame]:
    """From ``texts`` rows ``docs`` (text): the model and the staged counts of all
    words (word, c)."""
    counts = stage(count_words(docs), "words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the end is a token like a word, one for each text
    total, distinct = sums[0] + texts, sums[1] + int(texts > 0)
    own, endings = classes_for(total)
    top = sorted(((bytes(r.word), r.c) for r in most_frequent(counts, "c", max(COMMON, own)).collect()), key=lambda x: (-x[1], x[0]))
    classes = Classes([w for w, _ in top[:own]], endings)
    # of each class of endings: tokens, and tokens with one more for each word
    tokens, more = _class_sizes(counts, classes)
    unigram = np.concatenate([[c for _, c in top[:own]], tokens, [texts]]) + 0.5
    net = NoiseContrastive(unigram)
    turn = F.pmod(F.xxhash64("text"), F.lit(100))
    for number, share in enumerate(ROUNDS if texts else ()):
        low = sum(ROUNDS[:number])
        train_round(docs.where((turn >= low) & (turn < low + share)), classes, net, number)
    share = np.zeros(classes.size)
    share[classes.first : classes.end] = np.log10(more + 1)
    return Model(classes, net, normalise(docs, net), dict(top), total, distinct, share), counts


def _class_sizes(counts: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    shared = counts.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        own, out = shared.value, np.zeros((2, classes.endings))
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in own.of:
                    out[:, own.other(word) - own.first] += c, c + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.shape[1])), pa.array(out[0]), pa.array(out[1])], names=["k", "c", "v"])

    total = np.zeros((2, classes.endings))
    for r in counts.mapInArrow(run, "k bigint, c double, v double").groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        total[:, r.k] = r.c, r.v
    return total[0], total[1]


@settled("lm-scores")
def score_corpus(docs: DataFrame, *, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (7, 2)) -> DataFrame:
    """A row for each row of ``docs``: key, held_out, n_tokens (with the end),
    n_known, train_tokens, base_score (add-one unigrams), score (the model's log10
    probability of the text).

    All documents are learnt from but those whose crc32 of the key is r modulo m
    for ``held_out`` = (m, r); a null key is never held out. A null or empty text
    is an end alone. Rows that are repeated count as often as they stand there.
    With no document to learn from the counts are zero and no class is told from
    another by its context. Texts are scored whole; the words of one text are held at
    a time. Words that are equally frequent go by their bytes. Other columns are not
    looked at, whatever their names; an empty table gives no row.

    Tasks learn on their own between the rounds, so that ``score`` depends somewhat
    on how the table is dealt out to them; all else does not.
    """
    rows = pick(docs, key=key, text=text)
    held = key_crc(F.col("key"), held_out[0]) == held_out[1]
    training = rows.where(~held)
    texts = training.count()
    model, counts = learn(training, texts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["key"].dataType.simpleString()
    log_texts = float(np.log10(texts + 1))

    def run(batches):
        m = shared.value
        classes, share = m.classes, m.share
        # every word with a class of its own is common
        places = {w: i for i, w in enumerate(m.common, 1)}
        class_of = np.array([0, *map(classes.get, m.common)], np.int64)
        log_of = np.log10(np.array([0, *m.common.values()], float) + 1)
        for batch in batches:
            n_tokens, n_known, base, own, rare, times = [], [], [], [], [], []
            for value in batch.column(1):
                words = split(value.as_py())
                seq, logs, seen = classes_and_logs(words, places, class_of, log_of, classes)
                n_tokens.append(len(seq))
                n_known.append(len(words) - sum(seen.values()) + int(texts > 0))
                # the end was seen as often as texts were learnt from
                base.append(float(logs.sum()) + log_texts)
                # words that share a class have their part of it
                own.append(float(m.logs(seq).sum() - share[seq].sum() + logs[seq[:-1] >= classes.first].sum()))
                rare.append(list(seen))
                times.append(list(seen.values()))
            columns = [*batch.columns[::2], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "row", "n_tokens", "n_known", "base", "own", "rare", "times"])

    # a row's number is made once, here, and written
    numbered = rows.select("key", "text", F.monotonically_increasing_id().alias("row"))
    scored = stage(numbered.mapInArrow(run, f"key {kind}, row bigint, n_tokens bigint, n_known bigint, base double, own double, rare array<binary>, times array<bigint>"), "scored")
    # words that tasks do not hold meet their counts in a join, once for each text
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("met"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    out = scored.drop("rare", "times").join(met, "row", "left")
    base_of = float(np.log10(model.total + model.distinct + 1))
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("key").alias(key),
        (key_crc(F.col("key"), held_out[0]) == held_out[1]).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * base_of).alias("base_score"),
        (F.col("own") + more).alias("score"),
    )
