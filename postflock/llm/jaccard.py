"""Jaccard join of shingle sets, size-aware: subsets for small sets, inverted
lists for large ones.

Two sets of sizes s and t with Jaccard similarity of at least 9/10 share at
least c = ceil(9 (s + t) / 19) elements, thus a subset of size c. (Numbers here are
those of op8; shingles' words and the similarity are parameters.) Small sets list
their subsets of all sizes c that a partner may ask for, and meet on them. Large
sets meet on inverted lists of single elements; with one order of all elements
it is enough to list the first s - ceil(9 s / 10) + 1 of each set. Where the
boundary lies is decided by the number of rows either way makes.

The order puts elements that stand in very many lists last, and goes by hash
otherwise. All sets of a list are first compared with one pivot of it, what is
linked is joined into components, and only pairs from different components of
a list are compared after that: groups of near copies are linked without listing
their pairs, and no pair that might join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .core import broadcast_if_small, delete, most_frequent, once_per_worker, partitions, pick, settled, stage, without


class Likeness(NamedTuple):
    """Words of a shingle, and the least similarity num / den."""

    words: int
    num: int
    den: int


#: What op8's contract asks for.
OP8 = Likeness(3, 9, 10)
#: Lists of so many sets count as long, and at most this many of the longest in
#: each of two searches.
LONG_LIST, LONG_LISTS = 40, 100_000
#: The largest boundary that is tried, and rows of a list against one of a subset.
MOST_SMALL, LIST_COST = 24, 3
SMALL = 300_000
#: Members of a list that meet in one group.
BLOCK = 1024
#: Node of a row without key; keys must be less.
NO_KEY = 1 << 62
CACHE = 200_000
#: Cells over which a set's elements are counted, for a bound on what two share.
CELLS = 256

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * B
    return x ^ (x >> np.uint64(29))


def turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of so many words; of fewer words, one
    hash of all."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    known = once_per_worker("shingles", dict)
    try:
        hashes = list(map(known.__getitem__, found))
    except KeyError:
        if len(known) > CACHE:
            known.clear()
        for word in set(found).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = list(map(known.__getitem__, found))
    h = np.array(hashes, np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64) * A
    for j in range(n):
        out = mix(turn(out, 23) * A + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def least_overlap(s, t, like: Likeness = OP8):
    """Elements that sets of these sizes share at least."""
    return -(-like.num * (s + t) // (like.num + like.den))


def listed(n, like: Likeness):
    """How many first elements of a set of size n stand in lists."""
    return n - -(-like.num * n // like.den) + 1


def subset_sizes(n: int, boundary: int, like: Likeness) -> list[int]:
    """Sizes of common subsets that partners of at most ``boundary`` ask for."""
    partners = [t for t in range(1, boundary + 1) if like.den * min(n, t) >= like.num * max(n, t)]
    return sorted({c for t in partners if (c := least_overlap(n, t, like)) <= min(n, t)})


def subsets(sets: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Hashes of all subsets of these sizes: sums of the elements' hashes, of
    which the left-out ones are taken away."""
    values, out = mix(sets * C), []
    for size in sizes:
        todo = [(np.array([values.sum()], np.uint64), np.array([-1]))]
        for _ in range(len(sets) - size):
            grown, last = todo[-1]
            # leave out one more, after the last one left out
            pairs = [(i, j) for i in range(len(grown)) for j in range(last[i] + 1, len(values))]
            at, gone = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
            todo.append((grown[at] - values[gone], gone))
        sums = todo[-1][0]
        out.append(mix(sums * A + np.uint64(size)))
    return out


def rows_made(sizes: dict[int, int], like: Likeness, b: int) -> int:
    """The cost of a boundary, given how many small sets have which size."""
    small = sum(n * comb(s, c) for s, n in sizes.items() if s <= b for c in subset_sizes(s, b, like))
    lists = sum(LIST_COST * n * listed(s, like) for s, n in sizes.items() if like.den * s >= like.num * (b + 1))
    return small + lists


def boundary(cost: Callable[[int], int]) -> int:
    """The boundary of least cost."""
    return min(range(MOST_SMALL + 1), key=lambda b: (cost(b), b))


SKETCH = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.list_(pa.int64())), ("cells", pa.binary())])


def sketch(docs: DataFrame, like: Likeness) -> DataFrame:
    """key, rid, n, two digests of the set, somewhat more of its first elements by hash
    than lists need, and how many elements fall into each cell (no cells if a
    number might not fit)."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                n, d1, d2, first, cells = [], [], [], [], []
                for value in batch.column(1):
                    s = shingles(value.as_py(), like.words)
                    n.append(len(s))
                    d1.append(int(mix(s * B).sum().view(np.int64)) if len(s) else 0)
                    d2.append(int(mix(s * C).sum().view(np.int64)) if len(s) else 0)
                    first.append(s[: listed(len(s), like) * 13 // 10 + 8 if len(s) > MOST_SMALL else len(s)].view(np.int64))
                    cells.append(np.bincount((s >> np.uint64(17)) % np.uint64(CELLS), minlength=CELLS).astype("<u2").tobytes() if len(s) < 1 << 16 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(cells, pa.binary())], schema=SKETCH)

    return docs.mapInArrow(run, "key bigint, rid bigint, n bigint, d1 bigint, d2 bigint, first array<bigint>, cells binary")


POSTINGS = "b bigint, id bigint, n int, pos int, kind int"


def post(n: int, element: np.ndarray, heavy: np.ndarray, small: int, like: Likeness) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, positions, kind) of one set whose first or all elements are given;
    kind 0 are lists, 1 long lists, 2 subsets. None if more elements are needed."""
    out = []
    if n <= small:
        for x in subsets(element, subset_sizes(n, small, like)):
            out.append((x, np.zeros(len(x), np.int32), 2))
    if like.den * n >= like.num * (small + 1):
        want = listed(n, like)
        at = np.searchsorted(heavy, element)
        is_long = heavy[np.minimum(at, len(heavy) - 1)] == element if len(heavy) else np.zeros(len(element), bool)
        light = element[~is_long]
        if len(light) < want and len(element) < n:
            return None
        out.append((light[:want], np.arange(min(want, len(light)), dtype=np.int32), 0))
        if len(light) < want:
            rest = element[is_long][: want - len(light)]
            out.append((rest, np.arange(len(light), want, dtype=np.int32), 1))
    return out


def _rows(found: list[tuple[int, int, list]]) -> pa.RecordBatch:
    b, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    ids, ns, kinds, lengths = [], [], [], []
    for key, n, parts in found:
        for x, p, kind in parts:
            b.append(x)
            pos.append(p)
            ids.append(key)
            ns.append(n)
            kinds.append(kind)
            lengths.append(len(x))
    columns = [pa.array(np.concatenate(b).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), lengths)), pa.array(np.repeat(np.array(ns, np.int32), lengths)), pa.array(np.concatenate(pos)), pa.array(np.repeat(np.array(kinds, np.int32), lengths))]
    return pa.RecordBatch.from_arrays(columns, names=["b", "id", "n", "pos", "kind"])


def long_lists(classes: DataFrame, docs: DataFrame, small: int, like: Likeness) -> np.ndarray:
    """Elements that stand in very many sets, at most LONG_LISTS: first of the
    sets' first elements, then, for sets of which so many are long that others
    take their place, of all elements. Any choice gives right results."""
    large = classes.where(F.col("n") * like.den >= like.num * (small + 1))

    def longest(elements: DataFrame) -> np.ndarray:
        counts = stage(elements.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LONG_LIST), "long")
        rows = most_frequent(counts, "c", LONG_LISTS).collect()
        return np.array([r.b for r in rows], np.int64).view(np.uint64)

    heavy = np.sort(longest(large.select(F.explode("first").alias("b"))))
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def lacking(batches):
        for batch in batches:
            short = [key for key, n, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)) if post(n, first.values.to_numpy(zero_copy_only=False).view(np.uint64), shared.value, 0, like) is None]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64())], names=["id"])

    def elements(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for value in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(value.as_py(), like.words).view(np.int64))], names=["b"])

    if not len(heavy):
        return heavy
    short, _ = broadcast_if_small(stage(large.select("id", "n", "first").mapInArrow(lacking, "id bigint"), "short"), SMALL)
    more = longest(docs.join(short, docs["key"] == short["id"], "left_semi").select("text").mapInArrow(elements, "b bigint"))
    return np.unique(np.concatenate([heavy, more]))


def postings(reps: DataFrame, docs: DataFrame, heavy: np.ndarray, small: int, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Two staged tables: rows from the first elements, of which those of kind -1 only say
    that more are needed, and rows of the sets that need more, from their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # at most 2 LONG_LISTS

    def from_first(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                found, more = [], []
                for key, n, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    element = first.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    parts = post(n, element, shared.value, small, like)
                    if parts is None:
                        more.append((key, n, [(np.zeros(1, np.uint64), np.zeros(1, np.int32), -1)]))
                    else:
                        found.append((key, n, parts))
                yield _rows(found + more)

    def from_text(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                found = []
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    s = shingles(value.as_py(), like.words)
                    found.append((key, len(s), post(len(s), s, shared.value, small, like)))
                yield _rows(found)

    made = stage(reps.select("id", "n", "first").mapInArrow(from_first, POSTINGS), "postings")
    # written first: their number, not that of all postings, decides whether texts are moved
    short, _ = broadcast_if_small(stage(made.where("kind = -1").select("id").distinct(), "short"), SMALL)
    again = docs.join(short, docs["key"] == short["id"], "left_semi").dropDuplicates(["key", "text"]).mapInArrow(from_text, POSTINGS)
    return made, stage(again, "postings")


def pivoted(posts: DataFrame, *by: str) -> DataFrame:
    """Lists of more than one set: (by, p, size), p being the list's first set."""
    return posts.groupBy(*by).agg(F.min(F.struct("pos", "id", "n")).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")


def light_lists(posts: DataFrame) -> DataFrame:
    """Rows of kind 0 that meet others, with their pivots. Both sides of the join ask for
    the same columns, so that the rows are dealt out once for both."""
    dealt = posts.where("kind = 0").select("b", "id", "n", "pos").repartition(partitions(posts.sparkSession), "b")
    return dealt.join(pivoted(dealt, "b"), "b").withColumn("kind", F.lit(0))


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables from which nothing more is read."""
    for x in tables:
        delete(x.sparkSession, x.staged_path)


def alike(n1: str, n2: str, like: Likeness) -> F.Column:
    """Whether sets of these sizes may be similar."""
    return F.least(n1, n2) * like.den >= F.greatest(n1, n2) * like.num


def fits(n1: str, p1: str, n2: str, p2: str, like: Likeness) -> F.Column:
    """Whether sets with a common element at these places may be similar, if it is
    their first common one."""
    room = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
    return alike(n1, n2, like) & (room * (like.num + like.den) >= (F.col(n1) + F.col(n2)) * like.num)


def reach(shared: str, n1: str, n2: str, like: Likeness) -> F.Column:
    """Whether sets of which so many listed elements are common may be similar. Lists
    hold each set's first elements in one order. Of the set whose listed part ends
    first, every common element that is not counted comes after that part."""
    # a whole number: n without its listed elements, ceil(num n / den) - 1
    after = lambda n: F.floor((F.col(n) * like.num + like.den - 1) / like.den) - 1
    return (F.col(shared) + F.greatest(after(n1), after(n2))) * (like.num + like.den) >= (F.col(n1) + F.col(n2)) * like.num


def may_be_similar(pairs: DataFrame, classes: DataFrame, like: Likeness, *more: str) -> DataFrame:
    """``pairs`` (a, b, ...) without those that cannot be similar: in each cell two
    sets share at most the lesser of their numbers there."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("cells").alias(f"c{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *more, "ca", "cb", "na", "nb")

    def run(batches):
        for batch in batches:
            at = len(more) + 2
            known = np.array([x.is_valid and y.is_valid for x, y in zip(batch.column(at), batch.column(at + 1))], bool)
            x, y = (np.frombuffer(b"".join(v.as_py() for v, k in zip(batch.column(at + i), known) if k), "<u2").reshape(-1, CELLS) for i in (0, 1))
            most = np.full(len(known), 1 << 40, np.int64)
            most[known] = np.minimum(x, y).sum(1, dtype=np.int64)
            total = batch.column(at + 2).to_numpy() + batch.column(at + 3).to_numpy()
            yield batch.select(["a", "b", *more]).filter(pa.array(most * (like.num + like.den) >= like.num * total))

    return both.mapInArrow(run, ", ".join(f"`{x}` {t}" for x, t in both.dtypes[: len(more) + 2]))


def verify(pairs: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """``pairs`` (a, b), staged -> those whose whole sets are similar."""
    nodes = stage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "nodes")
    nodes, _ = broadcast_if_small(nodes, SMALL)

    def whole(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [shingles(x.as_py(), like.words).tobytes() for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    sets = stage(docs.join(nodes, docs["key"] == nodes["id"], "left_semi").mapInArrow(whole, "id bigint, s binary"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(common * like.den >= like.num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stage(both.mapInArrow(compare, "a bigint, b bigint"), "links")
    drop(sets)
    return links


@settled("grouped")
def _grouped(docs: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """key, rid (of key and text), n, node: the least node of the row's component,
    null for a row without shingles."""
    spark = docs.sparkSession
    rows = pick(docs, key=key, text=text).select(F.col("key").cast("bigint").alias("key"), "text")
    wide = stage(sketch(rows.withColumn("rid", F.xxhash64("key", "text")), like), "sketches")
    made = stage(wide.drop("first", "cells"), "rows")
    # a row without key gets a node that no key has; its text is found by it
    unkeyed = made.where("key IS NULL AND n > 0").limit(1).count() > 0
    node = F.coalesce("key", F.col("d1").bitwiseAND(F.lit(NO_KEY - 1)).bitwiseOR(F.lit(NO_KEY)))
    own = wide.withColumn("node", node)
    texts = rows.where("key IS NOT NULL")
    if unkeyed:
        texts = texts.unionByName(_node_texts(rows.where("key IS NULL"), like))
    classes = stage(own.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("node").alias("id"), F.first("first").alias("first"), F.first("cells").alias("cells")), "classes")
    drop(wide)
    sizes = {r.n: r["count"] for r in classes.where(F.col("n") <= 2 * MOST_SMALL).groupBy("n").count().collect()}
    small = boundary(partial(rows_made, sizes, like))
    heavy = long_lists(classes, texts, small, like)
    first, more = postings(classes, texts, heavy, small, like)
    posts = first.where("kind >= 0").unionByName(more)

    # lists of more than one set, each with a pivot
    light, other = light_lists(posts), posts.where("kind > 0")
    hubs = stage(pivoted(other, "b", "kind"), "hubs")
    hubs, _ = broadcast_if_small(hubs, SMALL)
    lists = stage(light.unionByName(other.join(hubs, ["b", "kind"]).select(light.columns)).select("b", "id", "n", "pos", "kind", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos")), "lists")
    drop(first, more)
    near = lists.where((F.col("id") != F.col("pid")) & fits("n", "pos", "pn", "ppos", like)).groupBy("id", "pid").agg(F.count(F.lit(1)).alias("shared"))
    # of a set's pivots the one with which it shares the most lists; what that misses
    # is found below
    best = near.groupBy("id").agg(F.max_by("pid", F.struct("shared", -F.col("pid"))).alias("pid"))
    best = stage(best.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct(), "best")
    pairs = stage(may_be_similar(best, classes, like), "pairs")
    links, checked = verify(pairs, texts, like), pairs
    found = components(links)

    # pairs from different components of a list
    known, _ = broadcast_if_small(found.withColumnRenamed("id", "node"), SMALL)
    inside = stage(lists.join(known, F.col("id") == F.col("node"), "left").select("b", "kind", "id", "n", "pos", F.coalesce("component", "id").alias("c")), "members")
    drop(lists)
    mixed = inside.groupBy("b", "kind").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    mixed = stage(mixed.select("b", "kind", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "mixed")
    mixed, _ = broadcast_if_small(mixed, SMALL)
    # a long list is dealt out as pairs of blocks of its members
    parted = inside.join(mixed, ["b", "kind"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = parted.select("b", "kind", "id", "n", "pos", "c", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    left = members.select("b", "kind", "one", "two", F.col("part").alias("partx"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("c").alias("cx"))
    place = ["b", "kind", "one", "two"]
    once = (F.col("one") == F.col("two")) | (F.col("partx") != F.col("part"))
    cross = left.join(members, place).where(once & (F.col("x") < F.col("id")) & (F.col("cx") != F.col("c")) & alike("nx", "n", like))
    # all common lists of two sets in different components are here: they tell how many
    # of the sets' listed elements are common, and so how many elements can be at most
    cross = cross.groupBy(F.col("x").alias("a"), F.col("id").alias("b")).agg(F.count_if(F.col("kind") < 2).alias("shared"), F.max("kind").alias("kind"), F.bool_or(fits("nx", "px", "n", "pos", like)).alias("fit"), F.first("nx").alias("nx"), F.first("n").alias("n"))
    cross = cross.where("fit").where((F.col("kind") == 2) | reach("shared", "nx", "n", like)).select("a", "b")
    cross = stage(may_be_similar(cross.join(checked, ["a", "b"], "left_anti"), classes, like), "pairs")
    drop(inside)
    if not cross.isEmpty():
        found = components(links.unionByName(verify(cross, texts, like)))
    named, _ = broadcast_if_small(found.withColumnRenamed("id", "of"), SMALL)
    placed = classes.join(named, F.col("id") == F.col("of"), "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component"))
    return made.join(placed, ["n", "d1", "d2"], "left").select("key", "rid", "n", F.col("component").alias("node"))


def similar_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", like: Likeness = OP8) -> DataFrame:
    """A row for each row of ``docs``: key, n_shingles, component_id (the least key
    that links between similar sets reach, itself included).

    Null and empty texts, and those of white space alone, have no shingle and no
    links. Rows with equal sets are one set from the start. A row without key
    links like any other, but its key is no component's name: a group of such
    rows alone has a null component_id. Rows of one key with other texts are
    joined. Keys are integers below 2**62. An empty table gives no row. Other
    columns are not looked at, whatever their names.
    """
    name = F.when(F.col("node") < NO_KEY, F.col("node")).when(F.col("node").isNull(), F.col("key"))
    return _grouped(docs, key, text, like).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), name.alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", like: Likeness = OP8) -> DataFrame:
    """``docs``, all columns, with one row of each group of similar ones: that of
    the least key (of equal keys, of the least hash of the text; rows without key
    come last). Of rows that are repeated one stays. Rows without shingles, those of
    null, empty or blank texts, stay. Other columns may have any names; an empty
    table stays empty."""
    rows = _grouped(docs, key, text, like).where("node IS NOT NULL")
    first = rows.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("f"))
    first = first.select(F.col("f.key").alias("k"), F.col("f.rid").alias("r"))
    same = (F.col("rid") == F.col("r")) & F.col("key").eqNullSafe(F.col("k"))
    kept = without(docs, rows.join(first, same, "left_anti"), key, text, SMALL)
    again = stage(rows.join(first, same, "left_semi").groupBy("key", "rid").count().where("count > 1").select("key", "rid"), "repeated")
    if again.isEmpty():
        return kept
    # repeated rows: taken out, and one of each put back
    names = [f"c{i}_" for i in range(len(docs.columns))]
    plain = kept.toDF(*names)
    k, t = (names[docs.columns.index(x)] for x in (key, text))
    on = (F.xxhash64(F.col(k).cast("bigint"), F.col(t)) == F.col("rid")) & F.col(k).eqNullSafe(F.col("key"))
    one = plain.join(again, on, "left_semi").dropDuplicates([k, t])
    return plain.join(again, on, "left_anti").unionByName(one).toDF(*docs.columns)


def _node_texts(rows: DataFrame, like: Likeness) -> DataFrame:
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                nodes = []
                for value in batch.column(1):
                    s = shingles(value.as_py(), like.words)
                    nodes.append((int(mix(s * B).sum()) if len(s) else 0) & (NO_KEY - 1) | NO_KEY)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(1)], names=["key", "text"])

    return rows.mapInArrow(run, "key bigint, text string")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS x FROM d, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (x) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      WHERE 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n) GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""
