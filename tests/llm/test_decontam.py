import hashlib
import random
import re

from postflock.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(decontam.UPPER, decontam.LOWER)


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, bench):
    windows = {}
    for item, text, *_ in bench:
        w = words(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    out = []
    for key, text, *_ in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    items |= windows[tuple(w[s : s + n])]
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((-1 if key is None else key, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def run(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string, TEXT int")
    b = spark.createDataFrame(bench, "item_id long, text string, Item_Id int")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(d, b).collect())


def test_against_brute_force(spark):
    rng = random.Random(7)
    pool = ["the", "Of", "éa", "Éa", "x1", "ΑΣ", "in", "on", "b"]
    draw = lambda n: [rng.choice(pool) for _ in range(n)]
    bench = [(i, " ".join(draw(rng.choice([13, 14, 30, 60]))), 0) for i in range(12)]
    bench += [(20, "short item éa", 0), (21, "One", 0), (22, None, 0), (23, " ... ", 0), (None, "null id item", 0), (20, "short item éa", 0)]
    docs = []
    for i in range(120):
        w = draw(rng.randint(0, 80))
        if i % 3 == 0:
            part = rng.choice(bench[:12])[1].split()
            n = rng.choice([12, 13, 20])
            at = rng.randint(0, max(0, len(part) - n))
            w[rng.randint(0, len(w)) :] += part[at : at + n]
        docs.append((i, rng.choice([" ", ", ", ".\n"]).join(w), 0))
    docs += [(200, None, 0), (201, "", 0), (202, "a short, ITEM éa!", 0), (None, "null id item", 0), (203, "one one", 0), (5, docs[3][1], 0), (5, docs[3][1], 0), (204, "the " * 30_000 + bench[2][1], 0)]
    got = run(spark, docs, bench)
    assert got == brute(docs, bench)
    assert sum(x[2] > 0 for x in got) > 25


def test_long_texts_full_of_hits(spark):
    """A text that is nothing but passages of items, and one in which all words are the
    same: work grows with the words, not with words times hits."""
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(3000)]
    bench = [(i, " ".join(rng.choices(pool, k=40)), 0) for i in range(300)] + [(900, "same " * 20, 0), (901, "short one", 0)]
    docs = [(1, " ".join(b[1] for b in bench[:300]) * 3, 0), (2, "same " * 60_000, 0), (3, "same " * 12, 0), (4, "short one " * 5_000, 0), (4, "short one", 0)]
    assert run(spark, docs, bench) == brute(docs, bench)


def test_empty_tables(spark):
    docs, bench = [(1, "a b c", 0), (2, None, 0)], [(1, "a b", 0)]
    assert run(spark, [], bench) == []
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, docs, [(1, "..", 0)]) == brute(docs, [(1, "..", 0)])
