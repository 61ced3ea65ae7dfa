import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemill.llm import jaccard_join
from tidemill.llm.jaccard_join import connected, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def shingles(text):
    words = WORD.findall((text or "").encode().lower().decode())
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Every pair of texts, and every id reached over links."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i == j or (a and b and 100 * len(a & b) >= 75 * len(a | b)):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    found = [(i, len(shingles(t)), None if i is None else root(i)) for i, t in rows]
    return sorted(found, key=str)


def classes(frame):
    return sorted((tuple(r) for r in near_duplicates(frame).collect()), key=str)


def edited(rng, words, share):
    return [f"x{rng.random():.6f}" if rng.random() < share else w for w in words]


def corpus():
    """Groups of copies, near copies at all distances, a passage that many share, odd texts."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = [None, "", "  \n ", "one", "One", "two words", "a b c d", "A b  c\td", "a b c d e", "É b c d e", "é b c d e"]
    for group in range(12):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        for copy in range(rng.randint(1, 12)):
            texts.append(" ".join(edited(rng, words, 0.004 * copy)))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) + " " + passage for _ in range(60)]
    texts += [" ".join(rng.choices("ab", k=40)) for _ in range(10)]
    base = rng.choices(vocabulary, k=120)
    texts += [" ".join(base)] * 15 + [" ".join(edited(rng, base, 0.02)) for _ in range(60)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_against_every_pair(spark, rows):
    rows = [*rows, (None, rows[20][1]), (None, None), rows[30], (rows[31][0], rows[40][1])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert classes(frame) == brute(rows)


def test_small_column_blocks_and_no_frequent_shingles(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMN_BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", 10**9)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert classes(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(8)
    sets = []
    for n in (1, 2, 31, 33, 90, 500, 700, 5000):
        own = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [own, own[: n * 3 // 4], np.concatenate([own, rng.integers(0, 1 << 63, n // 3).astype(np.uint64)])]
    sketches = np.array([jaccard_join._sketch(s) if len(s) else None for s in sets] + [None], object)
    i, j = np.triu_indices(len(sketches), 1)
    found = jaccard_join._differences(sketches, i, j)
    for a, b, bits in zip(i, j, found, strict=True):
        if sketches[a] is None or sketches[b] is None:
            assert bits == 0
        else:
            assert bits <= len(set(sets[a].tolist()) ^ set(sets[b].tolist()))
    # half of the members differ: seen as more than a similarity of 0.75 allows
    x, y = rng.integers(0, 1 << 63, (2, 300)).astype(np.uint64)
    y[:150] = x[:150]
    pair = np.array([jaccard_join._sketch(x), jaccard_join._sketch(y)], object)
    assert jaccard_join._differences(pair, np.array([0]), np.array([1]))[0] > 600 // 7


def test_ids_shared_by_different_texts_of_one_size(spark):
    rng = random.Random(5)
    one, two = ([f"{k}{rng.random():.4f}" for _ in range(60)] for k in "xy")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one[:58], "p", "q"])), (3, " ".join([*two[:58], "r", "s"]))]
    assert classes(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_empty_extra_columns_and_long_text(spark):
    assert classes(spark.createDataFrame([], SCHEMA)) == []
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short")]
    frame = spark.createDataFrame([(*r, "k", 5) for r in rows], SCHEMA + ", column string, n int")
    assert classes(frame) == [(1, 59_996, 1), (2, 59_997, 1), (3, 1, 3)]


def test_connected(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40) if i % 10] + [(100, 7), (100, 33), (5, 5)] + [(200, 200 + i) for i in range(1, 50)]
    rng.shuffle(edges)
    found = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for start in found:
        seen, todo = {start}, [start]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert found[start] == min(seen)
