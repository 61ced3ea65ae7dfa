import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tidemill.llm import collocations as col

WORDS = "the of in über été 漢字 a-b x\x01y big New York city state Of".split(" ")


def phrases_by_hand(rows, longest=4):
    found = defaultdict(Counter)
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                found[lang or "und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return found


def by_hand(rows, least, reported=2000, longest=4):
    out = []
    for lang, f in phrases_by_hand(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: c for p, c in f.items() if c >= least and len(p) > 1}
        kept = []
        for p, a in frequent.items():
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in frequent.items()
            )
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:reported], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed, count=200):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(" ".join(rng.choices(WORDS, [9, 7, 5] + [1] * (len(WORDS) - 3), k=rng.randint(0, 9))))
            if rng.random() < 0.4:
                parts.append(rng.choice(["New York City", "state of the big", "été  été\tété"]))
        rows.append((rng.choice(["en", "en", "fr", "und", None, ""]), rng.choice([". ", " ", "\n", "?!", "\t", ",", "\x0b"]).join(parts)))
    return rows + [("en", None), ("en", ""), ("en", ".. ,"), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string")


@pytest.mark.parametrize(("seed", "least", "longest"), [(1, 2, 4), (2, 5, 4), (3, 3, 3), (4, 2, 2)])
def test_against_every_phrase(spark, seed, least, longest, monkeypatch):
    monkeypatch.setattr(col, "PART_BYTES", 2000)  # several partitions
    rows = texts(seed)
    found = col.collocations(frame(spark, rows).repartition(3), least=least, longest=longest, entries=60)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows, least, longest=longest)


def test_only_the_first_of_each_language(spark):
    rows = texts(5)
    found = col.collocations(frame(spark, rows), least=2, reported=3)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows, 2, 3)


def test_a_full_pair_filter_changes_nothing(spark):
    rows = texts(6)
    exact = {tuple(r) for r in col.phrase_counts(frame(spark, rows), least=4).collect()}
    assert {tuple(r) for r in col.phrase_counts(frame(spark, rows), least=4, bloom_bits=64).collect()} == exact
    hand = {(len(p), lang, " ".join(p), c) for lang, f in phrases_by_hand(rows).items() for p, c in f.items() if c >= 4}
    assert {r for r in exact if r[0] > 0} == hand


def test_counts_beyond_a_long(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(4 * 10**17, 5 * 10**17, 7 * 10**17)], "a long, l long, r long")
    score = "cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    assert row.select(F.expr(score)).first()[0] == 2000000 * 4 * 10**17 // (12 * 10**17)


def counted(rows, batch=50, **changed):
    counter = col.Counter(**({"depth": 4, "least": 1, "sizes": (1, 2, 3, 4), "parts": 5, "pairs": None, "entries": 300} | changed))
    out = []
    for k in range(0, len(rows), batch):
        out += counter.count(pa.array([r[0] for r in rows[k : k + batch]], pa.string()), pa.array([r[1] for r in rows[k : k + batch]], pa.string()))
    out += counter.runs(0)
    return out


def total(runs):
    found = defaultdict(Counter)
    for run in runs:
        for r in run.to_pylist():
            phrases = r["phrases"].split(b"\n")[:-1]
            counts = [int.from_bytes(r["counts"][k : k + 8], "little") for k in range(0, len(r["counts"]), 8)]
            for p, c in zip(phrases, counts, strict=True):
                found[r["lang"]][tuple(p.decode().split(" "))] += c
    return found


@pytest.mark.parametrize(("burst", "segment", "entries"), [(2, 64, 40), (4096, 1 << 20, 10**6), (3, 200, 10**6)])
def test_trie_bursts_and_spills(monkeypatch, burst, segment, entries):
    monkeypatch.setattr(col, "BURST", burst)
    monkeypatch.setattr(col, "SEGMENT", segment)
    rows = texts(7, 120)
    runs = counted(rows, entries=entries)
    assert total(runs) == {lang: c for lang, c in phrases_by_hand(rows).items() if c}
    for run in runs:
        for r in run.to_pylist():  # sorted by the words of the paths, each once
            paths = [tuple(p.split(b" ")) for p in r["phrases"].split(b"\n")[:-1]]
            assert paths == sorted(set(paths)) and {len(p) for p in paths} == {r["size"]}


def test_numbers_begin_again(monkeypatch):
    monkeypatch.setattr(col, "ID_BITS", 7)
    monkeypatch.setattr(col, "SEGMENT", 200)
    rows = [("en", " ".join(f"w{i % 300} w{i % 7}" for i in range(k, k + 60)) + ".") for k in range(0, 900, 30)]
    assert total(counted(rows)) == {"en": phrases_by_hand(rows)["en"]}


def test_a_very_long_text_with_one_word(spark):
    rows = [("en", "word " * 400_000), ("en", "z" * 3_000_000)]
    found = {(r.size, r.phrase): r.n for r in col.phrase_counts(frame(spark, rows), entries=1000).collect()}
    assert found == {(0, None): 400_001} | {(k, " ".join(["word"] * k)): 400_001 - k for k in range(1, 5)}


def test_empty_tables_and_missing_columns(spark):
    empty = col.collocations(frame(spark, []).limit(0))
    assert empty.count() == 0 and empty.columns[:3] == ["lang", "rank", "phrase"]
    assert col.collocations(spark.range(3)).count() == 0
    one = spark.createDataFrame([("a b",)] * 40, "text string")
    assert [tuple(r) for r in col.collocations(one).collect()] == [("und", 1, "a b", 40, 40, 40, 80, 1_000_000)]


def test_lengths_outside_are_refused(spark):
    with pytest.raises(ValueError):
        col.phrase_counts(frame(spark, []), longest=5)
