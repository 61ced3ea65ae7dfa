import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import entropy_mix as mix
from tidemill.llm.linear_packing import Words, linear_packing, pieces, places, plan

FILE = public_tokenizers.path("byte_bpe_50k.json")


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    """Share out by weight; what is above a cap goes to the others, again and again."""
    order = sorted(sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        rest = [k for k in order if k not in full]
        total = sum(weight[k] for k in rest)
        share = {k: left * weight[k] / total for k in rest} if rest else {}
        above = [k for k in rest if share[k] > cap * sizes[k]]
        if not above:
            return target | share
        for k in above:
            full.add(k)
            target[k] = cap * sizes[k]
            left -= target[k]


def documents(spark, n=900):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "b", "b", "ü", None, "z"]), rng.randint(0, 300)) for i in range(n)]
    rows += [(5000, "tiny", 3), (5001, "nothing", 0), (5002, None, None), (None, "b", 40), (None, "b", 40), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def mixed(frame):
    totals = frame.groupBy(mix.source_key(F.col("source")).alias("key")).agg(F.sum(F.coalesce("size", F.lit(0))).alias("words"))
    targets = mix.weighted_targets(totals)
    return targets, mix.entropy_mix(frame, targets)


def test_targets_and_copies(spark):
    frame = documents(spark)
    targets, out = mixed(frame)
    found = {r.key: r for r in targets.collect()}
    assert sorted(found)[-1] == "1"  # NULL comes last
    expected = targets_by_hand({k: r.words for k, r in found.items()})
    assert {k: r.target for k, r in found.items()} == pytest.approx(expected)
    rows = out.collect()
    assert out.columns == ["doc_id", "source", "size", "rate", "copies"] and len(rows) == frame.count()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.copies <= 3 and (r.copies == 0 or r.size > 0)
        taken["1" if r.source is None else "0" + r.source] += r.copies * (r.size or 0)
    for key, target in expected.items():
        assert abs(taken[key] - target) <= 43  # two rows alike come together
    assert sorted(map(str, rows)) == sorted(map(str, mixed(frame.repartition(5))[1].collect()))


def test_dual_with_a_prior_and_a_cap(spark):
    """Where some rates are at the cap, the others make up for it."""
    frame = documents(spark, 300).withColumn("p", F.when(F.col("doc_id") % 4 == 0, 4.0).otherwise(0.5))
    totals = frame.groupBy(mix.source_key(F.col("source")).alias("key")).agg(F.sum(F.coalesce("size", F.lit(0))).alias("words"))
    targets = totals.select("key", (F.col("words") * 1.7).alias("target"))
    out = mix.entropy_mix(frame, targets, prior_column="p")
    taken = {r.source: (r.rated, r.words) for r in out.groupBy("source").agg(F.sum(F.col("rate") * F.coalesce("size", F.lit(0))).alias("rated"), F.sum("size").alias("words")).collect()}
    for rated, words in taken.values():
        assert rated == pytest.approx(1.7 * (words or 0), rel=1e-6)


def test_hot_count_is_split(spark, monkeypatch):
    """A third of the rows share source and size: exactly the copies asked for are made."""
    monkeypatch.setattr(mix, "PER_SLICE", 4)
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id")).cast("long").alias("size"))
    targets = spark.createDataFrame([("0s", 0.437 * 3_000_000)], "key string, target double")
    taken = mix.entropy_mix(frame, targets).agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert abs(taken - 0.437 * 3_000_000) <= 1


def test_rows_without_an_id_and_repeated_rows(spark):
    """A third of the rows are alike in all columns, another third differ in the text only."""
    rows = [(None, "a", 20, "same")] * 3000 + [(None, "a", 20, str(i)) for i in range(3000)] + [(i, "b", 7, "x") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long, text string").repartition(6)
    targets = spark.createDataFrame([("0a", 85_714.0), ("0b", 30_003.0)], "key string, target double")
    out = mix.entropy_mix(frame, targets).persist()
    taken = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()}
    assert out.count() == 9000 and abs(taken["a"] - 85_714) <= 10 and abs(taken["b"] - 30_003) <= 4
    again = mix.entropy_mix(frame.repartition(3, "text"), targets)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    only = frame.where("text = 'same'")
    some = mix.entropy_mix(only, spark.createDataFrame([("0a", 20_020.0)], "key string, target double"))
    assert [(r.copies, r["count"]) for r in some.groupBy("copies").count().orderBy("copies").collect()] == [(0, 1999), (1, 1001)]


def test_any_column_name_in_the_mix(spark):
    names = ["key", "prior", "u", "base", "last", "row", "rows_at", "extra_at", "chosen", "at", "task", "target"]
    frame = spark.createDataFrame([(i, "a", 5, *names) for i in range(9)], "doc_id long, source string, size long, " + ", ".join(f"{n} string" for n in names))
    out = mix.entropy_mix(frame, spark.createDataFrame([("0a", 30.0)], "key string, target double"))
    assert out.columns == [*frame.columns, "rate", "copies"]
    assert out.agg(F.sum("copies")).first()[0] == 6 and {tuple(r)[3:15] for r in out.collect()} == {tuple(names)}


def test_mix_of_nothing_clashing_columns_and_unknown_sources(spark):
    none = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixed(none)[1].count() == 0
    frame = spark.createDataFrame([(1, "a", 5, 9, "r")], "doc_id long, source string, size long, copies int, rate string")
    out = mix.entropy_mix(frame, spark.createDataFrame([("0b", 5.0)], "key string, target double"))
    assert out.columns == ["doc_id", "source", "size", "rate", "copies"] and out.first().copies == 0


def texts():
    rng = random.Random(6)
    odd = ["", None, " ", "a", "a  b", " \n x", "x<|endoftext|> y", "I'll 12ab naïve 漢字 🙂", "tab\there \t x", "end\n"]
    words = ["over", "the", "lazy", "Haus,", "grün.", "x1", "\n", "été"]
    return odd + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)] + ["word " * 5000, "a" * 9000]


def test_pieces_and_sequences(spark):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    tokenizer = Tokenizer.from_file(FILE)
    out = linear_packing(frame, FILE, capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in by_doc[doc_id] if doc_id != 3 or r.length), key=lambda r: r.piece)
        if doc_id == 3:
            own = own[:1]
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.crc == zlib.crc32(raw)
            assert r.length == 256 or r.piece == 0
        assert (len(own) == 1) == (len(ids) <= 256)
    for placed in by_sequence.values():
        placed.sort()
        assert placed[0][0] == 0 and sum(n for _, n in placed) <= 256
        assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:]))
    assert len(by_doc[3]) == 2
    least = -(-sum(r.length for r in out) // 256)
    assert len(by_sequence) <= 1.15 * least + 2


def test_words_equal_whole_texts():
    words, tokenizer = Words(FILE), Tokenizer.from_file(FILE)
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\ta1é.'s <|𝔘\u3000") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text in [t or "" for t in texts()] + odd:
        assert list(np.frombuffer(words.ids(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linear_packing(none, FILE).count() == 0
    row = pieces(spark.createDataFrame([(1, "the house")], "doc_id long, text string"), FILE, ids=True).first()
    assert row.ids == Tokenizer.from_file(FILE).encode("the house", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 2048): rng.randint(1, 40) for _ in range(rng.choice([1, 30, 600]))}
    kinds = plan(histogram)
    placed = defaultdict(int)
    for count, held in kinds:
        assert count > 0 and sum(n * each for n, each in held) <= 2048
        for n, each in held:
            placed[n] += count * each
    assert placed == histogram
    where = places(kinds)
    order = np.lexsort((where["first"], where["length"]))
    assert (order == np.arange(len(order))).all()


def test_packing_is_close_to_the_least_number_of_sequences():
    rng = random.Random(9)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(2048, int(rng.lognormvariate(5.8, 1.1)) + 1)] += 1
    total = sum(n * c for n, c in histogram.items())
    assert sum(c for c, _ in plan(dict(histogram))) <= 1.01 * total / 2048
