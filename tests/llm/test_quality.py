import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import kneser_ney
from tidemill.llm.blocks import blocks
from tidemill.llm.kneser_ney import quality, scored, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def brute(text):
    words = WORD.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    inside, lines, again = set(), set(), 0
    for i in range(n - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é#|\n\t\x0b\x1c𝔘", max_size=80), max_size=12), st.integers(1, 60))
def test_counts(texts, limit):
    got = []
    for _, _, block in blocks(pa.array(texts, pa.string()), limit):
        stats = text_stats(block)
        got += list(zip(*(stats[c].tolist() for c in kneser_ney.STATS), strict=True))
    assert got == [brute(t) for t in texts]


def sample(n=160):
    rng = np.random.default_rng(5)
    words = {"en": ["the", "house", "river", "green", "walks", "over", "stone"], "de": ["der", "haus", "fluss", "grün", "geht", "über", "stein"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[lang], int(rng.integers(22, 120)))), lang))
    rows.append((1000, " ".join("qxzj%03d vvkw" % k for k in range(40)), "en"))
    rows.append((1001, " ".join(rng.choice(words["de"], 60)), "en"))
    rows.append((1002, "a b", "en"))
    rows.append((1003, "same eight words again and again and again " * 9, "en"))
    rows += [(1004, None, None), (None, "", "en"), (1005, rows[0][1], None), rows[0]]
    return rows


def model_by_hand(texts, order):
    """Interpolated modified Kneser-Ney in dictionaries, for texts of one half."""
    counts = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for size in range(order - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    cut = {}
    for size, c in counts.items():
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0
        cut[size] = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[0] else 0
            cut[size].append(d if 0 < d < k else k / 2)
    contexts = defaultdict(list)
    for size, c in counts.items():
        for g, v in c.items():
            contexts[size, g[:-1]].append(v)

    def p(gram):
        size = len(gram)
        if not size:
            return 1 / (len(counts[1]) + 1)
        values = contexts.get((size, gram[:-1]))
        if not values:
            return p(gram[1:])
        spent = [min(v, cut[size][min(v, 3) - 1]) for v in values]
        v = counts[size][gram]
        own = max(0, v - (cut[size][min(v, 3) - 1] if v else 0)) / sum(values)
        return own + sum(spent) / sum(values) * p(gram[1:])

    return p


def test_perplexity_by_hand(spark):
    rows = [r for r in sample() if r[0] is not None and r[0] < 900]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in scored(frame).collect()}
    texts = [r[1] for r in rows]
    half = {}
    for first, _, block in blocks(pa.array(texts, pa.string())):
        half |= {texts[first + i]: int(h) for i, h in enumerate(kneser_ney._half(block))}
    models = {h: model_by_hand([t for t in texts if half[t] != h], kneser_ney.ORDER) for h in (0, 1)}
    for doc_id, text, _ in rows[:40]:
        p = models[half[text]]
        grams = [text[i : i + kneser_ney.ORDER] for i in range(len(text) - kneser_ney.ORDER + 1)]
        assert got[doc_id].n_grams == len(grams)
        assert got[doc_id].surprise == pytest.approx(-sum(math.log(p(g)) for g in grams), rel=1e-4)


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [r[1] for r in sample(60) if r[1]]
    p = model_by_hand(rows, 3)
    letters = set("".join(rows))
    assert sum(p("th" + c) for c in letters) + p("th\0") == pytest.approx(1)


def test_both_ways_to_reach_the_model_agree(spark):
    frame = spark.createDataFrame(sample(), SCHEMA)
    ways = [scored(frame, broadcast_bytes=size) for size in (1 << 30, 0)]
    a, b = (sorted((str(r.doc_id), r.n_words, r.n_grams, round(r.surprise, 6)) for r in w.collect()) for w in ways)
    assert a == b and len(a) == len(sample())


def test_verdicts_and_odd_rows(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine")).withColumn("n", F.lit(1))
    got = quality(frame)
    assert got.columns[:4] == ["doc_id", "text", "lang", "n"]
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert not by_id[1000].kept and not by_id[1000].base_failed
    assert by_id[1002].base_failed and by_id[1003].base_failed and by_id[1004].base_failed
    assert by_id[1004].n_words == 0 and by_id[1004].log_perplexity is None
    assert by_id[1005].kept and by_id[1001].kept
    assert all(by_id[i].kept for i in range(160))
    assert quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_few_texts_are_not_rejected_by_perplexity(spark):
    text = "some words of a text that is long enough to be judged by the rules of the model here now and then"
    got = quality(spark.createDataFrame([(1, text, "xx"), (2, text + " %%% ###", None)], SCHEMA)).collect()
    assert all(r.kept for r in got)


def test_long_text_and_large_alphabet(spark):
    wide = "".join(chr(0x4E00 + i % 6000) for i in range(20_000))
    rows = [(1, wide + " word" * 30, "zh"), (2, "word other " * 200_000, "en")]
    got = {r.doc_id: r for r in scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_grams == len(rows[0][1]) - 4 and got[2].n_words == 400_000


def test_short_junk_is_outside_of_the_band(spark):
    """Both limits act on short texts, and copies do not narrow the band."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("aeinorst"), int(rng.integers(2, 8)))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(22, 60)))), "en") for i in range(400)]
    rows += [(i, rows[0][1], "en") for i in range(400, 600)]
    rows.append((1000, " ".join(w + "%&*#"[k % 4] * 3 if k % 2 else w for k, w in enumerate(rng.choice(vocabulary, 25))), "en"))
    rows.append((1001, " ".join("st" * int(k) for k in rng.integers(2, 9, 30)), "en"))
    phrases = [" ".join(rng.choice(vocabulary, 4)) for _ in range(5)]
    order = [k for i in range(5) for k in (i, *(k for j in range(i + 1, 5) for k in (i, j)))]  # no two follow each other twice
    rows.append((1002, " ".join(phrases[k] for k in order), "en"))
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(600))
    assert all(0 < r.lowest < r.highest < 5 for r in got.values())
    assert got[1000].log_perplexity > got[1000].highest and not got[1000].kept
    assert not got[1001].kept and not got[1001].base_failed
    assert not got[1002].kept and got[1002].n_repeat_words == 0 and got[1002].lowest < got[1002].log_perplexity < got[1002].highest


def test_other_columns_are_kept_whatever_their_names(spark):
    names = ["all", "lang_near", "lang_middle", "bin_low", "any_mid", "value", "near", "half", "size", "key"]
    texts = [(i, "en", " ".join(f"word{(i * 7 + k) % 50}" for k in range(30))) for i in range(70)]
    plain = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    wide = plain.select("*", *(F.lit(n).alias(n) for n in names))
    found = quality(wide)
    assert {tuple(r) for r in found.select(*names).collect()} == {tuple(names)}
    judged = ["doc_id", "kept", "log_perplexity", "lowest", "highest"]
    assert sorted(map(tuple, found.select(*judged).collect())) == sorted(map(tuple, quality(plain).select(*judged).collect()))
    with pytest.raises(ValueError, match="_q_"):
        quality(plain.withColumn("_q_low", F.lit(1)))
