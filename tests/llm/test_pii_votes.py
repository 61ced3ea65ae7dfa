import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm import pii_votes as pii

SCHEMA = "doc_id long, text string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    """The base spans, with the patterns as they are given."""
    spans, text = [], text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def test_base_spans(spark):
    rng = random.Random(2)
    texts = [None, "", "a@b.c_d@e.f", "x%y@ z@q.r.s.", "1.2.3.4.5.6.7.8", "001.02.3.4", "256.1.1.1 1.2.3.4", "𝔘 é a@b.co +1 (555) 123-4567"]
    for letters, n in (("a0123456789.@ -+()é_%𝔘", 400), ("0123456789 -", 400), ("1.2", 150), ("ab@.", 150)):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(5, 90))) for _ in range(n)]
    texts += ["4539 1488 0343 6467", "4539-1488-0343-6467 1", "4539148803436467", "45391488034364671234567"]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    found = frame.select("text", F.filter(pii.candidates(F.col("text")), lambda c: c["base"]).alias("c")).collect()
    for r in found:
        assert [(c.kind, c.start, c.end) for c in r.c] == brute(r.text), r.text


def test_long_runs_take_linear_time(spark):
    texts = ["1" * 300_000, "a" * 300_000 + "@", "1 " * 150_000, "a@" * 100_000, "1." * 10_000, "+1" * 50_000]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = frame.select("doc_id", F.size(pii.candidates(F.col("text"))).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in found] == [0, 0, 0, 0, 2_500, 0]


@pytest.mark.parametrize("n", [0, 1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 20_000])
def test_many_finds_keep_their_places(spark, n):
    """Positions go on from block to block, as do those of spans that may clash."""
    text = "é𝔘 ".join(("u@ex.com", "10.1.2.3", "no", "+1 (678) 555-5272")[i % 4] for i in range(n)) + ' api_key = "0123456789abcdef0123"'
    spans = pii.pii_spans(spark.createDataFrame([(1, text)], SCHEMA)).first().spans
    assert [(s.kind, s.start, s.end) for s in spans if s.base] == brute(text)
    assert [(s.kind, text[s.start : s.end]) for s in spans if not s.base] == [("secret", "0123456789abcdef0123")]


def test_reliabilities_by_hand(spark):
    """The same expectation maximisation in plain Python."""
    rng = random.Random(3)
    rows = [("k", [rng.choice([0, 1, 1, 2]) for _ in pii.LABELERS], float(rng.randint(1, 9))) for _ in range(25)]
    prior, hit, reject = 0.5, [0.8] * 5, [0.8] * 5
    for _ in range(pii.ROUNDS):
        posterior = []
        for _, votes, _ in rows:
            true, false = prior, 1 - prior
            for v, h, r in zip(votes, hit, reject, strict=True):
                true *= {1: h, 0: 1 - h, 2: 1}[v]
                false *= {1: 1 - r, 0: r, 2: 1}[v]
            posterior.append(true / (true + false))
        total = sum(n for *_, n in rows)
        prior = (sum(n * p for (*_, n), p in zip(rows, posterior, strict=True)) + 1) / (total + 2)
        for j in range(5):
            own = [(v[j], n, p) for (_, v, n), p in zip(rows, posterior, strict=True)]
            hit[j] = (8 + sum(n * p for v, n, p in own if v == 1)) / (10 + sum(n * p for v, n, p in own if v != 2))
            reject[j] = (8 + sum(n * (1 - p) for v, n, p in own if v == 0)) / (10 + sum(n * (1 - p) for v, n, p in own if v != 2))
    got = pii.reliabilities(spark.createDataFrame(rows, "kind string, votes array<int>, n double")).first()
    assert got.prior == pytest.approx(prior)
    assert list(got.hit) == pytest.approx(hit) and list(got.reject) == pytest.approx(reject)


def held_out(spark):
    """Secrets and national numbers with context, and look-alikes that are none."""
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(400):
        good = rng.random() < 0.6
        if i % 2:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if good else rng.choice(["exampleexample", "your_token_here", "placeholder_key"])
            text = f'word token = "{value}" word'
        else:
            value = f"({rng.randint(212, 989)}) {rng.randint(600, 989)}-{rng.randint(1000, 9999)}" if good else f"{rng.choice(['000', '111'])}-{rng.choice(['000', '111'])}-0000"
            text = f"please call {value} now" if good else f"order no. x{value}y"
        rows.append((i, text))
        truth[i] = good
    return rows, truth


def test_accuracy_on_held_out_spans(spark):
    rows, truth = held_out(spark)
    found = {r.doc_id: bool(r.spans) for r in pii.pii_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = sum(found[i] == truth[i] for i in truth)
    assert right >= 0.95 * len(truth)


def test_spans_order_overlap_and_redaction(spark):
    text = 'mail a@b.com or +1 (678) 555-5272 from 10.1.2.3, api_key = "0123456789abcdef0123" end 𝔘 a@b.com'
    out = pii.pii_spans(spark.createDataFrame([(1, text), (2, None), (3, "clean text")], SCHEMA)).orderBy("doc_id")
    shown = out.select("doc_id", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("r"), pii.listed(F.col("spans")).alias("l")).collect()
    kinds = [s.kind for s in shown[0].spans]
    assert kinds == ["email", "email", "ip", "phone", "secret"]
    assert shown[0].r == 'mail <EMAIL> or <PHONE> from <IP>, api_key = "<SECRET>" end 𝔘 <EMAIL>'
    assert shown[0].l.startswith(f"email:5:12,email:{len(text) - 7}:{len(text)},ip:")
    assert (shown[1].r, shown[1].l, shown[2].r) == (None, "", "clean text")


def test_odd_tables(spark):
    assert pii.pii_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(None, "a@b.com", "x", 1), (1, "a@b.com", "x", 1), (1, "a@b.com", "x", 1)], SCHEMA + ", spans string, kind int")
    for keep in (True, False):
        out = pii.pii_spans(frame, keep_text=keep)
        assert out.columns == ["doc_id", *["text"] * keep, "kind", "spans"]
        assert [len(r.spans) for r in out.collect()] == [1, 1, 1]
