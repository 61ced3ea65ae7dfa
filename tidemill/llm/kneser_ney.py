"""Quality rules: counts over words and lines, and the perplexity of an n-gram model.

The model is over characters (A-Z folded, ASCII white space and digits as one each), so it
has a token for every text in every language, and a passage in another language than its
document's is no surprise. It is an interpolated modified Kneser-Ney model:

1. A scan counts the ``ORDER``-grams of all trusted texts, batch by batch; Spark adds them
   up. Trusted are texts that pass the base rules and have few symbols: what is to be found
   must not be what the model learns. Everything else follows from these counts: lower
   orders count the distinct grams they continue, discounts come from how many grams have
   count 1 to 4.
2. Two models, each from half of the texts (by a hash of the text, so copies stay
   together): a text is judged by the model that has not seen it.
3. Gram probabilities and back-off weights become arrays sorted by a 64-bit hash of
   (half, gram). If they are at most ``BROADCAST_BYTES`` they are sent to the executors;
   beyond that texts are dealt into blocks, and each block is joined with the part of the
   model whose hashes it holds. Both give the same numbers.
4. Bands. Within a language, log perplexities of trusted texts scatter around their median
   by about one over the root of the number of grams. The scatter's lower and upper tails
   (``TAIL`` of distinct texts) are taken for each text length (in powers of two). A text
   ``BAND`` tails below or above the median is rejected, where a tail counts as
   ``MIN_WIDTH`` at least; so is one below ``LEAST`` of the median at any length.
5. Repetition. Characters do not see words come back, so word trigrams that were there
   within the last ``NEAR`` words are counted, and their share has an upper limit of the
   same kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.blocks import Block, blocks, grams, mixed
from tidemill.llm.stages import columns_or_null, prepared, released, staged, unstage

ORDER = 5
BROADCAST_BYTES = 256 << 20
BLOCK_TEXT = 4 << 20
MIN_WORDS = 20
REPEAT_WORDS = 8
REPEAT_PERCENT = 30
SYMBOL_PERCENT = 10
#: A text is rejected so many tails from the median of its language; a tail holds this share.
BAND, TAIL = 4.0, 0.05
#: A tail is taken from so many distinct texts at least.
MIN_TEXTS = 50
#: A band reaches this far at least (in log perplexity), and down to this share of the median.
MIN_WIDTH, LEAST = 0.2, 0.25
#: Word trigrams are repeated if they were there within so many words; the limit of their
#: share is this far above the median at least.
NEAR_GRAM, NEAR, NEAR_WIDTH = 3, 128, 0.3
STEP = 0.001
#: Rows of bands (a language, or a language and length, each) that are sent to the texts.
SENT_ROWS = 100_000
#: Surprises of grams that a task keeps at hand: two to this power, 16 bytes each.
RECALLED_BITS = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48
_K = np.uint64(0x9E3779B97F4A7C15)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(block: Block, marks: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    sums = np.concatenate(([0], np.cumsum(marks)))
    return sums[block.offsets[1:]] - sums[block.offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def text_stats(block: Block) -> dict[str, np.ndarray]:
    """The counts of every text in a block: words, code points in words, symbols, lines with
    a word that equal an earlier line, and words in word windows that occur twice."""
    n = block.texts
    begin, end, owner = block.words()
    points = block.points()
    chars = np.bincount(owner, points[end] - points[begin], n).astype(np.int64)
    breaks = np.flatnonzero(block.data == 10)
    first = np.flatnonzero(block.starts())
    line_begin = np.sort(np.concatenate((first, breaks + 1)))
    line_begin = np.unique(line_begin[line_begin < len(block.data)])
    at = np.searchsorted(line_begin, np.concatenate((breaks, block.offsets[1:])), "left")
    line_end = np.full(len(line_begin), len(block.data))
    stops = np.concatenate((breaks, block.offsets[1:]))
    ok = at > 0
    np.minimum.at(line_end, at[ok] - 1, stops[ok])
    line_owner = block.owner(line_begin)
    line_end = np.minimum(line_end, block.offsets[line_owner + 1])
    solid = np.concatenate(([0], np.cumsum(np.bincount(begin, minlength=len(block.data))))) if len(block.data) else np.zeros(1, np.int64)
    filled = solid[line_end] > solid[line_begin]
    line_begin, line_end, line_owner = line_begin[filled], line_end[filled], line_owner[filled]
    key = mixed(block.hashes(line_begin, line_end) ^ mixed(line_owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    words = block.hashes(begin, end)
    runs, at = grams(words, owner, REPEAT_WORDS)
    twice = _repeated(mixed(runs ^ mixed(owner[at].astype(np.uint64) + np.uint64(1))))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WORDS, -1)
    inside = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": chars,
        "n_symbols": _per_text(block, _SYMBOL[block.data]),
        "n_dup_lines": np.bincount(line_owner[again], minlength=n),
        "n_repeat_words": np.bincount(owner[inside], minlength=n),
    }


def near_repeats(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many of its word trigrams were there within the last ``NEAR`` words,
    and how many trigrams it has."""
    begin, end, owner = block.words()
    runs, at = grams(block.hashes(begin, end), owner, NEAR_GRAM)
    key = mixed(runs ^ mixed(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    again = order[1:][(key[order[1:]] == key[order[:-1]]) & (at[order[1:]] - at[order[:-1]] <= NEAR)]
    of = owner[at]
    return np.bincount(of[again], minlength=block.texts), np.bincount(of, minlength=block.texts)


def _codes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a block, and the text each belongs to."""
    codes = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    plain = codes < 128
    codes = np.where(plain, _FOLD[np.where(plain, codes, 0)], codes)
    return codes, np.repeat(np.arange(block.texts), np.diff(block.points()[block.offsets]))


def _group(half: np.ndarray) -> np.ndarray:
    """The hash of the model that judges a half of the texts."""
    return mixed(half.astype(np.uint64) + np.uint64(1))


def _gram_hash(group: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    h = group ^ np.uint64(len(codes))
    for c in codes:
        h = (h ^ c) * _K
        h ^= h >> np.uint64(29)
    return mixed(h)


def _half(block: Block) -> np.ndarray:
    """0 or 1 by the text's content."""
    return (block.hashes(block.offsets[:-1], block.offsets[1:]) >> np.uint64(40)).astype(np.int64) & 1


def trusted(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Which texts the model is made from."""
    n = stats["n_words"]
    return (n >= MIN_WORDS) & (100 * stats["n_repeat_words"] <= REPEAT_PERCENT * n) & (100 * stats["n_symbols"] <= SYMBOL_PERCENT * n)


def _counts(order: int):
    """``half, gram, n``: grams of the trusted texts of a batch; the half is the other, that
    of the texts they help to judge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                codes, owner = _codes(block)
                if len(codes) < order:
                    continue
                good, half = trusted(text_stats(block)), 1 - _half(block)
                present = np.zeros(0x110000, bool)
                present[codes] = True
                alphabet = np.flatnonzero(present)
                bits = max(1, int(len(alphabet) - 1).bit_length())
                dense = np.cumsum(present)[codes].astype(np.int64) - 1
                n = len(codes) - order + 1
                inside = (owner[:n] == owner[order - 1 :]) & good[owner[:n]]
                if bits * order <= 62:
                    packed = half[owner[:n]]
                    for j in range(order):
                        packed = packed << bits | dense[j : n + j]
                    packed = np.sort(packed[inside])
                    edge = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
                    kinds, count = packed[edge], np.diff(np.concatenate((edge, [len(packed)])))
                    digits = [(kinds >> bits * (order - 1 - j)) & ((1 << bits) - 1) for j in range(order)]
                    of = kinds >> bits * order
                else:  # an alphabet too large to pack
                    rows = np.stack([half[owner[:n]], *(dense[j : n + j] for j in range(order))], 1)[inside]
                    rows, count = np.unique(rows, axis=0, return_counts=True)
                    of, digits = rows[:, 0], [rows[:, j + 1] for j in range(order)]
                text = alphabet[np.stack(digits, 1)].astype(np.uint32).tobytes().decode("utf-32-le", "replace")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of.astype(np.int32)),
                        pa.array([text[k : k + order] for k in range(0, len(text), order)], pa.string()),
                        pa.array(count.astype(np.int64)),
                    ],
                    ["half", "gram", "n"],
                )

    return run


def _discounts(counts: DataFrame) -> DataFrame:
    """``half, d1, d2, d3`` from how many grams have count 1, 2, 3 and 4; what these cannot
    give is 0.5, 1 and 1.5."""
    n = [F.sum(F.when(F.col("n") == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        usual = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
        return F.when((usual > 0) & (usual < k), usual).otherwise(k / 2).alias(f"d{k}")

    return counts.groupBy("half").agg(*n).select("half", *(discount(k) for k in (1, 2, 3)))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``half, size, gram, logp, backoff`` for the grams of every size, and size 0 with the
    unseen character's probability, from ``half, gram, n`` of the largest size."""
    tables = {order: staged(counts, "grams")}
    for size in range(order - 1, 0, -1):
        lower = tables[size + 1].groupBy("half", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n"))
        tables[size] = staged(lower, "grams")
    below, parts = None, []
    for size in range(1, order + 1):
        rates = _discounts(tables[size])
        spent = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = tables[size].join(rates, "half").select(
            "half", "gram", "n", F.least(spent, F.col("n")).alias("spent"), F.substring("gram", 1, size - 1).alias("context")
        )
        contexts = cut.groupBy("half", "context").agg(F.sum("n").alias("total"), F.sum("spent").alias("spent_all"), F.count("*").alias("types"))
        contexts = staged(contexts.withColumn("gamma", F.col("spent_all") / F.col("total")), "contexts")
        own = cut.join(contexts, ["half", "context"]).withColumn("own", (F.col("n") - F.col("spent")) / F.col("total"))
        if size == 1:
            probs = own.select("half", "gram", (F.col("own") + F.col("gamma") / (F.col("types") + 1)).alias("p"))
            unseen = F.log(F.col("gamma") / (F.col("types") + 1))
            parts.append(contexts.select("half", F.lit(0).alias("size"), F.lit("").alias("gram"), unseen.alias("logp"), F.lit(0.0).alias("backoff")))
        else:
            low = below.select("half", F.col("gram").alias("rest"), F.col("p").alias("q"))
            probs = own.withColumn("rest", F.substring("gram", 2, size - 1)).join(low, ["half", "rest"])
            probs = probs.select("half", "gram", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
            weights = contexts.select("half", F.col("context").alias("gram"), F.log("gamma").alias("backoff"))
            known = below.join(weights, ["half", "gram"], "left")
            parts.append(known.select("half", F.lit(size - 1).alias("size"), "gram", F.log("p").alias("logp"), F.coalesce("backoff", F.lit(0.0)).alias("backoff")))
        below = staged(probs, "probabilities")
    parts.append(below.select("half", F.lit(order).alias("size"), "gram", F.log("p").alias("logp"), F.lit(0.0).alias("backoff")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``size, key, logp, backoff`` of model rows."""
    for batch in batches:
        frame = batch.to_pandas()
        for size, rows in frame.groupby("size"):
            group = _group(rows["half"].to_numpy())
            codes = np.frombuffer("".join(rows["gram"]).encode("utf-32-le"), np.uint32).reshape(len(rows), size)
            key = _gram_hash(group, [codes[:, j] for j in range(size)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), size, np.int32)),
                    pa.array(key.view(np.int64)),
                    pa.array(rows["logp"].to_numpy(np.float32)),
                    pa.array(rows["backoff"].to_numpy(np.float32)),
                ],
                ["size", "key", "logp", "backoff"],
            )


class Arrays:
    """The model as arrays sorted by hash, one set for each size, with an index by the
    leading bits of the hash."""

    def __init__(self, by_size: dict[int, tuple]):
        self.by_size = by_size
        # surprises already worked out, by the leading bits of the gram's hash: a later gram
        # takes the place of an earlier one
        self.seen, self.worked_out = np.zeros(0, np.uint64), np.zeros(0)

    @classmethod
    def of(cls, size: np.ndarray, key: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> Arrays:
        by_size = {}
        for s in range(ORDER + 1):
            own = np.flatnonzero(size == s)
            own = own[np.argsort(key[own].view(np.uint64))]
            k = key[own].view(np.uint64)
            shift = np.uint64(63 - max(1, len(k)).bit_length())
            start = np.searchsorted(k >> shift, np.arange((1 << 64 - int(shift)) + 1, dtype=np.uint64))
            by_size[s] = k, start.astype(np.int32), shift, logp[own], backoff[own]
        return cls(by_size)

    def find(self, size: int, h: np.ndarray) -> np.ndarray:
        """The place of each hash in its arrays, or -1."""
        keys, start, shift, _, _ = self.by_size[size]
        bucket = (h >> shift).astype(np.int64)
        at, end = start[bucket], start[bucket + 1]
        found = np.full(len(h), -1, np.int64)
        active = np.flatnonzero(at < end)
        while len(active):
            place = at[active]
            hit = keys[place] == h[active]
            found[active[hit]] = place[hit]
            active = active[~hit]
            at[active] += 1
            active = active[at[active] < end[active]]
        return found

    def surprise(self, group: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        """Minus the log probability of the last character of each gram. Most grams have been
        met before: a text's grams are few kinds, and each kind is worked out once."""
        h = _gram_hash(group, codes)
        if not len(self.seen):
            self.seen, self.worked_out = np.zeros(1 << RECALLED_BITS, np.uint64), np.zeros(1 << RECALLED_BITS)
        place = (h >> np.uint64(64 - RECALLED_BITS)).astype(np.int64)
        found = self.worked_out[place]
        new = np.flatnonzero((self.seen[place] != h) | (h == 0))
        if len(new):
            _, first, of = np.unique(h[new], return_index=True, return_inverse=True)
            kinds = new[first]
            worked_out = self._worked_out(group[kinds], [c[kinds] for c in codes])
            found[new] = worked_out[of]
            self.seen[place[kinds]], self.worked_out[place[kinds]] = h[kinds], worked_out
        return found

    def _worked_out(self, group: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(group), np.float64)
        left = np.arange(len(group))
        for size in range(len(codes), 0, -1):
            own = codes[len(codes) - size :]
            at = self.find(size, _gram_hash(group[left], [c[left] for c in own]))
            seen = at >= 0
            total[left[seen]] -= self.by_size[size][3][at[seen]]
            left = left[~seen]
            if not len(left):
                return total
            if size > 1:
                at = self.find(size - 1, _gram_hash(group[left], [c[left] for c in own[:-1]]))
                total[left[at >= 0]] -= self.by_size[size - 1][4][at[at >= 0]]
        at = self.find(0, _gram_hash(group[left], []))
        total[left] -= np.where(at >= 0, self.by_size[0][3][at] if len(self.by_size[0][3]) else 0.0, np.log(1 / 256))
        return total


def _judged(block: Block, model: Arrays, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its surprises, and how many grams it has."""
    codes, owner = _codes(block)
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(block.texts), np.zeros(block.texts, np.int64)
    group = _group(_half(block))
    at = np.flatnonzero(owner[:n] == owner[order - 1 :])
    of = owner[at]
    surprise = model.surprise(group[of], [codes[at + j].astype(np.uint64) for j in range(order)])
    return np.bincount(of, surprise, block.texts), np.bincount(of, minlength=block.texts)


def _scored(model, order: int, names: list[str]):
    """The columns of each row but the text, its counts, its surprise and grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model.value)
        for batch in batches:
            yield _score_batch(batch, arrays, order, names)

    return run


def _score_batch(batch: pa.RecordBatch, arrays: Arrays, order: int, names: list[str]) -> pa.RecordBatch:
    parts: dict[str, list[np.ndarray]] = {c: [] for c in (*STATS, "surprise", "n_grams", "n_near", "n_trigrams")}
    for _, _, block in blocks(batch.column("_text")):
        for c, v in text_stats(block).items():
            parts[c].append(v.astype(np.int64))
        surprise, n = _judged(block, arrays, order)
        parts["surprise"].append(surprise)
        parts["n_grams"].append(n.astype(np.int64))
        for c, v in zip(("n_near", "n_trigrams"), near_repeats(block), strict=True):
            parts[c].append(v.astype(np.int64))
    empty = np.zeros(0, np.int64)
    made = [pa.array(np.concatenate(v) if v else (empty.astype(float) if c == "surprise" else empty)) for c, v in parts.items()]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, *parts])


def _needed(order: int):
    """``block, size, key``: the hashes of a batch's texts, of every size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt = batch.column("_block").to_numpy()
            for first, after, block in blocks(batch.column("_text")):
                codes, owner = _codes(block)
                group = _group(_half(block))
                for size in range(order + 1):
                    at = np.flatnonzero(owner[: len(codes) - size + 1] == owner[size - 1 :]) if 0 < size <= len(codes) else np.arange(0)
                    of = owner[at] if size else np.arange(block.texts)
                    key = _gram_hash(group[of], [codes[at + j].astype(np.uint64) for j in range(size)])
                    rows = np.unique(np.stack([dealt[first:after][of], key.view(np.int64)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[:, 0]), pa.array(np.full(len(rows), size, np.int32)), pa.array(rows[:, 1])], ["_block", "size", "key"]
                    )

    return run


def _by_block(rows: DataFrame, model: DataFrame, order: int, names: list[str], schema: str) -> DataFrame:
    """Scores from the part of the model that a block of texts needs."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_text", *names), F.lit(1 + size // BLOCK_TEXT)).cast("long"))
    needed = dealt.select("_text", "_block").mapInArrow(_needed(order), "_block long, size int, key long").distinct()
    part = needed.join(model, ["size", "key"])

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        arrays = Arrays.of(*(own.column(c).to_numpy() for c in ("size", "key", "logp", "backoff")))
        batches = [_score_batch(b, arrays, order, names) for b in texts.to_batches(max_chunksize=4096)]
        return pa.Table.from_batches(batches)

    return dealt.groupBy("_block").cogroup(part.groupBy("_block")).applyInArrow(score, schema)


def scored(
    docs: DataFrame, text_column: str = "text", keep_text: bool = True,
    order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The columns of ``docs`` (without the text unless ``keep_text``), the counts of
    :func:`text_stats`, ``surprise`` (sum over its grams), ``n_grams``, and ``n_near`` and
    ``n_trigrams`` of :func:`near_repeats`."""
    spark = prepared(docs.sparkSession)
    new = {*STATS, "surprise", "n_grams", "n_near", "n_trigrams", "_text", "_block"}
    names = [c for c in docs.columns if c not in new and (keep_text or c != text_column)]
    texts = columns_or_null(docs, [(text_column, "string")])
    counted = texts.mapInArrow(released(_counts(order)), "half int, gram string, n long").groupBy("half", "gram").agg(F.sum("n").alias("n"))
    model = staged(kneser_ney(counted, order).mapInArrow(released(_hashed), "size int, key long, logp float, backoff float"), "model")
    text = F.col(f"`{text_column}`").cast("string") if text_column in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*(f"`{c}`" for c in names), F.coalesce(text, F.lit("")).alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    schema = ", ".join([*kinds, *(f"{c} long" for c in STATS), "surprise double", "n_grams long", "n_near long", "n_trigrams long"])
    if model.count() * 16 > broadcast_bytes:
        return _by_block(rows, model, order, names, schema)
    found = model.toArrow()
    arrays = Arrays.of(*(found.column(c).to_numpy() for c in ("size", "key", "logp", "backoff")))
    unstage(model)
    sent = spark.sparkContext.broadcast(arrays.by_size)
    found = rows.mapInArrow(released(_scored(sent, order, names)), schema)
    found.model = sent
    return found


def _tails(values: DataFrame, cell: list[str]) -> DataFrame:
    """``low, mid, high`` of ``value`` for each cell with ``MIN_TEXTS`` texts or more: its lower
    tail, median and upper tail."""
    upto = Window.partitionBy(*cell).orderBy("level")
    every = Window.partitionBy(*cell)
    levels = values.groupBy(*cell, F.floor(F.col("value") / STEP).alias("level")).agg(F.count("*").alias("n"))
    ranked = levels.withColumn("seen", F.sum("n").over(upto)).withColumn("texts", F.sum("n").over(every)).where(F.col("texts") >= MIN_TEXTS)
    at = [((F.min(F.when(F.col("seen") >= q * F.col("texts"), F.col("level"))) + 0.5) * STEP).alias(c) for q, c in ((TAIL, "low"), (0.5, "mid"), (1 - TAIL, "high"))]
    return ranked.groupBy(*cell).agg(*at)


def _sent(bands: DataFrame) -> DataFrame:
    """``bands`` to be sent to the texts, instead of bringing all texts of a language together,
    if there are at most ``SENT_ROWS``."""
    return F.broadcast(bands) if bands.count() <= SENT_ROWS else bands


def quality(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", keep_text: bool = True,
    band: float = BAND, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with the counts of :func:`text_stats`, ``base_failed`` (fewer than
    ``MIN_WORDS`` words, or too many repeated ones), ``log_perplexity`` (per character; NULL
    for a text of fewer than ``ORDER`` characters), ``lowest`` and ``highest`` (the band of
    its language and length) and ``kept``: neither failed, nor outside of the band, nor with
    more near repeats than its language's limit.

    A NULL text has no words and fails. NULL is a language of its own. A language with fewer
    than ``MIN_TEXTS`` trusted texts has the band of all languages; with fewer than that in
    all, no text is rejected by its perplexity. Copies count once in a band. Repeated rows are
    judged alike, an empty table gives an empty result. Columns of ``docs`` with the names of
    new ones, of what they are made from (``surprise``, ``n_grams``, ``n_near``, ``n_trigrams``)
    or ``_bin``, ``_key``, ``_text`` and ``_block`` are replaced; names that begin with ``_q_``
    are refused, all others kept.
    """
    if any(c.startswith("_q_") for c in docs.columns):
        raise ValueError("names that begin with _q_ are taken")
    new = ["base_failed", "log_perplexity", "lowest", "highest", "kept", "_bin", "_key"]
    plain = docs.drop(*new)
    lang = F.col(f"`{lang_column}`").cast("string") if lang_column in plain.columns else F.lit(None).cast("string")
    key = F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang))
    found = scored(plain, text_column, keep_text, broadcast_bytes=broadcast_bytes)
    judged = found.withColumn("_key", key)
    judged = judged.withColumn("log_perplexity", F.when(F.col("n_grams") > 0, F.col("surprise") / F.col("n_grams")))
    judged = judged.withColumn("_bin", F.floor(F.log2(F.greatest("n_grams", F.lit(1)))).cast("int"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = staged(judged.withColumn("base_failed", failed), "quality")
    if "model" in vars(found):
        found.model.destroy()
    good = judged.where(~F.col("base_failed") & (100 * F.col("n_symbols") <= SYMBOL_PERCENT * F.col("n_words")) & F.col("log_perplexity").isNotNull())
    near = F.col("n_near") / F.greatest("n_trigrams", F.lit(1))
    # a text's copies have its counts and its perplexity
    good = staged(
        good.select("_key", "_bin", "n_words", "n_grams", F.round("log_perplexity", 9).alias("value"), near.alias("near"), F.lit(0).alias("_q_all")).distinct(),
        "quality-trusted",
    )
    langs = staged(_tails(good, ["_key"]).select("_key", F.col("mid").alias("_q_lang_middle")), "quality-tails")
    whole = _tails(good, ["_q_all"]).select("_q_all", *(F.col(c).alias(f"_q_any_{c}") for c in ("low", "mid", "high")))
    scatter = (F.col("value") - F.col("_q_lang_middle")) * F.sqrt("n_grams")
    scattered = good.join(langs, "_key").select("_key", "_bin", scatter.alias("value"))
    of_bin = _tails(scattered, ["_key", "_bin"]).select("_key", "_bin", F.col("low").alias("_q_bin_low"), F.col("high").alias("_q_bin_high"))
    of_lang = _tails(scattered, ["_key"]).select("_key", F.col("low").alias("_q_lang_low"), F.col("high").alias("_q_lang_high"))
    nears = good.select("_key", "_q_all", F.col("near").alias("value"))

    def most(cell: str, name: str) -> DataFrame:
        limit = F.col("mid") + F.greatest(F.lit(NEAR_WIDTH), band * (F.col("high") - F.col("mid")))
        return _tails(nears, [cell]).select(cell, limit.alias(name))

    # rows for each language and length: few, unless texts name very many languages
    langs = _sent(staged(langs.join(of_lang, "_key").join(most("_key", "_q_lang_near"), "_key"), "quality-langs"))
    of_bin = _sent(staged(of_bin, "quality-bins"))
    whole = whole.join(most("_q_all", "_q_any_near"), "_q_all")
    joined = judged.withColumn("_q_all", F.lit(0)).join(of_bin, ["_key", "_bin"], "left").join(langs, "_key", "left").join(F.broadcast(whole), "_q_all", "left")
    root = F.sqrt(F.greatest("n_grams", F.lit(1)))
    middle = F.coalesce("_q_lang_middle", "_q_any_mid")

    def width(tail: Column, of_all: Column) -> Column:
        # in a language with few texts: the tail of all texts, whose languages differ
        reach = F.when(F.col("_q_lang_middle").isNotNull(), tail / root).otherwise(of_all)
        return F.when(middle.isNotNull(), F.greatest(F.lit(MIN_WIDTH), band * reach))

    below = width(-F.coalesce("_q_bin_low", "_q_lang_low"), F.col("_q_any_mid") - F.col("_q_any_low"))
    above = width(F.coalesce("_q_bin_high", "_q_lang_high"), F.col("_q_any_high") - F.col("_q_any_mid"))
    lowest, highest = F.when(middle.isNotNull(), F.greatest(middle - below, LEAST * middle)), middle + above
    outside = (F.col("log_perplexity") < lowest) | (F.col("log_perplexity") > highest) | (near > F.coalesce("_q_lang_near", "_q_any_near"))
    names = [c for c in judged.columns if c not in ("_key", "_bin", "surprise", "n_grams", "n_near", "n_trigrams", "base_failed", "log_perplexity")]
    return joined.select(
        *(f"`{c}`" for c in names), "base_failed", "log_perplexity", lowest.alias("lowest"), highest.alias("highest"),
        (~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).alias("kept"),
    )
