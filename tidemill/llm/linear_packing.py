"""Packing documents into as few token sequences as possible, by linear grouping.

A document longer than a sequence is cut; every other piece stays whole. How many pieces
there are of each length (at most ``capacity`` numbers) is all that the plan needs:

1. Large lengths, in order, form groups of equal cardinality and are rounded up to the
   largest of their group. That leaves few sizes.
2. A linear program over the configurations of these sizes that fit a sequence says how
   many sequences of each configuration to use; its columns are generated by a knapsack.
3. Actual lengths take the places of the rounded ones. What the rounding down of the
   program leaves over, and the small lengths, are best-fitted into the gaps, the longest
   first, and into new sequences.

The plan names, for each length, which ranks go where. Ranks are given to the pieces on
Spark: pieces of one length are spread over buckets, counted, and numbered per bucket.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm.stages import columns_or_null, prepared, released, staged

CAPACITY = 2048
END_ID = 0
#: Lengths above this share of a sequence are large.
LARGE = 1 / 4
GROUPS = 32
PER_GROUP = 32
#: Configurations are added while one saves more than this share of a sequence.
GAIN = 0.005
CACHED_WORDS = 200_000
# How byte-level BPE cuts a text, and texts that show whether a file does so.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = (" The", " naïve", " it's 12ab", "x", " été,", " 漢字かな", " 𝔘🙂!", " a.\nB", " A1b2--c", " \x00\x7f")
#: Pieces numbered together, at least; and buckets of one length, at most.
PER_BUCKET = 256
BUCKETS = 65_536

PIECES = "uid long, id long, piece int, start long, length long, crc long"


def kept_by_worker(name: tuple, make):
    """An object that a reused Python worker keeps from task to task."""
    held = sys.__dict__.setdefault("_tidemill_kept", {})
    if name not in held:
        held[name] = make()
    return held[name]


def _word_encoder(path: str, tokenizer):
    """What gives the ids of one short text. For a byte-level BPE file, the same merges in
    ``tiktoken``, which has far less to do for each call; else the tokenizer itself."""

    def slow(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    added = [t["content"] for t in model.get("added_tokens") or []]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    try:
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        if any(fast(t) != slow(t) for t in PROBES):
            return slow
    except (KeyError, ValueError, TypeError):
        return slow
    return lambda text: slow(text) if any(a in text for a in added) else fast(text)


class Words(dict):
    """Token ids, as bytes, of a word with the space before it.

    A space that no other white space touches always begins a token, so a text may be
    tokenized word by word. A word that is empty, or begins or ends with white space, is
    None: its text is tokenized as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.encode = _word_encoder(path, self.tokenizer)

    def __missing__(self, word: str) -> bytes | None:
        if len(self) > CACHED_WORDS:
            self.clear()
        alone = word and not word[0].isspace() and not word[-1].isspace()
        found = self[word] = array("I", self.encode(" " + word)).tobytes() if alone else None
        return found

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        whole = [self[w] for w in rest]
        if None in whole or first[-1:].isspace():
            first, whole = text, []
        return array("I", self.tokenizer.encode(first, add_special_tokens=False).ids).tobytes() + b"".join(whole)


def _tokenized(path: str, capacity: int, end_id: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_by_worker(("words", path), lambda: Words(path))
        end = array("I", [end_id]).tobytes()
        uid = TaskContext.get().partitionId() << 36
        names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * keep
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep
        for batch in batches:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(words.ids(text or "") + end)
                size = len(ids) // 4
                start, piece = 0, 0
                while start < size:
                    length = min(size - start, capacity) if size <= capacity or piece else size % capacity or capacity
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((uid, id_, piece, start, length, zlib.crc32(own)) + ((np.frombuffer(own, "<i4"),) if keep else ()))
                    uid, start, piece = uid + 1, start + length, piece + 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def pieces(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False,
) -> DataFrame:
    """``uid, id, piece, start, length, crc`` and, if asked for, the token ``ids`` of every
    piece of every document: its tokens by the tokenizer file, then ``end_id``. Documents
    of more than ``capacity`` tokens are cut so that all pieces but the first are full."""
    prepared(docs.sparkSession)
    rows = columns_or_null(docs, [(id_column, "long"), (text_column, "string")])
    return rows.mapInArrow(released(_tokenized(tokenizer, capacity, end_id, ids)), PIECES + ", ids array<int>" * ids)


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and has most value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for at in range(int(sizes.min()), capacity + 1):
        fits = sizes <= at
        gain = np.where(fits, best[at - np.minimum(sizes, at)] + value, -1.0)
        i = int(gain.argmax())
        if gain[i] > best[at - 1] + 1e-12:
            best[at], choice[at] = gain[i], i
        else:
            best[at] = best[at - 1]
    pattern, at = np.zeros(len(sizes)), capacity
    while at > 0:
        if choice[at] < 0:
            at -= 1
        else:
            pattern[choice[at]] += 1
            at -= int(sizes[choice[at]])
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, by column generation: least sequences in
    all such that every size gets its demand."""
    size = np.array(sizes)
    basis = np.diag((capacity // size).astype(float))
    need = np.array(demand, float)
    for _ in range(8 * len(sizes)):
        inverse = np.linalg.inv(basis)
        use = inverse @ need
        worth = np.ones(len(sizes)) @ inverse
        value, pattern = _knapsack(size, np.maximum(worth, 0), capacity)
        if value <= 1 + GAIN:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, use / np.maximum(step, 1e-9), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    use = np.linalg.inv(basis) @ need
    return [(basis[:, j], max(float(use[j]), 0.0)) for j in range(len(sizes))]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences: how many of the kind, and the (length, how many) it holds."""
    left = {n: c for n, c in histogram.items() if c > 0}
    full = [(c, [(n, 1)]) for n, c in left.items() if n >= capacity]
    large = sorted((n for n in left if LARGE * capacity < n < capacity), reverse=True)
    total = sum(left[n] for n in large)
    groups: list[list[int]] = []
    used = 0
    share = max(1, -(-total // max(1, min(GROUPS, total // PER_GROUP))))
    for n in large:
        if not groups or used >= share * len(groups):
            groups.append([])
        groups[-1].append(n)
        used += left[n]
    gaps: dict[int, list[tuple[int, list]]] = defaultdict(list)  # gap -> kinds
    if groups:
        sizes = [g[0] for g in groups]
        ready = large[::-1]
        for pattern, use in configurations(sizes, [sum(left[n] for n in g) for g in groups], capacity):
            again = int(use + 1e-9)
            slots = [i for i, a in enumerate(pattern) for _ in range(round(a))]
            while again > 0 and slots:
                # as many sequences as can hold the same actual lengths; the last place of
                # a configuration takes the longest that fits what the others leave
                heads, wanted = [], defaultdict(int)
                for k, i in enumerate(slots):
                    if k + 1 < len(slots):
                        head = next((n for n in groups[i] if left[n] > wanted.get(n, 0)), None)
                    else:
                        at = bisect_left(ready, capacity - sum(heads) + 1) - 1
                        while at >= 0 and left[ready[at]] <= wanted.get(ready[at], 0):
                            if not left[ready[at]]:
                                ready.pop(at)
                            at -= 1
                        head = ready[at] if at >= 0 else None
                    if head is not None:
                        heads.append(head)
                        wanted[head] += 1
                if not heads:
                    break
                count = min(again, *(left[n] // c for n, c in wanted.items()))
                for n, c in wanted.items():
                    left[n] -= count * c
                gaps[capacity - sum(heads)].append((count, sorted(wanted.items())))
                again -= count
    rest = sorted((n for n in left if left[n] and n < capacity), reverse=True)
    open_gaps = sorted(gaps)
    for n in rest:
        while left[n]:
            at = bisect_left(open_gaps, n)
            if at == len(open_gaps):
                fit = capacity // n
                kinds = [(-(-left[n] // fit), [])]
                gap = capacity
            else:
                gap = open_gaps[at]
                fit, kinds = gap // n, gaps[gap]
            count, held = kinds.pop()
            if gap < capacity and not kinds:
                open_gaps.pop(at)
                del gaps[gap]
            take = min(count, left[n] // fit)
            parts = [(take, fit)] if take else [(1, left[n])]
            if count > parts[0][0] and gap < capacity:
                back = count - parts[0][0]
                if gap not in gaps:
                    insort(open_gaps, gap)
                gaps[gap].append((back, held))
            for k, each in parts:
                left[n] -= k * each
                after = gap - each * n
                if after not in gaps:
                    insort(open_gaps, after)
                gaps[after].append((k, [*held, (n, each)]))
    return full + [kind for kinds in gaps.values() for kind in kinds]


def places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, sorted by rank: ranks from ``first`` on fill sequences from
    ``sequence`` on, ``each`` to a sequence, from ``offset`` on."""
    rows, taken, sequence = [], defaultdict(int), 0
    for count, held in kinds:
        offset = 0
        for n, each in held:
            rows.append((n, taken[n], each, sequence, offset))
            taken[n] += count * each
            offset += n * each
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T.copy(), strict=True))


def _placed(where: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (where["length"] << 44) + where["first"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            nth, within = np.divmod(rank - where["first"][at], where["each"][at]) if len(at) else (rank, rank)
            sequence = where["sequence"][at] + nth
            offset = where["offset"][at] + within * length
            kept = [batch.column(c) for c in ("id", "piece", "start", "length", "crc")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "crc", "sequence_id", "offset"]
            )

    return run


def linear_packing(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """``id, piece, start, length, crc, sequence_id, offset`` for every piece of every row:
    where it lies in which sequence of at most ``capacity`` tokens. ``start`` counts the
    tokens of the document before the piece, ``crc`` is the CRC-32 of its ids.

    A NULL or empty text is a document of the closing token alone. Repeated rows, and rows
    whose id is NULL, are each packed. Other columns are ignored, an empty table gives an
    empty result.
    """
    cut = staged(pieces(docs, tokenizer, id_column, text_column, capacity, end_id), "packing-pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    where = places(plan(histogram, capacity))
    per = [F.lit(v) for n, c in sorted(histogram.items()) for v in (n, max(1, min(BUCKETS, c // PER_BUCKET)))]
    spread = F.create_map(*per)[F.col("length")] if per else F.lit(1)
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("uid"), spread).cast("long"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    bases = staged(bases.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-bases")
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1
    ranked = bucketed.withColumn("nth", nth).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("id", "piece", "start", "length", "crc", "rank").mapInArrow(
        released(_placed(where)), "id long, piece int, start long, length long, crc long, sequence_id long, offset long"
    )
