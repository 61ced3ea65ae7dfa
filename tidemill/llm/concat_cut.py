"""Packing by concatenation: all documents end to end, cut into windows of one length.

1. One scan tokenizes. Each task writes its documents' token ids with the number of tokens
   before them in the task.
2. Prefix sums, in two passes: over the documents of a task (while it writes), and over the
   totals of the tasks (one number each), which gives every document its global offset.
   Nothing is shuffled, so no source or group of copies can be hot.
3. Each document is cut where its tokens cross a window. What lies in one window is a
   boundary record: document, place in the document, place in the window.

The windows are full but for the last tokens of the table, fewer than a window. They are cut
at powers of two (at most log2 of the window's length of them), which need no padding.

A block of texts is tokenized at once: words are dictionary-encoded, each distinct one is
tokenized once, and the ids of all are gathered as arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.linear_packing import Words, kept_by_worker
from tidemill.llm.stages import columns_or_null, prepared, released, staged

WINDOW = 1024
END_ID = 0
#: Texts tokenized together, in characters (one text at least).
BLOCK_CHARS = 4 << 20

TOKENS = "id long, task int, before long, tokens long, ids binary"
RECORDS = "id long, start long, length long, crc long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of many words, each with the space before it, by one call: where tokens have
    as many characters as bytes, their lengths tell which belong to which word."""

    def __init__(self, path: str):
        self.words = Words(path)
        vocabulary = self.words.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)

    def text(self, text: str) -> np.ndarray:
        return np.array(self.words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has. No word is empty, or
        begins or ends with white space."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        listed = words.to_pylist()
        ids = np.array(self.words.encode(" " + " ".join(listed)), "<u4")
        after = np.cumsum(self.length[ids])
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        last = np.searchsorted(after, ends)
        if len(after) and last[-1] < len(after) and (after[last] == ends).all():
            return ids, np.diff(last, prepend=-1)
        parts = [np.array(self.words.encode(" " + w), "<u4") for w in listed]
        return np.concatenate(parts), np.array([len(p) for p in parts])


def token_ids(texts: pa.Array, encoder: Encoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, each followed by ``end_id``, and where each begins.

    A space that no other white space touches always begins a token, so a text may be
    tokenized word by word; other texts are tokenized as a whole."""
    cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
    edge = np.asarray(cut.offsets, np.int64)
    edge, n = edge - edge[0], len(texts)
    coded = cut.flatten().dictionary_encode()
    codes, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    # a word that begins a text has no space before it: it is an entry of its own
    begins = np.zeros(len(codes), bool)
    begins[edge[:-1]] = True
    used = np.zeros(len(known), bool)
    used[codes[~begins]] = True
    sound = pc.and_(pc.equal(pc.utf8_trim_whitespace(known), known), pc.greater(pc.binary_length(known), 0)).to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(n), np.diff(edge))
    firsts = known.take(pa.array(codes[edge[:-1]]))
    whole = ~pc.equal(pc.utf8_rtrim_whitespace(firsts), firsts).to_numpy(zero_copy_only=False).astype(bool)
    whole[row_of[~sound[codes] & ~begins]] = True
    own = [encoder.text(texts[row].as_py()) if whole[row] else np.array(encoder.words.encode(first), "<u4") for row, first in enumerate(firsts.to_pylist())]
    ids, counts = encoder.each(known.filter(pa.array(used & sound)))
    size = np.zeros(len(known) + n + 2, np.int64)
    size[: len(known)][used & sound] = counts
    size[len(known) : -2] = [len(o) for o in own]
    size[-1] = 1
    pool = np.concatenate([ids, *own, np.array([end_id], "<u4")])
    codes[whole[row_of]] = len(size) - 2  # nothing
    codes[edge[:-1]] = len(known) + np.arange(n)
    order = np.empty(len(codes) + n, np.int64)
    order[np.arange(len(codes)) + row_of] = codes
    order[edge[1:] + np.arange(n)] = len(size) - 1
    long = size[order]
    after = np.cumsum(long)
    made = pool[np.repeat((np.cumsum(size) - size)[order] - (after - long), long) + np.arange(after[-1] if len(after) else 0)]
    begin = np.concatenate(([0], after[edge[1:] + np.arange(n)])) if n else np.zeros(1, np.int64)
    return made, begin


def _blocks(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``BLOCK_CHARS`` with the row they begin at."""
    size = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(column):
        after = int(np.searchsorted(size, (size[row - 1] if row else 0) + BLOCK_CHARS, "right"))
        after = max(after, row + 1)
        yield row, column.slice(row, after - row).fill_null("")
        row = after


def _tokenized(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(("encoder", path), lambda: Encoder(path))
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, texts in _blocks(batch.column(1)):
                ids, begin = token_ids(texts, encoder, end_id)
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(texts)),
                        pa.array(np.full(len(texts), task, np.int32)),
                        pa.array(before + begin[:-1]),
                        pa.array(np.diff(begin)),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary()),
                    ],
                    ["id", "task", "before", "tokens", "ids"],
                )
                before += int(begin[-1])

    return run


def windows(total: int, window: int) -> np.ndarray:
    """Where the windows behind the last full one begin and end: powers of two, the largest
    first. The first entry is the end of the full ones."""
    left, edges = total % window, [total - total % window]
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    return np.array(edges, np.int64)


def _cut(bases: dict[int, int], total: int, window: int, keep: bool):
    last = windows(total, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")] + ["ids"] * keep
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("id", "task", "before", "tokens"))
            for id_, task, before, tokens, held in zip(*columns, batch.column("ids"), strict=True):
                ids = memoryview(held.as_buffer())
                begin, at = bases[task] + before, 0
                while at < tokens:
                    place = begin + at
                    if place < last[0]:
                        sequence, offset = divmod(place, window)
                        room = window - offset
                    else:
                        nth = int(np.searchsorted(last, place, "right")) - 1
                        sequence, offset, room = int(last[0]) // window + nth, place - int(last[nth]), int(last[nth + 1]) - place
                    length = min(room, tokens - at)
                    own = ids[4 * at : 4 * (at + length)]
                    rows.append((id_, at, length, zlib.crc32(own), tokens, sequence, offset) + ((np.frombuffer(own, "<i4"),) if keep else ()))
                    at += length
            made = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names)

    return run


def concatenate_and_cut(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    window: int = WINDOW, end_id: int = END_ID, ids: bool = False,
) -> DataFrame:
    """``id, start, length, crc, doc_tokens, sequence_id, offset`` and, if asked for, the
    token ``ids`` of every piece of every row: its tokens by the tokenizer file, then
    ``end_id``, lie in consecutive windows. ``start`` counts the document's tokens before the
    piece, ``offset`` those of the window, ``crc`` is the CRC-32 of the piece's ids.

    A NULL or empty text is a document of the closing token alone. Repeated rows, and rows
    whose id is NULL, are each packed. Documents follow one another as they are read, so
    which share a window depends on how the input is split into tasks. Other columns are
    ignored, an empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("a window holds one token at least")
    prepared(docs.sparkSession)
    rows = columns_or_null(docs, [(id_column, "long"), (text_column, "string")])
    tokens = staged(rows.mapInArrow(released(_tokenized(tokenizer, end_id)), TOKENS), "concat-tokens")
    totals = tokens.groupBy("task").agg(F.sum("tokens").alias("n")).orderBy("task").collect()  # one row for each task
    bases, total = {}, 0
    for r in totals:
        bases[r["task"]] = total
        total += r["n"]
    return tokens.mapInArrow(released(_cut(bases, total, window, ids)), RECORDS + ", ids array<int>" * ids)


def sequences(records: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the windows themselves, from records with their ``ids``. A group
    is one window, so no group is larger than that."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return records.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
