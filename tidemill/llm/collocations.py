"""Phrase collocations: every phrase's occurrences counted with burst tries, and cohesion scores.

A task counts the word paths of its texts in a trie. Words are numbered as they come up, so
frequent ones have small numbers. The trie is shallow: some neighbouring first words of a
language share a hash container of their paths, which bursts into a branch with a container
for each word once it holds too many, and these for each next word. When the containers of a task hold ``ENTRIES`` paths, whole subtrees, the largest
first, leave it as runs sorted by the words of their paths. A run is dealt to partitions by a
hash of the path's prefix; a partition merges the runs it gets and keeps what reaches the
least count. So a frequent word or pair is one row for each run, not one for each occurrence,
and the phrases that follow it are spread.

Two rounds, because most phrases are rare and a phrase is no more frequent than its parts:

1. Words and pairs, all of them.
2. Phrases of three words or more, where each pair in them is frequent. The pairs are sent
   as a Bloom filter of bounded size. It lets through every frequent pair; what else it lets
   through is counted and then falls below the least count, so it decides speed, not results.

Scores, cuts and the phrases inside longer ones are joins and aggregates of the frequent
phrases, in whole numbers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.blocks import Block, mixed
from tidemill.llm.stages import columns_or_null, prepared, released, staged, unstage

LONGEST = 4
LEAST = 30
REPORTED = 2000
#: A phrase is dropped if a longer one holds it this often, in percent.
INSIDE_PERCENT = 80
#: Paths that a task's trie holds, and a container before it bursts.
ENTRIES = 600_000
BURST = 4096
#: Text cut into paths at one time, in bytes.
SEGMENT = 1 << 20
#: Bits of a word's number; beyond them the numbers begin again. Bits of the first words that
#: share a container, where paths of the trie's depth leave room for them.
ID_BITS = 20
BLOCK_BITS = 10
#: Bytes of text for each partition of the merge.
PART_BYTES = 8 << 20
#: Rows that a merge gathers before it adds them up.
FOLD_ROWS = 500_000
BLOOM_BITS = 1 << 28
BLOOM_PER_KEY = 16
BLOOM_HASHES = 4
NO_LANGUAGE = "und"

RUNS = "part long, size int, lang string, phrases binary, counts binary"
COUNTS = "size int, lang string, phrase string, n long"
# What ends a piece, and what separates words.
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = np.zeros(256, bool)
_GAP[list(b" \t")] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_MIX = np.random.default_rng(13).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = np.append(data, np.uint8(0))  # an empty string at the end begins somewhere too
    return Block(data, offsets).hashes(offsets[:-1], offsets[1:])


def path_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A hash of a language and words, from their hashes."""
    total = lang * _MIX[0]
    for k, w in enumerate(words):
        total = total + w * _MIX[k + 1]
    return mixed(total)


class Pairs:
    """A Bloom filter of pairs, by their :func:`path_hash`."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for j in range(BLOOM_HASHES):
            yield (h + np.uint64(j) * step) & np.uint64(size - 1)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, 64 * len(self.bits)):
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


class Trie:
    """Counts of word paths, each a number made of its words': below each block of first
    words a container (path: count) or a branch (path's first words: node)."""

    def __init__(self, depth: int):
        self.rest = ID_BITS * (depth - 1)
        #: bits of the first word that are told apart within a block
        self.low = max(0, min(BLOCK_BITS, 62 - self.rest))
        self.shift = self.rest if self.low else self.rest - ID_BITS
        self.roots: dict[int, dict] = {}
        self.branched: set[int] = set()  # ids of the nodes that are branches
        self.held: dict[int, int] = {}
        self.entries = 0

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Count paths, given as language and first word, and the other words."""
        block, path = first >> self.low, (first & ((1 << self.low) - 1)) << self.rest | rest
        order = np.lexsort((path, block))
        block, path = block[order], path[order]
        opens = np.concatenate(([True], block[1:] != block[:-1]))
        edge = np.flatnonzero(opens | np.concatenate(([True], path[1:] != path[:-1])))
        counts = np.diff(np.concatenate((edge, [len(path)]))).tolist()
        block, paths, bound = block[edge], path[edge].tolist(), np.flatnonzero(opens[edge]).tolist()
        for root, a, b in zip(block[bound].tolist(), bound, [*bound[1:], len(paths)], strict=True):
            node = self.roots.get(root)
            if node is None:
                node = self.roots[root] = {}
            grown = self._add(node, paths[a:b], counts[a:b], self.shift)
            self.held[root] = self.held.get(root, 0) + grown
            self.entries += grown

    def _add(self, node: dict, paths: list[int], counts: list[int], shift: int) -> int:
        """Add sorted paths below a node; how many of them are new."""
        if id(node) in self.branched:
            grown, begin = 0, 0
            while begin < len(paths):
                word = paths[begin] >> shift
                end = bisect_left(paths, word + 1 << shift, begin)
                child = node.get(word)
                if child is None:
                    child = node[word] = {}
                grown += self._add(child, paths[begin:end], counts[begin:end], shift - ID_BITS)
                begin = end
            return grown
        before = len(node)
        if before:
            had = node.get
            for path, count in zip(paths, counts, strict=True):
                node[path] = had(path, 0) + count
        else:
            node.update(zip(paths, counts, strict=True))
        grown = len(node) - before
        if len(node) > BURST and shift > 0:
            rows = sorted(node.items())
            node.clear()
            self.branched.add(id(node))
            self._add(node, [p for p, _ in rows], [c for _, c in rows], shift)
        return grown

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remove whole subtrees, the largest first, until ``most`` entries are left: their
        first words, other words and counts."""
        roots, paths, counts = [], [], []
        for root in sorted(self.held, key=self.held.get, reverse=True):
            if self.entries <= most:
                break
            before = len(paths)
            self._walk(self.roots.pop(root), paths, counts)
            self.entries -= self.held.pop(root)
            roots.append((root, len(paths) - before))
        path = np.array(paths, np.int64)
        block = np.repeat(np.array([r for r, _ in roots], np.int64), [n for _, n in roots])
        return block << self.low | path >> self.rest, path & ((1 << self.rest) - 1), np.array(counts, np.int64)

    def _walk(self, node: dict, paths: list[int], counts: list[int]) -> None:
        if id(node) in self.branched:
            self.branched.discard(id(node))
            for child in node.values():
                self._walk(child, paths, counts)
        else:
            paths.extend(node.keys())
            counts.extend(node.values())


class Numbered(dict):
    """Numbers for strings as they come up."""

    def __missing__(self, value: bytes) -> int:
        self[value] = number = len(self)
        return number


class Counter:
    """The trie of a task with the words and languages it has numbered. Paths of up to
    ``depth`` words count if they have ``least`` words; phrases of ``sizes`` words leave it."""

    def __init__(self, depth: int, least: int, sizes: tuple[int, ...], parts: int, pairs: Pairs | None, entries: int):
        self.depth, self.least, self.sizes, self.parts, self.pairs, self.entries = depth, least, sizes, parts, pairs, entries
        self.langs = Numbered()
        self._new()

    def _new(self) -> None:
        self.words, self.hashes, self.trie = Numbered(), np.zeros(0, np.uint64), Trie(self.depth)

    def count(self, lang: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
        """Count the texts; runs come out when the trie is full."""
        text = text.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        names = [v.encode() for v in lang.cast(pa.string()).fill_null(NO_LANGUAGE).to_pylist()]
        of_text = np.array([self.langs[v] for v in names], np.int64)
        begin = 0
        while begin < len(data):
            end = _segment_end(data, offsets, begin)
            yield from self._segment(data[begin:end], offsets, begin, of_text)
            begin = end

    def _segment(self, raw: np.ndarray, offsets: np.ndarray, base: int, of_text: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = _BREAK[raw]
        inner = offsets[np.searchsorted(offsets, base, "left") : np.searchsorted(offsets, base + len(raw), "left")] - base
        starts = np.zeros(len(raw), bool)
        starts[inner] = True
        solid = ~(ends | _GAP[raw])
        opens = np.flatnonzero(solid & (starts | ~np.concatenate(([False], solid[:-1]))))
        if not len(opens):
            return
        closes = np.flatnonzero(solid & np.concatenate((starts[1:] | ~solid[1:], [True]))) + 1
        piece = np.cumsum(ends | starts)[opens]
        lang = of_text[np.searchsorted(offsets, base + opens, "right") - 1]
        letters = _FOLDED[raw[solid]]
        place = np.concatenate(([0], np.cumsum(closes - opens)))
        # numbers run out only between slices; a path may reach into the next slice
        step = SEGMENT // 4
        for first in range(0, len(opens), step):
            last = min(first + step, len(opens))
            after = min(last + self.depth - 1, len(opens))
            if len(self.words) + (after - first) >= (1 << ID_BITS) - 1:
                yield from self.runs(0)
                self._new()
            ids = self._numbers(letters[place[first] : place[after]], place[first : after + 1] - place[first])
            self._insert(ids, piece[first:after], lang[first:after], last - first)
            if self.trie.entries > self.entries:
                yield from self.runs(self.entries // 2)

    def _numbers(self, letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters.tobytes())])
        coded = words.dictionary_encode()
        known = len(self.words)
        numbers = np.array([self.words[w] for w in coded.dictionary.to_pylist()], np.int64)
        new = numbers >= known  # in the order of their numbers
        self.hashes = np.concatenate((self.hashes, text_hashes(coded.dictionary.filter(pa.array(new)))))
        return numbers[coded.indices.to_numpy()]

    def _insert(self, ids: np.ndarray, piece: np.ndarray, lang: np.ndarray, own: int) -> None:
        """Add the paths that begin at the first ``own`` words."""
        joined = np.zeros(len(ids) + self.depth, bool)  # a word and the next may lie in one path
        joined[: len(ids) - 1] = piece[1:] == piece[:-1]
        if self.pairs is not None and len(ids) > 1:
            at = np.flatnonzero(joined[: len(ids) - 1])
            h = path_hash(self._lang_hashes()[lang[at]], [self.hashes[ids[at]], self.hashes[ids[at + 1]]])
            joined[at] = self.pairs.may_hold(h)
        padded = np.concatenate((ids, np.zeros(self.depth, np.int64)))
        reach = np.ones(own, bool)
        path = np.zeros(own, np.int64)
        words = np.ones(own, np.int64)
        for k in range(1, self.depth):
            reach = reach & joined[k - 1 : k - 1 + own]
            path = path << ID_BITS | np.where(reach, padded[k : k + own] + 1, 0)
            words += reach
        first = lang[:own] << ID_BITS | ids[:own]
        keep = words >= self.least
        first, path = first[keep], path[keep]
        if not len(first):
            return
        self.trie.add(first, path)

    def _lang_hashes(self) -> np.ndarray:
        return text_hashes(pa.array(list(self.langs), pa.large_binary()))

    def runs(self, most: int) -> Iterator[pa.RecordBatch]:
        """Whole subtrees as sorted runs, until ``most`` paths are left in the trie."""
        first, path, count = self.trie.take(most)
        if not len(first):
            return
        lang, columns = first >> ID_BITS, [first & ((1 << ID_BITS) - 1)]
        for k in range(self.depth - 1):
            columns.append((path >> ID_BITS * (self.depth - 2 - k) & ((1 << ID_BITS) - 1)) - 1)
        vocabulary = pa.array(list(self.words), pa.large_binary())
        rank = np.empty(len(vocabulary) + 1, np.int64)
        rank[pc.sort_indices(vocabulary).to_numpy()] = np.arange(len(vocabulary))
        rank[-1] = -1  # of a path's missing words
        order = np.lexsort([rank[c] for c in reversed(columns)])
        lang, count, columns = lang[order], count[order], [c[order] for c in columns]
        for size in self.sizes:
            yield from self._run(size, lang, [c for c in columns[:size]], count, vocabulary)

    def _run(self, size: int, lang: np.ndarray, words: list[np.ndarray], count: np.ndarray, vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
        long = words[-1] >= 0
        lang, words, count = lang[long], [w[long] for w in words], count[long]
        if not len(lang):
            return
        part = path_hash(self._lang_hashes()[lang], [self.hashes[w] for w in words[:3]]) % np.uint64(self.parts)
        order = np.lexsort((lang, part))  # keeps the order of the words
        part, lang, count, words = part[order].astype(np.int64), lang[order], count[order], [w[order] for w in words]
        differs = (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])
        group = np.concatenate(([0], np.flatnonzero(differs) + 1, [len(part)]))
        for w in words:
            differs = differs | (w[1:] != w[:-1])
        edge = np.concatenate(([0], np.flatnonzero(differs) + 1))
        sums = np.add.reduceat(count, edge)
        phrases = pc.binary_join_element_wise(*(vocabulary.take(pa.array(w[edge])) for w in words), pa.scalar(b" ", pa.large_binary()))
        phrases = pc.binary_join_element_wise(phrases, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        at = np.searchsorted(edge, group)
        offsets = np.frombuffer(phrases.buffers()[1], np.int64)[: len(phrases) + 1]
        data, numbers = memoryview(phrases.buffers()[2]), memoryview(sums.astype("<i8").tobytes())
        names = list(self.langs)
        for a in range(0, len(group) - 1, 256):
            b = min(a + 256, len(group) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[group[a:b]]),
                    pa.array(np.full(b - a, size, np.int32)),
                    pa.array([names[i].decode() for i in lang[group[a:b]]], pa.string()),
                    pa.array([bytes(data[offsets[at[g]] : offsets[at[g + 1]]]) for g in range(a, b)], pa.binary()),
                    pa.array([bytes(numbers[8 * at[g] : 8 * at[g + 1]]) for g in range(a, b)], pa.binary()),
                ],
                ["part", "size", "lang", "phrases", "counts"],
            )


def _segment_end(data: np.ndarray, offsets: np.ndarray, begin: int) -> int:
    """Where a segment from ``begin`` on ends: after the last break, or at the last text's
    start, within ``SEGMENT`` bytes; at the first one beyond if there is none."""
    if begin + SEGMENT >= len(data):
        return len(data)
    start = int(offsets[np.searchsorted(offsets, begin + SEGMENT, "right") - 1])
    if start > begin:
        return start
    breaks = np.flatnonzero(_BREAK[data[begin : begin + SEGMENT]])
    if len(breaks):
        return begin + int(breaks[-1]) + 1
    limit = int(offsets[np.searchsorted(offsets, begin, "right")])  # the text's end
    at = begin + SEGMENT
    while at < limit:
        breaks = np.flatnonzero(_BREAK[data[at : at + SEGMENT]])
        if len(breaks):
            return min(at + int(breaks[0]) + 1, limit)
        at += SEGMENT
    return limit


def _counted(depth: int, least: int, sizes: tuple[int, ...], parts: int, pairs, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(depth, least, sizes, parts, None if pairs is None else Pairs(pairs.value), entries)
        for batch in batches:
            yield from counter.count(batch.column(0), batch.column(1))
        yield from counter.runs(0)

    return run


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("phrase").aggregate([("n", "sum")]).rename_columns(["phrase", "n"])


def _merged(least: int):
    """The phrases of each partition that reach the least count, from runs in the order of
    part, size and language; and as size 0 the words of each language in the partition."""

    def finished(key: tuple, tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        _, size, lang = key
        table = _added(tables)
        words = pc.sum(table["n"]).as_py()
        table = table.filter(pc.greater_equal(table["n"], least)).combine_chunks()
        phrases = [p[:-1].decode() for p in table["phrase"].to_pylist()]
        counts = table["n"].to_pylist()
        if size == 1:
            phrases, counts, sizes = [*phrases, None], [*counts, words], [1] * len(phrases) + [0]
        else:
            sizes = [size] * len(phrases)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int32()), pa.array([lang] * len(sizes), pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())],
            ["size", "lang", "phrase", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tables, rows = None, [], 0
        for batch in batches:
            columns = (batch.column(c) for c in ("part", "size", "lang", "phrases", "counts"))
            for part, size, lang, phrases, counts in zip(*columns, strict=True):
                own = (part.as_py(), size.as_py(), lang.as_py())
                if own != key:
                    if tables:
                        yield from finished(key, tables)
                    key, tables, rows = own, [], 0
                data = np.frombuffer(phrases.as_buffer(), np.uint8)
                offsets = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
                keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
                tables.append(pa.table({"phrase": keys, "n": pa.array(np.frombuffer(counts.as_buffer(), "<i8"))}))
                rows += len(keys)
                if rows > FOLD_ROWS:
                    tables = [_added(tables)]
                    rows = FOLD_ROWS // 2 if len(tables[0]) < FOLD_ROWS // 2 else 0
        if tables:
            yield from finished(key, tables)

    return run


def _bloom_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = text_hashes(pc.split_pattern(batch.column("phrase"), " ").flatten())
            h = path_hash(text_hashes(batch.column("lang")), [words[0::2], words[1::2]])
            at = np.unique(np.concatenate([*Pairs.places(h, size), np.zeros(0, np.uint64)])).astype(np.int64)
            bits = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bits.view(np.int64))], ["at", "bits"])

    return run


def pair_filter(pairs: DataFrame, limit: int = BLOOM_BITS) -> np.ndarray:
    """The bits of a Bloom filter of ``lang, phrase`` pairs: a power of two of them, at
    most ``limit``, however many pairs there are."""
    size = 1 << max(6, (BLOOM_PER_KEY * pairs.count() - 1).bit_length())
    size = min(size, limit)
    rows = pairs.select("lang", "phrase").mapInArrow(released(_bloom_rows(size)), "at long, bits long")
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # size / 64 rows at most
    bits = np.zeros(size // 64, np.uint64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def phrase_counts(
    docs: DataFrame, lang_column: str = "lang", text_column: str = "text",
    longest: int = LONGEST, least: int = LEAST, entries: int = ENTRIES, bloom_bits: int = BLOOM_BITS,
) -> DataFrame:
    """``size, lang, phrase, n``: every phrase of up to ``longest`` words (2 to 4) that occurs
    ``least`` times or more in its language, and as size 0 the language's words."""
    if not 2 <= longest <= 4:
        raise ValueError("phrases have 2 to 4 words")
    spark = prepared(docs.sparkSession)
    texts = columns_or_null(docs, [(lang_column, "string"), (text_column, "string")]).toDF("lang", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // PART_BYTES

    def merged(depth: int, least_words: int, sizes: tuple[int, ...], pairs, name: str) -> DataFrame:
        runs = texts.mapInArrow(released(_counted(depth, least_words, sizes, parts, pairs, entries)), RUNS)
        runs = runs.repartition("part").sortWithinPartitions("part", "size", "lang")
        return staged(runs.mapInArrow(released(_merged(least)), COUNTS), name)

    short = merged(2, 1, (1, 2), None, "phrases-short")
    counts = short.where("size > 0").unionByName(
        short.where("size = 0").groupBy("size", "lang").agg(F.lit(None).cast("string").alias("phrase"), F.sum("n").alias("n"))
    )
    if longest > 2:
        sent = spark.sparkContext.broadcast(pair_filter(short.where("size = 2"), bloom_bits))
        long = merged(longest, 3, tuple(range(3, longest + 1)), sent, "phrases-long")
        sent.destroy()
        counts = counts.unionByName(long)
    return counts


def _part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame, lang_column: str = "lang", text_column: str = "text",
    longest: int = LONGEST, least: int = LEAST, reported: int = REPORTED, inside_percent: int = INSIDE_PERCENT, entries: int = ENTRIES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``reported`` most cohesive
    phrases of 2 to ``longest`` words.

    A-Z are lowered; texts are split into pieces at ``.,;:!?`` and line ends, pieces into
    words at spaces and tabs. ``a`` is how often the phrase occurs, ``least`` times at least.
    A cut into a first part that occurs ``l`` times and a rest that occurs ``r`` times scores
    ``floor(2000000 a / (l + r))``; the cut with the lowest score counts, ties to the shortest
    first part. A phrase is dropped if a longer one that holds its words in a row occurs
    ``inside_percent`` percent as often, or more. Ties in score go to the greater ``a``, then the
    smaller phrase by its bytes. ``n`` is how many words the language has.

    A NULL language is ``und``. A NULL or empty text has no words. Repeated rows count each
    time. Other columns are ignored, an empty table gives an empty result.
    """
    counts = staged(phrase_counts(docs, lang_column, text_column, longest, least, entries), "phrases")
    found = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    known = counts.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))

    k = F.col("k")
    cut = found.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), _part(F.col("words"), F.lit(1), k).alias("part")),
        F.struct(F.lit(False).alias("left"), _part(F.col("words"), k + 1, F.col("size") - k).alias("part")),
    )
    asked = cut.select("lang", "phrase", "a", "k", F.explode(sides).alias("side")).select("lang", "phrase", "a", "k", "side.*")
    sizes = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = sizes.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))

    size, at = F.col("size"), F.col("at")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.struct(i.alias("at"), m.alias("m"))),
        )
    )
    inner = found.where("size > 2").select("lang", "a", "words", F.explode(spans).alias("span")).select("lang", "a", "words", "span.*")
    inner = inner.select("lang", _part(F.col("words"), at, F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (F.col("outer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside_percent)
    )

    # the first of each language: first within slices, then over what these leave
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = kept.select("lang", "phrase", "a", "least.l", "least.r", "least.score").withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= reported)
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= reported)
    words = counts.where("size = 0").select("lang", F.col("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
