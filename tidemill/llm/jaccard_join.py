"""Near-duplicate classes: every pair of texts whose word shingles overlap enough.

The document-by-shingle incidence matrix is multiplied with its own transpose, in blocks
of columns. Only the columns that can still reveal a link are kept of each row: under any
one order of the shingles, two sets with Jaccard similarity t share one of their first
``n - ceil(t n) + 1`` members. The order puts shingles that many texts hold last, so a
passage found in thousands of texts is not a column of texts that have words of their own.

1. One scan gives each text's set size and a key of its set, and the shingles that repeat
   within a batch; their sums say which shingles are frequent. That only fixes the order:
   any order gives the same result.
2. A second scan makes the incidence rows, shuffled by column. Columns with one text go.
3. Star round: each text is compared with the one text it shares most columns with, out of
   the hubs of its columns, if these columns reach the bound of step 4. Chain round: the texts
   of each block (see 4) in an order of its own, each with the next one if that is of another
   class. Groups of copies, however large, come together here without a pair for each two
   members.
4. Block product of what is left. Columns that the same texts hold are a block: they are
   multiplied once, with their number as weight, so near copies are a pair for each block
   and not for each shingle. Within a block, texts of different classes are paired, in blocks
   of rows dealt as tasks of their own where many texts hold it. Pairs that cannot reach the
   size-derived bound from the block's first column on are not made, nor are those whose sets
   differ in more members than it allows: a parity sketch of each whole set goes with its
   rows, and no two sets differ in fewer members than their sketches in bits. The overlap
   counts of the others are summed, and those that still cannot reach the bound are discarded.
5. Candidates of 3 and 4 are compared on their whole sets. Links are merged by alternating
   large-star and small-star steps.

Exact copies share a key and are joined by it; only their smallest id takes part from 2 on.
Sets are of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.blocks import blocks, distinct, mixed, shingle_sets
from tidemill.llm.stages import columns_or_null, prepared, released, staged, unstage

SHINGLE_WORDS = 5
#: Similarity to reach, as a fraction of whole numbers.
SIMILARITY = (3, 4)
#: How many frequent shingles are put last; 9 bytes each are sent to the executors.
FREQUENT_LIMIT = 1 << 20
FREQUENT_FROM = 16
#: Members of a column handled by one task at a time.
COLUMN_BLOCK = 2048
#: Up to so many ids (8 bytes each) are sent to the executors instead of joined.
BROADCAST_IDS = 2_000_000
#: Least and most bits of a set's parity sketch, powers of two; between them twice its members.
SKETCH_BITS = (64, 4096)
#: Pairs whose sketches are compared at a time.
SKETCH_PAIRS = 1 << 16

_SHARED = ["column", "id", "n", "place", "hub", "hub_n", "hub_place", "block", "blocks", "held_by"]
#: Rows of a text in a block of columns that the same texts hold.
_HELD = ["held_by", "block", "id", "n", "before", "after", "columns", "last", "sketch", "cls"]
_PAIRS = "a long, b long, na long, nb long, c long, after long"
_FACTS = "kind int, id long, n long, key long, sketch binary"
_ENTRIES = pa.schema([("column", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])


def _set_key(members: np.ndarray) -> int:
    total = mixed(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(members))], np.uint64)).view(np.int64)[0])


def _sketch(members: np.ndarray) -> bytes:
    """For each value of the low bits of a hash, whether an odd number of members has it."""
    least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << (2 * len(members) - 1).bit_length()))
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differences(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bits in which the sketches of ``i`` and ``j`` differ, the wider one folded to the
    width of the other; 0 where one is missing."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    own = sketches[rows]
    width = np.array([len(s) // 8 if s is not None else 0 for s in own])
    common = np.minimum(width[x], width[y])
    found = np.zeros(len(i), np.int64)
    for w in np.unique(common[common > 0]):
        folded = np.zeros((len(rows), w), np.uint64)
        for v in np.unique(width[width >= w]):
            some = np.flatnonzero(width == v)
            words = np.frombuffer(b"".join(own[some]), "<u8").reshape(len(some), v // w, w)
            folded[some] = np.bitwise_xor.reduce(words, axis=1)
        of = np.flatnonzero(common == w)
        found[of] = np.bitwise_count(folded[x[of]] ^ folded[y[of]]).sum(axis=1, dtype=np.int64)
    return found


def _facts(size: int):
    """Rows of kind 0: a text's id, set size, set key and sketch. Rows of kind 1: a shingle
    (key) that n texts of the batch hold, n at least 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, members, sketches = [], [], [], []
            for _, _, block in blocks(batch.column(1)):
                for own in shingle_sets(block, size):
                    sizes.append(len(own))
                    keys.append(_set_key(own) if len(own) else None)
                    sketches.append(_sketch(own) if len(own) else None)
                    members.append(own)
            pooled = np.sort(np.concatenate(members)) if members else np.zeros(0, np.uint64)
            edge = np.flatnonzero(np.concatenate(([True], pooled[1:] != pooled[:-1], [True]))) if len(pooled) else np.zeros(1, np.int64)
            count = np.diff(edge)
            often = count > 1
            shared, count = pooled[edge[:-1][often]], count[often]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [len(sizes), len(shared)]), pa.int32()),
                    pa.concat_arrays([batch.column(0), pa.nulls(len(shared), pa.int64())]),
                    pa.array(np.concatenate([np.array(sizes, np.int64), count]), pa.int64()),
                    pa.concat_arrays([pa.array(keys, pa.int64()), pa.array(shared.view(np.int64))]),
                    pa.concat_arrays([pa.array(sketches, pa.binary()), pa.nulls(len(shared), pa.binary())]),
                ],
                ["kind", "id", "n", "key", "sketch"],
            )

    return run


def _first_columns(own: np.ndarray, frequent: np.ndarray, grade: np.ndarray, num: int, den: int) -> np.ndarray:
    """The members of a sorted set that come first in the common order."""
    keep = len(own) - -(-num * len(own) // den) + 1
    if not len(frequent):
        return own[:keep]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    rank = np.where(frequent[at] == own, grade[at], 0)
    return own[np.argsort(rank, kind="stable")[:keep]] if rank.any() else own[:keep]


def _entries(size: int, similarity: tuple[int, int], frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, grade = frequent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            of_key: dict[int, tuple[int, np.ndarray]] = {}
            for first, _, block in blocks(batch.column(1)):
                for row, own in enumerate(shingle_sets(block, size), first):
                    if len(own) and ids[row] is not None:
                        key = _set_key(own)
                        if key not in of_key or ids[row] < of_key[key][0]:
                            of_key[key] = (ids[row], own)
            columns = [_first_columns(own, hashes, grade, *similarity) for _, own in of_key.values()]
            counts = [len(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *columns]).view(np.int64)),
                    pa.array(np.repeat(np.array([i for i, _ in of_key.values()], np.int64), counts)),
                    pa.array(np.repeat(np.array([len(own) for _, own in of_key.values()], np.int64), counts)),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *map(np.arange, counts)])),
                ],
                schema=_ENTRIES,
            )

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Whole runs of rows that agree in the first ``keys`` columns, many at a time, from
    sorted batches."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if not len(rest[0]):
            continue
        differs = np.zeros(len(rest[0]) - 1, bool)
        for k in range(keys):
            differs |= rest[k][1:] != rest[k][:-1]
        last = np.flatnonzero(differs)
        if len(last):
            cut = last[-1] + 1
            yield [x[:cut] for x in rest]
            rest = [x[cut:] for x in rest]
    if rest is not None and len(rest[0]):
        yield rest


def _edges(values: list[np.ndarray]) -> np.ndarray:
    differs = np.zeros(len(values[0]) - 1, bool)
    for v in values:
        differs |= v[1:] != v[:-1]
    return np.concatenate(([0], np.flatnonzero(differs) + 1, [len(values[0])]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of columns that several texts hold: the text's id, set size and place of the
    column in its order, the same of the column's hub, the row's own block and the number
    of blocks, and a hash of the texts that hold the column. The hub has the fewest shingles before the column, hence the fewest that few
    others hold: in a group of copies, what they are copies of."""
    for column, ids, n, place in _runs(batches, 1):
        edge = _edges([column])
        members = np.diff(edge)
        run = np.repeat(np.arange(len(members)), members)
        first = np.lexsort((ids, place, run))[edge[:-1]][run]
        nth = np.empty(len(ids), np.int64)
        nth[np.lexsort((ids, run))] = np.arange(len(ids)) - edge[:-1][run]
        block = nth // COLUMN_BLOCK
        held_by = mixed(np.add.reduceat(mixed(ids.view(np.uint64) + np.uint64(1)), edge[:-1])).view(np.int64)[run]
        blocks = -(-members // COLUMN_BLOCK)[run]
        many = (members > 1)[run]
        rows = (column, ids, n, place, ids[first], n[first], place[first], block, blocks, held_by)
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in rows], _SHARED)


def _alike(similarity: tuple[int, int], rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs (i, j) of rows whose sketches differ in no more bits than similar sets do in
    members, with the number of columns and what may come after the last of them."""
    num, den = similarity
    ids, n, columns, last = (rows[c] for c in ("id", "n", "columns", "last"))
    for at in range(0, len(i), SKETCH_PAIRS):
        x, y = i[at : at + SKETCH_PAIRS], j[at : at + SKETCH_PAIRS]
        alike = (num + den) * (n[x] + n[y] - _differences(rows["sketch"], x, y)) >= 2 * num * (n[x] + n[y])
        x, y = x[alike], y[alike]
        if len(x):
            x, y = np.where(ids[x] > ids[y], y, x), np.where(ids[x] > ids[y], x, y)
            rest, shared = np.minimum(last[x], last[y]), np.minimum(columns[x], columns[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (ids[x], ids[y], n[x], n[y], shared, rest)], ["a", "b", "na", "nb", "c", "after"]
            )


def _apart(similarity: tuple[int, int], rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows of one block are of different classes and can reach the bound: what
    they share is the first of the columns, or one of the ``before`` and ``after`` it that each
    shares with any text at all, as far as that is known."""
    num, den = similarity
    ids, n, before, after, cls = (rows[c] for c in ("id", "n", "before", "after", "cls"))
    apart = (cls[x] != cls[y]) & (ids[x] != ids[y])
    apart &= den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
    most = np.minimum(before[x], before[y]) + 1 + np.minimum(after[x], after[y])
    return apart & ((num + den) * most >= num * (n[x] + n[y]))


def _chains(similarity: tuple[int, int]):
    """Pairs of texts that are next to each other within (columns, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _runs(batches, 2):
            rows = dict(zip(_HELD, values, strict=True))
            column, block, ids = rows["held_by"], rows["block"], rows["id"]
            edge = _edges([column, block])
            run = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            order = np.lexsort((mixed(mixed(ids.view(np.uint64)) ^ column.view(np.uint64)), run))
            x, y = order[:-1], order[1:]
            wanted = (run[x] == run[y]) & _apart(similarity, rows, x, y)
            yield from _alike(similarity, rows, x[wanted], y[wanted])

    return run


def _products(similarity: tuple[int, int]):
    """Pairs of texts within each (columns, block, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low, high, *values in _runs(batches, 3):
            rows = dict(zip(_HELD, values, strict=True))
            ids, cls, block = rows["id"], rows["cls"], rows["block"]
            edge = _edges([rows["held_by"], low, high])
            pairs, waiting = [], 0
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2 or (cls[a:b] == cls[a]).all():
                    continue
                left = np.arange(a, b) if low[a] == high[a] else np.arange(a, b)[block[a:b] == low[a]]
                right = left if low[a] == high[a] else np.arange(a, b)[block[a:b] == high[a]]
                for part in np.array_split(left, -(-len(left) // 256)):
                    x, y = part[:, None], right[None, :]
                    apart = _apart(similarity, rows, x, y)
                    if low[a] == high[a]:
                        apart &= ids[x] < ids[y]
                    i, j = np.nonzero(apart)
                    pairs.append((part[i], right[j]))
                    waiting += len(i)
                    if waiting >= SKETCH_PAIRS:
                        yield from _alike(similarity, rows, *map(np.concatenate, zip(*pairs, strict=True)))
                        pairs, waiting = [], 0
            if waiting:
                yield from _alike(similarity, rows, *map(np.concatenate, zip(*pairs, strict=True)))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.view(np.int64) for _, _, block in blocks(batch.column(1)) for own in shingle_sets(block, size)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int32))).astype(np.int32)
            members = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), members)], ["id", "members"]
            )

    return run


def _linked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    num, den = similarity
    overlap = F.size(F.array_intersect("ma", "mb"))
    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
        .where((num + den) * overlap >= num * (F.size("ma") + F.size("mb")))
        .select("a", "b")
        .distinct()
    )


def connected(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``edges`` (columns a, b): the smallest id that can
    be reached. Alternates large-star and small-star until nothing changes."""
    directed = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = directed.unionByName(directed.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        following = staged(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        unstage(directed)
        directed = following
        now = directed.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return directed.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        directed.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE_WORDS,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """``id, n_shingles, component`` for every row of ``docs``.

    ``component`` is the smallest id that can be reached over links, the row's own
    included. A text without words, or NULL, has no shingles and is linked with nothing.
    Rows that share an id are one document and are linked. A row whose id is NULL keeps
    its ``n_shingles`` and has no component. Other columns are ignored, an empty table
    gives an empty result.
    """
    spark = prepared(docs.sparkSession)
    num, den = similarity
    texts = columns_or_null(docs, [(id_column, "long"), (text_column, "string")]).toDF("id", "text")
    facts = staged(texts.mapInArrow(released(_facts(size)), _FACTS), "jaccard-facts")
    rows = facts.where("kind = 0").select("id", "n", "key", "sketch")
    often = (
        facts.where("kind = 1")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT_FROM)
        .orderBy(F.desc("n"), "key")
        .limit(FREQUENT_LIMIT)
        .toPandas()
    )
    hashes = often["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    grade = np.log2(np.maximum(often["n"].to_numpy(np.float64), 1)).astype(np.uint8)
    frequent = spark.sparkContext.broadcast((hashes[order], grade[order]))
    copies = rows.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    copies = staged(copies.where("c > 1").select("key", "rep"), "jaccard-copies")
    again = rows.where("id is not null").join(copies, "key", "left").groupBy("id").agg(F.max(F.coalesce(F.col("rep") == F.col("id"), F.lit(True))).alias("first"))
    again = staged(again.where("not first").select("id"), "jaccard-again")
    sources = texts.join(F.broadcast(again) if again.count() <= BROADCAST_IDS else again, "id", "left_anti").select("id", "text")
    shared = staged(
        sources.mapInArrow(released(_entries(size, similarity, frequent)), "column long, id long, n long, place long")
        .repartition("column")
        .sortWithinPartitions("column")
        .mapInArrow(released(_shared), ", ".join(f"{c} long" for c in _SHARED)),
        "jaccard-shared",
    )
    frequent.destroy()

    def reaches(na, nb, common, after):
        """Whether two sets with ``common`` leading columns can be similar enough: what else
        they share comes after the last of these in both (``after`` members at most), and
        after the leading columns of one of the two."""
        beyond = F.least(after, F.floor(num * F.greatest(na, nb) / den).cast("long"))
        return (num + den) * (common + beyond) >= num * (na + nb)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.select("a", "b"), "jaccard-pairs")
        ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-wanted")
        chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        sets = texts.join(chosen, "id").select("id", "text").mapInArrow(released(_sets(size)), "id long, members array<long>")
        sets = staged(sets, "jaccard-sets")
        links = staged(_linked(pairs, sets, similarity), "jaccard-links")
        unstage(pairs, ids, sets)
        return links

    after = F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place")) - 1
    stars = (
        shared.where(F.col("id") != F.col("hub"))
        .groupBy("id", "n", "hub", "hub_n")
        .agg(F.count("*").alias("c"), F.min(after).alias("after"))
        .where(reaches(F.col("n"), F.col("hub_n"), F.col("c"), F.col("after")))
        .groupBy("id")
        .agg(F.max(F.struct("c", (-F.col("hub")).alias("h"))).alias("best"))
        .select(F.col("id").alias("b"), (-F.col("best.h")).alias("a"))
    )
    links = verified(stars)
    classes = connected(links)

    # the columns of a text that others have too: what others lack can't be shared
    own = Window.partitionBy("id", "n")
    before = F.row_number().over(own.orderBy("place")).cast("long") - 1
    unknown = F.col("n") - (F.col("n") - F.ceil(F.col("n") * num / den).cast("long") + 1)
    placed = shared.withColumn("before", before).withColumn("after", F.count("*").over(own) - F.col("before") - 1 + unknown)
    # the texts of a block share all its columns, in one order: the first has least before it
    held = placed.groupBy("held_by", "id", "n").agg(
        F.min("before").alias("before"), F.max("after").alias("after"), F.count("*").alias("columns"), F.min("after").alias("last"),
        F.first("block").alias("block"), F.first("blocks").alias("blocks"),
    )
    # rows that share an id and a size may be different texts: none of their sketches counts
    sketches = rows.where("n > 0 and id is not null").groupBy("id", "n").agg(
        F.when(F.min("key") == F.max("key"), F.min("sketch")).alias("sketch")
    )
    held = staged(held.join(sketches, ["id", "n"], "left"), "jaccard-held")
    unstage(shared)

    def rest() -> DataFrame:
        return held.join(classes, "id", "left").withColumn("cls", F.coalesce("component", "id"))

    chains = rest().select(*_HELD).repartition("held_by", "block").sortWithinPartitions("held_by", "block")
    links = staged(links.unionByName(verified(chains.mapInArrow(released(_chains(similarity)), _PAIRS).select("a", "b").distinct())), "jaccard-links")
    classes = connected(links)

    first = F.lit(0).cast("long")
    others = F.when(F.col("blocks") > 1, F.sequence(first, F.col("blocks") - 1)).otherwise(F.array(first))
    dealt = rest().withColumn("other", F.explode(others))
    dealt = dealt.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *_HELD)
    counted = (
        dealt.repartition("held_by", "low", "high")
        .sortWithinPartitions("low", "high", "held_by")
        .mapInArrow(released(_products(similarity)), _PAIRS)
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("c").alias("c"), F.min("after").alias("after"))
    )
    left = counted.where(reaches(F.col("na"), F.col("nb"), F.col("c"), F.col("after"))).select("a", "b").distinct()
    links = staged(links.unionByName(verified(left)), "jaccard-links")
    unstage(held)

    named = staged(
        rows.join(copies, "key", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).alias("rep")),
        "jaccard-named",
    )
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    to_rep = named.join(ends, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # rows that share an id
    twice = named.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("id")
    twice = named.join(twice, "id").where("rep is not null").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    classes = connected(links.unionByName(to_rep).unionByName(twice))
    return named.join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component")
    )
