"""Mixing sources to target sizes by entropy balancing.

Every document gets a rate, the number of times the mix should hold it. Of all rates that
give each source its target number of words, the balanced ones are closest to the prior
rates in relative entropy per word. Their dual has one coordinate for each source, and the
rates are the prior tilted exponentially: ``rate = min(cap, prior * exp(lambda[source]))``.

Documents are first counted by (source, size, prior), which is all the dual needs. Each
Newton iteration is one aggregation over these counts. Rates become whole copies per count:
from the largest size down, each takes the copies that bring its source nearest to what
the rates ask for so far, so that what one size leaves over is made up by the next; at the
end a source misses its target by about half of its smallest document. Which documents of
a count get the extra copy is decided by a hash of the whole row; of rows that are alike in
every column as many get it as the count asks for, so the result is the same on each run.

DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.stages import staged, unstage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
ITERATIONS = 60
TOLERANCE = 1e-9
#: Counts (about 40 bytes each) sent to the executors; more are joined by a shuffle.
BROADCAST_COUNTS = 500_000
#: Slices of the hash range in which the last extra copy of a count is looked for.
SLICES = 4096
PER_SLICE = 128


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as text that is never NULL and sorts NULL last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def weighted_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``key, words, target`` from ``key, words``: the weights, repeated over the keys in
    order, share out all words; a target stops at ``cap`` times its source's words and the
    excess goes to the others by weight until none is above.

    With the sources in order of the level at which they are full, the full ones come
    first, so running sums find the level at which the rest stand.
    """
    by_key = Window.orderBy("key")
    table = F.array(*(F.lit(float(w)) for w in weights))
    ranked = totals.withColumn("weight", table[(F.row_number().over(by_key) - 1) % len(weights)])
    ranked = ranked.withColumn("full", F.col("words") * float(cap)).withColumn("level", F.col("full") / F.col("weight"))
    order = Window.orderBy("level", "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    water = (F.sum("words").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("water", water)
    common = F.first(F.when(F.col("level") >= F.col("water"), F.col("water")), ignorenulls=True).over(everything)
    return levelled.withColumn("common", common).select(
        "key",
        "words",
        F.when(F.col("common").isNull() | (F.col("level") < F.col("common")), F.col("full"))
        .otherwise(F.col("common") * F.col("weight"))
        .alias("target"),
    )


def balanced(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``key, lambda``: the dual solution for ``counts`` (key, size, prior, n) and
    ``targets`` (key, target), by Newton's method with steps of at most 1.

    Sources without words, or with target 0, keep lambda 0 and are handled by the caller.
    """
    dual = staged(targets.select("key", "target", F.lit(0.0).alias("lambda")), "mix-dual")
    for _ in range(ITERATIONS):
        tilted = F.col("prior") * F.exp("lambda")
        mass = F.col("n") * F.col("size")
        sums = (
            counts.join(dual, "key")
            .groupBy("key")
            .agg(
                F.first("target").alias("target"),
                F.first("lambda").alias("lambda"),
                F.sum(mass * F.least(tilted, F.lit(float(cap)))).alias("taken"),
                F.sum(F.when(tilted < cap, mass * tilted).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("target") - F.col("taken")
        step = F.when(
            (F.col("target") > 0) & (F.abs(gap) > TOLERANCE * F.col("target")),
            # no document below the cap can only mean that too much is taken
            F.when(F.col("slope") > 0, gap / F.col("slope")).otherwise(F.signum(gap)),
        ).otherwise(0.0)
        stepped = staged(
            sums.select("key", "target", (F.col("lambda") + F.greatest(F.least(step, F.lit(1.0)), F.lit(-1.0))).alias("lambda"), (step != 0).alias("moved")),
            "mix-dual",
        )
        unstage(dual)
        dual = stepped
        if not dual.where("moved").limit(1).count():
            break
    return dual.select("key", "lambda")


def _whole(counts: DataFrame, cap: int) -> DataFrame:
    """``key, size, prior, n, copies``: all copies of each count, from the largest down."""
    entry = F.struct("size", "prior", "n", "rate")
    start = "named_struct('ideal', 0D, 'taken', 0D, 'out', cast(array() as array<bigint>))"
    copies = f"""cast(greatest(0D, least(cast({cap} * x.n as double),
        if(x.size = 0, 0D, round((s.ideal + x.rate * x.n * x.size - s.taken) / x.size)))) as bigint)"""
    fold = f"""aggregate(entries, {start},
        (s, x) -> named_struct('ideal', s.ideal + x.rate * x.n * x.size, 'taken', s.taken + {copies} * x.size, 'out', concat(s.out, array({copies}))), s -> s.out)"""
    return (
        counts.groupBy("key")
        .agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries"))
        .select("key", F.explode(F.arrays_zip("entries", F.expr(fold).alias("copies"))).alias("x"))
        .select("key", "x.entries.size", "x.entries.prior", "x.entries.n", "x.entries.rate", "x.copies")
    )


def _thresholds(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """``key, size, prior, rate, base, last, rows_at, extra_at``: every document gets ``base``
    copies, and one more if its ``u`` is below ``last``, or is one of ``extra_at`` of the
    ``rows_at`` rows at it. Found by counting slices of the range of u, then the values of u
    in one slice only."""
    cell = ["key", "size", "prior"]
    split = whole.withColumn("base", F.floor(F.col("copies") / F.greatest("n", F.lit(1))).cast("long"))
    split = split.withColumn("extra", F.col("copies") - F.col("base") * F.col("n"))
    slices = F.least(F.lit(SLICES), F.ceil(F.col("n") / PER_SLICE))
    sliced = rows.join(split.where("extra > 0").select(*cell, "n", "extra"), cell).withColumn(
        "slice", F.floor(F.col("u") * slices).cast("long")
    )
    upto = Window.partitionBy(*cell).orderBy("slice")
    found = (
        sliced.groupBy(*cell, "slice")
        .agg(F.count("*").alias("here"), F.first("extra").alias("extra"))
        .withColumn("seen", F.sum("here").over(upto))
        .where("seen >= extra and seen - here < extra")
        .select(*cell, "slice", (F.col("extra") - F.col("seen") + F.col("here")).alias("nth"))
    )
    before = Window.partitionBy(*cell).orderBy("u")
    last = (
        sliced.join(found, [*cell, "slice"])
        .groupBy(*cell, "u", "nth")
        .agg(F.count("*").alias("rows_at"))
        .withColumn("seen", F.sum("rows_at").over(before))
        .where("seen >= nth and seen - rows_at < nth")
        .select(*cell, F.col("u").alias("last"), "rows_at", (F.col("nth") - F.col("seen") + F.col("rows_at")).alias("extra_at"))
    )
    none = F.lit(0).cast("long")
    return split.join(last, cell, "left").select(
        *cell, "rate", "base", F.coalesce("last", F.lit(-1.0)).alias("last"), F.coalesce("rows_at", none).alias("rows_at"), F.coalesce("extra_at", none).alias("extra_at")
    )


def _some_of_each(rows: DataFrame, cell: Sequence[str], wanted: str) -> DataFrame:
    """``rows`` with ``chosen``, true for ``wanted`` rows of each ``cell``. A cell may hold a
    large share of all rows: they are numbered within the task that read them, and the tasks'
    counts are summed up."""
    placed = staged(rows.withColumn("at", F.monotonically_increasing_id()), "mix-ties")
    placed = placed.withColumn("task", F.shiftright("at", 33))
    upto = Window.partitionBy(*cell).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy(*cell, "task").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*cell, "task").orderBy("at"))
    numbered = placed.withColumn("within", within).join(tasks.drop("here"), [*cell, "task"])
    return numbered.withColumn("chosen", F.col("before") + F.col("within") <= F.col(wanted)).select(*rows.columns, "chosen")


def _hashed(docs: DataFrame, seed: int) -> Column:
    """A number from 0 to 1 of each whole row, but for types that have no hash."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = (F.col(f"`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind)
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


def entropy_mix(
    docs: DataFrame,
    targets: DataFrame,
    source_column: str = "source",
    size_column: str = "size",
    prior_column: str | None = None,
    cap: int = CAP,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with ``rate`` (double) and ``copies`` (long, 0 to ``cap``).

    ``targets`` has ``key`` (of :func:`source_key`) and ``target``, one row for each source.
    A source that ``targets`` lacks gets no copies. NULL is a source of its own, a NULL or
    negative size counts as 0 and gets no copies, a NULL prior as 1. Repeated rows, and rows
    without an id, are documents of their own: any number of them may get one copy more than
    the others. Columns called ``rate`` or ``copies`` are replaced, others may have any name.
    """
    size = F.greatest(F.coalesce(F.col(f"`{size_column}`").cast("long"), F.lit(0)), F.lit(0))
    prior = F.lit(1.0) if prior_column is None else F.coalesce(F.col(f"`{prior_column}`").cast("double"), F.lit(1.0))
    facts = {"key": source_key(F.col(f"`{source_column}`")), "size": size, "prior": prior, "u": _hashed(docs, seed)}
    rows = staged(docs.select(*(c.alias(n) for n, c in facts.items())), "mix-rows")
    counts = staged(rows.groupBy("key", "size", "prior").agg(F.count("*").alias("n")), "mix-counts")
    wanted = targets.select("key", "target")
    dual = balanced(counts, wanted, cap)
    rated = counts.join(dual, "key").join(wanted, "key")
    rated = rated.withColumn(
        # rounded: the last digits of a sum depend on the order of its parts
        "rate", F.when(F.col("target") > 0, F.round(F.least(F.col("prior") * F.exp("lambda"), F.lit(float(cap))), 9)).otherwise(0.0)
    ).select("key", "size", "prior", "n", "rate")
    whole = staged(_whole(rated, cap), "mix-whole")
    split = staged(_thresholds(rows, whole), "mix-split")
    split = F.broadcast(split) if split.count() <= BROADCAST_COUNTS else split
    plain = [c for c in docs.columns if c.lower() not in ("rate", "copies")]
    # the columns of the table stay packed, so their names meet none of those used here
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in plain)).alias("row"), *(c.alias(n) for n, c in facts.items()))
    cell = ["key", "size", "prior"]
    judged = packed.join(split, cell, "left")

    def copied(judged: DataFrame, more: Column) -> DataFrame:
        copies = F.least(F.coalesce("base", F.lit(0)) + F.when(more, 1).otherwise(0), F.lit(cap))
        return judged.select(
            *(F.col(f"row.`{c}`") for c in plain), F.coalesce("rate", F.lit(0.0)).alias("rate"), F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies")
        )

    if split.where("extra_at < rows_at").isEmpty():
        return copied(judged, F.col("u") <= F.col("last"))
    tied = F.coalesce((F.col("u") == F.col("last")) & (F.col("extra_at") < F.col("rows_at")), F.lit(False))
    clear = copied(judged.where(~tied), F.col("u") <= F.col("last"))
    return clear.unionByName(copied(_some_of_each(judged.where(tied), cell, "extra_at"), F.col("chosen")))
