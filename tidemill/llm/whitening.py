"""Whitening of vectors on their leading principal components, by Chebyshev-filtered
subspace iteration.

The covariance is never formed. All that is asked of the data is the product of the
covariance with a few columns, ``Xᵀ(XQ)/n`` over centred rows: a pass in which every task
returns one matrix of the columns' size.

1. Entries become whole numbers. The fit list is each distinct vector once.
2. A few Lanczos steps bound the spectrum from below.
3. A block of columns is put through a Chebyshev polynomial of the covariance, by its
   three-term recurrence, that is small on the unwanted part of the spectrum (from the lower
   bound to the block's least Ritz value) and grows steeply above it. Then QR, and
   Rayleigh-Ritz within the block.
4. That repeats until certified: the residuals ``|Vq - eq|`` of the wanted pairs are down to
   rounding, and a block of fresh random columns, filtered in the same way and orthogonal to
   the ones found, has no Ritz value above the least wanted one.

Where the block has as many columns as the vectors have entries, one pass settles it.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.stages import prepared, released, staged

COMPONENTS = 4
SCALE = 256
#: Columns of the block besides the wanted ones, degree of the polynomial, Lanczos steps.
GUARD, DEGREE, LANCZOS = 20, 10, 10
#: Residuals to reach, as a share of the largest eigenvalue; below ``SETTLED`` they may stop
#: falling, which is rounding.
RESIDUAL, SETTLED = 1e-15, 1e-12
MOST_ROUNDS = 200
#: Components whose eigenvalue is a smaller share of the largest are rounding, not data.
RANK = 1e-12
SEED = 11

WHITENED = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _vectors(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    held = batch.column(column)
    return held.flatten().to_numpy().reshape(len(held), -1) if len(held) else np.zeros((0, 0), np.int64)


def _whole(scale: int):
    """``id, x`` of the rows whose vector has finite entries only: ``floor(scale * entry)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            values = held.flatten()
            entry = values.fill_null(math.nan).to_numpy(zero_copy_only=False)
            size = np.array([0 if v is None else v for v in held.value_lengths().to_pylist()], np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(entry * scale)
            edge = np.concatenate(([0], np.cumsum(size)))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(entry))))
            good = (size > 0) & (bad[edge[1:]] == bad[edge[:-1]])
            inside = np.repeat(good, size)
            if (np.abs(x[inside]) >= 2.0**63).any():
                raise OverflowError(f"a finite entry times {scale} does not fit a long")
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(size[good]))).astype(np.int32)), pa.array(x[inside].astype(np.int64))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), lists], ["id", "x"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``i, high, low, n, most``: sums over a batch of each entry's upper and lower 32 bits."""
    for batch in batches:
        x = _vectors(batch)
        if not len(x):
            continue
        high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
        most = np.maximum(np.abs(x.max(0).astype(float)), np.abs(x.min(0).astype(float)))
        columns = (np.arange(x.shape[1]), high, low, np.full(x.shape[1], len(x)), most)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "high", "low", "n", "most"])


def _summed_by_task(of_rows: Callable[[np.ndarray], np.ndarray], mean: np.ndarray):
    """``i, j, v``: the sum over a task's rows of a matrix made from centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = _vectors(batch)
            if len(x):
                total = total + of_rows(x - mean)
        if np.ndim(total):
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, total)], ["i", "j", "v"])

    return run


class Covariance:
    """Products with the covariance of the fit list, each a pass over it."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]):
        self.fit, self.n, self.d = fit, n, len(sums)
        self.mean = np.array([s / n for s in sums])
        self.passes = 0

    def _pass(self, of_rows: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        self.passes += 1
        partial = self.fit.mapInArrow(released(_summed_by_task(of_rows, self.mean)), "i long, j long, v double")
        out = np.zeros(shape)
        for r in partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # as many as the shape has entries
            out[r["i"], r["j"]] = r["v"]
        return out / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        return self._pass(lambda x: x.T @ (x @ q), q.shape)

    def trace(self) -> float:
        return float(self._pass(lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), (1, 1))[0, 0])

    def projected(self, q: np.ndarray) -> np.ndarray:
        """The covariance of the rows' projections on the columns of ``q``."""

        def of_rows(x: np.ndarray) -> np.ndarray:
            w = x @ q
            return w.T @ w

        return self._pass(of_rows, (q.shape[1], q.shape[1]))


def lower_bound(times: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rng: np.random.Generator) -> float:
    """Below the spectrum of a positive operator, by Lanczos steps: the least Ritz value less
    the last residual."""
    basis, alpha, beta = [rng.standard_normal(d)], [], []
    basis[0] /= np.linalg.norm(basis[0])
    for _ in range(min(steps, d)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            for b in basis:
                w = w - (w @ b) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha[0], 1e-300):
            break
        basis.append(w / beta[-1])
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    return max(0.0, float(ritz[0]) - beta[-1])


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The columns under the polynomial that is within [-1, 1] on [low, high], scaled to 1 at
    ``top``."""
    half, middle = (high - low) / 2, (high + low) / 2
    rate = first = half / (top - middle)
    before, now = q, (times(q) - middle * q) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - rate)
        now, before = 2 * following / half * (times(now) - middle * now) - rate * following * before, now
        rate = following
    return now


def ritz(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling) and vectors of the span of ``q``, and each one's residual."""
    product = times(q)
    small = q.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, product = q @ turn, product @ turn
    return values, q, np.linalg.norm(product - q * values, axis=0)


def leading_pairs(
    times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int,
    guard: int = GUARD, degree: int = DEGREE, steps: int = LANCZOS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive operator given by its product with
    columns, their vectors and residuals."""
    wanted, rng = min(wanted, d), np.random.default_rng(SEED)
    if d <= wanted + guard:
        values, q, residual = ritz(times, np.eye(d))
        return values[:wanted], q[:, :wanted], residual[:wanted]
    q = np.linalg.qr(rng.standard_normal((d, wanted + guard)))[0]
    low = lower_bound(times, d, steps, rng)
    values, q, residual = ritz(times, q)
    worst = np.inf
    for _ in range(MOST_ROUNDS):
        top = float(values[0])
        if top <= 0:
            return values[:wanted], q[:, :wanted], residual[:wanted]
        now = float(residual[:wanted].max())
        if now <= RESIDUAL * top or (now <= SETTLED * top and now > worst / 2):
            # nothing missed: columns that know nothing of those found, through the same filter
            high = float(values[-1])
            probe = rng.standard_normal((d, wanted))
            if high > low and top > high:
                probe = chebyshev(times, probe - q @ (q.T @ probe), low, high, top, degree)
            for _ in range(2):
                probe -= q @ (q.T @ probe)
            probe = np.linalg.qr(probe)[0]
            seen, probe, _ = ritz(times, probe)
            if seen[0] <= values[wanted - 1] * (1 + SETTLED):
                return values[:wanted], q[:, :wanted], residual[:wanted]
            q = np.linalg.qr(np.hstack([q[:, :-wanted], probe]))[0]
            values, q, residual = ritz(times, q)
            worst = np.inf
            continue
        worst, high = now, float(values[-1])
        if not (high > low and top > high):  # a flat or closed spectrum: plain iteration
            q = np.linalg.qr(times(q))[0]
        else:
            q = np.linalg.qr(chebyshev(times, q, low, high, top, degree))[0]
        values, q, residual = ritz(times, q)
    raise ArithmeticError(f"residuals of {residual[:wanted]} after {MOST_ROUNDS} rounds")


def _projected(n: int, sums: list[int], small: bool, mean: np.ndarray, columns: np.ndarray, explained: list[float], error: float):
    """The result's rows: one for each row and component."""
    k = columns.shape[1]

    def deviations(x: np.ndarray) -> pa.Array:
        if small:
            return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
        return pa.array([decimal.Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            if not len(x):
                continue
            each = pa.array(np.repeat(np.arange(len(x)), k))
            rows = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows, n)),
                    deviations(x).take(each),
                    pa.array(((x - mean) @ columns).ravel()),
                    pa.array(np.tile(np.array(explained), len(x))),
                    pa.array(np.full(rows, error)),
                ],
                [f.split()[0] for f in WHITENED.split(", ")],
            )

    return run


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for every row
    with a vector and every component, numbered from 1 by falling eigenvalue.

    Entries become ``x = floor(scale * entry)``. The fit list, of ``n`` vectors with sums S,
    is each distinct x vector once, so copies do not weigh. ``deviation`` is the sum over
    entries of ``(n x - S)^2``, exact; NULL where it has over 38 digits. ``whitened`` is
    ``x - S/n`` on the component, over the root of its eigenvalue, ``explained`` the
    eigenvalue's share of the trace, ``identity_error`` how far the covariance of the
    whitened fit list is from the identity.

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries are dropped; a finite
    entry beyond a long raises. Vectors of another length than most (of equally many: the
    longest) are dropped too. Repeated rows and rows without an id each have their rows.
    Components without variance are left out, so a fit list of one vector gives none. Other
    columns are ignored, an empty table gives an empty result.
    """
    spark = prepared(vectors.sparkSession)
    vector = F.col(f"`{vector_column}`").cast("array<double>") if vector_column in vectors.columns else F.lit(None).cast("array<double>")
    id_ = F.col(f"`{id_column}`").cast("long") if id_column in vectors.columns else F.lit(None).cast("long")
    rows = vectors.select(id_.alias("id"), vector.alias("v")).where("v is not null")
    rows = staged(rows.mapInArrow(released(_whole(scale)), "id long, x array<long>"), "whiten-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], WHITENED)
    d = lengths[0]["d"]
    rows = rows.where(F.size("x") == d)
    fit = staged(rows.select("x").distinct(), "whiten-fit")
    whole = "decimal(38,0)"
    of_entry = fit.mapInArrow(released(_sums), "i long, high long, low long, n long, most double").groupBy("i").agg(
        F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low"),
        F.sum("n").alias("n"), F.max("most").alias("most"),
    ).orderBy("i").collect()  # one row for each entry of a vector
    n, most = of_entry[0]["n"], max(r["most"] for r in of_entry)
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in of_entry]
    of_fit = Covariance(fit, n, sums)
    trace = of_fit.trace()
    if trace <= 0:
        return spark.createDataFrame([], WHITENED)
    values, q, _ = leading_pairs(of_fit.times, d, components)
    held = int((values > RANK * values[0]).sum())
    columns = q[:, :held] / np.sqrt(values[:held])
    error = float(np.abs(of_fit.projected(columns) - np.eye(held)).max())
    small = (2 * n * (most + 1)) ** 2 * d < 2.0**62
    made = _projected(n, sums, small, of_fit.mean, columns, [float(v / trace) for v in values[:held]], error)
    return rows.mapInArrow(released(made), WHITENED)
