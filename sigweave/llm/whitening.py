"""Embedding whitening by Chebyshev-filtered subspace iteration.

The vectors stay distributed; the driver holds a block of ``dimensions x columns`` numbers.  One pass
over the vectors multiplies their covariance with such a block: every task centres its vectors,
forms XᵀXQ for them, and the tasks' parts are added up by position.  A filter is a Chebyshev
polynomial of the covariance, made by the three-term recurrence with one pass per degree; it is
small on the unwanted part of the spectrum and grows fast above.  After a filter the block is made
orthonormal (QR) and turned to the best eigenvectors it holds (Rayleigh-Ritz).  This is repeated
until the residual of every wanted pair is at rounding level, which certifies it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.tables import cut

RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")
#: Values a sum over all rows must stay below to be a long.
LONG = 1 << 63


@dataclass(frozen=True)
class Solver:
    """``guards``: columns beyond the wanted ones; ``degree``: of one filter; ``tolerance``: residual over the
    largest eigenvalue that certifies a pair; ``rounds``: filters after which the result must be there."""

    components: int = 32
    guards: int = 16
    degree: int = 10
    tolerance: float = 2e-14
    rounds: int = 60
    seed: int = 12


class NotCertified(ArithmeticError):
    """The residuals did not fall to the tolerance."""


def quantised(vectors: DataFrame, vector: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """The rows whose vector is whole, with ``__x``: floor(scale * entry) + shift for each entry.

    Null vectors and those with a null, infinite or NaN entry go; so do empty ones, those with an entry
    of 2^55 or more, whose numbers leave a long, and those whose length is not the commonest (of equally
    common ones the largest), as they share no space.
    """
    v = F.col(f"`{vector}`")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0**55))
    x = F.transform(v, lambda c: (F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift)).cast("long"))
    rows = vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: bad(c.cast("double")))).withColumn("__x", x)
    sizes = rows.groupBy(F.size("__x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows.filter(F.size("__x") == F.lit(common["size"] if common else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all vectors of what ``part`` makes of a block of them.

    A task sends one number per position; what meets at the driver has the result's size.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "part"])

    sums = rows.select("__x").mapInArrow(go, "place long, part double").groupBy("place").agg(F.sum("part").alias("part"))
    out = np.zeros(int(np.prod(shape)))
    for r in sums.toPandas().itertuples():
        out[r.place] = r.part
    return out.reshape(shape)


@dataclass(frozen=True)
class Fit:
    """Sums per dimension, number of vectors, and the certified pairs, eigenvalues falling."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The mean less ``base``: exact to one rounding, whatever the size of the entries."""
        return np.array([s % self.n / self.n for s in self.sums])


def _centred(base: np.ndarray, rest: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: (x - base) - rest


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Exact sums: decimals, as the sum of longs may leave their range."""
    place = rows.select(F.posexplode("__x").alias("place", "x"))
    got = place.groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n")).collect()
    by = {r["place"]: r for r in got}
    return (by[0]["n"], [int(by[i]["sum"]) for i in range(len(by))]) if by else (0, [])


def _filtered(apply: Callable, q: np.ndarray, vq: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The block times the Chebyshev polynomial that is small on [low, high] and 1 at ``top``."""
    middle, half = (low + high) / 2, (high - low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - middle * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def _lower_bound(apply: Callable, d: int, rng: np.random.Generator, steps: int = 8) -> float:
    """Below (about) the smallest eigenvalue: a few Lanczos steps, less the last residual."""
    basis = [rng.normal(size=d)]
    basis[0] /= np.linalg.norm(basis[0])
    alphas, betas = [], []
    for _ in range(min(steps, d)):
        w = apply(basis[-1][:, None])[:, 0]
        alphas.append(float(w @ basis[-1]))
        for b in basis * 2:
            w = w - (w @ b) * b
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[:-1][: len(alphas) - 1], 1) + np.diag(betas[:-1][: len(alphas) - 1], -1))
    return max(0.0, float(ritz[0]) - betas[-1])


def fit(rows: DataFrame, solver: Solver = Solver()) -> Fit | None:
    """The leading eigenpairs of the covariance (divisor n) of the column ``__x``; None without rows.

    Eigenvalues that are zero but for rounding have no component.  Raises NotCertified if residuals
    stay above the tolerance.
    """
    n, sums = _sums(rows)
    if not n:
        return None
    d = len(sums)
    blank = Fit(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), 0.0, 0)
    centred, passes = _centred(blank.base, blank.rest), 0
    trace = float(_summed(rows, lambda x: np.array([np.square(centred(x)).sum()]), (1,))[0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ q)

        return _summed(rows, part, q.shape) / n

    if trace <= 0:
        return blank
    rng = np.random.default_rng(solver.seed)
    wanted = min(solver.components, d)
    block = min(d, wanted + solver.guards)
    q = np.linalg.qr(rng.normal(size=(d, block)))[0]
    low = _lower_bound(apply, d, rng) if block < d else 0.0
    residual = math.inf
    for _ in range(solver.rounds):
        vq = apply(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        have = int((values[:wanted] > 1e-12 * trace).sum())
        residual = float(np.linalg.norm(vq[:, :have] - q[:, :have] * values[:have], axis=0).max(initial=0.0)) / values[0]
        if residual <= solver.tolerance:
            signs = np.sign(q[np.abs(q).argmax(axis=0), np.arange(block)])
            return Fit(n, sums, trace, values[:have], (q * signs)[:, :have], residual, passes)
        high = max(float(values[-1]), 1e-9 * float(values[0]))
        q = np.linalg.qr(_filtered(apply, q, vq, solver.degree, min(low, 0.9 * high), high, float(values[0])))[0]
    raise NotCertified(f"residual {residual:.1e} after {passes} passes")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)², exact; null beyond a long."""
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    off = x - base
    most = ((int(np.abs(off).max(initial=0)) + 1) * n) ** 2 * x.shape[1]
    if most < LONG:
        return np.square(off * n - rest).sum(axis=1).tolist()
    exact = [sum((int(a) * n - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in off]
    return [v if v < LONG else None for v in exact]


def _identity_error(rows: DataFrame, found: Fit) -> float:
    centred, scaled, k = _centred(found.base, found.rest), found.vectors / np.sqrt(found.values), len(found.values)

    def part(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ scaled
        return np.concatenate([z.T @ z, z.sum(axis=0)[None]])

    got = _summed(rows, part, (k + 1, k)) / found.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max(initial=0.0))


def whitened(vectors: DataFrame, vector: str = "embedding", solver: Solver = Solver()) -> DataFrame:
    """The rows that have a whole vector, once per component, without ``vector`` and with the columns of ``RESULT``.

    ``whitened`` is the centred vector on the component over the root of its eigenvalue, ``explained``
    the eigenvalue's share, ``identity_error`` how far the whitened covariance is from the identity.
    Components go by falling eigenvalue, from 1; each has one sign for all rows.  Repeated rows count
    each and come back each; vectors that are all alike, and an empty table, give no row, as there is
    no component.  Input columns named like a result are replaced.
    """
    other = [c for c in vectors.columns if c != vector and c not in RESULT]
    rows = cut(quantised(vectors, vector).select(*[F.col(f"`{c}`") for c in other], "__x"), "vectors")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__x")
    schema = (f"{kinds}, " if kinds else "") + (
        "component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    found = fit(rows, solver)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = _identity_error(rows, found)
    n, sums, k = found.n, found.sums, len(found.values)
    centred, scaled, share = _centred(found.base, found.rest), found.vectors / np.sqrt(found.values), found.values / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                m, x = batch.num_rows, _matrix(batch.column("__x"))
                again = pa.array(np.repeat(np.arange(m), k))
                kept = [batch.column(c).take(again) for c in batch.schema.names if c != "__x"]
                made = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(again), pa.array((centred(x) @ scaled).ravel()),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*(c for c in batch.schema.names if c != "__x"), *RESULT])

    return rows.mapInArrow(project, schema)
