"""Whitening of embeddings by their leading principal components, found by Jacobi-Davidson.

Entries become integers, floor(256 c). The fit list holds each distinct vector once; it is written as
blocks of packed rows, and everything that the eigenvectors need of it are products of its covariance
with a few columns: a pass over the blocks, each task centring its rows before it multiplies, and a sum
of d x k numbers. No covariance matrix is formed and no vectors reach the driver, whose work is on d
numbers a column: Rayleigh-Ritz on a subspace, correction equations projected against the converged and
the current vectors and solved by MINRES (the systems of all wanted pairs advance together, so that a
pass serves them all), locking of converged pairs, restarts from the best Ritz vectors. Iteration ends when
all residuals are at the rounding error of a product; otherwise it is an error, never a rougher result.

Cases: rows whose vector is null or has null or non-finite entries are left out; a shorter vector counts as if
it ended in zeros, an empty one too; a component without variance (fewer distinct vectors than components, or
constant dimensions) has null for ``whitened``, and where there is no variance at all also for ``explained``;
``identity_error`` is over the components with variance, null without any; components are at most the
dimensions; of equal eigenvalues any basis is taken, and of the two signs the one that makes the largest entry
positive; an entry beyond 2^61 / 256 counts as that bound; rows that repeat an identifier or have none give rows each; an
empty table gives an empty result; further columns are not needed. Deviations are exact decimals, null
from 10^38 on.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import arrow_batches, materialise

STEP = 256
BOUND = float(1 << 61)
EPS = float(np.finfo(np.float64).eps)
#: Rows of a block of packed vectors.
BLOCK = 4096


class Fit(NamedTuple):
    """What the fit list gives: its rows, sums by dimension, trace, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int
    identity_error: float | None


# The fit list


def integers(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows of ``df`` with a usable vector, with its integers as array ``x``."""
    entry = F.col(f"`{vec_col}`")
    usable = entry.isNotNull() & F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    whole = F.transform(entry, lambda c: F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c.cast("double") * STEP))).cast("long"))
    return df.filter(usable).withColumn("x", whole)


def _packed(d: int):
    """Blocks of vectors as the smallest integers that hold them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = _matrix(batch.column(0).slice(at, BLOCK), d)
                least = int(rows.min(initial=0)), int(rows.max(initial=0))
                width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= least[0] and least[1] < 1 << 8 * w - 1)
                yield pa.record_batch([pa.array([width], pa.int32()), pa.array([rows.astype(f"<i{width}").tobytes()], pa.binary())], names=["width", "rows"])

    return run


def _matrix(arrays: pa.Array, d: int) -> np.ndarray:
    """Arrays of integers as a matrix of ``d`` columns, filled up with zeros."""
    out = np.zeros((len(arrays), d), np.int64)
    values, length = arrays.flatten().to_numpy(zero_copy_only=False), np.diff(arrays.offsets.to_numpy())
    row = np.repeat(np.arange(len(arrays)), length)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out


def _unpacked(batches, d: int):
    for batch in batches:
        for width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield np.frombuffer(raw, f"<i{width}").reshape(-1, d)


def _sum_rows(totals: np.ndarray) -> pa.RecordBatch:
    """A row for each row of a small matrix."""
    return pa.record_batch([pa.array(np.arange(len(totals), dtype=np.int32)), *[pa.array(totals[:, k]) for k in range(totals.shape[1])]], names=["at", *[f"v{k}" for k in range(totals.shape[1])]])


def _added(blocks: DataFrame, task, columns: int, kind: str = "double") -> np.ndarray:
    """The sum of the matrices that tasks make of their blocks, added up by Spark."""
    schema = "at int, " + ", ".join(f"v{k} {kind}" for k in range(columns))
    found = blocks.mapInArrow(task, schema).groupBy("at").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(columns)])
    return np.array([list(r)[1:] for r in sorted(found.collect(), key=lambda r: r["at"])])  # a row a dimension or component


class FitList:
    """The distinct vectors, as blocks in the shared folder, and sums and products over them."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        x = vectors.select("x")
        self.d = x.agg(F.max(F.size("x"))).first()[0] or 0
        # Vectors that differ in zeros at the end are one.
        full = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(self.d) - F.size("x"))).alias("x")
        self.blocks = materialise(x.select(full).distinct().mapInArrow(_packed(self.d), "width int, rows binary"), "vectors")
        self.spark, self.passes = spark, 0
        d = self.d

        def sums(batches):
            # Low and high halves apart, so that neither overflows; a task has fewer than 2^31 rows.
            low, high, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
            for rows in _unpacked(batches, d):
                wide = rows.astype(np.int64)
                low += (wide & 0x7FFFFFFF).sum(axis=0)
                high += (wide >> 31).sum(axis=0)
                n += len(rows)
            yield _sum_rows(np.stack([low, high, np.full(d, n, np.int64)], axis=1))

        found = _added(self.blocks, sums, 3, "long") if d else np.zeros((0, 3))
        self.sums = [int(low) + (int(high) << 31) for low, high, _ in found.tolist()]
        self.n = int(found[0][2]) if d else 0
        # The mean is kept as an integer and a remainder, so that centring does not cancel.
        self.base = np.array([s // self.n for s in self.sums], np.int64) if self.n else np.zeros(d, np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums]) if self.n else np.zeros(d)

    def map(self, f, columns: int) -> np.ndarray:
        """The sum of f(centred rows) over the blocks, a matrix of ``columns`` columns."""
        d, base, rest = self.d, self.base, self.rest
        self.passes += 1

        def task(batches):
            total = 0
            for rows in _unpacked(batches, d):
                total = total + f((rows - base).astype(np.float64) - rest)
            if np.ndim(total):
                yield _sum_rows(total)

        return _added(self.blocks, task, columns)

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times ``columns``: one pass."""
        return self.map(lambda c: c.T @ (c @ columns), columns.shape[1]) / self.n

    def trace(self) -> float:
        return float(self.map(lambda c: np.square(c).sum(axis=0)[:, None], 1).sum() / self.n)


# Jacobi-Davidson


def orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The columns of ``new`` made orthonormal to each other and to ``against``; dependent ones are left out."""
    kept: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - against @ (against.T @ v)
            for q in kept:
                v = v - q * (q @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            kept.append(v)
    return np.array(kept).T if kept else np.zeros((len(new), 0))


class Minres:
    """MINRES for (I - QQ')(A - shift)(I - QQ') t = rhs; takes the product with A from outside, a step at a time."""

    def __init__(self, q: np.ndarray, shift: float, rhs: np.ndarray):
        self.q, self.shift = q, shift
        r = self.clean(rhs)
        self.beta = self.start = self.left = float(np.linalg.norm(r))
        self.t = np.zeros_like(r)
        self.v_old, self.v = np.zeros_like(r), r / self.beta if self.beta else r
        self.w_old, self.w = np.zeros_like(r), np.zeros_like(r)
        self.c_old = self.c = 1.0
        self.s_old = self.s = 0.0
        self.eta = self.beta
        self.beta_in = 0.0

    def clean(self, x: np.ndarray) -> np.ndarray:
        return x - self.q @ (self.q.T @ x)

    def ended(self, tolerance: float) -> bool:
        return self.left <= tolerance * self.start or not np.any(self.v)

    def step(self, product: np.ndarray) -> None:
        """``product`` is A times the current ``v``."""
        p = self.clean(product - self.shift * self.v)
        alpha = float(self.v @ p)
        p = self.clean(p - alpha * self.v - self.beta_in * self.v_old)
        beta = float(np.linalg.norm(p))
        # Two earlier rotations, then the new one, on the column of the tridiagonal matrix.
        rho3 = self.s_old * self.beta_in
        rho2 = self.s * alpha + self.c_old * self.c * self.beta_in
        bar = self.c * alpha - self.c_old * self.s * self.beta_in
        rho1 = float(np.hypot(bar, beta))
        if rho1 <= EPS * abs(self.shift):
            self.v = np.zeros_like(p)
            return
        c, s = bar / rho1, beta / rho1
        w = (self.v - rho3 * self.w_old - rho2 * self.w) / rho1
        self.t = self.t + c * self.eta * w
        self.w_old, self.w = self.w, w
        self.eta, self.left = -s * self.eta, abs(s * self.eta)
        self.c_old, self.c, self.s_old, self.s = self.c, c, self.s, s
        self.v_old, self.v = self.v, p / beta if beta > EPS * abs(self.shift) else np.zeros_like(p)
        self.beta_in = beta


def leading(product, d: int, wanted: int, scale: float, inner: int = 4, room: int = 10, max_outer: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, vectors and residuals of the ``wanted`` largest pairs of a symmetric matrix.

    ``product`` multiplies it with some columns; ``scale`` is a bound of its norm (the trace).
    Residuals end at d rounding errors of the largest eigenvalue.
    """
    rng = np.random.default_rng(7)
    wanted = min(wanted, d)
    locked, values, left = np.zeros((d, 0)), np.zeros(0), np.zeros(0)
    if not d or scale <= 0:
        return np.zeros(wanted), np.eye(d)[:, :wanted], np.zeros(wanted)
    space = orthonormal(rng.standard_normal((d, min(d, 2 * wanted))), locked)
    image = product(space)
    for outer in range(max_outer):
        small = space.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, y = theta[order], y[:, order]
        space, image = space @ y, image @ y
        size = np.linalg.norm(image - space * theta, axis=0)
        top = max([float(theta[0]) if len(theta) else 0.0, *values[:1].tolist()])
        tolerance = 4 * d * EPS * max(top, EPS * scale)
        # Pairs are locked in order, so that no larger one can be passed by.
        done = 0
        while done < len(theta) and len(values) + done < wanted and size[done] <= tolerance:
            done += 1
        locked, values, left = np.hstack([locked, space[:, :done]]), np.append(values, theta[:done]), np.append(left, size[:done])
        space, image, theta, size = space[:, done:], image[:, done:], theta[done:], size[done:]
        if len(values) == wanted:
            break
        if space.shape[1] + locked.shape[1] >= d and not space.shape[1]:
            break
        n = min(wanted - len(values), space.shape[1])
        if space.shape[1] > room * wanted:  # restart
            space, image = space[:, : 2 * wanted], image[:, : 2 * wanted]
        systems = [Minres(np.hstack([locked, space[:, i : i + 1]]), float(theta[i]), space[:, i] * theta[i] - image[:, i]) for i in range(n) if size[i] > tolerance]
        tolerance_in = max(1e-9, 0.5 ** (outer + 2))
        for _ in range(min(inner, d)):
            running = [s for s in systems if not s.ended(tolerance_in)]
            if not running:
                break
            products = product(np.stack([s.v for s in running], axis=1))
            for s, p in zip(running, products.T, strict=True):
                s.step(p)
        new = np.stack([s.t for s in systems], axis=1) if systems else np.zeros((d, 0))
        new = orthonormal(new, np.hstack([locked, space]))
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((d, 1)), np.hstack([locked, space]))
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
        elif space.shape[1] + locked.shape[1] >= d:  # the whole space: only rounding is left, so take fresh products
            image = product(space)
    else:
        raise RuntimeError(f"residuals {size[:wanted]} have not reached {tolerance} after {max_outer} rounds")
    return values, locked, left


# Whitening


def fit(vectors: DataFrame, components: int = 4) -> Fit:
    """The leading components of the distinct vectors ``x``."""
    data = FitList(vectors)
    trace = data.trace() if data.n else 0.0
    k = min(components, data.d)
    values, basis, residuals = leading(data.product, data.d, k, trace) if trace > 0 else (np.zeros(k), np.eye(data.d)[:, :k], np.zeros(k))
    values = np.where(values > data.d * EPS * trace, values, 0.0)
    order = np.argsort(-values, kind="stable")
    values, basis, residuals = values[order], basis[:, order], residuals[order]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0) if data.d else basis
    has = values > 0
    error = None
    if has.any():
        scaled = basis[:, has] / np.sqrt(values[has])
        mean = data.map(lambda c: (c @ scaled).sum(axis=0)[:, None], 1)[:, 0] / data.n
        spread = data.map(lambda c: (c @ scaled - mean).T @ (c @ scaled - mean), int(has.sum())) / data.n
        error = float(np.abs(spread - np.eye(int(has.sum()))).max())
    return Fit(data.n, data.sums, trace, values, basis, residuals, data.passes, error)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each usable row of ``df`` and component: its identifier, number, exact deviation, whitened value and share."""
    arrow_batches(df.sparkSession, 4096)
    rows = integers(df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias(vec_col)), vec_col).select("vec_id", "x")
    found = fit(rows, components)
    d, n, sums, k = len(found.sums), found.n, found.sums, len(found.values)
    base = np.array([s // n for s in sums], np.int64) if n else np.zeros(d, np.int64)
    rest = [s % n for s in sums] if n else []
    share = np.array([r / n for r in rest])
    vectors, scale = found.vectors, np.sqrt(np.where(found.values > 0, found.values, np.nan))
    #: n * x - S is n * (x - base) - rest; squares are summed in three exact sums of integers.
    rest_squared = sum(r * r for r in rest)

    def deviations(gap: np.ndarray) -> list[int]:
        small = np.abs(gap).max(initial=0) < 1 << 20
        gaps = gap if small else gap.astype(object)
        squares = np.square(gaps).sum(axis=1).tolist()
        if small and n < 1 << 31:
            crossed = [int(a) + (int(b) << 16) for a, b in zip((gap @ (np.array(rest) & 0xFFFF)).tolist(), (gap @ (np.array(rest) >> 16)).tolist(), strict=True)]
        else:
            crossed = [sum(int(g) * r for g, r in zip(row, rest, strict=True)) for row in gap.tolist()]
        return [n * n * int(q) - 2 * n * c + rest_squared for q, c in zip(squares, crossed, strict=True)]

    def run(batches):
        for batch in batches:
            gap = _matrix(batch.column(1), d) - base
            white = ((gap - share) @ vectors) / scale
            exact = pa.array([v if v < 10**38 else None for v in deviations(gap)], pa.decimal128(38, 0))
            yield pa.record_batch([batch.column(0), exact, pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "white"])

    if not k:
        return df.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    scored = rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), white array<double>")
    shares = [float(v / found.trace) if found.trace > 0 else None for v in found.values]
    white = F.col("w")
    return scored.select("vec_id", "deviation", F.posexplode("white").alias("at", "w")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan(white), white).alias("whitened"),
        F.get(F.array(*[F.lit(s).cast("double") for s in shares]), "at").alias("explained"),
        F.lit(found.identity_error).cast("double").alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """The columns of the contract; a deviation beyond a long is null (``whiten`` has it as a decimal)."""
    return whiten(embeddings).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
