"""Whitening of vectors by an incremental eigendecomposition.

Entries c become whole numbers x = floor(1024 c) + 100000.  Each partition keeps the spectrum of its
own centred scatter: a new vector adds one centred rank-one term, whose eigenvalues are the
roots of a secular equation and whose eigenvectors follow from them; entries that the term
does not touch and pairs of equal eigenvalues are deflated first.  Spectra of partitions are
combined, a few at a time in rounds, by adding one's eigenpairs to the other as rank-one
terms, and last the term between their means.  The basis found is then refined over all
rows: partitions sum the centred products of their projections (Rayleigh-Ritz), and the
small problem's eigenvectors turn the basis into the components.

Sums of x are whole numbers and exact.  What a task or the driver holds is one spectrum of
the vectors' length squared, whatever the number of rows.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no
part and have no rows, nor have those with an entry of 2**42 or more, whose x is no exact
double, nor those of another length than most vectors have (of lengths equally frequent
the greatest counts); components without variance (an eigenvalue of at most 1e-12 of the
greatest) have no rows, so one vector alone gives none; repeated rows count as often as they
stand; null and repeated vec_ids are carried row by row; an empty table gives no rows;
other columns are neither read nor returned.  Equal eigenvalues may come in any order, with
any basis of their space, the same for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.storage import Scratch, attach

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 42)
#: Spectra that one task combines in a round.
MERGED = 8
LEAST_SHARE = 1e-12


@dataclass
class Spectrum:
    """Count, exact sums and the eigenpairs of the centred scatter of some vectors."""

    n: int
    sums: np.ndarray  # whole numbers, as Python integers
    values: np.ndarray
    vectors: np.ndarray  # one eigenvector a column

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(0, np.zeros(dim, object), np.zeros(dim), np.eye(dim))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums.tolist()], np.float64)

    def add_term(self, z: np.ndarray, weight: float) -> None:
        """Add weight * z z' to the scatter."""
        self.values, self.vectors = rank_one(self.values, self.vectors, z, weight)

    def merge(self, other: Spectrum) -> None:
        """Take the other's vectors in: its eigenpairs one by one, then the term between the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.values, self.vectors = other.n, other.sums, other.values, other.vectors
            return
        between = other.mean() - self.mean()
        for value, vector in zip(other.values.tolist(), other.vectors.T):
            if value > 0:
                self.add_term(vector, value)
        self.add_term(between, self.n * other.n / (self.n + other.n))
        self.n, self.sums = self.n + other.n, self.sums + other.sums


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 = sum z2_i / (root - d_i), for rising and distinct d and positive z2.

    Each root lies between its d and the next one (the last below d + sum z2).  It is returned
    as the nearer pole and the distance from it, so that differences to all poles keep their
    digits: root_j - d_i = (pole_j - d_i) + distance_j.
    """
    m = len(d)
    rows = np.arange(m)
    gap = np.append(d[1:] - d[:-1], z2.sum())
    far = d[:, None] - d[None, :]
    # The nearer pole: by the sign of the function in the middle of the interval.
    upper = 1 - (z2 / (far + gap[:, None] / 2)).sum(1) < 0
    upper[-1] = False
    here = rows + upper
    other = np.where(upper, rows, np.minimum(rows + 1, m - 1))  # the pole at the interval's other end; the last has none
    pole, far = d[here], far[here]
    low, high = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, gap / 2)
    high[-1] = gap[-1]
    side = ((rows[None, :] <= rows[:, None]) == ~upper[:, None]).astype(np.float64)  # poles on the nearer pole's side of the interval
    g, lone, sign = far[rows, other], other == here, np.where(upper, -1.0, 1.0)
    at, out = (low + high) / 2, np.zeros(m)
    live = rows
    for _ in range(100):
        away = far + at[:, None]
        inverse = 1 / away
        terms = z2 * inverse
        value = 1 - terms.sum(1)
        slope = terms * inverse
        go = np.abs(value) > 8 * m * np.finfo(float).eps * (1 + np.abs(terms).sum(1))
        out[live] = at
        if not go.any():
            break
        low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
        # a - b/x - c/(x + g) with the slopes of the poles on either side, equal to the function here.
        b = np.einsum("ij,ij->i", slope, side)
        c = (slope.sum(1) - b) * (at + g) ** 2
        b *= at * at
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            a = value + b / at + np.where(lone, 0.0, c / (at + g))
            p, q = a * g - b - c, -b * g
            t = -(p + np.copysign(np.sqrt(np.maximum(p * p - 4 * a * q, 0)), p)) / 2
            x1, x2 = t / a, q / t
            new = np.where(lone, b / a, np.where((x1 > low) & (x1 < high), x1, x2))
        # Where the fit leaves the bracket: halve it, by magnitude if its ends differ by much.
        near, away = np.minimum(np.abs(low), np.abs(high)), np.maximum(np.abs(low), np.abs(high))
        halved = np.where(away > 4 * near, sign * np.sqrt(np.maximum(near, 1e-300)) * np.sqrt(np.maximum(away, 1e-300)), (low + high) / 2)
        at = np.where((new > low) & (new < high), new, halved)
        live, far, at, low, high, side, g, lone, sign = live[go], far[go], at[go], low[go], high[go], side[go], g[go], lone[go], sign[go]
    return pole, out


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of V diag(values) V' + weight * direction direction', for weight > 0."""
    z = vectors.T @ direction
    order = np.argsort(values, kind="stable")
    d, z, v = values[order].copy(), z[order] * np.sqrt(weight), vectors[:, order].copy()
    size = max(np.abs(d).max(initial=0.0), z @ z)
    if not size > 0:
        return d, v
    small = 8 * np.finfo(float).eps * size
    # Deflation: entries that the term does not reach stay; of two equal values a rotation
    # moves the term to one of them.
    live = np.abs(z) * np.sqrt(size) > small
    z = np.where(live, z, 0.0)
    last = -1
    for k in np.flatnonzero(live).tolist():
        if last >= 0 and d[k] - d[last] <= small:
            r = np.hypot(z[last], z[k])
            c, s = z[k] / r, z[last] / r
            z[k], z[last], live[last] = r, 0.0, False
            v[:, [last, k]] = v[:, [last, k]] @ np.array([[c, s], [-s, c]])
        last = k
    at = np.flatnonzero(live)
    if not len(at):
        return d, v
    poles = d[at]
    pole, distance = secular_roots(poles, z[at] ** 2)
    apart = (poles[:, None] - pole[None, :]) - distance[None, :]  # d_i - root_j
    # The term for which these roots are exact, so that the eigenvectors are orthogonal.
    n = len(at)
    inner = poles[:, None] - poles[None, :]
    np.fill_diagonal(inner, 1.0)
    ratio = apart / inner
    squares = -np.diag(apart) * np.prod(np.where(np.eye(n, dtype=bool), 1.0, ratio), axis=1)
    exact = np.sqrt(np.abs(squares)) * np.sign(z[at])
    small_vectors = exact[:, None] / apart
    small_vectors /= np.linalg.norm(small_vectors, axis=0)
    v[:, at] = v[:, at] @ small_vectors
    d[at] = pole + distance
    return d, v


def whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
    """The x of every vector of a batch whose vectors have one length."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(batch.num_rows, -1)


def _pack(s: Spectrum) -> tuple:
    return s.n, [str(x) for x in s.sums.tolist()], s.values.tolist(), s.vectors.reshape(-1).tolist()


SPECTRUM = "n long, sums array<string>, eigenvalues array<double>, eigenvectors array<double>"


def _batch(s: Spectrum) -> pa.RecordBatch:
    n, sums, values, vectors = _pack(s)
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.string())), pa.array([values], pa.list_(pa.float64())), pa.array([vectors], pa.list_(pa.float64()))], names=["n", "sums", "eigenvalues", "eigenvectors"])


def _spectra(batches):
    for batch in batches:
        for row in batch.to_pylist():
            dim = len(row["eigenvalues"])
            yield Spectrum(row["n"], np.array([int(x) for x in row["sums"]], object), np.array(row["eigenvalues"]), np.array(row["eigenvectors"]).reshape(dim, dim))


def _of_partition(batches):
    """One spectrum a partition: every vector is one centred rank-one term."""
    own = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = whole_numbers(batch)
        if own is None:
            own = Spectrum.empty(x.shape[1])
            running = np.zeros(x.shape[1])
            origin = x[0].astype(np.float64)
        for row in x.astype(np.float64) - origin:
            if own.n:
                step = row - running
                own.add_term(step, own.n / (own.n + 1))
                running = running + step / (own.n + 1)
            else:
                running = row.copy()
            own.n += 1
        own.sums = own.sums + x.sum(0).astype(object)
    if own is not None:
        yield _batch(own)


def _merged(batches):
    whole = None
    for s in _spectra(batches):
        if whole is None:
            whole = s
        else:
            whole.merge(s)
    if whole is not None:
        yield _batch(whole)


def _small_sums(matrices: DataFrame, scratch: Scratch, name: str) -> np.ndarray | None:
    """Sum of one square matrix a partition, entry by entry."""
    summed = matrices.select(F.posexplode("m").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    rows = scratch.keep(summed, name).collect()
    if not rows:
        return None
    size = int(round(len(rows) ** 0.5))
    out = np.zeros(size * size)
    out[[r["at"] for r in rows]] = [r["v"] for r in rows]
    return (out.reshape(size, size) + out.reshape(size, size).T) / 2


def _products(center: np.ndarray, basis: np.ndarray):
    """Each partition's sum of (x - center) basis times its transpose."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = (whole_numbers(batch) - center) @ basis
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["m"])

    return run


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (double) of the rows that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    own = own.where(F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)), F.lit(False)))
    lengths = own.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return own.where(F.size("vector") == (lengths["dim"] if lengths else 0))


def fit_spectrum(own: DataFrame, scratch: Scratch) -> Spectrum | None:
    """The spectrum of all rows of ``usable_vectors``, before it is refined."""
    spectra = scratch.keep(own.select("vector").mapInArrow(_of_partition, SPECTRUM), "spectra-0")
    many, k = spectra.count(), 0
    while many > 1:
        groups = -(-many // MERGED)
        dealt = spectra.repartition(groups) if groups > 1 else spectra.coalesce(1)
        merged = scratch.keep(dealt.mapInArrow(_merged, SPECTRUM), f"spectra-{k + 1}")
        scratch.drop(f"spectra-{k}")
        spectra, k = merged, k + 1
        many = spectra.count()
    rows = spectra.collect()
    scratch.drop(f"spectra-{k}")
    return next(_spectra(pa.RecordBatch.from_pylist([r.asDict()]) for r in rows), None)


def whiten(vectors: DataFrame, *, components: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal, exact), whitened, explained, identity_error.

    ``deviation`` is null beyond 38 digits.  The fit runs when this is called.
    """
    spark = attach(vectors.sparkSession)
    scratch = Scratch(spark, "whitening")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    own = usable_vectors(vectors)
    found = fit_spectrum(own, scratch)
    if found is None:
        return spark.createDataFrame([], schema)
    n, sums, dim = found.n, found.sums, len(found.values)
    center = found.mean()
    basis = np.linalg.qr(found.vectors)[0]
    inner = _small_sums(own.select("vector").mapInArrow(_products(center, basis), "m array<double>"), scratch, "inner") / n
    values, turn = np.linalg.eigh(inner)
    order = np.argsort(-values, kind="stable")
    values, basis = values[order], basis @ turn[:, order]
    trace = float(values.sum())
    kept = min(components, int((values > LEAST_SHARE * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], schema)
    basis = basis[:, :kept] / np.sqrt(values[:kept])
    covariance = _small_sums(own.select("vector").mapInArrow(_products(center, basis), "m array<double>"), scratch, "covariance") / n
    error = float(np.abs(covariance - np.eye(kept)).max())
    explained = values[:kept] / trace
    scratch.drop("inner", "covariance")
    model = spark.sparkContext.broadcast((n, sums, center, basis, explained))

    def run(batches):
        n, sums, center, basis, explained = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = whole_numbers(part)
                y = (x - center) @ basis
                rows, parts = y.shape
                deviation = pc.take(_deviations(x, n, sums), pa.array(np.repeat(np.arange(rows), parts)))
                yield pa.RecordBatch.from_arrays(
                    [pc.take(part.column("vec_id"), pa.array(np.repeat(np.arange(rows), parts))), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), rows)), pa.array(np.full(rows * parts, n)),
                     deviation, pa.array(y.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * parts, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(run, schema)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)**2, in whole numbers of any size."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(abs(s) for s in sums.tolist())) * 2
    if most < 1 << 62:
        apart = n * x - sums.astype(np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
        apart = apart.astype(object)
    else:
        apart = n * x.astype(object) - sums
    return pa.array([None if v >= 10**38 else Decimal(v) for v in (apart * apart).sum(1).tolist()], pa.decimal128(38, 0))
