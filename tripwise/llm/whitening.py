"""Embedding whitening by matrix-free block Lanczos.

The covariance of the vectors is never formed: each Lanczos step multiplies it with a block of
vectors in one distributed pass, every task adding up Yt (Y Q) over its own centred rows Y. The
driver holds the basis only (as many columns as there are dimensions, at most), keeps it
orthogonal by full reorthogonalisation done twice, and takes eigenpairs from the projection of
the covariance onto it. It ends when the residuals of all wanted pairs are as small as rounding
lets them be, or the basis spans all dimensions. Columns of a block that break down (the space
so far maps into itself) are replaced by new random directions orthogonal to the basis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS, BLOCK = 32, 16
SCALE, SHIFT = 64, 1_000_000
#: Vectors with entries of this size have no deviation that a long holds; see `fit_list`.
LIMIT = 2.0**30
#: Eigenvalues below this share of the largest count as zero: such directions cannot be whitened.
LEAST_SHARE = 1e-12


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the entries as longs: floor(64 c) + 1000000; written to the shared folder.

    Vectors that are null, empty, or hold null or non-finite entries (or entries of 2**30 or more) are dropped;
    so are those that have not the commonest length (of equally common ones the largest). Rows that repeat a
    vec_id, or have none, are vectors of their own.
    """
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LIMIT))
    kept = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & sound)
    lengths = kept.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is not None:
        kept = kept.filter(F.size(vector) == lengths["d"])
    return materialize(kept.select("vec_id", F.transform(c, lambda e: F.floor(e * SCALE) + SHIFT).alias("x")), "whitening-x")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(batch.num_rows, -1)


def summed(x: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all batches of part(rows), a flat list of fixed length; each task sends its own sum, and positions are summed apart."""
    arrow = pa.float64() if kind == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(matrix(batch))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, arrow)], ["at", "v"])

    rows = x.select("x").mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(rows.num_rows, np.float64 if kind == "double" else np.int64)
    out[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out


class Fit:
    """What whitens: the number n of vectors, their sums, and unit components with their eigenvalues and shares."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.components, self.values, self.explained = np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.n * int(np.abs(x).max(initial=0)) >= 2**62:
            raise OverflowError("entries times the number of vectors do not fit a long")
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.gaps(x) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def next_block(wide: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that go on from `wide`, at most as many as dimensions are left; those that break down start anew."""
    room = min(wide.shape[1], basis.shape[0] - basis.shape[1])
    found = basis[:, :0]
    for column in wide.T:
        held = np.hstack([basis, found])
        if found.shape[1] == room:
            break
        rest = orthogonal(column[:, None], held)
        size = float(np.linalg.norm(rest))
        least = 1e-10 * scale
        while size <= least or size == 0:
            rest, least = orthogonal(rng.standard_normal((len(column), 1)), held), 1e-10
            size = float(np.linalg.norm(rest))
        rest = orthogonal(rest / size, held)
        found = np.hstack([found, rest / np.linalg.norm(rest)])
    return found


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The `wanted` largest eigenvalues of a symmetric d x d operator, their unit vectors (columns), and the passes it took.

    A Krylov space meets no more copies of an eigenvalue than its block has columns. So once all wanted pairs have
    converged it starts anew in the space that is left, until the largest value there is known to be none of the wanted.
    """
    rng = np.random.default_rng(seed)
    basis = image = np.zeros((d, 0))
    wide, scale = rng.standard_normal((d, min(block, d))), 1.0
    passes, since = 0, None
    while True:
        new = next_block(wide, basis, scale, rng)
        basis, image, passes = np.hstack([basis, new]), np.hstack([image, apply(new)]), passes + 1
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:wanted], inner[:, ::-1][:, :wanted]
        ritz, scale = basis @ inner, max(float(np.abs(values).max(initial=0)), np.finfo(float).tiny)
        residual = np.linalg.norm(image @ inner - ritz * values, axis=0).max()
        wide = image[:, -new.shape[1] :]
        done = basis.shape[1] == d
        if not done and len(values) == wanted and residual <= 64 * np.finfo(float).eps * scale:
            if since is None:
                since, wide = basis.shape[1], rng.standard_normal((d, min(block, d)))
            else:
                rest, at = basis[:, since:], image[:, since:]
                left, inside = np.linalg.eigh(rest.T @ at)
                off = orthogonal(at @ inside[:, -1:] - rest @ inside[:, -1:] * left[-1], basis[:, :since])
                done = left[-1] + np.linalg.norm(off) < values[-1]
        if done:
            unit, upper = np.linalg.qr(ritz)
            return values, unit * np.sign(np.diag(upper)), passes


def fit(x: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Fit | None:
    """The components of a fit list; None where it is empty. Directions without variance are left out."""
    totals = summed(x, lambda rows: np.concatenate([[len(rows)], rows.sum(0)]), "long")
    if not len(totals):
        return None
    found = Fit(int(totals[0]), totals[1:])
    d = len(found.sums)
    n, gaps, centred = found.n, found.gaps, found.centred
    # The trace is the sum of all deviations over n ** 3.
    trace = float(summed(x, lambda rows: np.array([np.square(gaps(rows).astype(float)).sum()]))[0]) / n**3

    def apply(q: np.ndarray) -> np.ndarray:
        def part(rows: np.ndarray) -> np.ndarray:
            y = centred(rows)
            return (y.T @ (y @ q)).ravel()

        return summed(x, part).reshape(q.shape) / n

    if trace > 0:
        values, vectors, _ = lanczos(apply, d, min(components, d), block)
        kept = values > LEAST_SHARE * values[0]
        found.components, found.values, found.explained = vectors[:, kept], values[kept], values[kept] / trace
    return found


def identity_error(x: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(found.values)
    if not k:
        return 0.0

    def part(rows: np.ndarray) -> np.ndarray:
        w = found.whitened(rows)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    sums = summed(x, part)
    mean = sums[:k] / found.n
    return float(np.abs(sums[k:].reshape(k, k) / found.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(x: DataFrame, found: Fit) -> DataFrame:
    """(vec_id, deviation, whitened): the exact sum of squares of n x - S, and the list of projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch)
            gaps = found.gaps(rows)
            if np.square(gaps.astype(float)).sum(1).max() > 2.0**63 * 0.999:
                raise OverflowError("deviation does not fit a long")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.square(gaps).sum(1)), pa.array(list(found.whitened(rows)), pa.list_(pa.float64()))],
                ["vec_id", "deviation", "whitened"],
            )

    return x.mapInArrow(run, f"vec_id {x.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def whitening_report(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Which vectors count is said in `fit_list`. There are as many components as directions with variance,
    `components` at most: none (and so no rows) for a single vector, equal vectors, or an empty table. Of
    equal eigenvalues the components are some orthonormal basis. A deviation beyond a long is an error.
    Columns other than vec_id and embedding are not looked at.
    """
    x = fit_list(vectors)
    found = fit(x, components, block)
    if found is None:
        found = Fit(0, np.zeros(0, np.int64))
    each = whitened(x, found).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(v)) for v in found.explained]) if len(found.explained) else F.expr("cast(array() as array<double>)")
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(identity_error(x, found) if len(found.values) else 0.0).alias("identity_error"),
    )
