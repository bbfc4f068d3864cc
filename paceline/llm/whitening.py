"""Whitening of vectors on their leading principal components, without ever forming the covariance.

Block subspace iteration: each pass over the table computes XᵀXQ for the centred rows X and an orthonormal block Q, task
by task with numpy and summed up by dimension; QR and Rayleigh-Ritz on the driver give the next block and the residual of
each component. Passes go on until the residuals certify all components. The driver holds matrices of dimension times
block, never rows. A block that converges too slowly is made wider, up to the whole space, where one pass certifies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import read_table, unused

#: Entries are cut to this, which only numbers that no long can hold reach.
LIMIT = 2.0**63 - 2.0**21
#: Numbers handled as one matrix, and columns summed up in one row.
CELLS = 1 << 21
COLUMNS = 64


@dataclass(frozen=True)
class Settings:
    k: int = 32
    scale: int = 64
    shift: int = 1_000_000
    #: columns of the first block for each component wanted
    wider: int = 2
    #: a component is certified when its residual is at most this share of the greatest eigenvalue
    tolerance: float = 1e-12
    #: components of less than this share of the greatest eigenvalue count as having no variance
    flat: float = 1e-12
    #: the block is doubled when the last two passes foretell more passes than these
    patience: int = 30
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """``n`` rows with the exact sums ``total`` of each dimension; ``axes`` (dimension x component), eigenvalues, trace and passes."""

    settings: Settings
    n: int
    total: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is neither null nor holds null or non-finite entries."""
    x = F.col(f"`{column}`").cast("array<double>")
    return vectors.where(F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)))


def slices(column: pa.Array, scale: int, least: int) -> Iterator[np.ndarray]:
    """Matrices of floor(scale * c), as int64, of some rows at a time; short vectors are filled up with zeros to ``least``
    entries or to the longest of the batch."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = max(least, int(lengths.max(initial=0)))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    rows = max(1, CELLS // max(1, width))
    for low in range(0, len(lengths), rows):
        some = lengths[low : low + rows]
        out = np.zeros((len(some), width))
        out[np.arange(width) < some[:, None]] = values[ends[low] : ends[low + len(some)]]
        yield np.clip(np.floor(out * scale), -LIMIT, LIMIT).astype(np.int64)


def exact(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """``x`` itself, or as Python's integers if sums of ``factor`` such numbers could leave 64 bits."""
    return x if not x.size or factor * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62 else x.astype(object)


def totals(rows: DataFrame, column: str, settings: Settings) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension of x = floor(scale * c) + shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            for u in slices(batch.column(0), settings.scale, len(total)):
                total = np.concatenate([total, np.zeros(u.shape[1] - len(total), object)]) + exact(u, len(u)).sum(0).astype(object)
                n += len(u)
        dims = np.arange(-1, len(total), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array([n, *map(int, total)], pa.decimal128(38, 0))], ["dim", "total"])

    parts = rows.select(F.col(f"`{column}`").cast("array<double>").alias("v")).mapInArrow(run, "dim int, total decimal(38,0)")
    found = {r.dim: int(r.total) for r in parts.groupBy("dim").agg(F.sum("total").alias("total")).collect()}  # a row for each dimension
    n = found.get(-1, 0)
    return n, [found[k] + n * settings.shift for k in range(len(found) - 1)]


class Centre:
    """x - total / n of each entry: whole parts are subtracted as integers, so nothing is lost to the size of the mean."""

    def __init__(self, n: int, total: tuple[int, ...], shift: int):
        self.n = n
        self.whole = [t // n - shift for t in total]
        self.rest = [t % n for t in total]
        self.far = max(map(abs, self.whole), default=0) >= 1 << 61

    def whole_parts(self, u: np.ndarray) -> np.ndarray:
        """x - floor(total / n), exact."""
        if self.far or u.size and max(abs(int(u.min())), abs(int(u.max()))) >= 1 << 61:
            return u.astype(object) - np.array(self.whole, object)
        return u - np.array(self.whole, np.int64)

    def __call__(self, u: np.ndarray) -> np.ndarray:
        return self.whole_parts(u).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, u: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - total)^2 of each row, exact."""
        d, n = self.whole_parts(u), self.n
        if d.dtype == object or max(abs(int(d.min(initial=0))), abs(int(d.max(initial=0)))) ** 2 * d.shape[1] >= 1 << 62:
            d = d.astype(object)
        rest = np.array(self.rest, np.int64) if d.dtype != object and n * d.shape[1] * max(1, int(np.abs(d).max(initial=0))) < 1 << 62 else np.array(self.rest, object)
        squares, mixed, own = (d * d).sum(1), (d * rest).sum(1), sum(r * r for r in self.rest)
        return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, mixed, strict=True)]


def products(rows: DataFrame, column: str, settings: Settings, centre: Centre, left: np.ndarray | None, right: np.ndarray) -> np.ndarray:
    """(Y left)ᵀ (Y right) over all centred rows Y (``left`` None: Yᵀ Y right), with a last column of the squared entries' sums."""
    dim, height = len(centre.rest), len(centre.rest) if left is None else left.shape[1]
    width = right.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((height, width))
        for batch in batches:
            for u in slices(batch.column(0), settings.scale, dim):
                y = centre(u)
                a = y if left is None else y @ left
                out[:, :-1] += a.T @ (y @ right)
                out[:, -1] += (a * a).sum(0)
        for low in range(0, width, COLUMNS):
            block = np.zeros((height, COLUMNS))
            block[:, : min(width - low, COLUMNS)] = out[:, low : low + COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), pa.array(np.full(height, low, np.int32)), *(pa.array(block[:, k]) for k in range(COLUMNS))], ["dim", "low", *(f"c{k}" for k in range(COLUMNS))])

    schema = "dim int, low int, " + ", ".join(f"c{k} double" for k in range(COLUMNS))
    parts = rows.select(F.col(f"`{column}`").cast("array<double>").alias("v")).mapInArrow(run, schema)
    out = np.zeros((height, width + COLUMNS))
    for r in parts.groupBy("dim", "low").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(COLUMNS))).collect():  # dimension times block
        out[r.dim, r.low : r.low + COLUMNS] = r[2:]
    return out[:, :width]


def fit(vectors: DataFrame, column: str = "embedding", settings: Settings = Settings()) -> Model:
    """The leading components of the covariance (divisor n) of x = floor(scale * c) + shift over all usable rows.

    Vectors of unequal lengths are filled up with zeros. There are at most ``settings.k`` components, at most one for
    each dimension, and none without variance, so none at all for an empty table or for equal rows. Raises if the whole
    space doesn't certify them. Vectors of equal eigenvalue are one of many right choices, the same for all rows.
    """
    rows = usable(vectors, column)
    n, total = totals(rows, column, settings)
    dim = len(total)
    if not n or not dim:
        return Model(settings, n, tuple(total), np.zeros((dim, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    centre, k = Centre(n, tuple(total), settings.shift), min(settings.k, dim)
    rng = np.random.default_rng(settings.seed)
    block = np.linalg.qr(rng.standard_normal((dim, min(dim, settings.wider * settings.k))))[0]
    passes, full, before = 0, 0, math.inf
    while True:
        image = products(rows, column, settings, centre, None, block) / n
        trace, image = float(image[:, -1].sum()), image[:, :-1]
        passes += 1
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        axes, moved = block @ turn, image @ turn
        if not values[0] > 0:
            return Model(settings, n, tuple(total), np.zeros((dim, 0)), np.zeros(0), trace, np.zeros(0), passes)
        residuals = np.linalg.norm(moved[:, :k] - axes[:, :k] * values[:k], axis=0)
        worst = float(residuals.max()) / (settings.tolerance * values[0])
        if worst <= 1:
            keep = int((values[:k] > settings.flat * values[0]).sum())
            return Model(settings, n, tuple(total), axes[:, :keep], values[:keep], trace, residuals[:keep], passes)
        full += block.shape[1] == dim
        if full > 3:
            raise RuntimeError(f"residuals stay {worst:.3g} times too large over the whole space")
        ahead = math.log(worst) / math.log(before / worst) if worst < before < math.inf else 0 if before == math.inf else math.inf
        before = worst
        if ahead > settings.patience and block.shape[1] < dim:
            more = rng.standard_normal((dim, min(block.shape[1], dim - block.shape[1])))
            moved, before = np.hstack([moved / values[0], more]), math.inf
        block = np.linalg.qr(moved)[0]


def whitened_axes(model: Model) -> np.ndarray:
    return model.axes / np.sqrt(model.values)


def identity_error(vectors: DataFrame, model: Model, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over the table."""
    axes = whitened_axes(model)
    if not axes.shape[1]:
        return 0.0
    centre = Centre(model.n, model.total, model.settings.shift)
    measured = products(usable(vectors, column), column, model.settings, centre, axes, axes)[:, :-1] / model.n
    return float(np.abs(measured - np.eye(len(measured))).max())


def transform(vectors: DataFrame, model: Model, column: str = "embedding", names: tuple[str, str] = ("whitened", "deviation")) -> DataFrame:
    """The usable rows with all their columns, the whitened vector, and the exact sum over dimensions of (n * x - S)^2 as
    decimal(38,0), null where it is longer. Rows are transformed one by one: repeated rows and null ids stay as they are. A
    column with one of the new names is replaced. For a model without components whitened vectors are empty; vectors
    longer than the model's are cut to its dimensions."""
    axes, settings, dim = whitened_axes(model), model.settings, len(model.total)
    centre = Centre(max(1, model.n), model.total, settings.shift)

    @F.arrow_udf("struct<whitened: array<double>, deviation: decimal(38,0)>")
    def both(v: pa.Array) -> pa.Array:
        white, far = [], []
        for u in slices(v, settings.scale, dim):
            white.append((centre(u[:, :dim]) @ axes).reshape(-1))
            far += [x if x < 10**38 else None for x in centre.deviations(u[:, :dim])]
        flat = np.concatenate(white) if white else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * axes.shape[1], pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([lists, pa.array(far, pa.decimal128(38, 0))], ["whitened", "deviation"])

    (made,) = unused(vectors, "made")
    out = usable(vectors, column).withColumn(made, both(F.col(f"`{column}`").cast("array<double>")))
    return out.withColumns({names[0]: F.col(f"{made}.whitened"), names[1]: F.col(f"{made}.deviation")}).drop(made)


def op12_whitening_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component; ``deviation`` is null where no long can hold it."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    error = identity_error(vectors, model)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values)).cast("array<double>")
    rows = transform(vectors, model).select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
