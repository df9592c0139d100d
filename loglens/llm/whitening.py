"""Whitening of embeddings; covariances by polarisation.

An entry c becomes the whole number x = floor(scale * c).  The fit list holds
each different x vector once.  Its rows are moved by the rounded-down mean, and
the tasks sum, exactly, the squares of every dimension and of the sum of every
two dimensions.  The variances of the sums less those of the dimensions are
twice the covariances: ``2 cov(a, b) = var(a + b) - var(a) - var(b)``.  All
sums are whole numbers (limbs of 30 bits, so they can't overflow), which makes
each covariance the nearest double to its exact value.  The matrix of a length
of vectors goes to one task for ``eigh``; its size depends on the length alone.

Vectors of different lengths are fitted apart, each length as a table of its
own.  A component with an eigenvalue of zero (below the rounding of the
matrix) can't be scaled: its ``whitened`` is null, and ``identity_error``
covers the others (null if there are none).

Edge cases: null vectors, those with a null or non-finite entry or one too
large for a long, and empty ones are dropped; repeated rows each get their
result and count once in the fit; null ids pass through; a table without
vectors gives no rows; a deviation of more than 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import map_arrow, stored

SCALE = 256
COMPONENTS = 4
LIMB = 30
LIMBS = 6
# Numbers of the models that are broadcast (32 MB); beyond that they are joined by shuffle.
TOLD = 1 << 22
# Numbers of a block of rows in a task.
BLOCK = 1 << 19


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """_k, d (length) and x array<long> of every row that counts."""
    entries = F.col(vector).cast("array<double>")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(2.0**62))
    rows = vectors.select(F.col(key).alias("_k"), entries.alias("e")).where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", fits))
    return rows.select("_k", F.size("e").alias("d"), F.transform("e", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, d)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of rows of one length; column 0 is the length, the last one the vectors."""
    for batch in batches:
        lengths = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            step = max(1, BLOCK // int(lengths[a]))
            for i in range(a, b, step):
                yield int(lengths[a]), batch.slice(i, min(step, b - i))


def _limbs(value: int) -> list[int]:
    """Base 2**LIMB, the last limb with the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


class Sums:
    """Exact sums of one length: entries, squares, and squares of sums of two."""

    def __init__(self, d: int):
        self.d, self.rows = d, 0
        self.totals = [[0] * d, *([0] * (d - i) for i in range(d))]

    def add(self, z: np.ndarray) -> None:
        self.rows += len(z)
        largest = max(abs(int(z.max())), abs(int(z.min())))
        if (2 * largest) ** 2 * len(z) >= 1 << 62:
            z = z.astype(object)  # whole numbers of any size
        self.totals[0] = [a + int(b) for a, b in zip(self.totals[0], z.sum(0))]
        for i in range(self.d):
            pairs = z[:, i:] + z[:, i : i + 1]
            pairs[:, 0] = z[:, i]  # the dimension itself
            self.totals[i + 1] = [a + int(b) for a, b in zip(self.totals[i + 1], (pairs * pairs).sum(0))]

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        for i, line in enumerate(self.totals):
            limbs = zip(*(_limbs(v) for v in line))
            at = range(len(line)) if i == 0 else range(i - 1, self.d)
            columns = [pa.array([self.d] * len(line), pa.int32()), pa.array([i - 1] * len(line), pa.int32()), pa.array(at, pa.int32()), pa.array([self.rows] * len(line), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in limbs)], ["d", "i", "j", "rows", *(f"l{k}" for k in range(LIMBS))])


def polarised(fit: DataFrame, centre: dict[int, list[int]]) -> DataFrame:
    """d, i, j, rows, l0...: sums of (i, j) over the fit list moved by ``centre``.

    i = -1: of entry j; i = j: of its square; i < j: of the square of the sum.
    """
    shared = fit.sparkSession.sparkContext.broadcast({d: np.array(c, np.int64) for d, c in centre.items()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for d, some in _by_length(batches):
            if sums is None or sums.d != d:
                if sums is not None:
                    yield from sums.rows_out()
                sums = Sums(d)
            sums.add(_matrix(some.column(1), d) - shared.value[d])
        if sums is not None:
            yield from sums.rows_out()

    limbs = [f"l{k}" for k in range(LIMBS)]
    parts = map_arrow(fit.select("d", "x").sortWithinPartitions("d"), add, "d int, i int, j int, rows long, " + ", ".join(f"{c} long" for c in limbs))
    return parts.groupBy("d", "i", "j").agg(*(F.sum(c).alias(c) for c in ["rows", *limbs]))


MODEL = "d int, component int, n long, total array<decimal(38,0)>, axis array<double>, value double, explained double"


def eigen(sums: DataFrame, centre: dict[int, list[int]], components: int) -> DataFrame:
    """The components of every length: MODEL."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        from decimal import Decimal

        d, n = int(part["d"].iloc[0]), int(part["rows"].iloc[0])
        total, squares = [0] * d, {}
        for i, j, *limbs in part[["i", "j", *(f"l{k}" for k in range(LIMBS))]].itertuples(index=False):
            value = sum(int(v) << (LIMB * k) for k, v in enumerate(limbs))
            if i < 0:
                total[j] = value
            else:
                squares[i, j] = value
        # n * n * (sum of squares less the square of the sum over n), all whole numbers
        spread = {(i, j): n * s - (total[i] + (total[j] if i != j else 0)) ** 2 for (i, j), s in squares.items()}
        cov = np.empty((d, d))
        for (i, j), s in spread.items():
            cov[i, j] = cov[j, i] = s / n**2 if i == j else (s - spread[i, i] - spread[j, j]) / (2 * n**2)
        values, axes = np.linalg.eigh(cov)
        trace = sum(spread[i, i] for i in range(d)) / n**2
        out = []
        for c in range(min(components, d)):
            value, axis = float(values[-1 - c]), axes[:, -1 - c]
            if value <= trace * d * np.finfo(float).eps:
                value = 0.0
            axis = axis * (1 if axis[np.argmax(np.abs(axis))] >= 0 else -1)
            sums_x = [Decimal(t + n * m) for t, m in zip(total, centre[d])]
            out.append((d, c + 1, n, sums_x, axis.tolist(), value, value / trace if trace else 0.0))
        return pd.DataFrame(out, columns=["d", "component", "n", "total", "axis", "value", "explained"])

    return sums.groupBy("d").applyInPandas(solve, MODEL)


def _exact_deviation(x: np.ndarray, n: int, total: list[int]) -> list:
    """The sum over dimensions of (n * x - S)^2 of every row, as decimals."""
    from decimal import Decimal

    y = x.astype(object) * n - np.array(total, object)
    if max(abs(v) for v in (y.max(), y.min())) ** 2 * x.shape[1] < 1 << 62:
        y = y.astype(np.int64)
    return [Decimal(int(v)) if abs(int(v)) < 10**38 else None for v in (y * y).sum(1)]


def _project(rows: DataFrame, model: DataFrame, kind: str) -> DataFrame:
    """_k, d, n, deviation, w array<struct<component, whitened, explained>> of every row."""
    of = model.groupBy("d").agg(F.first("n").alias("n"), F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("component", "value", "explained", "axis"))).alias("parts"))
    size = of.agg(F.sum(F.col("d") * (F.size("parts") + 1))).first()[0] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, some in _by_length(batches):
            n, total, parts = (some.column(k)[0].as_py() for k in (2, 3, 4))
            x = _matrix(some.column(5), d)
            total = [int(t) for t in total]
            # x - S/n: the whole part of the mean first, so that nothing is lost
            whole = [t // n for t in total]
            centred = (x - np.array(whole, np.int64)).astype(float) - np.array([(t - n * m) / n for t, m in zip(total, whole)])
            lists = [[] for _ in range(len(x))]
            for p in parts:
                w = centred @ np.array(p["axis"]) / np.sqrt(p["value"]) if p["value"] > 0 else [None] * len(x)
                for line, v in zip(lists, w):
                    line.append({"component": p["component"], "whitened": None if v is None else float(v), "explained": p["explained"]})
            kinds = pa.list_(pa.struct([("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [some.column(1), some.column(0), some.column(2), pa.array(_exact_deviation(x, n, total), pa.decimal128(38, 0)), pa.array(lists, kinds)],
                ["_k", "d", "n", "deviation", "w"],
            )

    both = rows.join(F.broadcast(of) if size <= TOLD else of, "d").select("d", "_k", "n", "total", "parts", "x")
    return map_arrow(both, work, f"_k {kind}, d int, n long, deviation decimal(38,0), w array<struct<component int, whitened double, explained double>>")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """key, component, n, deviation decimal(38,0), whitened, explained, identity_error for every row and component."""
    rows = whole_numbers(vectors, key, vector, scale)
    kind = rows.schema["_k"].dataType.simpleString()
    fit = stored(rows.select("d", "x").dropDuplicates(["d", "x"]), "fit")
    means = fit.select("d", F.posexplode("x").alias("j", "v")).groupBy("d", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    means = means.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("j", "s", "n"))).alias("m"))
    centre = {r["d"]: [int(m["s"]) // m["n"] for m in r["m"]] for r in means.toLocalIterator()}  # one number a dimension
    model = stored(eigen(polarised(fit, centre), centre, components), "components")
    ours = _project(fit.select("d", F.lit(None).cast(kind).alias("_k"), "x"), model, kind)
    error = stored(identity_errors(ours, components), "identity")
    out = _project(rows, model, kind).select("_k", "d", "n", "deviation", F.explode("w").alias("w")).join(F.broadcast(error) if model.count() <= TOLD // 16 else error, "d", "left")
    return out.select(F.col("_k").alias(key), F.col("w.component").alias("component"), "n", "deviation", F.col("w.whitened").alias("whitened"), F.col("w.explained").alias("explained"), "identity_error")


def identity_errors(fitted: DataFrame, components: int) -> DataFrame:
    """d, identity_error: how far the whitened fit list's covariances are from the identity."""
    c = [F.get(F.col("w"), F.lit(i))["whitened"] for i in range(components)]
    off = [F.abs(F.covar_pop(c[i], c[j]) - (1.0 if i == j else 0.0)) for i in range(components) for j in range(i, components)]
    return fitted.groupBy("d").agg(F.array_max(F.array(*off)).alias("identity_error"))
