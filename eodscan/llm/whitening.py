"""Embedding whitening by a bidiagonal qd solver.

A vector's entries c become integers x = floor(64 c) + 1000000. Tasks add up x exactly, so the mean is S / n without
rounding. Blocks of centred rows are reduced by QR, each block stacked under the triangle of those before it; the tasks'
triangles are reduced the same way in two more rounds, so what reaches the driver is one d x d triangle R with
R'R = n V, whatever the number of rows. There Householder reflections make R bidiagonal, dqds (differential quotient
differences with shifts) finds the squared singular values to high relative accuracy, and a twisted factorisation for
each of them gives its direction, which the reflections carry back. Shifts are Newton's lower bound, which a qd step
without a shift gives along the way, so no step fails. Directions of near values are made orthogonal; for values
that are equal to rounding their space is found by inverse iteration.

Two more passes over the rows follow: one adds up the covariance of the whitened values (identity_error is measured on
rows, not derived from R), one emits the result. Every table is read in tasks, sums are of fixed size d or d x d.

Edge cases: rows with a null vector, or null or non-finite entries, are dropped; a null vec_id is kept, repeated rows
count and come out as often as they stand. All vectors should have one length; if not, those of the commonest length
(the longer one in a tie) are taken. Entries beyond 2 ** 40 / 64 count as that. A component without variance
(its eigenvalue is within rounding of 0) can't be whitened: its whitened is null, and it isn't part of identity_error;
explained is null if there is no variance at all, identity_error if no component has any. A deviation that no long
holds is null. No rows, or vectors of length 0: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40
BLOCK_ROWS = 4096
FAN_IN = 64  # triangles that the last reducing task stacks
EPS = float(np.finfo(np.float64).eps)
NEAR = 1e-3  # relative gap up to which directions are made orthogonal explicitly
SAME = 1e-9  # and up to which values count as equal

RESULT = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


# ---------------------------------------------------------------- the solver (d x d, on the driver)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and the reflectors of the columns: U' R V is upper bidiagonal."""
    a, d = np.array(r, dtype=np.float64), len(r)
    right = []

    def reflector(x):
        """Unit w with (1 - 2 w w') x on the first axis, or None."""
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            return None
        w = x.copy()
        w[0] += np.copysign(size, x[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        w = reflector(a[k, k + 1 :]) if k + 2 < d else None
        if w is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
        right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def carried_back(z: np.ndarray, right: list) -> np.ndarray:
    """V z, for columns z."""
    z = z.copy()
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        if w is not None:
            z[k + 1 :] -= 2 * np.outer(w, w @ z[k + 1 :])
    return z


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds transform: q and e of the next bidiagonal matrix, and the d along the way."""
    d, new_q, new_e, ds = q[0] - shift, [], [], []
    for k, below in enumerate(e):
        ds.append(d)
        top = d + below
        ratio = q[k + 1] / top
        new_q.append(top)
        new_e.append(below * ratio)
        d = d * ratio - shift
    ds.append(d)
    new_q.append(d)
    return new_q, new_e, ds


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> list[float]:
    """Of an upper bidiagonal matrix without zeros on the diagonal."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper]
    found, total, tiny = [], 0.0, (10 * EPS) ** 2
    while q:
        if len(q) == 1:
            found.append(total + q.pop())
            continue
        if e[-1] <= tiny * (total + q[-1]):
            found.append(total + q.pop())
            e.pop()
            continue
        if q[0] * 1.5 < q[-1]:
            q.reverse()
            e.reverse()
        q, e, ds = qd_step(q, e, 0.0)
        if min(ds) <= 0:  # the smallest is 0 to rounding, and stands last
            q[-1] = 0.0
            found.append(total)
            q.pop()
            e.pop()
            continue
        # 1 / d adds up to the trace of the inverse, so this lies below the smallest eigenvalue
        shift = (1 - 4 * len(q) * EPS) / sum(1 / d for d in ds)
        if shift > EPS * 0.01 * total:
            moved = qd_step(q, e, shift)
            if min(moved[2]) > 0:
                (q, e, _), total = moved, total + shift
    return found


def twisted(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray):
    """Stationary and progressive factors of B'B less each value, and the pivots g of each twist; one column a value."""
    n, d, low = len(diagonal), diagonal**2, upper / diagonal[:-1]
    tiny = EPS**2 * d.max() * 0.01  # a pivot this small is one of rounding
    s, p = np.empty((n, len(values))), np.empty((n, len(values)))
    down, up = np.empty((n - 1, len(values))), np.empty((n - 1, len(values)))
    s[0] = -values
    for k in range(n - 1):
        top = d[k] + s[k]
        down[k] = d[k] * low[k] / np.where(np.abs(top) < tiny, tiny, top)
        s[k + 1] = down[k] * low[k] * s[k] - values
    p[n - 1] = d[n - 1] - values
    for k in range(n - 2, -1, -1):
        bottom = d[k] * low[k] ** 2 + p[k + 1]
        ratio = d[k] / np.where(np.abs(bottom) < tiny, tiny, bottom)
        up[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - values
    return down, up, s + p + values


def directions(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (columns) of the bidiagonal matrix for its squared singular values, falling."""
    n, values = len(diagonal), np.array(values, dtype=np.float64)
    if n == 1:
        return np.ones((1, 1))
    for _ in range(2):  # the second time with the value corrected by the pivot
        down, up, pivots = twisted(diagonal, upper, values)
        at = np.argmin(np.abs(pivots), axis=0)
        z = np.zeros((n, len(values)))
        z[at, np.arange(len(values))] = 1
        for k in range(n - 1):
            z[k + 1] = np.where(k >= at, -up[k] * z[k], z[k + 1])
        for k in range(n - 2, -1, -1):
            z[k] = np.where(k < at, -down[k] * z[k + 1], z[k])
        sizes = (z**2).sum(axis=0)
        z /= np.sqrt(sizes)
        values = values + pivots[at, np.arange(len(values))] / sizes
    for first, last in _runs(values, SAME):
        z[:, first:last] = _same_space(diagonal, upper, values[first:last])
    for first, last in _runs(values, NEAR):
        for _ in range(2):
            z[:, first:last] = np.linalg.qr(z[:, first:last])[0]
    return z


def _runs(values: np.ndarray, gap: float):
    """(first, last + 1) of runs of two or more falling values with relative gaps of at most gap."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > gap * values[:-1]) + 1
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(values)]) if b - a > 1]


def _same_space(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Directions of values equal to rounding: their space by inverse iteration, its axes by one-sided rotations."""
    b = np.diag(diagonal) + np.diag(upper, 1)
    normal = b.T @ b - np.diag(np.full(len(b), values.mean() * (1 + 8 * EPS)))
    x = np.random.default_rng(7).standard_normal((len(b), len(values)))
    for _ in range(4):
        x = np.linalg.qr(np.linalg.solve(normal, x))[0]
    y, k = b @ x, len(values)
    for _ in range(6):
        for i in range(k):
            for j in range(i + 1, k):
                both = y[:, i] @ y[:, j]
                if both:
                    ratio = (y[:, j] @ y[:, j] - y[:, i] @ y[:, i]) / (2 * both)
                    t = (1.0 if ratio >= 0 else -1.0) / (abs(ratio) + np.hypot(1, ratio))
                    turn = np.array([[1, t], [-t, 1]]) / np.hypot(1, t)
                    x[:, [i, j]], y[:, [i, j]] = x[:, [i, j]] @ turn, y[:, [i, j]] @ turn
    return x[:, np.argsort(-(y**2).sum(axis=0), kind="stable")]


def solve(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of R'R, falling, and its unit eigenvectors in columns. Eigenvalues within rounding of 0 are 0."""
    d = len(r)
    scale = np.abs(r).max()
    if not scale:
        return np.zeros(d), np.eye(d)
    diagonal, upper, right = bidiagonal(r / scale)
    size = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0))
    least = EPS * size * 0.01
    diagonal = np.where(np.abs(diagonal) < least, least, diagonal)
    values, z = np.zeros(d), np.zeros((d, d))
    cuts = np.flatnonzero(np.abs(upper) <= EPS * np.sqrt(np.abs(diagonal[:-1] * diagonal[1:])) * 0.5) + 1
    for first, last in zip([0, *cuts], [*cuts, d]):  # nothing joins these blocks
        own, above = diagonal[first:last], upper[first : last - 1]
        found = np.sort(squared_singular_values(own, above))[::-1]
        values[first:last] = found
        z[first:last, first:last] = directions(own, above, found)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], carried_back(z[:, order], right)
    values[values <= (d * EPS) ** 2 * values[0]] = 0
    return values * scale**2, vectors


# ---------------------------------------------------------------- passes over the rows


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and v (array<double>) of the rows that stay, and the length of v."""
    own = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = own.filter(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    lengths = own.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    d = lengths[0]["length"] if lengths else 0
    return own.filter(F.size("v") == d), d


def integers(column: pa.Array, d: int) -> np.ndarray:
    """x of a batch of vectors, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _each(batches, d: int):
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(first, BLOCK_ROWS)
            yield part, integers(part.column("v"), d)


def totals(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sums S."""

    def add(batches):
        for _, x in _each(batches, d):
            own = np.append(x.sum(axis=0), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(own)], names=["at", "part"])

    parts = rows.select("v").mapInArrow(add, "at int, part long")
    found = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()  # d + 1 rows
    sums = {r["at"]: int(r["total"]) for r in found}
    return sums.get(d, 0), [sums.get(k, 0) for k in range(d)]


def centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """S / n as whole part and rest (0 <= rest < n), so that x - S / n keeps all its digits."""
    return np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)


def triangle(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: in tasks, over FAN_IN groups of tasks, and over those."""
    whole, rest = centre(sums, n)
    part = rest / n

    def packed(r):
        at = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["task", "r"]
        )

    def reduce_rows(batches):
        r = np.zeros((0, d))
        for _, x in _each(batches, d):
            r = np.linalg.qr(np.vstack([r, (x - whole) - part]), mode="r")
        if len(r):
            yield packed(r)

    def reduce_triangles(batches):
        r = np.zeros((0, d))
        for batch in batches:
            for own in batch.column("r").to_pylist():
                r = np.linalg.qr(np.vstack([r, np.frombuffer(own).reshape(-1, d)]), mode="r")
        if len(r):
            yield packed(r)

    schema = "task long, r binary"
    first = rows.select("v").mapInArrow(reduce_rows, schema)
    second = first.repartition(FAN_IN, "task").mapInArrow(reduce_triangles, schema)
    last = second.coalesce(1).mapInArrow(reduce_triangles, schema).collect()  # one triangle
    r = np.zeros((d, d))
    own = np.frombuffer(last[0]["r"]).reshape(-1, d)
    r[: len(own)] = own
    return r


def whitened_error(rows: DataFrame, d: int, whole, part, project: np.ndarray) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = project.shape[1]
    if not k:
        return None

    def add(batches):
        for _, x in _each(batches, d):
            w = ((x - whole) - part) @ project
            own = np.concatenate([(w.T @ w).ravel(), w.sum(axis=0), [len(w)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["at", "part"])

    parts = rows.select("v").mapInArrow(add, "at int, part double")
    found = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect()}  # k * (k + 1) + 1 rows
    total = np.array([found[i] for i in range(len(found))])
    n, mean = total[-1], total[k * k : k * k + k] / total[-1]
    covariance = total[: k * k].reshape(k, k) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    spark = vectors.sparkSession
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {RESULT}"
    rows, d = usable(vectors, column)
    if not d:
        return spark.createDataFrame([], schema)
    n, sums = totals(rows, d)
    values, axes = solve(triangle(rows, d, n, sums))
    k, trace = min(components, d), float(values.sum())
    whole, rest = centre(sums, n)
    part = rest / n
    scales = np.sqrt(values[:k] / n)
    varied = scales > 0
    project = np.divide(axes[:, :k], scales, out=np.zeros((d, k)), where=varied)
    error = whitened_error(rows, d, whole, part, project[:, varied])
    explained = pa.array(values[:k] / trace if trace else [None] * k, pa.float64())
    names = ["vec_id", *[f.split()[0] for f in RESULT.split(", ")]]

    def deviations(x):
        """Exact sums of (n x - S) ** 2."""
        away = x - whole
        most = (int(np.abs(away).max(initial=0)) + 1) * n
        if most * most * d < 1 << 63:
            return pa.array(((n * away - rest) ** 2).sum(axis=1), pa.int64())
        exact = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in away]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def emit(batches):
        for batch, x in _each(batches, d):
            w = ((x - whole) - part) @ project
            count = len(x)
            each = pa.array(np.repeat(np.arange(count, dtype=np.int32), k))
            which = np.tile(np.arange(k, dtype=np.int32), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(which + 1), pa.array(np.full(count * k, n)), deviations(x).take(each),
                    pa.array(w.ravel(), mask=~varied[which]), explained.take(pa.array(which)), pa.array([error] * (count * k), pa.float64()),
                ],
                names=names,
            )

    return rows.mapInArrow(emit, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every usable row of embeddings, whitened."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
