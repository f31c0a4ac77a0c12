"""Centroid clustering of integer vectors, exact at the speed of float32.

A vector's nearest centroid is looked for with one float32 matrix product. Each squared distance so found has an
interval that holds the true one for sure: the error of a product of ``n`` terms is at most gamma(n) times the sum of
their sizes, whatever the order of summation. Centroids whose interval reaches below the least upper end make the
shortlist. Most vectors have one centroid there; for the others the distances are computed with integers, and of equal
ones the centroid with the lowest number wins. Sums for the next centroids are integers of any length, so the result
depends neither on partitions nor on rounding.

A round is one pass over the vectors that leaves partial sums, combined before the shuffle; only the centroids
(k times the width) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.common import saved

#: Below this size of components squared distances of 64 components fit in 64 bits.
_SMALL = 2.0**27
#: Bits of a digit of partial sums; a sum of 2**60 of them still fits decimal(38, 0).
_DIGIT = 60
_LONG = (1 << 63) - 1
#: Unit roundoff of float32.
_UNIT = 2.0**-24


def whole(x: np.ndarray) -> np.ndarray:
    """floor(64 x): whole numbers in float64, exact while finite, infinite where 64 x is."""
    with np.errstate(over="ignore"):
        return np.floor(x * 64.0)


def integers(row: np.ndarray) -> list[int]:
    """floor(64 x) as Python integers, exact for any finite x: from 2**53 on x is a whole number itself."""
    return [int(v) * 64 if abs(v) >= 2.0**53 else int(np.floor(v * 64.0)) for v in row.tolist()]


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, rounded up."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + 1e-9)


class Centroids:
    """Centroids as exact integers, with what the screening needs of them."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.floats = np.array([[_float(v) for v in r] for r in rows]).reshape(len(rows), len(rows[0]) if rows else 0)
        self.squares = np.array([_float(sum(v * v for v in r)) for r in rows])
        self.norms = _norms(self.floats)
        self.small = bool((np.abs(self.floats) < _SMALL).all())
        self.exact = self.floats.astype(np.int64) if self.small else None

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of |c|^2 - 2 x.c for each vector and centroid; not finite where float32 can't hold a product."""
        n = x.shape[1] + 2  # the roundings of both factors to float32 count too
        gamma = n * _UNIT / (1 - n * _UNIT)
        with np.errstate(over="ignore", invalid="ignore"):
            product = (x.astype(np.float32) @ self.floats.astype(np.float32).T).astype(np.float64)
            size = _norms(x)[:, None] * self.norms[None, :]
            near = self.squares[None, :] - 2 * product
            # The last part covers what float64 rounds in the sums of this very formula.
            error = 2 * gamma * 1.001 * size + 1e-12 * (self.squares[None, :] + 2 * size) + 1e-6
            return near - error, near + error

    def nearest(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the nearest centroids, squared distances (held to the range of long), rows that were recomputed."""
        x = whole(raw)
        low, high = self.intervals(x)
        sure = np.isfinite(low).all(axis=1) & np.isfinite(high).all(axis=1)
        with np.errstate(invalid="ignore"):
            listed = ~(low > high.min(axis=1)[:, None]) | ~sure[:, None]
        best = np.argmax(listed, axis=1)
        far = np.zeros(len(x), np.int64)
        again = listed.sum(axis=1) > 1
        small = (np.abs(x) < _SMALL).all(axis=1) & self.small
        rows = np.flatnonzero(again & small)
        if len(rows):
            own, at = x[rows].astype(np.int64), listed[rows]
            least = np.full(len(rows), _LONG)
            for c in range(len(self.rows)):
                ask = np.flatnonzero(at[:, c])
                distance = np.square(own[ask] - self.exact[c]).sum(axis=1)
                better = distance < least[ask]  # of equal ones the lower number stays
                least[ask[better]], best[rows[ask[better]]] = distance[better], c
        rows = np.flatnonzero(small)
        far[rows] = np.square(x[rows].astype(np.int64) - self.exact[best[rows]]).sum(axis=1) if len(rows) else far[rows]
        for i in np.flatnonzero(~small).tolist():
            own = integers(raw[i])
            distance = {c: sum((a - b) ** 2 for a, b in zip(own, self.rows[c], strict=True)) for c in np.flatnonzero(listed[i]).tolist()}
            best[i] = min(distance, key=lambda c: (distance[c], c))  # noqa: B023
            far[i] = min(distance[int(best[i])], _LONG)
        return best, far, int(again.sum())


def _float(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return float("inf") if v > 0 else float("-inf")


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _digits(value: int) -> list[int]:
    """``value`` in digits of ``_DIGIT`` bits, the last one signed."""
    out = []
    while not -(1 << _DIGIT) <= value < 1 << _DIGIT:
        out.append(value & ((1 << _DIGIT) - 1))
        value >>= _DIGIT
    return [*out, value]


def _add(batches: Iterator[pa.RecordBatch], centroids: Centroids, width: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of a partition: (cluster, component, digit, value); component -1 is the number of vectors."""
    sums = [[0] * width for _ in centroids.rows]
    counts = [0] * len(centroids.rows)
    for batch in batches:
        raw = _vectors(batch.column(0), width)
        best, _, _ = centroids.nearest(raw)
        x = whole(raw)
        small = (np.abs(x) < 2.0**40).all(axis=1)  # a batch's sums fit in 64 bits
        for c in np.unique(best).tolist():
            mine = best == c
            counts[c] += int(mine.sum())
            part = x[mine & small].astype(np.int64).sum(axis=0).tolist()
            sums[c] = [a + b for a, b in zip(sums[c], part, strict=True)]
            for i in np.flatnonzero(mine & ~small).tolist():
                sums[c] = [a + b for a, b in zip(sums[c], integers(raw[i]), strict=True)]
    out: list[tuple[int, int, int, int]] = []
    for c, n in enumerate(counts):
        if n:
            out.append((c, -1, 0, n))
            out.extend((c, j, d, v) for j, total in enumerate(sums[c]) for d, v in enumerate(_digits(total)))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "component", "digit", "value"])


def _assign(batches: Iterator[pa.RecordBatch], centroids: Centroids, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best, far, _ = centroids.nearest(_vectors(batch.column(1), width))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])


def kept_vectors(vectors: DataFrame, width: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows whose vector has exactly ``width`` components, none of them null or non-finite."""
    kind = vectors.schema[embedding].dataType.simpleString()
    vector = F.col(embedding) if kind in ("array<float>", "array<double>") else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.where(f"size(vector) = {int(width)} and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def first_centroids(rows: DataFrame, k: int) -> Centroids:
    """The ``k`` vectors whose ids have the smallest hashes; equal hashes (repeated ids) in the order of their vectors."""
    named = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "vector")
    chosen = named.orderBy("hash", "vector").limit(k).collect()  # k rows
    return Centroids([integers(np.array(r["vector"], np.float64)) for r in chosen])


def fit(rows: DataFrame, k: int = 16, rounds: int = 3, width: int = 64) -> Centroids:
    """Centroids after ``rounds`` rounds over ``rows`` (vec_id, vector), as ``kept_vectors`` gives them."""
    now = first_centroids(rows, k)
    for _ in range(rounds if now.rows else 0):
        parts = rows.select("vector").mapInArrow(partial(_add, centroids=now, width=width), "cluster int, component int, digit int, value long")
        total: dict[tuple[int, int], int] = {}
        for r in parts.groupBy("cluster", "component", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # k times the width
            at = (r["cluster"], r["component"])
            total[at] = total.get(at, 0) + (int(r["value"]) << (_DIGIT * r["digit"]))
        now = Centroids([[total[c, j] // total[c, -1] for j in range(width)] if (c, -1) in total else old for c, old in enumerate(now.rows)])
    return now


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The cluster of each vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components count as floor(64 x). Centroids start as the ``k`` vectors with the smallest hashes of their ids; each
    of ``rounds`` rounds assigns every vector to the nearest (of equal ones the lowest number) and moves every centroid
    that has vectors to the floor of their mean; then vectors are assigned once more. ``distance`` is squared;
    ``centroid_sha256`` is the hash of the cluster's final components as decimal integers joined by commas.

    Rows whose vector is null, of another width, or holds null or non-finite components are left out. Rows that repeat
    an id count as vectors each; a row without an id is assigned and counts in means, but never starts a centroid (if
    no row has an id, the result is empty). With fewer vectors than ``k`` there are fewer centroids. Distances and sums
    beyond long are held to its range; which centroid is nearest is exact for any finite vector all the same. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = kept_vectors(vectors, width, vec_id, embedding)
    final = fit(rows, k, rounds, width)
    if not final.rows:
        return rows.where("false").selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    assigned = saved(rows.mapInArrow(partial(_assign, centroids=final, width=width), "vec_id long, cluster int, distance long"), "assigned")
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    held = lambda v: min(v, _LONG)
    shas, inertia = final.sha256(), held(sum(totals.values()))
    of = rows.sparkSession.createDataFrame([(c, held(v), inertia, shas[c]) for c, v in sorted(totals.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
