"""Clustering around centroids, each vector's nearest found by the threshold algorithm.

Vectors are integers: floor(scale * component). For each dimension the centroids lie in a list sorted by
their component there. From a vector's own value the lists are walked outward, the nearer neighbour
first, one step in every dimension at a time. A centroid met for the first time is compared exactly; the squared
differences last met add up to a bound for every centroid not met so far, and the walk ends when that
bound is above the best exact distance. At equality it goes on: of equally near centroids the smallest number wins.

Each round reads the written vectors once. Tasks send one partial sum per centroid and dimension, Spark adds them
up, the driver gets k * dimensions numbers, whatever the number of rows, and sends the new centroids to the tasks. A
round that changes nothing ends the search early, since all further ones would be like it.

Rows whose vector is null, of another length, or holds a null or a number that is not finite are left out; repeated
rows are vectors of their own; a null key counts as empty text where starts are chosen, and of equal keys the
vector that sorts first. Fewer rows than k: fewer centroids. Empty table: empty result. Components above LARGEST in size
would not leave room for exact sums of squares and raise an error. Columns that carry the name of a result column
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm import shared as s

CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
DIMENSIONS = 64
LARGEST = 1 << 27       # times 64 dimensions: squared distances stay below 2 ** 63
ROWS = 4096             # vectors walked together; memory goes by rows * dimensions
PAIRS = 1 << 14         # exact comparisons at a time


class SortedLists:
    """For each dimension the centroids in order of their component."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()          # dimension, place -> number
        self.values = np.take_along_axis(centroids.T, self.order, axis=1).copy()    # dimension, place -> component

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance for each row."""
        n, (dims, k) = len(vectors), self.values.shape
        right = np.stack([np.searchsorted(self.values[d], vectors[:, d]) for d in range(dims)], 1)
        left = right - 1
        best = np.full(n, -1)
        least = np.full(n, np.iinfo(np.int64).max)
        met = np.zeros((n, k), bool)
        active = np.arange(n)
        every = np.arange(dims)
        far = np.iinfo(np.int64).max
        for _ in range(k):
            x, lo, hi = vectors[active], left[active], right[active]
            below = np.where(lo >= 0, x - self.values[every, np.maximum(lo, 0)], far)
            above = np.where(hi < k, self.values[every, np.minimum(hi, k - 1)] - x, far)
            down = below <= above
            number = self.order[every, np.where(down, lo, hi)]
            frontier = np.where(down, below, above)
            left[active] -= down
            right[active] += ~down
            new = np.zeros((len(active), k), bool)
            new[np.arange(len(active))[:, None], number] = True
            new &= ~met[active]
            met[active] |= new
            self._compare(vectors, active, new, best, least)
            active = active[(frontier * frontier).sum(1) <= least[active]]
            active = active[~met[active].all(1)]
            if not len(active):
                break
        return best, least

    def _compare(self, vectors, active, new, best, least) -> None:
        """Exact distances of newly met pairs; smaller numbers first, so that a tie keeps the smaller."""
        row, number = np.nonzero(new)
        for at in range(0, len(row), PAIRS):
            r, c = active[row[at:at + PAIRS]], number[at:at + PAIRS]
            distance = ((vectors[r] - self.centroids[c]) ** 2).sum(1)
            order = np.lexsort((c, distance, r))
            r, c, distance = r[order], c[order], distance[order]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            r, c, distance = r[first], c[first], distance[first]
            better = (distance < least[r]) | ((distance == least[r]) & (c < best[r]))
            best[r[better]], least[r[better]] = c[better], distance[better]


def whole(vector: Column, dimensions: int) -> Column:
    """Of that length, all components there and finite."""
    kind = "double"
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast(kind)) & (F.abs(x.cast(kind)) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def to_integers(vector: Column, scale: int) -> Column:
    def one(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) <= LARGEST, scaled).otherwise(
            F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")).cast("long"))
    return F.transform(vector, one)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _assign(vectors: np.ndarray, lists: SortedLists) -> tuple[np.ndarray, np.ndarray]:
    parts = [lists.nearest(vectors[at:at + ROWS]) for at in range(0, len(vectors), ROWS)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of each cluster that has any."""
    k, dimensions = centroids.shape
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)  # k * dimensions numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(shipped.value)
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(0), dimensions)
                number, _ = _assign(vectors, lists)
                counts += np.bincount(number, minlength=k)
                order = np.argsort(number, kind="stable")
                met, first = np.unique(number[order], return_index=True)
                sums[met] += np.add.reduceat(vectors[order], first)
        there = np.flatnonzero(counts)
        places = np.tile(np.arange(-1, dimensions), len(there))
        values = np.concatenate([counts[there, None], sums[there]], 1).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(there, dimensions + 1).astype(np.int32)), pa.array(places.astype(np.int32)),
             pa.array(values)], ["cluster", "place", "value"])

    partial = s.map_arrow(rows.select("__ints"), run, "cluster int, place int, value long")
    out: dict[int, dict[int, int]] = {}
    for r in partial.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["cluster"], {})[r["place"]] = r["value"]
    shipped.unpersist()
    return {c: (got[-1], [got[d] for d in range(dimensions)]) for c, got in out.items()}


@dataclass(frozen=True)
class Clustering:
    rows: DataFrame          # all columns of the kept rows, and __cluster, __distance
    centroids: np.ndarray    # k x dimensions integers
    rounds: int              # rounds made before nothing changed

    def totals(self) -> dict[int, int]:
        """Squared distances summed over each cluster; at most k rows."""
        return {r["__cluster"]: r["total"] for r in self.rows.groupBy("__cluster").agg(
            F.sum("__distance").alias("total")).collect()}

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def starts(rows: DataFrame, key: str, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose key has the smallest digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    return [r["__ints"] for r in rows.select("__ints", digest.alias("__digest"))
            .orderBy("__digest", "__ints").limit(k).collect()]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            seed: int = SEED, scale: int = SCALE, dimensions: int = DIMENSIONS) -> Clustering:
    """Assign every whole vector to one of k centroids after `rounds` rounds of moving them."""
    names = {"__ints": "array<long>", "__cluster": "int", "__distance": "long"}
    own = vectors.drop(*(c for c in vectors.columns if c.lower() in names and c not in (key, vector)))
    column = F.col(f"`{vector}`")
    kept = own.where(whole(column, dimensions)).withColumn("__ints", to_integers(column, scale))
    kept = s.settle(kept, "vectors")  # each round reads them again
    centroids = np.array(starts(kept, key, k, seed), np.int64).reshape(-1, dimensions)
    made = 0
    while made < rounds and len(centroids):
        made += 1
        moved = centroids.copy()
        for number, (count, sums) in _sums(kept, centroids).items():
            moved[number] = [x // count for x in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    shipped = own.sparkSession.sparkContext.broadcast(centroids)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = batch.schema.get_field_index("__ints")
        number, distance = _assign(_matrix(batch.column(place), dimensions), SortedLists(shipped.value))
        return s.add_columns(batch, __cluster=pa.array(number.astype(np.int32)), __distance=pa.array(distance))
    done = s.map_batches(kept, each, s.extended(kept, __cluster="int", __distance="long")).drop("__ints")
    done = s.settle(done, "clusters")  # totals and rows are read from it
    s.release(kept)
    return Clustering(done, centroids, made)
