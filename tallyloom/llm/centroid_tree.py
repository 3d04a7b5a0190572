"""Lloyd's clustering of integer vectors with a vantage-point tree over the centroids.

Each round builds the tree anew on the driver (it holds the k centroids only)
and broadcasts it. Tasks search it best first for each vector: a vector keeps
the lower bounds of the nodes it may still visit, visits the one with the
smallest bound, and ends when that bound is beyond its best distance. A bound
equal to the best distance is still visited, as a centroid of the same distance
and a smaller number may be there. All vectors of a block take a step at the
same time, each into a node of its own choice. Distances to centroids are exact
integers; bounds are doubles with slack on the safe side. Tasks hand on one sum
per centroid, so no vector is shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import stored
from tallyloom.llm.integer_vectors import as_doubles, integers, matrix, sums_by_group, whole_vectors

_SLACK = 1e-9


def squared(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each of ``others``."""
    out = np.empty((len(vectors), len(others)), dtype=np.int64)
    for j, other in enumerate(others):
        gap = vectors - other
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


@dataclass
class VantageTree:
    """Nodes hold a few centroids, the first of which is the vantage point; a child knows the range of its distances to it."""

    centroids: np.ndarray
    leaf: int = 3
    members: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    reach: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self):
        pending = [(np.arange(len(self.centroids)), (0.0, 0.0), None)] if len(self.centroids) else []
        while pending:
            own, reach, parent = pending.pop()
            node = len(self.members)
            self.reach.append(reach)
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if len(own) <= self.leaf:
                self.members.append(own)
                continue
            # the centroid farthest from the node's first one lies at an edge, from where distances differ most
            point = own[squared(self.centroids[own], self.centroids[own[:1]])[:, 0].argmax()]
            rest = own[own != point]
            far = np.sqrt(squared(self.centroids[rest], self.centroids[[point]])[:, 0].astype(float))
            order = np.argsort(far, kind="stable")
            self.members.append(np.array([point]))
            for half in np.array_split(order, 2):
                pending.append((rest[half], (float(far[half].min()), float(far[half].max())), node))

    def nearest(self, vectors: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each vector, smaller numbers first in ties; and distances computed."""
        numbers, distances, work = [], [], 0
        for start in range(0, len(vectors), block):
            number, distance, done = self._nearest(vectors[start : start + block])
            numbers.append(number)
            distances.append(distance)
            work += done
        if not numbers:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        return np.concatenate(numbers), np.concatenate(distances), work

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, work = len(vectors), 0
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, np.iinfo(np.int64).max)
        bounds = np.full((n, len(self.members)), np.inf)  # of the nodes that a vector may visit next
        bounds[:, 0] = 0.0
        open_ = np.arange(n)
        while len(open_):
            choice = bounds[open_].argmin(axis=1)
            bound = bounds[open_, choice]
            on = bound <= np.sqrt(best[open_].astype(float)) * (1 + _SLACK)  # inclusive; inf ends it
            open_, choice = open_[on], choice[on]
            for node in np.unique(choice):
                rows = open_[choice == node]
                own = self.members[node]
                found = squared(vectors[rows], self.centroids[own])
                work += found.size
                for j, c in enumerate(own):
                    d = found[:, j]
                    better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
                    best[rows[better]], number[rows[better]] = d[better], c
                here = bounds[rows, node]
                bounds[rows, node] = np.inf
                if self.children[node]:
                    away = np.sqrt(found[:, 0].astype(float))
                    for child in self.children[node]:
                        near, far = self.reach[child]
                        gap = np.maximum(away - far, near - away) - _SLACK * (away + far)
                        bounds[rows, child] = np.maximum(here, gap)
        return number, best, work


def _start(vectors: DataFrame, k: int, dim: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hash of their id (a missing id: empty), equal ones by their components."""
    whole = vectors.where((F.size("embedding") == dim) & whole_vectors("embedding"))
    place = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = whole.select(place.alias("place"), integers("embedding").alias("x")).orderBy("place", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64).reshape(-1, dim)


def _moved(vectors: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """Centroids after one round: exact floors of the means of their vectors, empty ones as they were."""
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            _, found, _ = matrix(batch.column("embedding"), dim)
            number, _, _ = tree.value.nearest(found)
            order = np.argsort(number, kind="stable")
            at = np.flatnonzero(np.diff(number[order], prepend=-1))
            if len(at):
                sums[number[order][at]] += np.add.reduceat(found[order], at, axis=0)
                counts += np.bincount(number, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64()), "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    after = centroids.copy()
    for r in sums_by_group(vectors.select("embedding").mapInArrow(run, "cluster int, n long, sums array<long>"), ["cluster"]):
        after[r.cluster, r.place] = int(r.total) // r.n
    tree.unpersist()
    return after


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2:") -> DataFrame:
    """Clusters the rows of ``vectors`` (vec_id, embedding) by integer Lloyd rounds.

    Rows with null embeddings, other lengths than ``dim``, null or non-finite
    components are left out; components count as floor(256 * x). Centroids start
    as the k vectors with the smallest SHA-256 of salt and id; with fewer vectors
    there are fewer centroids. Repeated rows count as often as they occur; rows
    that share an id are drawn in the order of their components; a missing id
    hashes as empty text. An empty table gives no rows; further columns are
    ignored. A component beyond 2^27 / 256 is an error, as its distance fits no
    long. Returns vec_id, cluster, distance (squared), cluster_inertia, inertia
    and the SHA-256 of the final centroid.
    """
    vectors = vectors.select("vec_id", as_doubles("embedding").alias("embedding"))
    spark = vectors.sparkSession
    centroids = _start(vectors, k, dim, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids, dim)
    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def run(batches):
        for batch in batches:
            rows, found, _ = matrix(batch.column("embedding"), dim)
            number, distance, _ = tree.value.nearest(found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    placed = stored(vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")
    # one row per centroid, k at most
    totals = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = sum(int(r.s) for r in totals)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = [(r.cluster, int(r.s), inertia, shas[r.cluster]) for r in totals]
    facts = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
