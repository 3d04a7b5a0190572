"""Product quantisation by dual-tree Lloyd rounds on integer vectors.

Vectors are cut into parts; each part position has a codebook. Tasks hold two
trees per position: one over the parts of a block of vectors (ranges along a
Z-order curve, halved again and again) and one over the codebook's entries.
Pairs of nodes are refined together from the roots. Boxes are integer, so the
least and greatest distance of a pair are exact: an entry node goes where its
least distance exceeds the greatest distance of another pair of the same part
node, and a single entry goes where another one is nearer in the whole box. A
part node left with one entry is assigned whole, by its cached sums; parts in
leaves that keep several entries are compared by exact integer distances. The
trees over parts never leave their task; only sums per entry do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import stored
from tallyloom.llm.integer_vectors import as_doubles, integers, matrix, sums_by_group, whole_vectors


def curve_order(points: np.ndarray) -> np.ndarray:
    """Order of the points along a Z-order curve over their leading bits; any order would be right, this one keeps near points together."""
    low, spread = points.min(axis=0), np.ptp(points, axis=0)
    axes = np.argsort(-spread, kind="stable")[:12]
    bits = 60 // len(axes)
    shift = max(0, int(spread.max()).bit_length() - bits)
    cells = ((points[:, axes] - low[axes]) >> shift).astype(np.int64)
    code = np.zeros(len(points), np.int64)
    for b in reversed(range(min(bits, max(1, int(cells.max()).bit_length())))):
        for a in range(len(axes)):
            code = code << 1 | cells[:, a] >> b & 1
    return np.argsort(code, kind="stable")


class PointTree:
    """A binary tree over points: level by level ranges of the curve order, with boxes and cached counts and sums."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = curve_order(points)
        self.points = points[self.order]
        edges = [np.arange(0, len(points), leaf)]
        lows, highs = [np.minimum.reduceat(self.points, edges[0])], [np.maximum.reduceat(self.points, edges[0])]
        while len(edges[-1]) > 1:
            pairs = np.arange(0, len(edges[-1]), 2)
            edges.append(edges[-1][::2])
            lows.append(np.minimum.reduceat(lows[-1], pairs))
            highs.append(np.maximum.reduceat(highs[-1], pairs))
        self.starts, self.lows, self.highs = edges[::-1], lows[::-1], highs[::-1]
        self.depth = len(self.starts) - 1
        self.before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.starts[level][1:], len(self.points))


class EntryTree(PointTree):
    """The tree over the distinct entries of a codebook; of equal entries the first stands for all, as ties go to it."""

    def __init__(self, entries: np.ndarray):
        _, first = np.unique(entries, axis=0, return_index=True)
        first = np.sort(first)
        super().__init__(entries[first], 1)
        self.index = first[self.order]


def _least(low_a, high_a, low_b, high_b) -> np.ndarray:
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return np.einsum("ij,ij->i", gap, gap)


def _greatest(low_a, high_a, low_b, high_b) -> np.ndarray:
    gap = np.maximum(np.abs(high_a - low_b), np.abs(high_b - low_a))
    return np.einsum("ij,ij->i", gap, gap)


def _halves(nodes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes in a level that has ``below`` nodes, and which of ``nodes`` each comes from."""
    children = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
    source = np.repeat(np.arange(len(nodes)), 2)
    there = children < below
    return children[there], source[there]


def assign(tree: PointTree, entries: EntryTree) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, int]:
    """Nearest entries of all points of ``tree``.

    Returns whole ranges (start, end, entry) in the tree's order, then places
    and entries of the points decided one by one, and the distances computed
    for these. Every place is in one of the two.
    """
    part, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level, e_level = 0, 0
    whole: list[tuple[int, int, int]] = []
    while True:
        low, high = tree.lows[level][part], tree.highs[level][part]
        e_low, e_high = entries.lows[e_level][entry], entries.highs[e_level][entry]
        most = np.full(len(tree.lows[level]), np.iinfo(np.int64).max)
        np.minimum.at(most, part, _greatest(low, high, e_low, e_high))
        keep = _least(low, high, e_low, e_high) <= most[part]  # an equal one may hold the tie's winner
        if e_level == entries.depth:
            keep &= ~_dominated(tree, level, part, entry, entries)
        part, entry = part[keep], entry[keep]
        if e_level == entries.depth:
            single = np.bincount(part, minlength=len(tree.lows[level]))[part] == 1
            ends = tree.ends(level)
            whole += zip(tree.starts[level][part[single]].tolist(), ends[part[single]].tolist(), entries.index[entry[single]].tolist())
            part, entry = part[~single], entry[~single]
            if not len(part) or level == tree.depth:
                break
        if level < tree.depth:
            part, source = _halves(part, len(tree.lows[level + 1]))
            entry, level = entry[source], level + 1
        if e_level < entries.depth:
            entry, source = _halves(entry, len(entries.lows[e_level + 1]))
            part, e_level = part[source], e_level + 1
    return whole, *_one_by_one(tree, part, entry, entries)


def _dominated(tree: PointTree, level: int, part: np.ndarray, entry: np.ndarray, entries: EntryTree) -> np.ndarray:
    """Pairs whose entry, for every point of the box, loses against the entry nearest to the box's middle."""
    low, high = tree.lows[level], tree.highs[level]
    gap = low[part] + high[part] - 2 * entries.points[entry]
    far = np.einsum("ij,ij->i", gap, gap)
    order = np.lexsort((entries.index[entry], far, part))
    first = np.flatnonzero(np.diff(part[order], prepend=-1))
    rival = np.zeros(len(low), np.int64)
    rival[part[order][first]] = entry[order][first]
    one, other = entries.points[rival[part]], entries.points[entry]
    toward = other - one
    # |x - other|^2 - |x - one|^2 is linear in x, so it is least in a corner of the box
    corner = np.where(toward > 0, high[part], low[part])
    least = np.einsum("ij,ij->i", toward, one + other - 2 * corner)
    loses = (least > 0) | ((least == 0) & (entries.index[entry] > entries.index[rival[part]]))
    return loses & (entry != rival[part])


def _one_by_one(tree: PointTree, part: np.ndarray, entry: np.ndarray, entries: EntryTree) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and nearest entries of the points in leaves that keep several entries."""
    if not len(part):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    starts, ends = tree.starts[tree.depth][part], tree.ends(tree.depth)[part]
    sizes = ends - starts
    pair = np.repeat(np.arange(len(part)), sizes)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[pair]
    gap = tree.points[place] - entries.points[entry[pair]]
    far, index = np.einsum("ij,ij->i", gap, gap), entries.index[entry[pair]]
    order = np.lexsort((index, far, place))
    first = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
    return place[first], index[first], len(pair)


def codes_of(points: np.ndarray, entries: EntryTree, leaf: int) -> np.ndarray:
    """Index of the nearest entry of each point, in the order given."""
    tree = PointTree(points, leaf)
    whole, places, found, _ = assign(tree, entries)
    code = np.empty(len(points), np.int64)
    for start, end, index in whole:
        code[tree.order[start:end]] = index
    code[tree.order[places]] = found
    return code


def sums_of(points: np.ndarray, entries: EntryTree, n_entries: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """How many points each entry gets, and their sums; whole nodes add their cached sums."""
    tree = PointTree(points, leaf)
    whole, places, found, _ = assign(tree, entries)
    counts, sums = np.zeros(n_entries, np.int64), np.zeros((n_entries, points.shape[1]), np.int64)
    if whole:
        start, end, index = np.array(whole).T
        np.add.at(counts, index, end - start)
        np.add.at(sums, index, tree.before[end] - tree.before[start])
    np.add.at(counts, found, 1)
    np.add.at(sums, found, tree.points[places])
    return counts, sums


def _start(vectors: DataFrame, n_entries: int, dim: int) -> np.ndarray:
    """The vectors with the smallest ids, missing ids last, equal ids by their components."""
    whole = vectors.where((F.size("embedding") == dim) & whole_vectors("embedding"))
    rows = whole.select("vec_id", integers("embedding").alias("x")).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(n_entries).collect()
    return np.array([r.x for r in rows], dtype=np.int64).reshape(-1, dim)


def _moved(vectors: DataFrame, books: np.ndarray, leaf: int) -> np.ndarray:
    """Codebooks (position, entry, component) after one round; unused entries as they were."""
    parts, n_entries, width = books.shape
    trees = vectors.sparkSession.sparkContext.broadcast([EntryTree(b) for b in books])

    def run(batches):
        counts, sums = np.zeros((parts, n_entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            _, found, _ = matrix(batch.column("embedding"), parts * width)
            for p in range(parts if len(found) else 0):
                n, s = sums_of(found[:, p * width : (p + 1) * width], trees.value[p], n_entries, leaf)
                counts[p] += n
                sums[p] += s
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e], pa.int64()), "sums": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})

    after = books.copy()
    for r in sums_by_group(vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<long>"), ["part", "entry"]):
        after[r.part, r.entry, r.place] = int(r.total) // r.n
    trees.unpersist()
    return after


def compress_vectors(vectors: DataFrame, parts: int = 16, n_entries: int = 64, rounds: int = 2, dim: int = 64, leaf: int = 8) -> DataFrame:
    """Codes of the rows of ``vectors`` (vec_id, embedding, label) from codebooks learned on all of them.

    Rows with null embeddings, null or non-finite components are left out.
    Components count as floor(256 * x). A whole vector of another length than
    ``dim`` can't be cut alike: it stays, with null code and error. Codebooks
    start as the parts of the vectors with the smallest ids (missing ids last,
    equal ids by their components); with fewer vectors there are fewer entries.
    Repeated rows count as often as they occur. An empty table gives no rows;
    further columns are ignored; without a label column labels are null. A
    component beyond 2^27 / 256 is an error, as its distance fits no long.
    Returns vec_id, label, code, error, label_error (null labels together) and
    the SHA-256 of the final codebooks.
    """
    if dim % parts or n_entries > 256:
        raise ValueError("parts must divide dim, and an index has two hex digits")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    vectors = vectors.select("vec_id", label.alias("label"), as_doubles("embedding").alias("embedding"))
    width = dim // parts
    books = np.ascontiguousarray(_start(vectors, n_entries, dim).reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds if books.size else 0):
        books = _moved(vectors, books, leaf)
    trees = vectors.sparkSession.sparkContext.broadcast(([EntryTree(b) for b in books] if books.size else [], books))
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for batch in batches:
            fits, found, rows = matrix(batch.column("embedding"), dim)
            code, error = np.empty((len(found), parts), np.int64), np.zeros(len(found), np.int64)
            for p in range(parts if len(found) else 0):
                points = found[:, p * width : (p + 1) * width]
                code[:, p] = codes_of(points, trees.value[0][p], leaf)
                gap = points - trees.value[1][p][code[:, p]]
                error += np.einsum("ij,ij->i", gap, gap)
            at = np.searchsorted(rows, fits)
            texts, errors = np.full(len(rows), None, object), np.full(len(rows), None, object)
            texts[at] = ["".join(r) for r in digits[code].tolist()]
            errors[at] = error
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = stored(vectors.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "codes")
    per_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of_label")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(per_label, coded["label"].eqNullSafe(per_label["of_label"]))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
