"""Near-duplicate documents by min-max hashing.

Each hash permutation of a document's word shingles gives its smallest and its
largest value, two nearly independent samples for one evaluation. Bands of four
values make buckets; documents that meet in a bucket are compared on their full
shingle sets. In a bucket each document is first compared with one hub, so a
large group costs a star and not all its pairs. Only documents that are still in
different components are compared further, and of them only those whose known
overlaps with the hub allow a link, with what they share beside the hub.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.common import small_side, stored
from tallyloom.llm.components import connected_components

SHINGLE = 5
NEAR = 75  # per cent of the union
PERMUTATIONS, BAND = 80, 4  # 160 values, 40 bands; a pair at the limit is missed with probability 2.5e-7
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.frombuffer(hashlib.shake_256(b"factors").digest(8 * PERMUTATIONS), dtype="<u8") | np.uint64(1)
_MASKS = np.frombuffer(hashlib.shake_256(b"masks").digest(8 * PERMUTATIONS), dtype="<u8")


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 80_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words_of: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: five words, or all words of a shorter text as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words_of.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(h))
    total = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(total))


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of the set under each permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        values = (shingles[at : at + 2048, None] ^ _MASKS) * _FACTORS
        low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    return low, high


def _bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    values = np.stack((low, high), axis=1).ravel().reshape(-1, BAND)
    key = np.arange(1, len(values) + 1, dtype=np.uint64)
    for k in range(BAND):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, n, node (name of the shingle set, null without words), bands, sketch (a byte of each value)."""

    def run(batches):
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        words_of = _WordHash()
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, words_of)
                if len(s):
                    low, high = min_max(s)
                    sketch = ((np.concatenate((low, high)) * _M1) >> np.uint64(56)).astype(np.uint8).view(np.int64)
                    rows.append((row, doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), _bands(low, high), sketch))
                else:
                    rows.append((row, doc_id, 0, None, None, None))
            out = pd.DataFrame(rows, columns=["row", "doc_id", "n", "node", "bands", "sketch"])
            out["doc_id"] = batch["doc_id"].to_numpy()
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInPandas(run, f"row long, doc_id {kind}, n long, node binary, bands array<long>, sketch array<long>")


def _sets_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes, from one document each."""
    wanted = stored(reps.join(nodes, "node", "left_semi").select("row", "node"), "wanted")
    rows = docs.join(small_side(wanted, wanted.count()), "row").select("node", "text")

    def run(batches):
        words_of = _WordHash()
        for batch in batches:
            sets = [shingle_set(t, words_of).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})

    return rows.mapInPandas(run, "node binary, shingles array<long>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes of their intersection and union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("common", both)
    return joined.select("a", "b", "common", (F.size("sa") + F.size("sb") - F.col("common")).alias("joint"))


def _linked(confirmed: DataFrame) -> DataFrame:
    return confirmed.where(100 * F.col("common") >= NEAR * F.col("joint")).select("a", "b")


def _sizes_allow(x: str, y: str):
    """The smaller set may make up enough of the larger one."""
    return 100 * F.least(x, y) >= NEAR * F.greatest(x, y)


def _mixed_rows(buckets: DataFrame, known: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, without the hub, with the number of shingles in which each differs from the hub (null: not compared)."""
    rows = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    apart = known.select(F.col("b").alias("hub"), F.col("a").alias("node"), (F.col("joint") - F.col("common")).alias("apart"))
    rows = rows.where("node <> hub").join(mixed, "key", "left_semi").join(apart, ["hub", "node"], "left")
    return rows.join(reps.select("node", "sketch"), "node").select("key", "hub", "node", "n", "label", "apart", "sketch")


def _pairs_on(rows: DataFrame, on: list[str], condition) -> DataFrame:
    """Pairs of ``rows`` in different components that agree in ``on``, whose sizes allow a link."""
    rest = [c for c in rows.columns if c not in on]
    a, b = (rows.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in rest]) for s in "ab")
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & _sizes_allow("n_a", "n_b")
    return a.join(b, on).where(apart & condition).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _alike():
    """Whether the sketches of a pair agree in places enough; sets of few shingles pass, as their samples repeat.

    Of a pair at the limit 120 of 160 places agree, give or take 5.5; 86 leaves
    six deviations. A place is a byte; folding its bits onto the lowest one tells
    which bytes differ.
    """

    def differing(x, y):
        bits = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))

    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", differing), F.lit(0), lambda n, d: n + d)
    return (F.least("n_a", "n_b") < 100) | (apart <= 2 * PERMUTATIONS - 86)


def _further_pairs(buckets: DataFrame, known: DataFrame, labels: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of a bucket in different components that what is known of the hub allows to be linked.

    Write d for the shingles in which a set differs from the hub, missing ones and
    added ones. A pair differs in d_a + d_b - 2 o shingles, o being the differences
    it shares, and is linked if these are no more than (n_a + n_b) / 7. Pairs that
    need no shared difference, or have not been compared with the hub, are found in
    their bucket. The others share at least o = (7 d_a - n_a + 7 d_b - n_b) / 14
    differences and are found by these. Differences that no other set has can't be
    shared and don't count, so copies with edits of their own drop out.
    """
    rows = stored(_mixed_rows(buckets, known, labels, reps), "mixed-buckets")
    free = F.col("apart_a").isNull() | F.col("apart_b").isNull() | (7 * (F.col("apart_a") + F.col("apart_b")) <= F.col("n_a") + F.col("n_b"))
    by_hub = _pairs_on(rows, ["key"], free & _alike())

    hub_label = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    family = rows.where("apart IS NOT NULL").select("hub", "node", "n", "label", (7 * F.col("apart") - F.col("n")).alias("turns")).distinct()
    family = stored(family.join(hub_label, "hub", "left").withColumn("near", F.coalesce(F.col("label") == F.col("hub_label"), F.lit(False))).drop("hub_label"), "families")
    # the partner that asks for least; those of the hub's component look for others only
    least = family.groupBy("hub").agg(F.min("turns").alias("any"), F.min(F.when(~F.col("near"), F.col("turns"))).alias("far"))
    need = F.greatest(F.ceil((F.col("turns") + F.when(F.col("near"), F.col("far")).otherwise(F.col("any"))) / 14), F.lit(1))
    family = stored(family.join(least, "hub").where("NOT near OR far IS NOT NULL").select("hub", "node", "n", "label", "turns", need.alias("need")), "needs")
    of_hub, of_node = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("hub", "node"))
    differing = F.explode(F.concat(F.array_except("_node", "_hub"), F.array_except("_hub", "_node")))
    differing = family.join(of_node, "node").join(of_hub, "hub").select(*family.columns, differing.alias("shingle"))
    differing = stored(differing, "differences")
    shared = differing.groupBy("hub", "shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    differing = stored(differing.join(shared, ["hub", "shingle"]), "shared-differences")
    # If two sets share o or more, they share one among all but the last o - 1 of each, in any one order, and the
    # first that they share has o - 1 after it in both. The order is from rare to frequent.
    own = W.partitionBy("hub", "node")
    differing = differing.withColumn("held", F.count("*").over(own)).withColumn("turn", F.row_number().over(own.orderBy("holders", "shingle")))
    leading = differing.where(F.col("turn") <= F.col("held") - F.col("need") + 1)
    leading = leading.select("hub", "shingle", "node", "n", "label", "turns", (F.col("held") - F.col("turn")).alias("after"))
    wanted = F.col("turns_a") + F.col("turns_b")
    by_rest = _pairs_on(leading, ["hub", "shingle"], (wanted > 0) & (14 * (1 + F.least("after_a", "after_b")) >= wanted))
    return by_hub.union(by_rest).distinct()


def _first(doc_id: str, row: str):
    """Orders rows by id, missing ids last."""
    return F.struct(F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("id"), F.col(row).alias("row"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents linked by near-equal shingle sets.

    One row per row of ``docs``: row (hash of id and text), doc_id, n_shingles,
    component_id (smallest id reachable), kept (doc_id equals component_id) and
    first_row (hash of one row of the component, of those with the smallest id).
    Documents without words are linked with nothing. A null id takes part in
    links but never is a component's smallest, unless there is no other; such a
    row is kept only then. Repeated rows get equal results. Other columns are
    ignored; an empty table gives no rows.
    """
    base = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    found = stored(signatures(base), "signatures")
    # documents with equal sets are one node
    reps = found.where("node IS NOT NULL").groupBy("node").agg(F.min(_first("doc_id", "row")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = stored(reps.select("*", F.col("first.id").alias("rep"), F.col("first.row").alias("row")).drop("first"), "nodes")
    keys = reps.select(F.explode("bands").alias("key"), "node", "n", F.struct(-F.col("copies"), "rep", "node", "n").alias("turn"))
    # what has most copies, and then what came first, is likely what the others derive from
    hubs = keys.groupBy("key").agg(F.min("turn").alias("h"), F.count("*").alias("c")).where("c > 1").select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    hubs = stored(hubs, "hubs")
    buckets = stored(keys.drop("turn").join(small_side(hubs, hubs.count(), 1_000_000), "key"), "buckets")
    stars = stored(buckets.where((F.col("node") != F.col("hub")) & _sizes_allow("n", "hub_n")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    sets = stored(_sets_of(base, reps, stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()), "sets")
    known = stored(_confirmed(stars, sets), "confirmed")
    links = _linked(known)
    labels = connected_components(links)
    more = stored(_further_pairs(buckets, known, labels, sets, reps), "further-pairs")
    if not more.isEmpty():
        nodes = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
        sets = stored(_sets_of(base, reps, nodes), "sets")
        further = stored(_linked(_confirmed(more, sets)), "further-links")
        if not further.isEmpty():
            labels = connected_components(links.union(further))
    ends = reps.select("node", _first("rep", "row").alias("own"))
    smallest = ends.join(labels, "node").groupBy("label").agg(F.min("own").alias("least"))
    of_node = ends.join(labels, "node", "left").join(smallest, "label", "left").select("node", F.coalesce("least", "own").alias("least"))
    return (
        found.select("row", "doc_id", "n", "node").join(of_node, "node", "left")
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.id")))
        .select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("least.row", "row").alias("first_row"))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, of those with the smallest id, with all its columns.

    Rows repeated with equal id and text are one row, also those without words;
    so are rows without ids in one component. Documents without words stay, once
    per id and text. Only texts of repeated rows are moved. An empty table gives
    no rows.
    """
    found = stored(near_duplicates(docs).select("row", "doc_id", "first_row"), "near-duplicates")
    key = [F.col("row").alias("_nd_gone"), F.col("doc_id").alias("_nd_id")]
    gone = stored(found.where("row <> first_row").select(*key).distinct(), "gone")
    repeats = stored(found.groupBy("row", "doc_id").count().where("count > 1").select(*key), "repeated-rows")
    keyed = docs.withColumn("_nd_row", F.xxhash64("doc_id", "text"))

    def among(rows: DataFrame, how: str, others: DataFrame) -> DataFrame:
        return rows.join(small_side(others, others.count()), (F.col("_nd_row") == F.col("_nd_gone")) & F.col("doc_id").eqNullSafe(F.col("_nd_id")), how)

    left = among(keyed, "left_anti", gone)
    if not repeats.isEmpty():
        left = among(left, "left_anti", repeats).unionByName(among(left, "left_semi", repeats).dropDuplicates(["_nd_row", "doc_id"]))
    return left.drop("_nd_row")
