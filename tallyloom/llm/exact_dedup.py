"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its bytes says so, so equal texts have
equal chunks. A digest that occurs once in the corpus names a chunk no other
text has: a text that holds such a chunk has no copy and moves no further. Only
chunks whose digest recurs are moved, once per distinct content after the
map-side combine, to verify that equal digests stand for equal bytes. Texts are
then compared by their ordered lists of verified chunk identifiers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.common import small_side, stored

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
# One 32-bit number per byte value for the rolling hash, from a fixed rule.
_GEAR = np.frombuffer(hashlib.sha512(b"chunk borders").digest() * 16, dtype="<u4")[:256] ^ (np.arange(256, dtype=np.uint32) * np.uint32(2654435761))
_REACH = 16


def normalised(text: str | None) -> bytes:
    return _SPACES.sub(" ", text or "").encode("utf-8", "surrogatepass")


def cut_points(data: bytes, mean: int, longest: int) -> list[int]:
    """End offsets of the chunks of ``data``; they depend on nearby bytes only, but for the limit on length."""
    n = len(data)
    if n <= mean:
        return [n]
    g = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    h = g.copy()
    for k in range(1, _REACH):  # weighted sum of the last bytes
        h[k:] += g[:-k] << np.uint32(k)
    marks = np.flatnonzero((h >> np.uint32(7)) % np.uint32(mean) == 0) + 1
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        if m - last < mean // 4 and m < n:
            continue
        while m - last > longest:
            last += longest
            ends.append(last)
        if m > last:
            ends.append(m)
            last = m
    return ends


def chunks(data: bytes, mean: int, longest: int) -> Iterator[bytes]:
    start = 0
    for end in cut_points(data, mean, longest):
        yield data[start:end]
        start = end


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def chunk_recipes(docs: DataFrame, mean: int = 4096, longest: int = 32768, digest_bytes: int = 16, spelled_out: frozenset[bytes] = frozenset()) -> DataFrame:
    """doc_id, SHA-256 of the normalised text, and the identifiers of its chunks in order.

    The identifier of a chunk is its digest; a chunk whose digest is in
    ``spelled_out`` is its own identifier.
    """

    def run(batches):
        for batch in batches:
            shas, lists = [], []
            for text in batch["text"]:
                data = normalised(text)
                shas.append(hashlib.sha256(data).hexdigest())
                named = ((c, _digest(c, digest_bytes)) for c in chunks(data, mean, longest))
                lists.append([b"=" + c if d in spelled_out else d for c, d in named])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_sha256": shas, "recipe": lists})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text_sha256 string, recipe array<binary>")


def chunk_contents(docs: DataFrame, mean: int, longest: int, digest_bytes: int) -> DataFrame:
    """(digest, content) of all chunks, without repeats inside a batch."""

    def run(batches):
        for batch in batches:
            seen = {}
            for text in batch["text"]:
                for c in chunks(normalised(text), mean, longest):
                    seen[_digest(c, digest_bytes), c] = None
            yield pd.DataFrame(list(seen), columns=["digest", "content"])

    return docs.select("text").mapInPandas(run, "digest binary, content binary")


def ambiguous_digests(docs: DataFrame, in_question: DataFrame, mean: int, longest: int, digest_bytes: int) -> DataFrame:
    """Those of the digests ``in_question`` that stand for more than one content."""
    found = chunk_contents(docs, mean, longest, digest_bytes).join(small_side(in_question, in_question.count()), "digest", "left_semi")
    return found.distinct().groupBy("digest").count().where("count > 1").select("digest")


def exact_groups(docs: DataFrame, mean: int = 4096, longest: int = 32768, digest_bytes: int = 16) -> DataFrame:
    """Groups of documents whose texts are equal after each run of ASCII white space became one space.

    One row per row of ``docs``: doc_id, keep_id (smallest id of the group),
    group_size, kept, text_sha256. Null texts count as empty. Of repeated rows
    that share the smallest id one stays. A null id is the smallest only in a
    group that has no other. An empty table gives no rows; columns other than
    doc_id and text are ignored. Digests are 128 bits wide by default; should
    one stand for two contents, its chunks are compared by content instead.
    """
    base = docs.select("doc_id", "text")
    recipes = stored(chunk_recipes(base, mean, longest, digest_bytes), "recipes")

    def groups_of(rows):
        return rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")

    groups = stored(groups_of(recipes), "recipe-groups")
    in_question = stored(groups.select(F.explode("recipe").alias("digest")).distinct(), "digests")
    doubtful = frozenset(bytes(r.digest) for r in ambiguous_digests(base, in_question, mean, longest, digest_bytes).collect())
    if doubtful:  # collisions of the digest only
        recipes = stored(chunk_recipes(base, mean, longest, digest_bytes, doubtful), "recipes")
        groups = stored(groups_of(recipes), "recipe-groups")
    once = W.partitionBy("doc_id", "text_sha256").orderBy(F.lit(0))
    shared = F.col("group_size").isNotNull()
    return (
        recipes.join(small_side(groups, groups.count(), 100_000), "recipe", "left")
        .withColumn("first", F.row_number().over(once) == 1)
        .select(
            "doc_id",
            F.when(shared, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (~shared | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first"))).alias("kept"),
            "text_sha256",
        )
    )
