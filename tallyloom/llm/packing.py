"""Packing tokenised documents into training sequences.

Pieces are dealt into blocks of bounded size. For each block several islands
evolve solutions over the block's lengths by a grouping genetic algorithm, as rows
of a table; between epochs each island's elite migrates to the next island of its
block. Poorly filled sequences of all blocks are taken apart once more and packed
together in larger blocks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Cached, stored
from tallyloom.llm.grouping_ga import evolve

CAPACITY = 4096
END_ID = 1
BLOCK_PIECES = 4096
ISLANDS, EPOCHS = 2, 2
FULL_ENOUGH = 0.985  # sequences below are packed again
MERGED_BLOCKS = 16
_BLOCK_BITS = 24


# Byte-level vocabularies write a byte as a character: printable Latin-1 as itself, the others in order from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_AS_CHARACTER = "".join(chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256))
_LATIN_WORD = re.compile("[a-zß-öø-ÿ]+")
# letters, then signs but no apostrophe, which may begin a token of letters
_LETTERS_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds(Cached):
    """Token ids of a word (bytes between ASCII white space) as little-endian 32-bit numbers.

    White space separates words for the tokenizer too, and it lowers case itself,
    so a text's ids are those of its lower-case words in order.
    """

    def __init__(self, path: str, most: int = 120_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokens_of = self.tokenizer.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def made(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # bytes: ASCII letters only
            return self._letters(word.decode("ascii"))
        text = word.decode("utf-8", "replace")
        if found := _LETTERS_SIGNS.fullmatch(text):
            signs = len(found[2])
            if signs:  # letters and signs are tokens of their own
                return self[word[:-signs]] + self[word[-signs:]]
            return self._letters(text.lower().encode("utf-8").decode("latin-1").translate(_AS_CHARACTER))
        if len(text) > 1 and text[-1] in ".," and _LATIN_WORD.fullmatch(text[-2]):
            return self[word[:-1]] + self[word[-1:]]
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, characters: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokens_of(characters)])

    def of(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        # names of special tokens keep their case
        return b"".join(map(self.__getitem__, (data if b"<|" in data else data.lower()).split()))


@cache
def word_ids(path: str) -> WordIds:
    """One per Python worker; tasks that follow find the words already known."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as ids with END_ID behind, cut where longer than a sequence."""

    def run(batches):
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        ids_of = word_ids(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch["text"]):
                ids = ids_of.of(text) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    at.append(i)
                    rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", batch["doc_id"].iloc[at].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packings(blocked: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(block, bins): the best solution found for the lengths of each block. ``blocked`` has block and length."""
    counts = blocked.where(F.col("length") < capacity).groupBy("block", "length").count()
    lengths = counts.groupBy("block").agg(F.flatten(F.collect_list(F.array_repeat(F.col("length").cast("int"), F.col("count").cast("int")))).alias("lengths"))
    # a collected list has at most as many entries as a block has pieces
    state = lengths.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.withColumn("elites", F.array().cast("array<array<array<int>>>"))
    schema = "block long, lengths array<int>, island int, bins array<array<int>>"
    for epoch in range(epochs):

        def run(batches, epoch=epoch):
            for batch in batches:
                found = []
                for block, lengths, island, elites in zip(batch["block"], batch["lengths"], batch["island"], batch["elites"], strict=True):
                    given = [[tuple(int(x) for x in b) for b in e] for e in elites]
                    seed = hash((int(block), int(island), epoch))
                    found.append([list(b) for b in evolve(sorted(int(x) for x in lengths), given, capacity, seed)])
                yield pd.DataFrame({"block": batch["block"], "lengths": batch["lengths"], "island": batch["island"], "bins": found})

        state = stored(state.repartition("block", "island").mapInPandas(run, schema), "islands")
        guests = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("guest"))
        if epoch + 1 < epochs:
            state = state.join(guests, ["block", "island"]).select("block", "lengths", "island", F.array("bins", "guest").alias("elites"))
    return state.groupBy("block").agg(F.min_by("bins", F.struct(F.size("bins"), "island")).alias("bins"))


def _assigned(blocked: DataFrame, solutions: DataFrame, capacity: int, keep: float) -> DataFrame:
    """``blocked`` with sequence_id and offset; null where the sequence is filled less than ``keep``."""

    def run(rows: pd.DataFrame, solution: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        first = {}  # next row of each length
        for i, x in enumerate(rows["length"]):
            first.setdefault(x, i)
        seq, offset = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        number = 0
        for b in solution["bins"].iat[0] if len(solution) else []:
            good, at = sum(b) >= keep * capacity, 0
            for x in b:
                i = first[x]
                first[x] += 1
                if good:
                    seq[i], offset[i] = number, at
                at += x
            number += good
        whole = np.flatnonzero(rows["length"].to_numpy() >= capacity)
        seq[whole] = number + np.arange(len(whole))
        base = int(rows["block"].iat[0]) << _BLOCK_BITS if len(rows) else 0
        rows["sequence_id"] = pd.array(np.where(seq < 0, -1, base + seq), dtype="Int64")
        rows["offset"] = offset
        return rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocked.schema)
    joined = blocked.groupBy("block").cogroup(solutions.groupBy("block")).applyInPandas(run, f"{fields}, sequence_id long, offset long")
    return joined.withColumn("sequence_id", F.when(F.col("sequence_id") >= 0, F.col("sequence_id")))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: one END_ID. Repeated rows are packed each. Sequences have
    no gaps. Only documents longer than a sequence are cut. Other columns are
    ignored; an empty table gives no rows.
    """
    cut = stored(pieces(docs, tokenizer_path, capacity), "pieces")
    n_blocks = max(1, -(-cut.count() // block_pieces))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_blocks)).cast("long")
    blocked = cut.withColumn("block", spread)
    first = stored(_assigned(blocked, packings(blocked, capacity), capacity, FULL_ENOUGH), "packed")
    left = first.where("sequence_id IS NULL").drop("sequence_id", "offset")
    # the rest of MERGED_BLOCKS blocks goes together; block numbers go on
    merged = left.withColumn("block", F.lit(n_blocks) + F.floor(F.col("block") / MERGED_BLOCKS))
    second = _assigned(merged, packings(merged, capacity), capacity, 0.0)
    return first.where("sequence_id IS NOT NULL").unionByName(second).drop("block")
