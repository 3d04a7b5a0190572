"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language in order of
frequency. A document gets the language whose profile is nearest to its own by
out-of-place distance: the sum, over the document's n-grams, of how far each
stands from its rank in the profile.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.common import small_side

PROFILE_SIZE = 400
LONGEST = 3  # letters; three code points of 21 bits fit one 64-bit code
DOCS_PER_LANGUAGE = 4000
_BITS = np.uint64(21)


@cache
def _letters() -> np.ndarray:
    """For each code point the lower-case letter's code point, or a space where it is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def ngram_codes(text: str | None, longest: int = LONGEST) -> np.ndarray:
    """Codes of the text's n-grams of letters and word borders, with repeats; empty without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    folded = _letters()[points]
    blank = folded == 32
    if blank.all():
        return np.empty(0, dtype=np.uint64)
    # one space between words, one before and one behind the text
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    chars = np.concatenate(([32], folded[keep], [32])).astype(np.uint64)
    out, code = [], chars
    for n in range(1, longest + 1):
        if n > 1:
            code = (code[:-1] << _BITS) | chars[n - 1 :]
        # a space is a border: never alone, and only first or last
        good = np.ones(len(code), dtype=bool) if n > 1 else code != 32
        for inner in range(1, n - 1):
            good &= chars[inner : inner + len(code)] != 32
        out.append(code[good])
    return np.concatenate(out)


def most_frequent(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, equal counts in code order."""
    if not len(codes):
        return codes
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    found, counts = codes[first], np.diff(np.append(first, len(codes)))
    return found[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Profiles of the learned languages as one table of ranks."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size, self.languages = size, sorted(ranked)
        known = sorted({g for grams in ranked.values() for g in grams})
        self.known = np.array(known, dtype=np.uint64)
        # the last column stands for n-grams of no profile
        self.ranks = np.full((len(self.languages), len(known) + 1), -1, dtype=np.int64)
        at = {g: i for i, g in enumerate(known)}
        for row, name in enumerate(self.languages):
            for rank, gram in enumerate(ranked[name]):
                self.ranks[row, at[gram]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and closeness (0: nothing in common, 1: the profile itself); ties go to the first name."""
        own = most_frequent(ngram_codes(text), self.size)
        if not len(own) or not self.languages:
            return "und", 0.0
        spot = np.searchsorted(self.known, own)
        spot[spot == len(self.known)] = 0
        spot = np.where(self.known[spot] == own, spot, len(self.known))
        ranks = self.ranks[:, spot]
        out_of_place = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(out_of_place.argmin())
        return self.languages[best], float(1 - out_of_place[best] / (self.size * len(own)))


def learn_profiles(labelled: DataFrame, size: int = PROFILE_SIZE, docs_per_language: int = DOCS_PER_LANGUAGE) -> Profiles:
    """Profiles from ``labelled`` (doc_id, text, lang).

    About ``docs_per_language`` documents of each language are read, those whose
    hash is below a threshold set from the language's count; with fewer, all are.
    Rows without text or language teach nothing.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    shares = rows.groupBy("lang").agg((F.lit(float(docs_per_language)) / F.count("*")).alias("share"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row for each language: joined without moving texts
    sample = rows.join(small_side(shares, shares.count()), "lang").where(unit < F.col("share")).select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                codes = np.sort(np.concatenate([ngram_codes(t) for t in texts]))
                found, counts = np.unique(codes, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": found.astype(np.int64), "n": counts})

    totals = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    ranked: dict[str, list[int]] = {}
    top = totals.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank")
    for row in top.collect():  # at most ``size`` rows for each language
        ranked.setdefault(row.lang, []).append(row.gram)
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score of the whole text.

    ``und`` with score 0 where the text is null, has no letter, or nothing was
    learned. Other columns pass through, but for earlier ones of these names.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for batch in batches:
            found = [model.value.predict(t) for t in batch["text"]]
            out = batch.drop(columns=["text"])
            out["lang_pred"], out["score"] = [f[0] for f in found], [f[1] for f in found]
            yield out

    rest = docs.drop("lang_pred", "score")
    kept = [f for f in rest.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    return rest.select(*[f"`{f.name}`" for f in kept], "text").mapInPandas(run, schema)
