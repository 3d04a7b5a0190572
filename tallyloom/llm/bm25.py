"""Exact top-k search with BM25 over sharded inverted indexes.

Each task turns its documents into index shards of bounded size. Queries come in
blocks of bounded size, whose terms get global document frequencies. A task holds
some of the shards and answers the block's queries on one after the other, so what
it has found bounds the k-th best from below. Inside a shard, postings of rare terms
are added up; with the maxima of frequent terms over ranges of documents of like
length they tell which ranges can hold an answer for which queries. Only there are
frequent terms added, as products of small matrices, and the few documents that
reach the bound are scored exactly. Tasks' answers are merged exactly, as all use the
same statistics; each gives k rows a query at most.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.common import stored

K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS, SHARD_POSTINGS = 60_000, 3_000_000
QUERY_BLOCK = 6000
RANGE = 64  # documents that share a block maximum
FREQUENT = 20  # a term is frequent if it is in one document of so many
MATRIX_CELLS, SCORE_CELLS, ADDED = 8_000_000, 500_000, 4_000_000  # frequent terms by documents; queries at hand by documents; postings added at once
DIGITS = 6  # of a score; ties after rounding go to the smaller id


class _TermHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def term_counts(text: str | None, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words (A-Z in lower case, between ASCII white space) and how often each occurs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words)), return_counts=True)


_SHARD = "n_docs long, n_words long, ids array<long>, lengths binary, terms binary, starts binary, docs binary, counts binary"


def _packed(ids, lengths, terms, counts) -> pd.DataFrame:
    sizes = np.array([len(t) for t in terms])
    term, count = np.concatenate(terms), np.concatenate(counts)
    doc = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
    order = np.argsort(term, kind="stable")
    term = term[order]
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, dtype=np.int64)
    row = (len(ids), sum(lengths), ids, np.array(lengths, dtype=np.int64).tobytes(), term[starts].tobytes(), np.append(starts, len(term)).astype(np.int64).tobytes(), doc[order].tobytes(), count[order].astype(np.uint32).tobytes())
    return pd.DataFrame([row], columns=[c.split()[0] for c in _SHARD.split(", ")])


def index_shards(docs: DataFrame) -> DataFrame:
    """One row per shard with its postings as arrays, in the order of the input's partitions."""

    def run(batches):
        cache = _TermHash()
        ids, lengths, terms, counts, n = [], [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                t, c = term_counts(text, cache)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(int(c.sum()))
                terms.append(t)
                counts.append(c.astype(np.uint32))
                n += len(t)
                if len(ids) >= SHARD_DOCS or n >= SHARD_POSTINGS:
                    yield _packed(ids, lengths, terms, counts)
                    ids, lengths, terms, counts, n = [], [], [], [], 0
        if ids:
            yield _packed(ids, lengths, terms, counts)

    return docs.select("doc_id", "text").mapInPandas(run, _SHARD)


class Asked(NamedTuple):
    """A block of queries; query i has the terms ``at[starts[i]:starts[i + 1]]`` of the sorted ``terms``."""

    ids: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    weights: np.ndarray  # of the terms


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all spans, one behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


class Shard:
    """A shard's postings with what they add to a score, and block maxima, for the terms of a block of queries."""

    def __init__(self, row, mean_length: float, asked: Asked):
        lengths = np.frombuffer(row.lengths, dtype=np.int64)
        self.n = int(row.n_docs)
        terms = np.frombuffer(row.terms, dtype=np.uint64)
        starts = np.frombuffer(row.starts, dtype=np.int64)
        sizes = np.diff(starts)
        at = np.searchsorted(terms, asked.terms)
        at[at == len(terms)] = 0
        there = terms[at] == asked.terms if len(terms) else np.zeros(len(at), dtype=bool)
        # only terms that are asked for, numbered anew; place: their number for each term of the queries
        self.place = np.where(there, np.cumsum(there) - 1, -1).astype(np.int32)
        self.weights = asked.weights[there]
        self.sizes = sizes[at[there]]
        self.starts = np.cumsum(self.sizes) - self.sizes
        held = _spans(starts[at[there]], self.sizes)
        # documents of like length stand together, so that their block maxima are close
        order = np.argsort(lengths, kind="stable")
        self.ids = [row.ids[i] for i in order]
        rank = np.empty(self.n, dtype=np.uint16)
        rank[order] = np.arange(self.n)
        self.docs = rank[np.frombuffer(row.docs, dtype=np.uint16)[held]]
        tf = np.frombuffer(row.counts, dtype=np.uint32)[held]
        del held
        self.norm = K1 * (1 - B + B * lengths[order] / mean_length)
        term_of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        # single precision finds the candidates, the same postings by document score them
        near = tf.astype(np.float32)
        self.adds = near * np.float32(K1 + 1) / (near + self.norm.astype(np.float32)[self.docs]) * self.weights.astype(np.float32)[term_of]
        by_doc = np.argsort(self.docs, kind="stable")
        self.terms_of, self.tf_of = term_of[by_doc], tf[by_doc]
        self.doc_starts = np.concatenate(([0], np.cumsum(np.bincount(self.docs, minlength=self.n))))
        del by_doc, term_of, near, tf
        self.frequent = np.flatnonzero(self.sizes > max(16, self.n // FREQUENT))
        if len(self.frequent) * self.n > MATRIX_CELLS:
            most = MATRIX_CELLS // self.n
            self.frequent = np.sort(self.frequent[np.argsort(-self.sizes[self.frequent], kind="stable")[:most]])
        self.row_of = np.full(len(self.sizes), -1, dtype=np.int32)
        self.row_of[self.frequent] = np.arange(len(self.frequent))
        self.matrix = np.zeros((len(self.frequent), self.n), dtype=np.float32)
        for row_at, term in enumerate(self.frequent):
            span = slice(self.starts[term], self.starts[term] + self.sizes[term])
            self.matrix[row_at, self.docs[span]] = self.adds[span]
        self.blocks = np.arange(0, self.n, RANGE)
        self.maxima = np.maximum.reduceat(self.matrix, self.blocks, axis=1) if len(self.frequent) else np.zeros((0, len(self.blocks)), dtype=np.float32)
        self.searched = 0  # (query, block) pairs whose documents were scored
        self.asked_now = np.zeros(len(self.sizes))  # weights of the query at hand

    def full(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whole scores of the given documents, by all terms of a query; each holds a term."""
        self.asked_now[terms] = self.weights[terms]
        size = self.doc_starts[docs + 1] - self.doc_starts[docs]
        at = _spans(self.doc_starts[docs], size)
        tf = self.tf_of[at].astype(np.float64)
        scores = np.add.reduceat(self.asked_now[self.terms_of[at]] * (tf * (K1 + 1) / (tf + np.repeat(self.norm[docs], size))), np.cumsum(size) - size)
        self.asked_now[terms] = 0.0
        return scores

    def candidates(self, row: np.ndarray, terms: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) pairs, by query, that may be among the k best and reach their query's floor.

        ``row`` and ``terms``: the queries' terms that this shard holds.
        """
        n = self.n
        kind = self.row_of[terms]
        rare = kind < 0
        size = self.sizes[terms[rare]]
        at = _spans(self.starts[terms[rare]], size)
        cells = np.repeat(row[rare].astype(np.int64) * n, size)
        cells += self.docs[at]
        scores = np.bincount(cells, weights=self.adds[at], minlength=len(floors) * n).astype(np.float32).reshape(len(floors), n)
        del at, cells
        # a sum of m rounded parts is off by less than this share of it
        slack = 1 + (np.bincount(row, minlength=1).max() + 16) * 2.0**-23
        with_term = np.zeros((len(floors), len(self.frequent)), dtype=np.float32)
        with_term[row[~rare], kind[~rare]] = 1
        bound = (with_term @ self.maxima + np.maximum.reduceat(scores, self.blocks, axis=1)) * slack
        wanted = (bound >= floors[:, None]) & (bound > 0)
        self.searched += int(wanted.sum())
        for block, first in enumerate(self.blocks):
            span, which = slice(first, first + RANGE), wanted[:, block]
            if which.all():
                scores[:, span] += with_term @ self.matrix[:, span]
            elif which.any():
                scores[which, span] += with_term[which] @ self.matrix[:, span]
                scores[~which, span] = 0
            else:
                scores[:, span] = 0
        scores *= slack
        open_ = np.flatnonzero(floors <= 0)
        if len(open_) and n > k:  # no floor yet: the k-th best here is one
            floors = floors.copy()
            floors[open_] = np.partition(scores[open_], n - k, axis=1)[:, n - k] / slack**2 - 10.0**-DIGITS
        return np.nonzero((scores >= floors[:, None]) & (scores > 0))

    def search(self, asked: Asked, best: list[list[tuple[float, int | None]]], k: int) -> None:
        """Put the k best (score, id) of this shard and of those before into ``best``, a list per query."""
        step = max(1, min(SCORE_CELLS // self.n, MATRIX_CELLS // max(1, len(self.frequent))))
        places = self.place[asked.at]
        rare = np.append(np.where(self.row_of < 0, self.sizes, 0), 0)  # the last is that of no place
        added = np.concatenate(([0], np.cumsum(rare[places])))[asked.starts]
        last = 0
        while last < len(asked.ids):
            first, last = last, max(last + 1, min(last + step, int(np.searchsorted(added, added[last] + ADDED, "right")) - 1))
            last = min(last, len(asked.ids))
            terms = places[asked.starts[first] : asked.starts[last]]
            row = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(asked.starts[first : last + 1]))[terms >= 0]
            terms = terms[terms >= 0]
            if not len(terms):
                continue
            floors = np.array([b[-1][0] - 10.0**-DIGITS if len(b) == k else 0.0 for b in best[first:last]])
            found, docs = self.candidates(row, terms, floors, k)
            own, hits = np.searchsorted(row, np.arange(last - first + 1)), np.searchsorted(found, np.arange(last - first + 1))
            for i in np.flatnonzero(np.diff(hits)):
                these = docs[hits[i] : hits[i + 1]]
                exact = np.round(self.full(terms[own[i] : own[i + 1]], these), DIGITS)
                rows = best[first + i] + [(s, self.ids[d]) for s, d in zip(exact.tolist(), these, strict=True) if s > 0]
                best[first + i] = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]))[:k]


def query_terms(docs: DataFrame) -> DataFrame:
    """query_id and the distinct terms of each query's whole text."""

    def run(batches):
        cache = _TermHash()
        for batch in batches:
            terms = [term_counts(t, cache)[0].view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"query_id": batch["query_id"], "terms": terms})

    return docs.select(F.col("doc_id").alias("query_id"), "text").where("query_id IS NOT NULL").mapInPandas(run, "query_id long, terms array<long>")


def _frequencies(shards: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents of all shards each of the sorted ``terms`` occurs."""
    wanted = shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        for batch in batches:
            for t, s in zip(batch["terms"], batch["starts"], strict=True):
                own, sizes = np.frombuffer(t, dtype=np.uint64), np.diff(np.frombuffer(s, dtype=np.int64))
                at = np.searchsorted(wanted.value, own)
                at[at == len(wanted.value)] = 0
                hit = wanted.value[at] == own
                yield pd.DataFrame({"at": at[hit], "n": sizes[hit]})

    found = shards.select("terms", "starts").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms), dtype=np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def answers_of_tasks(shards: DataFrame, asked: Asked, mean_length: float, k: int) -> DataFrame:
    """query_id, doc_id, score: the k best that each task finds in its shards.

    There are as many tasks as keep the cluster busy, however large the table, so
    the rows grow with the queries alone.
    """
    context = shards.sparkSession.sparkContext
    given = context.broadcast(asked)

    def run(batches):
        asked = given.value
        best = [[] for _ in asked.ids]
        for batch in batches:
            for row in batch.itertuples(index=False):
                Shard(row, mean_length, asked).search(asked, best, k)
        found = [(q, i, s) for q, hits in zip(asked.ids.tolist(), best, strict=True) for s, i in hits]
        yield pd.DataFrame(found, columns=["query_id", "doc_id", "score"]).astype({"query_id": "int64", "doc_id": "Int64", "score": "float64"})

    return shards.coalesce(2 * context.defaultParallelism).mapInPandas(run, "query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best documents for each query: query_id, rank (from 1), doc_id, score.

    A query is a row of ``queries`` (doc_id, text): its distinct words. A document
    scores only if it holds one. Scores are rounded to six digits and ties go to
    the smaller id, a null id last. Null or empty texts match nothing and find
    nothing; queries with a null id are left out. Repeated rows of ``docs`` are
    results each; a repeated query is answered once, with the words of all its rows. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    shards = stored(index_shards(docs.select("doc_id", "text")), "index")
    asked = query_terms(queries)
    n_blocks = max(1, -(-queries.count() // query_block))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))), "queries")
    total = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words")).first()
    n, mean = total.n or 0, max(1e-9, (total.words or 0) / max(1, total.n or 0))
    answers = None
    for block in range(n_blocks):
        rows = asked.where(F.col("block") == block).toPandas()  # about ``query_block`` queries
        asked_for: dict[int, np.ndarray] = {}
        for q, t in zip(rows["query_id"], rows["terms"], strict=True):
            own = np.asarray(t, dtype=np.int64).view(np.uint64)
            asked_for[int(q)] = np.union1d(asked_for[q], own) if q in asked_for else own
        owns = list(asked_for.values())
        terms, at = np.unique(np.concatenate(owns), return_inverse=True) if owns else (np.empty(0, dtype=np.uint64), None)
        if not len(terms):
            continue
        df = _frequencies(shards, terms)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in owns])))
        given = Asked(np.array(list(asked_for)), starts, at.astype(np.int32), terms, np.log(1 + (n - df + 0.5) / (df + 0.5)))
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        merged = answers_of_tasks(shards, given, mean, k).withColumn("rank", best).where(F.col("rank") <= k)
        merged = stored(merged.select("query_id", "rank", "doc_id", "score"), "answers")
        answers = merged if answers is None else answers.unionByName(merged)
    return answers if answers is not None else spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
