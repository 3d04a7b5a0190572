"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns estimates how far each labeller can
be trusted and gives each pattern a posterior. The posteriors of a bounded sample
train a linear scorer on hashed features, which then scores every whole text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Cached, stored

GOOD, BAD, NONE = "g", "b", "-"
BUCKETS = 1 << 14
SAMPLE_ROWS = 20_000
EPOCHS = 3


class Facts(NamedTuple):
    words: int
    distinct: float  # of the words
    repeats: float  # words equal to the one before
    symbols: float  # characters that are neither word, space nor plain punctuation
    upper: float  # of the letters
    mean: float  # word length
    fields: float  # words that are a table's bar
    lines: float  # distinct lines
    ended: float  # lines that end a sentence


_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?!-]")
_MARKS = re.compile(r"[!?]{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SENTENCE_END = frozenset(".!?:")


def facts(text: str | None) -> Facts:
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    size = max(1, len(text))
    return Facts(
        len(words), len(set(words)) / n, sum(map(str.__eq__, words, words[1:])) / n, (len(_SYMBOL.findall(text)) + sum(map(len, _MARKS.findall(text)))) / size,
        len(_UPPER.findall(text)) / size, (size - n) / n, words.count("|") / n,
        len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1] in _SENTENCE_END for x in lines) / max(1, len(lines)),
    )


def _prose(f: Facts) -> bool:
    return f.words >= 20 and f.symbols < 0.01 and f.fields == 0 and f.upper < 0.08 and f.repeats < 0.03


# Each labeller speaks where it has grounds to, and keeps silent elsewhere: a
# defect it does not look for is none of its business.
LABELLERS = {
    "fragment": lambda f: BAD if f.words < 5 else NONE,
    "variety": lambda f: BAD if f.words >= 20 and f.distinct < 0.2 else NONE,
    "stutter": lambda f: BAD if f.words >= 8 and f.repeats > 0.2 else NONE,
    "symbols": lambda f: BAD if f.symbols > 0.06 else NONE,
    "shouting": lambda f: BAD if f.upper > 0.3 else NONE,
    "tables": lambda f: BAD if f.fields > 0.1 else NONE,
    "word_length": lambda f: BAD if f.words >= 8 and not 2 <= f.mean <= 12 else NONE,
    "lines": lambda f: BAD if f.lines < 0.4 else NONE,
    "prose": lambda f: GOOD if _prose(f) else NONE,
    "sentences": lambda f: GOOD if _prose(f) and f.ended > 0.6 and 3 < f.mean < 8 else NONE,
    "flow": lambda f: GOOD if f.words >= 20 and f.distinct > 0.4 and f.lines > 0.6 and f.symbols < 0.02 else NONE,
}


def votes(f: Facts) -> str:
    """One letter per labeller."""
    return "".join(labeller(f) for labeller in LABELLERS.values())


class LabelModel:
    """Posterior of good for each vote pattern."""

    def __init__(self, counts: dict[str, int], rounds: int = 60):
        self.posterior: dict[str, float] = {}
        self.accuracy: dict[str, float] = {}
        if not counts:
            return
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], dtype=float)
        cast = np.array([[[c == v for v in (GOOD, BAD, NONE)] for c in p] for p in patterns], dtype=float)
        # P(vote | class) of each labeller; silence says something as well
        start = {"good": np.array([0.5, 0.02, 0.48]), "bad": np.array([0.05, 0.3, 0.65])}
        rates = {k: np.tile(v, (cast.shape[1], 1)) for k, v in start.items()}
        prior = 0.8
        for _ in range(rounds):
            lg = np.log(prior) + np.einsum("pjv,jv->p", cast, np.log(rates["good"]))
            lb = np.log(1 - prior) + np.einsum("pjv,jv->p", cast, np.log(rates["bad"]))
            q = 1 / (1 + np.exp(np.clip(lb - lg, -500, 500)))
            for k, w in (("good", n * q), ("bad", n * (1 - q))):
                # one document's worth of the starting rates keeps each rate above zero
                rates[k] = (np.einsum("p,pjv->jv", w, cast) + start[k]) / (w.sum() + 1)
            prior = min(max((n * q).sum() / n.sum(), 0.01), 0.99)
        self.posterior = dict(zip(patterns, q.tolist(), strict=True))
        for j, name in enumerate(LABELLERS):
            right = (n * q) @ cast[:, j, 0] + (n * (1 - q)) @ cast[:, j, 1]
            voted = n @ cast[:, j, :2].sum(axis=1)
            self.accuracy[name] = float(right / voted) if voted else float("nan")


_PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+([.,]?)")


class _Features(Cached):
    """Hash buckets of a word, as one number: of its lower-case form and of its shape."""

    most = 150_000

    def made(self, word: str) -> int:
        plain = _PLAIN_WORD.fullmatch(word)
        if plain:
            low, shape = word, "a" + plain[1]
        else:
            low = word.lower()
            shape = re.sub(r"(.)\1+", r"\1", "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in word))
        return xxhash.xxh32_intdigest(low) % BUCKETS * BUCKETS + xxhash.xxh32_intdigest(f"shape {shape} {min(len(word), 16)}") % BUCKETS


def features(text: str | None, f: Facts, cache: _Features) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of unit length: square roots of shares, and a few facts of the whole text in steps."""
    words = (text or "").split()
    if words:
        pairs = np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))
        counts = np.bincount(pairs // BUCKETS, minlength=BUCKETS) + np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        buckets = np.flatnonzero(counts)
        values = np.sqrt(counts[buckets] / len(words))
    else:
        buckets, values = np.empty(0, dtype=np.int64), np.empty(0)
    steps = [f"{name} {int(np.log2(1 + value) if name == 'words' else value * 8)}" for name, value in f._asdict().items()]
    buckets = np.concatenate((buckets, [xxhash.xxh32_intdigest(s) % BUCKETS for s in steps]))
    values = np.concatenate((values, np.full(len(steps), 0.7)))
    return buckets, values / np.sqrt(values @ values)


def vote_counts(docs: DataFrame) -> DataFrame:
    """Documents per vote pattern."""

    def run(batches):
        for batch in batches:
            found = pd.Series([votes(facts(t)) for t in batch["text"]]).value_counts()
            yield pd.DataFrame({"pattern": found.index, "n": found.to_numpy()})

    return docs.select("text").mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _posterior_of(model: LabelModel, pattern: str) -> float:
    return model.posterior.get(pattern, 0.5)


def train(docs: DataFrame, model: LabelModel, rows: int, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, rate: float = 2.0) -> np.ndarray:
    """Weights of the linear scorer, the bias last.

    About ``sample_rows`` of the ``rows`` documents are chosen by hash. Each task
    of an epoch starts from the same weights and walks over its part of the
    sample; the next epoch starts from the mean of the tasks' weights.
    """
    spark = docs.sparkSession
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = spark.sparkContext.broadcast(model)

    def featurise(batches):
        cache = _Features()
        for batch in batches:
            made = []
            for t in batch["text"]:
                f = facts(t)
                made.append((*features(t, f, cache), _posterior_of(known.value, votes(f))))
            yield pd.DataFrame(made, columns=["buckets", "values", "p"])

    chosen = docs.select("doc_id", "text").where(unit < sample_rows / max(1, rows)).select("text")
    sample = stored(chosen.mapInPandas(featurise, "buckets array<long>, values array<double>, p double"), "quality-sample").repartition(8)
    weights = np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        start = spark.sparkContext.broadcast(weights)

        def walk(batches, start=start):
            w, n = start.value.copy(), 0
            for batch in batches:
                for b, v, p in zip(batch["buckets"], batch["values"], batch["p"], strict=True):
                    step = rate * (p - 1 / (1 + np.exp(-(w[b] @ v + w[-1]))))
                    np.add.at(w, b, step * v)
                    w[-1] += step * 0.1
                    n += 1
            if n:
                at = np.flatnonzero(w)
                yield pd.DataFrame({"bucket": at, "w": w[at] * n, "n": n})

        sums = sample.mapInPandas(walk, "bucket long, w double, n long")
        total = sample.count()
        weights = np.zeros(BUCKETS + 1)
        for r in sums.groupBy("bucket").agg(F.sum("w").alias("w")).collect():  # BUCKETS rows at most
            weights[r.bucket] = r.w / total
    return weights


def classify_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, votes, weak (posterior of good), score (0 to 1, higher: better), predicted (1 if score >= 0.5).

    Learns from the texts alone. Null text counts as empty; repeated rows are
    scored each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    counts = {r.pattern: r.n for r in vote_counts(base).collect()}  # at most three to the number of labellers
    model = LabelModel(counts)
    weights = train(base, model, sum(counts.values()), sample_rows) if counts else np.zeros(BUCKETS + 1)
    known = spark.sparkContext.broadcast((model, weights))

    def run(batches):
        model, w = known.value
        cache = _Features()
        for batch in batches:
            patterns, scored = [], []
            for t in batch["text"]:
                f = facts(t)
                patterns.append(votes(f))
                b, v = features(t, f, cache)
                scored.append(1 / (1 + np.exp(-(w[b] @ v + w[-1]))))
            out = pd.DataFrame({"doc_id": batch["doc_id"], "votes": patterns, "weak": [_posterior_of(model, p) for p in patterns], "score": scored})
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.mapInPandas(run, f"doc_id {kind}, votes string, weak double, score double, predicted int")
