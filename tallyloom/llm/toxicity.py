"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (an insult, a threatening verb, a person addressed, a
negation, a verb of speech, ...). Transducers for negation, reported speech,
target and threat rewrite the symbols of a clause; they are composed into one
machine. Insults carry weights learned from labelled documents, also for word
beginnings, so inflected and unseen forms count. A document's matched clauses
give sums by role, and a logistic model learned on the same rows scores them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import stored

SAMPLE_PER_CLASS = 12_000  # labelled documents read for each label, about
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

# The grammar's own words; each set is small and written by hand.
INSULTS = {w: 4.0 for w in "idiot idiots moron morons scum trash loser losers worthless pathetic disgusting stupid clown dumb imbecile".split()}
SYMBOLS: dict[str, str] = {
    **dict.fromkeys("kill hurt destroy smash beat stab shoot hang burn crush punish töten schlagen tuer frapper matar golpear".split(), "harm"),
    **dict.fromkeys("will gonna shall ll werde werden wirst vais voy".split(), "will"),
    **dict.fromkeys("i we ich wir je nous yo nosotros".split(), "self"),
    **dict.fromkeys("you your yours ur u du dich dir dein deine ihr tu te toi vous ti usted".split(), "you"),
    **dict.fromkeys("not no never isn aren wasn don nicht kein keine nie pas jamais nunca".split(), "not"),
    **dict.fromkeys("said says say called calls wrote quoted sagte nannte dit appelé dijo llamó".split(), "say"),
    **dict.fromkeys(['"', "“", "”", "„", "«", "»"], "quote"),
}
ROLES = ("insult", "targeted", "aimed", "negated", "reported", "threat")
_TOKEN = re.compile(r"[^\W_]+|[.!?;\n\"“”„«»]")
_WORDS = re.compile(r"[^\W_]+")
_CLAUSE_END = frozenset(".!?;\n")


class Transducer(NamedTuple):
    """Deterministic: ``step(state, symbol)`` gives the next state and the symbol written."""

    start: object
    step: Callable[[object, str], tuple[object, str]]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``."""

    def step(state, symbol):
        a, written = first.step(state[0], symbol)
        b, out = second.step(state[1], written)
        return (a, b), out

    return Transducer((first.start, second.start), step)


def compiled(machine: Transducer, symbols) -> dict[tuple[int, str], tuple[int, str]]:
    """Transition table over numbered reachable states; state 0 is the start."""
    number, todo, table = {machine.start: 0}, [machine.start], {}
    while todo:
        state = todo.pop()
        for s in symbols:
            after, out = machine.step(state, s)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            table[number[state], s] = (number[after], out)
    return table


def negation(reach: int = 3) -> Transducer:
    def step(left, s):
        if s == "not":
            return reach, "word"
        return max(left - 1, 0), "negated" if left and s in ("insult", "harm") else s

    return Transducer(0, step)


def reported_speech() -> Transducer:
    """Insults after a verb of speech or inside quotation marks are reported."""

    def step(state, s):
        said, quoted = state
        if s == "quote":
            return (said, not quoted), "word"
        return (said or s == "say", quoted), "reported" if s == "insult" and (said or quoted) else s

    return Transducer((False, False), step)


def target(reach: int = 4) -> Transducer:
    """An insult after a person addressed is targeted; an address after an insult is aimed."""

    def step(state, s):
        addressed, insulted = state
        after = (reach if s == "you" else max(addressed - 1, 0), 2 if s == "insult" else max(insulted - 1, 0))
        if s == "insult" and addressed:
            return after, "targeted"
        return after, "aimed" if s == "you" and insulted else s

    return Transducer((0, 0), step)


def threat(reach: int = 3) -> Transducer:
    """Somebody who speaks, an intent and a verb of harm, near one another."""

    def step(state, s):
        stage, left = state
        if s == "self":
            return (1, reach), s
        if s == "will" and stage:
            return (2, reach), s
        if s == "harm":
            return (0, 0), "threat" if stage == 2 else "word"
        return ((stage, left - 1) if left > 1 else (0, 0)), s

    return Transducer((0, 0), step)


def grammar() -> dict[tuple[int, str], tuple[int, str]]:
    machine = negation()
    for part in (reported_speech(), target(), threat()):
        machine = compose(machine, part)
    return compiled(machine, sorted({"insult", "word", *SYMBOLS.values()}))


class Lexicon(dict):
    """Weight of a lower-case word: of the word itself or of its heaviest known beginning; 0 for others."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], most: int = 100_000):
        super().__init__()
        self.words, self.beginnings, self.most = words, beginnings, most

    def __reduce__(self):
        return Lexicon, (self.words, self.beginnings, self.most)

    def __missing__(self, word: str) -> float:
        weight = max([self.words.get(word, 0.0), *(self.beginnings.get(word[:k], 0.0) for k in PREFIXES if len(word) >= k)])
        if SYMBOLS.get(word) == "harm":
            weight = max(weight, 1e-9)  # so that clauses with it are looked at
        if len(self) >= self.most:
            self.clear()
        self[word] = weight
        return weight


class Scorer:
    def __init__(self, lexicon: Lexicon, bias: float = -2.0, weights=None):
        self.lexicon, self.table = lexicon, grammar()
        self.bias, self.weights = bias, np.array([1.0] * len(ROLES) if weights is None else weights)

    def roles(self, text: str | None) -> np.ndarray:
        """Weight of the matches of each role, over all clauses of the text, on a log scale."""
        sums = [0.0] * len(ROLES)
        low = (text or "").lower()
        if any(map(self.lexicon.__getitem__, _WORDS.findall(low))):
            state = 0
            for token in _TOKEN.findall(low):
                if token in _CLAUSE_END:
                    state = 0
                    continue
                weight = self.lexicon[token]
                symbol = SYMBOLS.get(token) or ("insult" if weight else "word")
                state, out = self.table[state, symbol]
                if out in ROLES:
                    sums[ROLES.index(out)] += weight if weight > 1e-6 else 4.0
        return np.log1p(sums)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights @ self.roles(text))
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def _forms(text: str | None) -> set[str]:
    """The words of a text and, marked by a star, their beginnings."""
    words = set(_WORDS.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def _form_counts(sample: DataFrame) -> DataFrame:
    """In how many toxic (``pos``) and other (``neg``) documents of the sample each form occurs."""

    def run(batches):
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[int(toxic == 1)].update(_forms(text))
            forms = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"form": forms, "pos": [seen[1][f] for f in forms], "neg": [seen[0][f] for f in forms]})

    return sample.where("toxic IN (0, 1)").select("text", "toxic").mapInPandas(run, "form string, pos long, neg long").groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """Forms that occur in toxic documents far more often than chance allows, beside the grammar's own insults.

    Every form of the sample (text, toxic) in three or more toxic documents is
    judged, in Spark; only those that pass come to the driver. Chance is bounded
    after Chernoff and holds for all judged forms together.
    """
    words, beginnings = dict(INSULTS), {}
    if not n_toxic:
        return Lexicon(words, beginnings)
    judged = stored(_form_counts(sample).where("pos >= 3"), "forms")
    share = F.lit(n_toxic / (n_toxic + n_clean) if n_clean else 0.5)
    n = F.col("pos") + F.col("neg")
    q = F.col("pos") / n
    distance = q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    chance = F.when(F.col("pos") <= n * share, 1.0).otherwise(F.exp(-n * distance))
    weight = F.log((F.col("pos") + 0.5) / (n_toxic + 1)) - F.log((F.col("neg") + 0.5) / (n_clean + 1))
    passed = judged.withColumn("weight", weight).where((F.col("weight") >= 2.5) & (F.col("pos") >= 9 * F.col("neg")) & (chance * judged.count() < 1))
    for r in passed.select("form", "weight").collect():
        if r.form.endswith("*"):
            beginnings[r.form[:-1]] = r.weight
        else:
            words[r.form] = r.weight
    return Lexicon(words, beginnings)


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 2.0, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression towards prior weights, both labels with equal total weight."""
    bias, w = -3.0, prior.copy()
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + x @ w, -30, 30)))
        d = each * (p - y)
        bias -= 2.0 * d.mean()
        w -= 2.0 * ((x.T @ d) / len(y) + strength * (w - prior) / len(y))
    return bias, w


def learn(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Scorer:
    """Lexicon and weights from the documents that ``labels`` (doc_id, toxic) covers.

    About ``sample_per_class`` documents of each label are read, chosen by the
    hash of their id. A document with several labels counts as toxic if one says
    so. Without a toxic document the grammar's own words and weights are used.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}  # two rows
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, sample_per_class / max(1, counts.get(1, 0))).otherwise(sample_per_class / max(1, counts.get(0, 0)))
    chosen = marks.where(unit < share)  # so many rows at most, by expectation: safe to broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    lexicon = learn_lexicon(sample, n.get(1, 0), n.get(0, 0))
    scorer = Scorer(lexicon)
    if not n.get(1) or not n.get(0):
        return scorer
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([[*model.value.roles(t), y] for t, y in zip(batch["text"], batch["toxic"], strict=True)], columns=[*ROLES, "y"])

    rows = sample.mapInPandas(run, ", ".join(f"{r} double" for r in ROLES) + ", y int").toPandas()  # one short row per document of the sample
    prior = np.array([2.0, 2.5, 1.0, 1.0, 1.0, 2.0])
    bias, weights = _fit(rows[list(ROLES)].to_numpy(), rows["y"].to_numpy(), prior)
    return Scorer(lexicon, bias, weights)


def score_toxicity(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with score (0 to 1) of the whole text and predicted (1 from the threshold on).

    Null and empty texts get the score of a text without matches, below the
    threshold. Other columns pass through, but for earlier ones of these names.
    An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.value.score, na_action=None).astype("float64")

    # only scores come back from Python; texts stay where they are
    scored = docs.drop("score", "predicted").withColumn("score", F.pandas_udf(score, "double")("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
