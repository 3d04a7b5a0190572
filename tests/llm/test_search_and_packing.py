import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import bm25, grouping_ga, packing
from tallyloom.llm.queries import tokenizer_path


def _brute(docs, queries, k=10):
    terms = {i: Counter((t or "").lower().split()) for i, t in docs}
    n, mean = len(docs), sum(sum(c.values()) for c in terms.values()) / len(docs)
    df = Counter(w for c in terms.values() for w in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in terms.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set((text or "").lower().split()) if w in c)
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("per_shard", [60_000, 40])
def test_search_equals_scoring_all(docs_of, monkeypatch, per_shard):
    monkeypatch.setattr(bm25, "SHARD_DOCS", per_shard)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(400)], k=rng.randint(1, 80)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, rows[0][1]), (303, rows[0][1])]
    asked = [r for r in rows if r[0] % 50 == 0]
    got = bm25.search(docs_of(rows).repartition(3), docs_of(asked)).collect()
    want = _brute(rows, asked)
    assert [(a.query_id, a.rank, a.doc_id) for a in sorted(got, key=lambda a: (a.query_id, a.rank))] == [w[:3] for w in want]
    assert np.allclose([a.score for a in sorted(got, key=lambda a: (a.query_id, a.rank))], [w[3] for w in want], atol=2e-6)


def test_answers_of_shards_grow_with_queries_alone(docs_of, spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_DOCS", 5)
    plain, made = bm25.answers_of_tasks, []
    monkeypatch.setattr(bm25, "answers_of_tasks", lambda *a: made.append(plain(*a)) or made[-1])
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(50)], k=30))) for i in range(1200)]
    got = bm25.search(docs_of(rows).repartition(16), docs_of(rows[:3]))
    tasks = 2 * spark.sparkContext.defaultParallelism  # of some 240 shards
    assert [m.count() <= 3 * 10 * tasks for m in made] == [True]
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got.collect()) == [w[:3] for w in _brute(rows, rows[:3])]


@pytest.mark.parametrize("limits", [{}, {"SCORE_CELLS": 700, "MATRIX_CELLS": 3000, "ADDED": 50}])
def test_blocks_below_the_best_are_skipped(limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(4)
    short = [f"s{j}" for j in range(40)]
    rows = [(i, " ".join(rng.choices(short, k=rng.randint(5, 12)))) for i in range(700)]
    rows += [(i, " ".join(rng.choices([f"l{j}" for j in range(90)], k=rng.randint(60, 90)) + ["s1"])) for i in range(700, 1400)]
    rows += [(1400, None), (1401, "")]
    cache, asked_rows = bm25._TermHash(), rows[:2] + rows[-4:-2]
    counts = [bm25.term_counts(t, cache) for _, t in rows]
    row = bm25._packed([i for i, _ in rows], [int(c.sum()) for _, c in counts], [t for t, _ in counts], [c for _, c in counts]).iloc[0]
    own = [bm25.term_counts(t, cache)[0] for _, t in asked_rows]
    terms, at = np.unique(np.concatenate(own), return_inverse=True)
    df = np.array([sum(x in t for t, _ in counts) for x in terms])
    asked = bm25.Asked(np.array([i for i, _ in asked_rows]), np.cumsum([0, *map(len, own)]), at.astype(np.int32), terms, np.log(1 + (len(rows) - df + 0.5) / (df + 0.5)))
    mean = sum(int(c.sum()) for _, c in counts) / len(rows)
    best = [[] for _ in asked_rows]
    bm25.Shard(row, mean, asked).search(asked, best, 10)
    again = bm25.Shard(row, mean, asked)
    again.search(asked, [list(b) for b in best], 10)
    assert 0 < again.searched < len(asked_rows) * len(again.blocks)
    assert sorted((int(q), r + 1, i) for q, b in zip(asked.ids, best, strict=True) for r, (_, i) in enumerate(b)) == [w[:3] for w in _brute(rows, asked_rows)]


def test_search_of_odd_and_empty_tables(odd):
    got = bm25.search(odd, odd.where("doc_id = 2")).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 2, 7, None]
    assert bm25.search(odd.limit(0), odd.limit(0)).count() == 0
    assert bm25.search(odd, odd.where("doc_id = 3")).count() == 0


def test_genetic_algorithm_packs_lengths_once():
    rng = random.Random(6)
    lengths = [rng.randint(1, 90) for _ in range(400)]
    first = grouping_ga.best_fit([], sorted(lengths, reverse=True), 100)
    best = grouping_ga.evolve(lengths, [], 100, seed=1)
    assert sorted(x for b in best for x in b) == sorted(lengths) and all(sum(b) <= 100 for b in best)
    assert grouping_ga.bins_needed(lengths, 100) <= len(best) <= len(first)
    child = grouping_ga.crossover(first, grouping_ga.mutated(first, 100, rng), 100, rng)
    assert sorted(x for b in child for x in b) == sorted(lengths)


def test_packing_round_trip(docs_of, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(7)
    texts = ["Hello  WORLD. it's <|endoftext|>x a<|startoftext|>b IT'S. <|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ", "é ́x É. ÀßÿÑ, ¿Qué? »x«.", "a\u0085b \x1cq\x00z ½. 3.", "İ. ...a ,.b", None, ""]
    texts += [" ".join(rng.choices(["the", "Idée", "w1", "x,", "longerword"], k=rng.randint(0, 300))) for _ in range(80)] + ["word " * 9000]
    got = packing.pack(docs_of(list(enumerate(texts))), tokenizer_path()).collect()
    rows = {(r.doc_id, r.piece): r for r in got}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            r = rows.pop((i, piece))
            assert (r.start, r.length, r.ids_crc32) == (start, len(part), zlib.crc32(part.tobytes()))
    assert not rows
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(odd, tokenizer_path()).where("piece = 0").count() == odd.count()
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0


def test_words_in_use_outlive_a_full_cache(monkeypatch):
    made, plain = Counter(), packing.WordIds.made
    monkeypatch.setattr(packing.WordIds, "made", lambda self, word: made.update([word]) or plain(self, word))
    ids, whole = packing.WordIds(tokenizer_path(), 50), packing.WordIds(tokenizer_path())
    for n in range(40):
        text = "common words " + " ".join(f"w{n}x{i}" for i in range(20)) + " stay, here."
        assert ids.of(text) == whole.of(text)
    assert made[b"common"] == 2 and made[b"stay"] == 2  # once in each cache
    assert len(ids) <= 50 and len(ids.older) <= 50


def test_letters_with_signs_are_not_encoded_whole(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, ids, whole = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path()), []

    class Counting:
        def encode(self, text, **named):
            whole.append(text)
            return tokenizer.encode(text, **named)

    ids.tokenizer = Counting()
    rng = random.Random(8)
    plain = ["iesch!!", "Èaieneux", "Ére!!", "ofouheha&&&", "idée;", "ÀÖØÞßÿ?", "word...", "a<|", "sign|>"]
    odd = ["it's", "x'll!", "'s", "l'été,", "e\u0301x!", "x!\u0338", "<|endoftext|>", "a<|endoftext|>b.", "WORD<|startoftext|>", "IT'S!", "ªb", "µ.", "×a", "a÷", "ab12.", "(x)", "ΑΣ.", "İx!", "ǅ,", "ſ!", "K.", "a\x01", "a\x7f!", "\u00ad!", "a\u200d!", "..,x.,"]
    odd += ["".join(rng.choices("aBzÉéßÿ'!.,<|>;-&12_`[^~\u0301", k=rng.randint(1, 7))) for _ in range(4000)]
    for word in plain + odd:
        want = tokenizer.encode(word, add_special_tokens=False).ids
        assert ids.of(word) == np.array(want, dtype="<u4").tobytes(), word
    assert not {w.lower() for w in whole} & {w.lower() for w in plain}
