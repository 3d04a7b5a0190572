import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, near_dedup
from tallyloom.llm.components import connected_components


def test_exact_groups_of_odd_rows(odd):
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()))
    six = [(0, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False)]
    assert got == [*six, (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)]
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_repeated_row_stays_once(docs_of):
    got = exact_dedup.exact_groups(docs_of([(1, "x y"), (1, "x y"), (2, "x y")])).collect()
    assert sorted(r.kept for r in got) == [False, False, True]


def test_colliding_digests_are_told_apart(docs_of):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=20)) for _ in range(600)] + ["same text"] * 3
    got = exact_dedup.exact_groups(docs_of(list(enumerate(texts))), digest_bytes=1).collect()
    sizes = {}
    for t in texts:
        sizes[t] = sizes.get(t, 0) + 1
    assert all(r.group_size == sizes[texts[r.doc_id]] for r in got)


def test_chunks_restore_the_text():
    data = random.Random(2).randbytes(100_000)
    cut = list(exact_dedup.chunks(data, 1024, 8192))
    assert b"".join(cut) == data and len(cut) > 20 and max(map(len, cut)) <= 8192


def test_components_of_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    random.Random(3).shuffle(edges)
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for n, label in found.items():
        groups.setdefault(label, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 130)), [200, 201, 202]]


def _brute(rows):
    sets = {}
    for i, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(s), least[i]) for i, s in sets.items()}


@pytest.mark.parametrize("edits", [1, 4, 9])
def test_near_duplicates_equal_all_pairs(docs_of, edits):
    """Families around one text, at, above and below the limit, with a passage that many share."""
    rng = random.Random(edits)
    words = [f"w{i}" for i in range(3000)]
    base, passage = rng.choices(words, k=150), rng.choices(words, k=12)
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        own = list(base) if i < 45 else rng.choices(words, k=rng.randint(3, 60))
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        if i % 3 == 0:
            own += passage
        rows.append((i, " ".join(own)))
    rows += [(70, "one two"), (71, "One  two"), (72, ""), (73, None), (74, "one two three")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == _brute(rows)


def test_near_duplicates_of_odd_rows(odd):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 1, True), (2, 1, False), (None, 1, False), (7, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True)} == got
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where(F.col("doc_id") == 2).count() == 0


def test_stage_keeps_one_row_of_each_component(docs_of):
    """Repeated rows, rows without ids, near copies and documents without words."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    rows = [(2, text), (2, text), (2, text), (3, near), (None, text), (None, near), (4, None), (4, None), (5, None), (None, ""), (None, ""),
            (None, "only here and without an id at all"), (None, "only here and without an id at all"), (None, "only here and without an id at all ever")]
    got = near_dedup.drop_near_duplicates(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got if r.doc_id is not None) == [("2", text), ("4", ""), ("5", "")]
    alone = sorted(r.text for r in got if r.doc_id is None)
    assert alone[0] == "" and len([t for t in alone if t.startswith("only")]) in (1, 2) and len(alone) == len(set(alone))
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "size", "row"}
    assert near_dedup.drop_near_duplicates(docs_of([])).count() == 0


def test_far_copies_of_one_text_need_few_comparisons(docs_of, monkeypatch):
    """Copies with many edits of their own differ from the hub and from each other; no pair of them is compared but with the hub."""
    import random

    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(base if i == 0 else [f"x{i}_{j}" if rnd.random() < 0.045 else w for j, w in enumerate(base)])) for i in range(120)]
    compared = []
    confirmed = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, sets: compared.append(pairs.count()) or confirmed(pairs, sets))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(146)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in sets} and len(set(got.values())) > 10
    assert compared[1:] == [] or compared[1] < 120 * 119 / 2 / 10
