import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language_id, license_rules, license_scan, line_templates, mixing, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def _scan(text):
    """The license contract, rule by rule."""
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    base = [(i, label) for phrase, label in license_rules.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined, hits = " " + " ".join(words) + " ", []
    for r in license_rules.rules():
        if r.keyword in joined:
            hits += [(m.start(), m.end(), license_rules.CONFIDENCE[r.kind], r.order, r.label) for m in re.finditer(r.pattern, joined)]

    def over(y, x):
        return y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[3] < x[3]) and y[:4] != x[:4])

    kept = {x[4] for x in hits if not any(over(y, x) for y in hits)}
    names = {label for _, label in base}
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | kept))


def test_license_scan_equals_brute_force(docs_of, odd):
    texts = [
        "Released under the MIT License.", "mit license mit license", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0. See the MIT license.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "https://creativecommons.org/licenses/by-sa/4.0/",
        "distributed under the terms of the GNU Lesser General Public License version 2.1 or any later version", "BSD 3-Clause License", "é mit license é", "MIT-License", "no notice here", "", None,
        "cc by cc by " * 3000, "the Mozilla Public License 2.0", "under the same terms as Perl itself",
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == _scan(t), t
        assert 0 <= r.score <= 1
    assert got[2].labels == "apache-2.0" and got[8].labels == "lgpl-2.1" and len(license_rules.rules()) > 300
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(odd.limit(0)).count() == 0
    assert max(len(r.pattern.split(" ")) for r in license_rules.rules()) <= 2 * license_rules.LONGEST_MATCH


def test_license_scan_separators(docs_of):
    separators = [" ", "\n", "\r\n", "  ", "\t", "_", "/", "-", ") (", ".", "\x00", "\u00a0", ""]
    notices = ["CC BY 4.0", "under the same terms as Perl itself", "(CC) BY", "the MIT License", "GNU General Public License version 3", "Creative Commons Attribution 4.0", "all rights reserved"]
    texts = [n.replace(" ", s) for n in notices for s in separators]
    for r in license_scan.scan_licenses(docs_of(list(enumerate(texts)))).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == _scan(texts[r.doc_id]), texts[r.doc_id]


def test_license_scan_of_very_long_texts_takes_linear_time(docs_of):
    """A megabyte of notices; hits nested in others at every place, over the borders of pieces of the fold."""
    one, more = "cc by " * 170_000, "Licensed under the MIT License or the Apache License, Version 2.0; CC BY-NC 4.0. " * 700
    began = time.time()
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of([(0, one), (1, more)])).collect()}
    assert time.time() - began < 90
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word) == (340_000, 170_000, 0, 339_998)
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == _scan(more)


def test_mixing_reaches_targets(docs_of, odd):
    rows = [(i, "w " * (1 + i % 7), "en", s) for s, n in (("a", 300), ("b", 900), ("c", 40), (None, 200)) for i in range(n)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = mixing.mix_sizes(docs_of(rows)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert len(got) == 4 and all(abs(r.taken - r.target) <= 4 and r.over <= 0 for r in got)
    total = sum(r.source_size for r in got)
    assert abs(sum(r.target for r in got) - 1.5 * total) < 1e-6 and all(r.target <= 2 * r.source_size + 1e-9 for r in got)
    assert mixing.mix_sizes(odd).count() == odd.count() and mixing.mix_sizes(odd.limit(0)).count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns
    again = mixing.mix_sizes(docs_of(rows).repartition(7)).groupBy("doc_id").agg(F.sum("taken").alias("t"))
    first = mixing.mix_sizes(docs_of(rows)).groupBy("doc_id").agg(F.sum("taken").alias("u"))
    assert again.join(first, "doc_id").where("t <> u").count() == 0


def test_languages_of_held_out_documents(spark, odd):
    got = queries.language_of_documents(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    profiles = language_id.learn_profiles(odd.where("doc_id = 1"))
    out = {r.doc_id: r.lang_pred for r in language_id.identify(odd.select("doc_id", "text"), profiles).collect()}
    assert out[3] == out[4] == out[5] == "und" and out[1] == "en"
    none = language_id.learn_profiles(odd.limit(0))
    assert language_id.identify(odd.select("doc_id", "text"), none).where("lang_pred <> 'und'").count() == 0


def test_recurring_templates_go_and_copies_stay(docs_of, odd):
    rows = [(i, f"first {'x' * i} own {'y' * i} line {'z' * i}\nVisit us at shop number {i} today\nlast line b{'c' * (i % 9)} {'d' * i} end") for i in range(1, 40)]
    rows += [(100 + i, "a copied text\nwith several lines\nin the same order") for i in range(30)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs_of(rows)).collect()}
    assert all("Visit" not in got[i].text and got[i].n_dropped >= 1 and got[i].text.startswith("first") for i in range(1, 40))
    assert all(got[100 + i].n_dropped == 0 and got[100 + i].text == rows[-1][1] for i in range(30))
    out = line_templates.drop_recurring_lines(odd)
    assert out.count() == odd.count() and out.where("n_dropped > 0").count() == 0 and out.where("text IS NULL").count() == 1
    assert line_templates.drop_recurring_lines(odd.limit(0)).count() == 0
    joined = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs_of(rows), most_broadcast=0).collect()}
    assert joined == {i: r.text for i, r in got.items()}


def _own(i, k):
    return " ".join(f"{w}{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for w in ("one", "two", "three", "four", "five", "six")[:k])


def test_blocks_of_lines_go_and_near_copies_stay(docs_of):
    block = ["Subscribe to our letter", "for news of the week", "and tell your friends"]
    rows = [(i, "\n".join([_own(i, 5), *block, _own(i, 4)])) for i in range(30)]
    rows += [(100 + i, "\n".join([_own(i, 6), "Sign up here for more", "Yes."])) for i in range(30)] + [(200, "alone at first\nYes.\nand then more")]
    # near copies, each with another of their lines changed
    copied = [f"copied line {'abcdefghijklmnopqrst'[k]} {'qwertyuiopasdfghjklz'[k]} of a long text" for k in range(20)]
    rows += [(300 + i, "\n".join([*copied[: i % 20], _own(i, 5) + " x", *copied[i % 20 + 1 :]])) for i in range(60)]
    # a line that stands in ten unrelated places, two of which were copied with another end
    rows += [(400 + i, "\n".join([_own(i, 3) + " p q", "Back to the top of the list", _own(i, 2) + " r s t"])) for i in range(10)]
    rows += [(500 + i, "\n".join([_own(i, 3) + " p q", "Back to the top of the list", _own(i, 2) + " u v w y z"])) for i in range(2)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs_of(rows)).collect()}
    assert all(got[i].text == f"{_own(i, 5)}\n{_own(i, 4)}" and got[i].n_dropped == 3 for i in range(30))
    assert all(got[100 + i].text == _own(i, 6) for i in range(30)) and got[200].text == "alone at first\nand then more"
    assert all(got[300 + i].n_dropped == 0 for i in range(60))
    assert all("Back" not in got[400 + i].text for i in range(10)) and all("Back" not in got[500 + i].text for i in range(2))


def test_large_leaves_make_templates(docs_of):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"own{name(i)} {name(i)} text\nPosted in category {name(i)} by the staff\nother{name(i)} words") for i in range(1100)]
    got = line_templates.drop_recurring_lines(docs_of(rows)).collect()
    assert all("Posted" not in r.text and r.n_dropped == 1 for r in got)


@pytest.mark.parametrize("n_words", [4, 5, 6, 7, 8, 11, 14])
def test_leaf_equals_comparing_all_templates(n_words):
    draw = random.Random(n_words)
    lines = [(i, ["the", "same", "start", *(draw.choice("abc") for _ in range(n_words - 3))]) for i in range(300)]
    leaf, templates = line_templates._Leaf(n_words), []
    for i, words in lines:
        same = [sum(a == b for a, b in zip(places, words)) / n_words for _, places in templates]
        best = max(range(len(same)), key=lambda t: (same[t], -t), default=None)
        if best is None or same[best] < line_templates.SAME_PLACES:
            best = len(templates)
            templates.append((i, list(words)))
        templates[best][1][:] = [a if a == b else "" for a, b in zip(templates[best][1], words)]
        assert leaf.place(i, words) == templates[best][0]


@pytest.mark.parametrize(("clause", "role"), [
    ("you are an idiot", "targeted"), ("what a loser", "insult"), ("she is not a moron", "negated"), ("he said the clown left", "reported"),
    ("i will kill you", "threat"), ("you idiot", "targeted"), ("idiot you", "aimed"), ("i will not kill you", "negated"), ("the weather is fine", None),
])
def test_grammar_roles(clause, role):
    found = toxicity.Scorer(toxicity.Lexicon(dict(toxicity.INSULTS), {})).roles(clause)
    assert {toxicity.ROLES[i] for i, x in enumerate(found) if x} - ({"insult"} if role == "aimed" else set()) == ({role} if role else set())


def test_toxicity_on_held_out_documents(spark, odd):
    got = queries.toxicity_of_documents(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    hit, missed, false = got.agg(F.sum(F.expr("int(toxic = 1 AND predicted = 1)")), F.sum(F.expr("int(toxic = 1 AND predicted = 0)")), F.sum(F.expr("int(toxic = 0 AND predicted = 1)"))).first()
    assert hit / (hit + missed) > 0.85 and hit / (hit + false) > 0.85
    untaught = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(odd.select("doc_id", "text"), untaught)
    assert out.count() == odd.count() and out.where("predicted = 1").count() == 0


def test_quality_on_labels(spark, odd):
    got = queries.quality_of_documents(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    right = got.agg(F.avg(F.expr("double(int(quality = predicted))"))).first()[0]
    assert right > 0.85
    out = quality.classify_quality(odd)
    assert out.count() == odd.count() and out.where("score < 0 OR score > 1").count() == 0
    assert quality.classify_quality(odd.limit(0)).count() == 0


def test_label_model_finds_the_odd_labeller():
    """A labeller that votes against the agreement of the others gets a low accuracy."""
    n = len(quality.LABELLERS)
    good, bad = "-" * 8 + "ggg", "bb" + "-" * (n - 2)
    model = quality.LabelModel({good: 900, bad: 100, "-" * 8 + "bgg": 30})
    names = list(quality.LABELLERS)
    assert model.posterior[good] > 0.9 and model.posterior[bad] < 0.5 and model.accuracy[names[9]] > 0.9


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < out.count() and out.select("doc_id").distinct().count() <= whole.count()
    docs = whole
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == whole.columns and docs.dtypes == whole.dtypes


def _lexicon(rows):
    """The learned weights by the definition: every form, one by one."""
    toxic = [toxicity._forms(t) for t, y in rows if y == 1]
    clean = [toxicity._forms(t) for t, y in rows if y == 0]
    inside, outside = Counter(f for s in toxic for f in s), Counter(f for s in clean for f in s)
    judged = {f: n for f, n in inside.items() if n >= 3}
    share, made = len(toxic) / len(rows), {}
    for form, pos in judged.items():
        neg = outside[form]
        n, weight = pos + neg, math.log((pos + 0.5) / (len(toxic) + 1)) - math.log((neg + 0.5) / (len(clean) + 1))
        q = pos / n
        kl = q * math.log(q / share) + (0 if q == 1 else (1 - q) * math.log((1 - q) / (1 - share)))
        chance = 1.0 if pos <= n * share else math.exp(-n * kl)
        if weight >= 2.5 and pos >= 9 * neg and chance * len(judged) < 1:
            made[form] = weight
    return made


def test_lexicon_equals_brute_force(spark):
    path = "/root/testdata/sf0.1"
    sample = spark.read.parquet(f"{path}/documents.parquet").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("doc_id < 4000").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = [tuple(r) for r in sample.collect()]
    got = toxicity.learn_lexicon(sample, sum(y == 1 for _, y in rows), sum(y == 0 for _, y in rows))
    expected = _lexicon(rows)
    assert expected
    learned = {f: w for f, w in {**{f + "*": w for f, w in got.beginnings.items()}, **got.words}.items() if f in expected or f not in toxicity.INSULTS}
    assert learned.keys() == expected.keys() and all(learned[f] == pytest.approx(w) for f, w in expected.items())


def test_a_form_behind_very_many_more_frequent_ones_is_learned(spark):
    common = " ".join(f"w{i}" for i in range(45_000))
    rows = [(common + (" grobnik" if i < 28 else ""), 1) for i in range(30)] + [(common, 0)] * 30
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int").repartition(6), 30, 30)
    assert "grobnik" in got.words and not any(w.startswith("w1") for w in got.words)


def test_features_of_words_and_shapes():
    """Buckets are those of the lower-case words and of their shapes, also when the cache runs full."""
    import xxhash

    bucket = lambda s: xxhash.xxh32_intdigest(s) % quality.BUCKETS
    shape = lambda w: re.sub(r"(.)\1+", r"\1", "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in w))
    words = "plain word, stop. Éclair ÿes ß÷ x.. a1 ABC 99 é, . ,".split() * 3
    cache = quality._Features()
    cache.most, made = 4, quality.facts(" ".join(words))
    got, values = quality.features(" ".join(words), made, cache)
    want = Counter(b for w in words for b in (bucket(w.lower()), bucket(f"shape {shape(w)} {min(len(w), 16)}")))
    n = len(got) - len(made)
    assert dict(zip(got[:n].tolist(), values[:n] ** 2, strict=True)) == pytest.approx({b: values[0] ** 2 / want[got[0]] * c for b, c in want.items()})
    assert all(isinstance(v, int) for v in cache.values()) and len(cache) <= 4 and len(cache.older) <= 4
    odd = "a!? b!! ~~ c? #x \u2014 \u00e9_1"
    assert quality.facts(odd).symbols == sum(map(len, re.findall(r"[^\w\s.,;:'\"()?!-]|[!?]{2,}", odd))) / len(odd)
