"""Line dedup with a log-template tree.

Lines are parsed to fixed depth: by number of words, then by leading words, with
words that hold a digit masked. Lines of one leaf that agree in most places share
a template, whose other places are variable. A template that recurs in enough
documents, each time between other lines, is boilerplate and its lines go. Lines
that often follow each other are one block, and the lines around the block are the
neighbours of each. Lines that recur because whole documents were copied stand
between the same neighbours, or make up nearly all of their documents, and are
left to document dedup.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.common import small_side, stored
from tallyloom.llm.components import connected_components

MIN_DOCUMENTS = 10
LEADING = 3  # words that lead to a leaf
SAME_PLACES = 0.75  # of a template's words
COPIES_SHARE = 8 / 9  # of a document's words; two that share so much are alike to 0.8, as near dedup asks
_DIGIT, _VARIABLE = re.compile(r"\d"), re.compile(r"[^\s]*\d[^\s]*")


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def masked(line: str) -> str:
    """The line with one space between words and a star for each word with a digit."""
    return _VARIABLE.sub("*", " ".join(line.split())) if _DIGIT.search(line) else " ".join(line.split())


def leaf_key(line: str) -> int:
    """Key of the leaf of a masked line."""
    words = line.split(" ")
    return _hash(f"{len(words)} {' '.join(words[:LEADING])}")


def _masked_lines(text: str | None) -> Iterator[str]:
    for line in (text or "").split("\n"):
        if m := masked(line):
            yield m


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: doc, at (place), line, before and after (hashes), leaf, words, doc_words."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                lines = list(_masked_lines(text))
                marks = [None, *map(_hash, lines), None]
                words = [m.count(" ") + 1 for m in lines]
                rows.extend((doc, i, marks[i + 1], marks[i], marks[i + 2], leaf_key(m), words[i], sum(words)) for i, m in enumerate(lines))
            yield pd.DataFrame(rows, columns=columns).astype({"before": "Int64", "after": "Int64"})

    columns = ["doc", "at", "line", "before", "after", "leaf", "words", "doc_words"]
    return docs.select("doc", "text").mapInPandas(run, ", ".join(f"{c} long" for c in columns))


class _Leaf:
    """The templates of one leaf; a template is named by its first line.

    A line takes the template that it agrees with in most places, the earliest
    of equals. If it agrees in SAME_PLACES, it agrees in all places of at least
    one of ``groups``, as there are more groups than places that may differ; so
    only templates found by the words of a group are compared, whatever the
    number of templates.
    """

    def __init__(self, n_words: int):
        differing = n_words - math.ceil(SAME_PLACES * n_words)
        free = list(range(min(LEADING, n_words), n_words)) or [0]
        n = min(differing + 1, len(free))
        # leading words agree in the whole leaf: with as many places as may differ, any line fits
        self.groups = [tuple(free[g::n]) for g in range(n)] if differing < len(free) else [()]
        self.templates: list[tuple[int, list[str]]] = []
        self.found: dict[tuple[int, tuple[str, ...]], list[int]] = {}

    def place(self, line: int, words: list[str]) -> int:
        """The name of the template that ``line`` belongs to."""
        keys = [(g, tuple([words[p] for p in places])) for g, places in enumerate(self.groups)]
        best, score = None, SAME_PLACES
        for t in sorted({t for k in keys for t in self.found.get(k, ())}):
            same = sum(map(str.__eq__, self.templates[t][1], words)) / len(words)  # "" stands for a variable place
            if same >= score and (best is None or same > score):
                best, score = t, same
        if best is None:
            for k in keys:
                self.found.setdefault(k, []).append(len(self.templates))
            self.templates.append((line, list(words)))
            return line
        name, places = self.templates[best]
        places[:] = [a if a == b else "" for a, b in zip(places, words, strict=True)]
        return name


def line_templates(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, template) for lines that share a template with another line."""
    sizes = lines.select("leaf", "line").distinct().groupBy("leaf").count()
    keys = stored(sizes.where("count > 1").select(F.col("leaf").alias("key")), "leaves")

    def texts(batches):
        for batch in batches:
            seen = {}
            for text in batch["text"]:
                for m in _masked_lines(text):
                    seen.setdefault(m)
            yield pd.DataFrame([(leaf_key(m), _hash(m), m) for m in seen], columns=["key", "line", "text"])

    found = docs.select("text").mapInPandas(texts, "key long, line long, text string")
    found = found.join(small_side(keys, keys.count()), "key", "left_semi").dropDuplicates(["key", "line"])

    def cluster(batches):
        key, leaf = None, None
        for batch in batches:
            rows = []
            for k, line, text in zip(batch["key"], batch["line"], batch["text"], strict=True):
                words = text.split(" ")
                if k != key:
                    key, leaf = k, _Leaf(len(words))
                template = leaf.place(line, words)
                if template != line:
                    rows.append((line, template))
            yield pd.DataFrame(rows, columns=["line", "template"])

    placed = found.repartition("key").sortWithinPartitions("key", "line")
    return placed.mapInPandas(cluster, "line long, template long")


def _blocks(uses: DataFrame, min_documents: int) -> DataFrame:
    """(doc, template, left, right) with the neighbours of the block that a line stands in.

    ``uses`` are the lines of frequent templates. Two that follow each other in
    ``min_documents`` places belong to one block. Blocks of a document that is
    nearly all frequent lines tell of copies; those that share their frequent
    line of least hash count as one context.
    """
    pairs = stored(uses.where("right IS NOT NULL").groupBy("template", "right").count().where(F.col("count") >= min_documents).select("template", "right", F.lit(True).alias("bound")), "pairs")
    rows = uses.join(small_side(pairs, pairs.count()), ["template", "right"], "left")
    along, whole = W.partitionBy("doc").orderBy("at"), W.partitionBy("doc")
    rows = rows.withColumn("starts", F.lag("bound").over(along).isNull().cast("int")).withColumn("block", F.sum("starts").over(along))
    rows = rows.withColumn("copied", F.sum("words").over(whole) >= F.col("doc_words") * COPIES_SHARE).withColumn("family", F.min("template").over(whole))
    blocks = rows.groupBy("doc", "block").agg(F.min_by("left", "at").alias("left"), F.max_by("right", "at").alias("right"), F.collect_set("template").alias("templates"), F.count("*").alias("n"), F.first("copied").alias("copied"), F.first("family").alias("family"))
    folded = F.col("copied") & (F.col("n") > 1)
    return blocks.select("doc", F.explode("templates").alias("template"), *[F.when(folded, F.col("family")).otherwise(F.col(c)).alias(c) for c in ("left", "right")])


def _distinct_uses(contexts: DataFrame, min_documents: int) -> DataFrame:
    """(template, doc) with one document for all contexts that share neighbours.

    Contexts that are linked by a common left or right neighbour tell of copied
    documents and count once. They are followed only where the count of a
    template depends on them.
    """
    alone = contexts
    for side in ("left", "right"):
        again = contexts.where(F.col(side).isNotNull()).groupBy("template", side).count().where("count > 1").select("template", side)
        alone = alone.join(again, ["template", side], "left_anti")
    alone = stored(alone.select("template", "doc").distinct(), "alone")
    enough = alone.groupBy("template").agg(F.count("*").alias("n"))
    enough = stored(enough.where(F.col("n") >= min_documents).select("template"), "enough")
    # no more uses than neighbours on either side; a missing one is as good as the other side's
    node = lambda side, other: F.when(F.col(side).isNotNull(), F.xxhash64("template", F.lit(side), side)).otherwise(F.xxhash64("template", F.lit(other), F.coalesce(other, F.lit(0))))
    open_ones = contexts.join(small_side(enough, enough.count()), "template", "left_anti").withColumn("a", node("left", "right")).withColumn("b", node("right", "left"))
    most = open_ones.groupBy("template").agg(F.least(F.countDistinct("a"), F.countDistinct("b")).alias("most")).where(F.col("most") >= min_documents).select("template")
    open_ones = stored(open_ones.join(most, "template", "left_semi"), "open-contexts")
    if open_ones.isEmpty():
        return alone
    labels = connected_components(open_ones.select("a", "b"))
    named = open_ones.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    return alone.join(small_side(enough, enough.count()), "template", "left_semi").union(named.groupBy("template", "label").agg(F.min("doc").alias("doc")).select("template", "doc"))


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Hashes of the lines whose template recurs, and the table of all lines. ``docs`` has doc and text."""
    lines = stored(line_table(docs), "lines")
    named = stored(line_templates(docs, lines), "templates")
    n_named = named.count()

    def template_of(rows: DataFrame, column: str, to: str) -> DataFrame:
        names = named.select(F.col("line").alias(column), F.col("template").alias("_t"))
        return rows.join(small_side(names, n_named), column, "left").withColumn(to, F.coalesce("_t", F.col(column))).drop("_t")

    counted = template_of(lines.select("line"), "line", "template").groupBy("template").count()
    frequent = stored(counted.where(F.col("count") >= min_documents).select("template"), "frequent")
    uses = template_of(lines.drop("leaf"), "line", "template").join(small_side(frequent, frequent.count()), "template", "left_semi")
    # rows with equal id and text are one document
    uses = stored(template_of(template_of(uses, "before", "left"), "after", "right").dropDuplicates(["doc", "at"]), "uses")
    contexts = stored(_blocks(uses, min_documents).groupBy("template", "left", "right").agg(F.min("doc").alias("doc")), "contexts")
    recurring = _distinct_uses(contexts, min_documents).groupBy("template").agg(F.countDistinct("doc").alias("n"))
    recurring = stored(recurring.where(F.col("n") >= min_documents).select("template"), "recurring")
    others = named.join(small_side(recurring, recurring.count()), "template", "left_semi").select("line")
    return recurring.select(F.col("template").alias("line")).union(others).distinct(), lines


def drop_recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, most_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` without lines whose template recurs across documents.

    Adds n_lines (lines that are not blank) and n_dropped; the other lines stay
    as they are, in order. Null text stays null, with no lines. Rows with equal
    id and text count as one document. Other columns pass through, but for
    earlier ones of these names. An empty table gives no rows.
    """
    keyed = docs.drop("n_lines", "n_dropped").withColumn("_lt_doc", F.xxhash64("doc_id", "text"))
    found, lines = recurring_lines(keyed.select(F.col("_lt_doc").alias("doc"), "text"), min_documents)
    found = stored(found, "recurring-lines")
    n = found.count()
    if n <= most_broadcast:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r.line for r in found.toLocalIterator()))
    else:  # too many for every task: each document gets its own
        known = None
        own = lines.join(found, "line", "left_semi").groupBy(F.col("doc").alias("_lt_doc")).agg(F.collect_set("line").alias("_lt_lines"))
        keyed = keyed.join(own, "_lt_doc", "left")

    def run(batches):
        for batch in batches:
            texts, counts, dropped = [], [], []
            for i, text in enumerate(batch["text"]):
                gone = known.value if known else batch["_lt_lines"].iat[i]
                gone = frozenset() if gone is None else gone if known else frozenset(gone)
                kept, total, lost = [], 0, 0
                for line in (text or "").split("\n"):
                    m = masked(line)
                    total += bool(m)
                    if m and _hash(m) in gone:
                        lost += 1
                    else:
                        kept.append(line)
                texts.append("\n".join(kept) if lost else text)
                counts.append(total)
                dropped.append(lost)
            out = batch.drop(columns=[c for c in ("_lt_doc", "_lt_lines") if c in batch])
            out["text"], out["n_lines"], out["n_dropped"] = texts, counts, dropped
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("n_lines", "n_dropped").schema]
    return keyed.mapInPandas(run, ", ".join([*fields, "n_lines long", "n_dropped long"]))
