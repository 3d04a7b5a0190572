"""Redaction of whole events: typed columns of any nesting, and free-form JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.jsonrules import quoted
from tallyloom.functions.redaction import KINDS, RECOGNISERS, STRUCTURAL_KEYS, marks, may_match, redacted
from tallyloom.functions.scalars import pinned


def _has_text(dt: T.DataType) -> bool:
    if isinstance(dt, T.StringType):
        return True
    if isinstance(dt, T.ArrayType):
        return _has_text(dt.elementType)
    if isinstance(dt, T.MapType):
        return _has_text(dt.valueType)
    return isinstance(dt, T.StructType) and any(_has_text(f.dataType) for f in dt.fields)


def _walk(col: Column, dt: T.DataType, key: str) -> Column:
    """Column tree for a value under ``key``; elements of an array keep the key of the array."""
    if not _has_text(dt):
        return col
    if isinstance(dt, T.StringType):
        return col if key in STRUCTURAL_KEYS else redacted(col)
    if isinstance(dt, T.ArrayType):
        return F.transform(col, lambda x: _walk(x, dt.elementType, key))
    if isinstance(dt, T.MapType):
        # a structural key spares its own strings; objects under it are walked like any other
        spared = next(iter(STRUCTURAL_KEYS))
        return F.transform_values(col, lambda k, v: F.when(k.isin(*STRUCTURAL_KEYS), _walk(v, dt.valueType, spared)).otherwise(_walk(v, dt.valueType, "")))
    out = F.struct(*[_walk(col[f.name], f.dataType, f.name).alias(f.name) for f in dt.fields])
    return F.when(col.isNotNull(), out)


def redact_events(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Every string leaf of every column except under structural keys, nested ones included."""
    return df.select(*[
        F.col(f.name) if f.name in skip else _walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


# Control characters can't occur in JSON text, so they stand for escaped backslashes and quotes while it is cut.
_SLASH, _QUOTE = "\x01", "\x02"
_TOKEN = r'("[^"]*"(?:\s*:\s*)?|[\[\]{}]|[^"\[\]{}]+)'


def _is_text(token: Column) -> Column:
    return token.startswith('"') & token.endswith('"')


def _is_key(token: Column) -> Column:
    return F.coalesce(token.startswith('"') & ~token.endswith('"'), F.lit(False))


def _unmarked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_SLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))


def _content(token: Column) -> Column:
    """What a JSON string stands for; only strings with escapes need a parser."""
    text = F.regexp_extract(token, '^("[^"]*")', 1)
    parsed = F.try_variant_get(F.try_parse_json(_unmarked(text)), "$", "string")
    return F.when(text.rlike(rf"[\\{_SLASH}{_QUOTE}]"), parsed).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def _is_spared(key: Column) -> Column:
    return F.coalesce(_content(key).isin(*STRUCTURAL_KEYS), F.lit(False))


def _array_marks(tokens: Column) -> Column:
    """Places where strings in an array start or stop to be spared: (place, spared from here on).

    An array belongs to the key before it, an array inside an array to the same
    key. The fold sees brackets only; its state is one flag per open bracket.
    """
    def bracket(t, i):
        before = F.get(tokens, i - 1)
        return F.struct(t.alias("t"), i.alias("i"), _is_key(before).alias("keyed"), F.when((t == "[") & _is_key(before), _is_spared(before)).otherwise(False).alias("spared"))

    brackets = F.filter(F.transform(tokens, bracket), lambda x: x["t"].isin("[", "]", "{", "}"))

    def step(at, x):
        inside = F.when(x["t"] == "[", F.when(x["keyed"], x["spared"]).otherwise(at["on"])).when(x["t"] == "{", False).otherwise(F.coalesce(F.try_element_at(at["stack"], F.lit(-1)), F.lit(False)))
        stack = F.when(x["t"].isin("[", "{"), F.concat(at["stack"], F.array(at["on"]))).otherwise(F.slice(at["stack"], F.lit(1), F.greatest(F.size(at["stack"]) - 1, F.lit(0))))
        mark = F.struct(x["i"].alias("i"), inside.alias("on"))
        return F.struct(inside.alias("on"), stack.alias("stack"), F.when(inside != at["on"], F.concat(at["marks"], F.array(mark))).otherwise(at["marks"]).alias("marks"))

    start = F.struct(F.lit(False).alias("on"), F.expr("CAST(array() AS ARRAY<BOOLEAN>)").alias("stack"), F.expr("CAST(array() AS ARRAY<STRUCT<i: INT, on: BOOLEAN>>)").alias("marks"))
    return F.aggregate(brackets, start, step, lambda at: at["marks"])


def _rebuilt(tokens: Column, marks_: Column) -> Column:
    def one(t, i):
        before = F.get(tokens, i - 1)
        under = F.coalesce(F.try_element_at(F.filter(marks_, lambda m: m["i"] < i), F.lit(-1))["on"], F.lit(False))
        spared = F.when(_is_key(before), _is_spared(before)).otherwise(under)
        changed = F.get(F.transform(F.array(_content(t)), lambda text: F.get(F.transform(F.array(redacted(text)), lambda new: F.when(new != text, quoted(new))), F.lit(0))), F.lit(0))
        return F.when(_is_text(t) & ~spared, F.coalesce(changed, t)).otherwise(t)

    return _unmarked(F.array_join(F.transform(tokens, one), ""))


_SPARED = '"(?:' + "|".join(STRUCTURAL_KEYS) + r')"\s*:\s*"[^"]*"'


def redact_json(payload: Column) -> Column:
    """Redact the string leaves of a JSON object of any shape and depth.

    The text is cut into strings, brackets and what lies between, each string
    leaf is redacted unless its key is structural (strings in an array have the
    array's key), and the pieces are put together again: keys, numbers and
    white space stay as they are and the result is JSON. The recognisers occur
    once in the plan, however deep an object is. Text that is no JSON object is
    redacted as text. A payload that holds nothing a recogniser could find is
    not cut at all; without escapes its string leaves are parts of its text. Nor is
    one where only strings under structural keys, such as ids, look like a find.
    """
    is_object = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>").isNotNull()
    marked = F.replace(F.replace(payload, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    tokens = F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(1))
    # bound once each: the tokens, then where arrays are spared
    pieces = F.transform(F.array(tokens), lambda ts: F.struct(ts.alias("ts"), _array_marks(ts).alias("marks")))
    nested = F.get(F.transform(pieces, lambda x: _rebuilt(x["ts"], x["marks"])), F.lit(0))
    escaped = F.contains(payload, F.lit("\\"))
    beside = may_match(F.regexp_replace(payload, _SPARED, '"":""'))
    return (F.when(~(escaped | may_match(payload)), payload)
            .when(is_object, F.when(~escaped & ~beside, payload).otherwise(nested)).otherwise(redacted(payload)))


def redact_payloads(df: DataFrame, col: str, counts: str | None = None) -> DataFrame:
    """``redact_json`` of a column; with ``counts``, a map of kind to number of replacements in each event."""
    after = pinned(df, "_after", redact_json(F.col(col)))
    out = [F.col("_after").alias(c) if c == col else F.col(c) for c in df.columns]
    return after.select(*out, *([redaction_counts(F.col(col), F.col("_after")).alias(counts)] if counts else []))


def redaction_counts(before: Column, after: Column) -> Column:
    """Map of kind to number of new placeholders."""
    pairs = []
    for kind, _, name, _ in RECOGNISERS:
        pairs += [F.lit(kind), marks(after, name) - marks(before, name)]
    return F.map_filter(F.create_map(*pairs), lambda k, n: n > 0)


__all__ = ["KINDS", "redact_events", "redact_json", "redact_payloads", "redaction_counts"]
