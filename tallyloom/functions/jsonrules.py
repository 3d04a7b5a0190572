"""Field rules over parsed JSON, as data.

The fields that rules name are taken out of a document once, as (type, text,
number). Each rule compiles to a predicate of its own over its field, so a
document runs compiled code and only the rules of its type.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import pinned

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
SNAKE = "^[a-z][a-z0-9_]*$"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S+$"

KINDS = ("string", "text", "int", "number", "bool", "object", "array", "datetime", "uuid", "snake", "url")


@dataclass(frozen=True)
class Rule:
    """One field: its kind, whether it must be there, and the bounds on its value.

    Kinds: string (not empty), text (any string), int, number, bool, object,
    array, datetime, uuid, snake, url. A nested field is looked at only where
    its parent is an object. ``when`` limits the rule to documents of one type.
    """

    path: str
    kind: str = "string"
    required: bool = True
    nullable: bool = False
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    above: float | None = None
    length: int | None = None
    code: str = "not allowed"
    when: str | None = None


def _typed(entries: Column, name) -> Column:
    """Entries of an object as (path, value, type); the type of a value is looked up once."""
    return F.transform(entries, lambda e: F.struct(
        name(e["key"]).alias("path"), e["value"].alias("value"), F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0).alias("t")))


def _leaf(x: Column) -> Column:
    t, value = x["t"], x["value"]
    return F.struct(
        x["path"].alias("path"),
        F.struct(t.alias("t"), F.when(~t.isin("OBJECT", "ARRAY"), F.try_variant_get(value, "$", "string")).alias("s"),
                 F.when(t.isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(value, "$", "double")).alias("n")).alias("f"))


def _name(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))


def flatten_json(doc: Column) -> Column:
    """Map of path to (type, text, number) for the top level and one level below; NULL for no object.

    A dot inside a key is written with a backslash before it, so that it is no border between levels.
    """
    members = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))

    def whole(top: Column) -> Column:
        inner = F.flatten(F.transform(
            F.filter(top, lambda x: x["t"] == "OBJECT"),
            lambda x: _typed(members(x["value"]), lambda key: F.concat(x["path"], F.lit("."), _name(key)))))
        return F.map_from_entries(F.transform(F.concat(top, inner), _leaf))

    # bound once: the document is parsed and read one time
    return F.get(F.transform(F.array(_typed(members(doc), _name)), whole), F.lit(0))


def paths_of(rules: Iterable[Rule]) -> tuple[str, ...]:
    """The fields that rules read, parents of nested ones included."""
    return tuple(dict.fromkeys(p for r in rules for p in (r.path.rpartition(".")[0], r.path) if p))


@dataclass(frozen=True)
class Picked:
    """Fields of a JSON object as columns, read from the struct that ``pick_fields`` adds; all NULL for no object."""

    struct: Column

    def kind(self, path: str) -> Column:
        """Type of the field as Spark names it (STRING, BIGINT, OBJECT<...>); NULL where it is missing."""
        return self.struct["kinds"][path]

    def is_a(self, path: str, kind: str) -> Column:
        return self.kind(path) == kind if kind in ("STRING", "BOOLEAN", "VOID") else self.kind(path).startswith(kind)

    def text(self, path: str) -> Column:
        """The field as string, only if it is a JSON string."""
        return F.when(self.is_a(path, "STRING"), _part(self.struct["tops"], path, "string"))

    def number(self, path: str) -> Column:
        """The field as double, only if it is a JSON number."""
        k, tops = self.kind(path), self.struct["tops"]
        # whole numbers are read as they are stored; a cast inside the document costs far more
        return F.when(k == "BIGINT", _part(tops, path, "bigint").cast("double")).when((k == "DOUBLE") | k.startswith("DECIMAL"), _part(tops, path, "double"))


def _part(tops: Column, path: str, kind: str) -> Column:
    top, _, inner = path.partition(".")
    return F.try_variant_get(tops[top], f"$.{inner}" if inner else "$", kind)


def pick_fields(df: DataFrame, name: str, doc: Column, paths: Iterable[str]) -> DataFrame:
    """Add a struct for ``Picked``: the fields at ``paths`` with their types; NULL for no object.

    ``flatten_json`` for fields that are known: they are taken out in one reading of the object,
    and no other field is looked at.
    """
    paths = list(dict.fromkeys(paths))
    tops = dict.fromkeys(p.partition(".")[0] for p in paths)
    d = pinned(df, "_tops", F.try_variant_get(doc, "$", "struct<" + ",".join(f"`{t}`:variant" for t in tops) + ">"))
    kinds = F.struct(*[F.schema_of_variant(_part(F.col("_tops"), p, "variant") if "." in p else F.col("_tops")[p]).alias(p) for p in paths])
    return pinned(d, name, F.when(F.col("_tops").isNotNull(), F.struct(F.col("_tops").alias("tops"), kinds.alias("kinds")))).drop("_tops")


def field(flat: Column, path: str | Column) -> Column:
    return F.try_element_at(flat, F.lit(path) if isinstance(path, str) else path)


def text_of(flat: Column, path: str) -> Column:
    """The field as string, only if it is a JSON string."""
    f = field(flat, path)
    return F.when(f["t"] == "STRING", f["s"])


def number_of(flat: Column, path: str) -> Column:
    """The field as double, only if it is a JSON number."""
    return field(flat, path)["n"]


def _check(doc: Picked, r: Rule) -> Column:
    """Reason of one rule, or '' when its field is fine."""
    if r.kind not in KINDS:
        raise ValueError(f"unknown kind: {r.kind}")
    s, n = doc.text(r.path), doc.number(r.path)
    said = lambda code: F.lit(f"{r.path}: {code}")
    json_type = {"bool": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}.get(r.kind, "STRING")
    fits = n.isNotNull() if r.kind in ("int", "number") else doc.is_a(r.path, json_type)
    steps = [(doc.kind(r.path).isNull(), said("missing") if r.required else F.lit(""))]
    if r.nullable:
        steps.append((doc.is_a(r.path, "VOID"), F.lit("")))
    steps.append((~fits, said("wrong type")))
    if r.kind == "string" and not r.values:
        steps.append((s == "", said("empty")))
    steps += {
        "uuid": [(~s.rlike(UUID), said("not a uuid"))], "datetime": [(~s.rlike(DATETIME) | F.try_to_timestamp(s).isNull(), said("not a datetime with offset"))],
        "snake": [(~s.rlike(SNAKE), said("not snake_case"))], "url": [(~s.rlike(URL), said("not a url"))], "int": [(n != F.floor(n), said("not an integer"))],
    }.get(r.kind, [])
    if r.values:
        steps.append((~s.isin(*r.values), said(r.code)))
    if r.length is not None:
        steps.append((F.length(s) != r.length, said("wrong length")))
    if r.low is not None:
        steps.append((n < float(r.low), said("too small")))
    if r.above is not None:
        steps.append((n <= float(r.above), said("too small")))
    if r.high is not None:
        steps.append((n > float(r.high), said("too large")))
    reason = reduce(lambda chain, step: chain.when(*step), steps[1:], F.when(*steps[0])).otherwise("")
    parent = r.path.rpartition(".")[0]
    # nested fields count only where their parent is an object
    return F.when(doc.is_a(parent, "OBJECT"), reason).otherwise("") if parent else reason


def reasons(doc: Picked, rules: Iterable[Rule], type_path: str | None = None, otherwise: Iterable[Rule] = ()) -> Column:
    """All reasons; for text that is no JSON object that is the one reason.

    ``doc`` holds the fields ``paths_of(rules)``. Rules with ``when`` apply, behind the common ones, to documents
    whose ``type_path`` holds that value, the rules ``otherwise`` to documents of any other type.
    """
    # fine fields are '' and not NULL: a filter by a function would read all checks expression by expression
    rules, otherwise = list(rules), list(otherwise)
    none = F.array(*[_check(doc, r) for r in otherwise]) if otherwise else F.expr("CAST(array() AS ARRAY<STRING>)")
    by_type: dict[str, list[Column]] = {}
    for r in rules:
        if r.when is not None and type_path is not None:
            by_type.setdefault(r.when, []).append(_check(doc, r))
    parts = [F.array(*[_check(doc, r) for r in rules if r.when is None])]
    if by_type:
        kind = doc.text(type_path)
        parts.append(F.coalesce(*[F.when(kind == k, F.array(*checks)) for k, checks in by_type.items()], none))
    return F.when(doc.struct.isNull(), F.array(F.lit("(document): not an object"))).otherwise(F.array_remove(F.concat(*parts), F.lit("")))


def with_fields(payload: Column, extras: dict[str, Column]) -> Column:
    """The JSON object with the given top-level fields set (values as JSON text); other text is left as it is."""
    members = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    kept = F.to_json(F.map_filter(members, lambda k, v: ~k.isin(*extras)))
    # what is between the brackets, as one element or none, so that nothing is computed twice
    inner = F.regexp_extract_all(kept, F.lit(r"(?s)\A\{(.+)\}\z"), F.lit(1))
    added = F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in extras.items()])
    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.concat(inner, added), ","), F.lit("}")), payload)


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))
