"""Documents whose shape depends on their type, form parameters in brackets, and renaming inside nested columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# fixed values: the fields of each request type, with their kinds; those behind a question mark may be missing
RESULT_TIME = {"minutes": "int", "seconds": "int", "hundredths": "int"}
SWIMMER = {"swimmer_id": "bigint", "swimmer_last_name": "string", "swimmer_first_name": "string", "swimmer_year_of_birth": "int", "gender_type_id": "int"}
REQUEST_FIELDS = {
    "0": {"team_id": "bigint", "season_id": "bigint"},
    "1a": {"meeting_id": "bigint", "results_url": "string"},
    "1b": {"parent_meeting_id": "bigint", "parent_meeting_class": "string", "event_type_id": "int", **RESULT_TIME, **SWIMMER},
    "1b1": {"result_id": "bigint", "result_class": "string", **RESULT_TIME},
    "2b1": {"result_id": "bigint", "result_class": "string", "team?": "string", "swimmer?": "string"},
    "3b": SWIMMER,
    "3c": {"type3c_first_name": "string", "type3c_last_name": "string", "type3c_year_of_birth": "int", "type3c_gender_type_id": "int"},
    "4": {},
    "5": {"reason?": "string"},
}


def request_fields(kind: Column, body: Column) -> Column:
    """The fields of a request as an array of (field, value, reason): what its type asks for, read from a variant with the field's kind.

    The reason says why there is no value: the body is no JSON object, the type is unknown, the field is missing, or its value is of another kind; a field that may be missing has neither.
    """
    parsed = F.try_parse_json(body)
    whole = parsed.isNotNull() & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    entry = lambda field, value, reason: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), reason.cast("string").alias("reason"))
    none = F.lit(None).cast("string")
    by_type = F.when(~whole, F.array(entry("*", none, F.lit("no JSON object"))))
    for name, fields in REQUEST_FIELDS.items():
        cells = []
        for field, of_kind in fields.items():
            path, optional = f"$.{field.rstrip('?')}", field.endswith("?")
            raw = F.try_variant_get(parsed, path, "string")
            value = raw.try_cast(of_kind) if of_kind != "string" else raw
            reason = F.when(raw.isNull(), none if optional else F.lit("missing")).when(value.isNull(), F.lit(f"not {of_kind}"))
            cells.append(entry(field.rstrip("?"), value, reason))
        by_type = by_type.when(kind == name, F.array(*cells) if cells else F.array().cast("array<struct<field:string,value:string,reason:string>>"))
    return by_type.otherwise(F.array(entry("*", none, F.lit("unknown type"))))


def form_params(body: Column, root: str, allowed: list[str]) -> Column:
    """`root[3][name]=x&root[name]=y` as an array of (index, fields), in the order of the indices, whatever gaps they have.

    A field of an index is what the form has under it, else what it has without an index; of repeated ones the last. Only the allowed names are taken.
    What isn't of this form is left out. A form without indices has none.
    """
    pair = "^([^=\\[\\]]+)(?:\\[(\\d+)\\])?\\[([^=\\[\\]]+)\\]=(.*)$"
    part = lambda x, k: F.regexp_extract(x, pair, k)
    pairs = F.filter(F.split(F.coalesce(body, F.lit("")), "&"), lambda x: part(x, 1) == root)
    once = F.transform(pairs, lambda x: F.struct(part(x, 2).try_cast("int").alias("index"), part(x, 3).alias("name"), F.try_url_decode(part(x, 4)).alias("value")))
    # a variable of a lambda, so that the pairs are read once and not again for each index and name
    return F.get(F.transform(F.array(once), lambda found: _form_fields(found, allowed)), F.lit(0))


def _form_fields(found: Column, allowed: list[str]) -> Column:
    indices = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x["index"]), lambda i: i.isNotNull())))

    def last(own: Callable[[Column], Column]) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(found, own), lambda x: x["value"])), -1)

    def of(i: Column, name: str) -> Column:
        return F.coalesce(last(lambda x: (x["index"] == i) & (x["name"] == name)), last(lambda x: x["index"].isNull() & (x["name"] == name)))

    def fields(i: Column) -> Column:
        return F.struct(i.alias("index"), *(of(i, name).alias(name) for name in allowed))

    return F.transform(indices, fields)


def rewritten(column: Column, kind: DataType, change: Callable[[str, Column], Column | None]) -> Column:
    """column with all its leaves rewritten, at any depth: change(name, leaf) gives the new leaf, or None where it stays. Orders and shapes stay."""
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: rewritten(x, kind.elementType, change))
    if isinstance(kind, StructType):
        fields = [(f.name, rewritten(column[f.name], f.dataType, change) if isinstance(f.dataType, ArrayType | StructType) else change(f.name, column[f.name])) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*((column[name] if new is None else new).alias(name) for name, new in fields)))
    return column


def leaves(column: Column, kind: DataType, wanted: Callable[[str], bool]) -> Column | None:
    """All leaves of the wanted names in a nested column as one array of texts; None if it has none."""
    if isinstance(kind, ArrayType):
        inner = leaves(F.lit(None), kind.elementType, wanted)
        return None if inner is None else F.flatten(F.transform(F.coalesce(column, F.array().cast(kind)), lambda x: leaves(x, kind.elementType, wanted)))
    if isinstance(kind, StructType):
        parts = []
        for f in kind.fields:
            at = column[f.name] if not isinstance(column, type(None)) else column
            if isinstance(f.dataType, ArrayType | StructType):
                inner = leaves(at, f.dataType, wanted)
                parts += [] if inner is None else [F.coalesce(inner, F.array().cast("array<string>"))]
            elif wanted(f.name):
                parts.append(F.array(at.cast("string")))
        return F.concat(*parts) if parts else None
    return None
