"""JSON text with keys in order, and JSON documents as rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import importable


def stable_json(**fields: Column) -> Column:
    """An object with its keys in order, null ones left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def stable_struct(**fields: Column) -> Column:
    return F.struct(*(fields[k].alias(k) for k in sorted(fields)))


def ordered(c: Column, kind: T.DataType) -> Column:
    """A value with the keys of its objects in order, however deep; arrays stay as they are."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(ordered(c[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), ordered(e["value"], kind.valueType).alias("value")))))
    return c


def stable_text(df: DataFrame, *columns: str) -> Column:
    """The named columns of ``df`` as one JSON object with keys in order at every depth, null ones left out."""
    return F.to_json(F.struct(*(ordered(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns))))


LEAF = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])


def leaves(text: str | None) -> list[tuple[int, str, str]]:
    """(order, path, JSON text) of the scalars of a document, depth first, at any depth; not JSON: none.

    Of a key that stands twice in an object the last value counts, at the first one's place.
    """
    try:
        try:
            whole = json.loads(text)
        except RecursionError:
            whole = deep(text)
    except (TypeError, ValueError):
        return []
    found: list[tuple[int, str, str]] = []
    work = [("$", whole)]
    while work:
        path, value = work.pop()
        if isinstance(value, dict):
            work += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            work += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            found.append((len(found) + 1, path, json.dumps(value, ensure_ascii=False)))
    return found


BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = json.JSONDecoder()


def deep(text: str):
    """``json.loads`` for documents that are nested too deep for it: open containers are kept in a list."""
    open_: list[tuple[object, str | None]] = []  # containers, with the key under which each is to be put
    at = BLANK.match(text).end()
    key: str | None = None

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no key at {at}")
        k, at = _SCALAR.raw_decode(text, at)
        at = BLANK.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return k, BLANK.match(text, at + 1).end()

    while True:
        sign = text[at : at + 1]
        if sign in ("{", "[") and sign:
            inner = BLANK.match(text, at + 1).end()
            value: object = {} if sign == "{" else []
            if text[inner : inner + 1] != ("}" if sign == "{" else "]"):
                open_.append((value, key))
                key, at = name(inner) if sign == "{" else (None, inner)
                continue
            at = inner + 1
        else:
            value, at = _SCALAR.raw_decode(text, at)
        while True:  # a value is whole: put it where it belongs, and close what ends with it
            at = BLANK.match(text, at).end()
            if not open_:
                if at != len(text):
                    raise ValueError(f"more than one value, at {at}")
                return value
            holder, above = open_[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            sign = text[at : at + 1]
            if sign == ",":
                at = BLANK.match(text, at + 1).end()
                key, at = name(at) if isinstance(holder, dict) else (None, at)
                break
            if sign != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"neither a comma nor an end at {at}")
            value, key, at = holder, above, at + 1
            open_.pop()


def flatten(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, ord, path, text): a row for each scalar of any depth, by an Arrow pass over the texts."""
    import pyarrow as pa

    importable(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("j"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [leaves(t) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.string())], ["id", "ord", "path", "text"])

    return rows.mapInArrow(run, f"id {kind}, ord int, path string, text string")


def flatten_object(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, text) of an object's own fields, inside the JVM; for documents one level deep."""
    fields = F.from_json(F.col(json_col), "map<string,string>")
    rows = df.select(F.col(id_col).alias("id"), F.explode(fields))
    return rows.select("id", F.concat(F.lit("$."), "key").alias("path"), F.col("value").alias("text"))
