"""Per-page kernels as DataFrame operators: values, shapes, grids, widget groups and greedy alignment.

One nested row is one page, so a page's boxes, cells or values are never shuffled. Equal pairs of shapes
are scored once: distinct pairs go through the kernel and are joined back.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import documents as D
from quillmark.functions import kernels as K


def rowwise(df: DataFrame, inputs: list[str], out: dict[str, str], kernel) -> DataFrame:
    """df with the columns ``out`` (name -> DDL type) of kernel(*inputs), which returns one value for each, for every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in out.items())).fields])
    added = [to_arrow_schema(schema).field(n).type for n in out]
    at = [df.columns.index(c) for c in inputs]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                rows = [kernel(*v) for v in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in added]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, added, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)


def _parsed(text: str | None):
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    return D.tidy(D.unwrapped(value)) if isinstance(value, dict) else None


def value_similarity(df: DataFrame, truth: str, raw: str, out: str = "value_ned") -> DataFrame:
    """Best assignment of answer values by edit similarity; 0 for a missing or invalid prediction. Equal texts of an object need no kernel."""

    def kernel(t, r):
        if t == r and r is not None and r[:1] == "{" and _parsed(r) is not None:
            return (1.0,)
        said = _parsed(r)
        if said is None:
            return (0.0,)
        tokens = lambda v: [x for x in map(D.token, D.leaves(v).values()) if x]
        return (K.values_similarity(tokens(_parsed(t) or {}), tokens(said)),)

    return rowwise(df, [truth, raw], {out: "double"}, kernel)


#: A scalar of a JSON text where a value stands, and a key that could be taken for one.
SCALAR = r'(?<=[:\[,])\s*(?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?=\s*[,\]}])'
ODD_KEY = r'"[^"]*[:\[,][^"]*"\s*:'


def masked(text: Column) -> Column:
    """A JSON text with its scalars as null: pages of one shape have few different ones. Texts with odd keys stay as they are."""
    return F.when(text.rlike(ODD_KEY), text).otherwise(F.regexp_replace(text, SCALAR, "null"))


def shape_similarity(df: DataFrame, truth: str, raw: str, out: str = "schema_nted") -> DataFrame:
    """Tree edit similarity of the answers' shapes; 0 for a missing or invalid prediction. Scalars are masked in the plan, and only different pairs of masked texts are parsed and scored."""

    def kernel(t, r):
        said = _parsed(r)
        return (0.0 if said is None else K.tree_similarity(_parsed(t) or {}, said),)

    shaped = df.withColumns({"__t": masked(F.coalesce(F.col(truth), F.lit("{}"))), "__r": masked(F.col(raw))})
    scored = rowwise(shaped.where("__r is not null").select("__t", "__r").distinct(), ["__t", "__r"], {out: "double"}, kernel)
    return shaped.join(scored, ["__t", "__r"], "left").withColumn(out, F.coalesce(out, F.lit(0.0))).drop("__t", "__r")


def _cells(rows) -> list[K.Cell]:
    return [(c["r"], c["c"], c["h"], c["w"]) for c in rows or []]


def grid_similarity(df: DataFrame, truth: str, predicted: str, out: str = "grits_top") -> DataFrame:
    """Topology F1 of two grids of cells (r, c, h, w); null where the truth has no grid, 0 where only the prediction is broken."""

    def kernel(t, p):
        if not t:
            return (None,)
        found = K.grid_topology(_cells(t), _cells(p))
        return (found[0] if found else 0.0,)

    return rowwise(df, [truth, predicted], {out: "double"}, kernel)


def widget_group_similarity(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """wg_total, wg_truth, wg_predicted of arrays of groups (type, members(type, state, bbox))."""
    return rowwise(df, [truth, predicted], {"wg_total": "double", "wg_truth": "long", "wg_predicted": "long"}, lambda t, p: K.widget_groups(t or [], p or []))


def greedy_alignment(df: DataFrame, candidates: str, fields: str, least: float = 0.55) -> DataFrame:
    """aligned map<path, value> and unaligned array of candidates (label, value, bbox) and fields (path, label, bbox)."""

    def kernel(c, f):
        found, rest = K.greedy(c or [], f or [], least)
        return list(found.items()), rest

    return rowwise(df, [candidates, fields], {"aligned": "map<string,string>", "unaligned": "array<string>"}, kernel)


def responses(df: DataFrame, text: str) -> DataFrame:
    """ok, error, json of model responses."""
    return rowwise(df, [text], {"ok": "boolean", "error": "string", "json": "string"}, D.parse_response)


def table_cells(df: DataFrame, page: str) -> DataFrame:
    """A row for each table cell: the other columns, row, col, text."""
    cells = rowwise(df, [page], {"__c": "array<struct<row:int,col:int,text:string>>"}, lambda p: ([{"row": r, "col": c, "text": t} for r, c, t in D.table_cells(p)],))
    return cells.select(*[c for c in df.columns if c != page], F.explode("__c").alias("c")).select("*", "c.*").drop("c")


REGION = "struct<kind:string,x1:double,y1:double,x2:double,y2:double,content:string>"


def ocr_pages(df: DataFrame, text: str) -> DataFrame:
    """df with regions array<REGION> and lines array<string> of OCR output."""
    names = ("kind", "x1", "y1", "x2", "y2", "content")

    def kernel(t):
        regions, lines = D.ocr_page(t)
        return [dict(zip(names, (k, *b, c), strict=True)) for k, b, c in regions], lines

    return rowwise(df, [text], {"regions": f"array<{REGION}>", "lines": "array<string>"}, kernel)


def ocr_regions(df: DataFrame, text: str) -> DataFrame:
    """A row for each region of OCR output: kind, x1, y1, x2, y2, text."""
    found = ocr_pages(df.withColumnRenamed(text, "__t"), "__t")
    return found.select(*[c for c in df.columns if c != text], F.explode("regions").alias("r")).select("*", "r.*").drop("r")


def ungrounded(df: DataFrame, text: str, out: str = "plain") -> DataFrame:
    """df with the texts that grounding tags refer to."""
    return rowwise(df, [text], {out: "string"}, lambda t: (D.without_grounding(t),))


def pipeline_pages(df: DataFrame, text: str) -> DataFrame:
    """df with regions, lines, cells and rows of a layout pipeline's JSON."""
    region = "struct<id:string,kind:string,box:array<double>,text:string,label:string>"
    kernel = lambda t: tuple((found := D.pipeline_page(t))[k] for k in ("regions", "lines", "cells", "rows"))
    return rowwise(df, [text], {"regions": f"array<{region}>", "lines": "array<string>", "cells": "array<string>", "rows": "array<string>"}, kernel)


def repeated_members(df: DataFrame, text: str) -> DataFrame:
    """A row for each key that an object has more than once: path, member, times."""
    found = rowwise(df, [text], {"__m": "array<struct<path:string,member:string,times:int>>"}, lambda t: ([{"path": p, "member": k, "times": n} for p, k, n in D.repeated_members(t)],))
    return found.select(*[c for c in df.columns if c != text], F.explode("__m").alias("m")).select("*", "m.*").drop("m")


def hashed_answers(df: DataFrame, text: str, out: str = "answer_hash") -> DataFrame:
    """Hash of the canonical form of JSON texts; null for a text that isn't JSON."""

    def kernel(t):
        try:
            return (D.canonical_hash(json.loads(t)),)
        except (TypeError, ValueError, RecursionError):
            return (None,)

    return rowwise(df, [text], {out: "string"}, kernel)
