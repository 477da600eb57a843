"""Structure of predictions as DataFrame operators: one row is one page, so nothing of a page is ever shuffled.

Predictions and truths are JSON texts; a text that isn't JSON counts as a missing prediction.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import structures as S
from quillmark.operators.pages import rowwise

WIDGET = "struct<id:string,type:string,state:string,bbox:array<double>>"
GROUP = f"struct<id:string,type:string,members:array<{WIDGET}>>"
CELL = "struct<id:string,r:int,c:int,h:int,w:int,bbox:array<double>>"
GRID = f"struct<id:string,region:string,cells:array<{CELL}>,bbox:array<double>>"
PART = "struct<id:string,type:string,bbox:array<double>>"
EDGE = "struct<source:string,target:string,type:string>"
COUNTS = ("lg_total", "lg_predicted", "lg_truth", "lg_matches", "wg_total", "wg_predicted", "wg_truth", "rel_matched", "rel_predicted", "rel_truth", "rel_predicted_known", "rel_truth_known", "parents_recovered")


def read(text: str | None):
    """The JSON value of a text; nothing if it isn't JSON."""
    try:
        return json.loads(text or "")
    except (ValueError, RecursionError):
        return None


def adapted(df: DataFrame, raw: str) -> DataFrame:
    """df with ``envelope`` (JSON text under usual names) and ``audit`` (map of counts)."""

    def kernel(text):
        page, audit = S.adapted(read(text))
        return json.dumps(page, sort_keys=True, separators=(",", ":")), list(audit.items())

    return rowwise(df, [raw], {"envelope": "string", "audit": "map<string,int>"}, kernel)


def parsed(df: DataFrame, raw: str, space: str = "normalized_1", width: float = 1.0, height: float = 1.0) -> DataFrame:
    """df with regions, grids, groups, relations, line_items and audit of each prediction."""
    kinds = {"regions": f"array<{PART}>", "grids": f"array<{GRID}>", "groups": f"array<{GROUP}>", "relations": f"array<{EDGE}>", "line_items": "array<struct<id:string,bbox:array<double>>>", "audit": "map<string,int>"}

    def kernel(text):
        p = S.parsed(read(text), space, width, height)
        edges = [dict(zip(("source", "target", "type"), e, strict=True)) for e in p["relations"]]
        return p["regions"], p["grids"], p["groups"], edges, p["line_items"], list(p["audit"].items())

    return rowwise(df, [raw], kinds, kernel)


def truth_of(text: str | None) -> dict:
    """A page's true structure: regions, grids, groups, relations, line_items, fields (slashed path -> id)."""
    value = read(text) or {}
    out = {k: value.get(k) or [] for k in ("regions", "grids", "groups", "line_items")}
    out["relations"] = [tuple(r) for r in value.get("relations") or []]
    out["fields"] = {tuple(k.split("/")): v for k, v in (value.get("fields") or {}).items()}
    return out


def page_scores(df: DataFrame, truth: str, raw: str, space: str = "normalized_1", symmetric: frozenset = frozenset()) -> DataFrame:
    """df with ``valid`` and COUNTS of local grids, widget groups and relations."""
    kinds = {"valid": "boolean"} | {c: "double" if c.endswith("total") else "long" for c in COUNTS}

    def kernel(t, p):
        value = read(p)
        own = S.parsed(value, space, 1.0, 1.0) if isinstance(value, dict) else None
        found = S.page_scores(own, truth_of(t), symmetric)
        return own is not None, *(float(found[c]) if c.endswith("total") else found[c] for c in COUNTS)

    return rowwise(df, [truth, raw], kinds, kernel)


def run_rollup(scores: DataFrame, key: str = "model") -> DataFrame:
    """key: pages, valid ones; macro means over pages where a part applies, and scores of the summed counts, for grids, groups and relations."""
    total = lambda *c: sum((F.sum(x) for x in c[1:]), F.sum(c[0]))
    page = lambda m, p, t: F.when(F.col(p) + F.col(t) > 0, 2 * F.col(m) / (F.col(p) + F.col(t)))
    whole = lambda m, p, t: F.when(total(p, t) > 0, 2 * total(m) / total(p, t))
    parts = {"lg": ("lg_total", "lg_predicted", "lg_truth"), "wg": ("wg_total", "wg_predicted", "wg_truth"), "rel": ("rel_matched", "rel_predicted", "rel_truth"), "rel_known": ("rel_matched", "rel_predicted_known", "rel_truth_known")}
    return scores.groupBy(key).agg(
        F.count("*").alias("n_pages"), F.count_if("valid").alias("n_valid"),
        *[F.avg(page(*c)).alias(f"{n}_macro") for n, c in parts.items()], *[whole(*c).alias(f"{n}_corpus") for n, c in parts.items()],
        F.when(total("rel_predicted") > 0, total("rel_matched") / total("rel_predicted")).alias("rel_precision"), F.when(total("rel_truth") > 0, total("rel_matched") / total("rel_truth")).alias("rel_recall"),
        total("parents_recovered").alias("parents_recovered"),
    )


def resolved_groups(df: DataFrame, specs: str, answer: str) -> DataFrame:
    """df with ``groups`` and ``sources`` (map of counts): a template's widget specs (JSON) with their states in a page's answer (JSON)."""

    def kernel(s, a):
        groups, sources = S.resolved_groups(read(s) or [], read(a))
        return groups, list(sources.items())

    return rowwise(df, [specs, answer], {"groups": f"array<{GROUP}>", "sources": "map<string,int>"}, kernel)


def mappings(df: DataFrame, truth: str, raw: str, space: str = "normalized_1") -> DataFrame:
    """df with region_map, widget_map, line_item_map and field_map: predicted names -> true names."""
    names = ("region_map", "widget_map", "line_item_map", "field_map")

    def kernel(t, p):
        gold, own = truth_of(t), S.parsed(read(p), space, 1.0, 1.0)
        found = (S.region_matches(own["regions"], gold["regions"]), S.widget_matches(own["groups"], gold["groups"]), S.box_matches(own["line_items"], gold["line_items"]), S.field_endpoints(own["paths"], own["relations"], gold["fields"]))
        return tuple(list(m.items()) for m in found)

    return rowwise(df, [truth, raw], dict.fromkeys(names, "map<string,string>"), kernel)


def older_scores(df: DataFrame, truth: str, raw: str) -> DataFrame:
    """df with F1 of widgets, line items and relations in the older metrics; null where the truth has none."""
    kernels: dict[str, Callable] = {"widget_f1": S.older_widgets, "line_item_f1": S.older_line_items, "relation_f1": S.older_relations}

    def kernel(t, p):
        gold, said = read(t), read(p)
        counts = [k(said, gold) for k in kernels.values()]
        return tuple(2 * m / (n + g) if g else None for m, n, g in counts)

    return rowwise(df, [truth, raw], dict.fromkeys(kernels, "double"), kernel)
