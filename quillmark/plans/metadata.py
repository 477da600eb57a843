"""Queries: annotation trees, constraints from metadata, context of pages, and agreement of two annotations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import metadata as M
from quillmark.functions import structures as S
from quillmark.operators import summaries as Y
from quillmark.operators.pages import rowwise
from quillmark.operators.predictions import read, truth_of
from quillmark.plans.predictions import PARTIAL, TRUTH, _counts, values

FORM = {
    "original_width": 100, "original_height": 200,
    "fields": [
        {"semantic_key": "Applicant", "bbox": [0, 0, 50, 10], "keys": [
            {"semantic_key": "Name", "bbox": [0, 20, 50, 30], "value": {"data_type": "text", "bbox": [60, 20, 90, 30]}},
            {"semantic_key": "Approval_Date", "bbox": [0, 40, 50, 50], "values": [{"data_type": "Checkbox"}, {"data_type": "radio"}, "odd"]}]},
        {"semantic_key": "approval date", "bbox": [0, 0, 50, 10], "data_type": "check_box", "value": {"data_type": "date"}},
        {"semantic_key": "Total", "bbox": [0, 60, 50, 100]}, "odd", {"keys": [{}]},
    ],
}
SECTIONED = {"metadata": {"layout_structure": {"page_bbox": [0, 0, 10, 10], "sections": [{"bbox": [0, 0, 10, 3]}, {"bbox": [0, 3, 10, 5]}, {"bbox": [9, 9, 1, 1]}]}, "text_direction": {"reading_direction": "rtl"}}, "fields": []}
MIXED = {"metadata": {"text_direction": {"orientation": "LTR and RTL"}}, "fields": 7}
TREES = [("form", FORM), ("sectioned", SECTIONED), ("mixed", MIXED), ("broken", None)]


def _layouts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, json.dumps(t) if t is not None else "{") for n, t in TREES], "name string, layout string")


def annotation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, data types and graph of annotation trees."""

    def kernel(text):
        fields = M.part({"x": read(text)}, "x").get("fields")
        counts, graph = M.tree_counts(fields), M.field_graph(fields)
        return list(counts.items()), list(M.type_counts(fields).items()), [(k, float(v)) for k, v in graph.items()]

    t = rowwise(_layouts(spark), ["layout"], {"counts": "map<string,int>", "types": "map<string,int>", "graph": "map<string,double>"}, kernel)
    return t.select("name", _counts("counts").alias("counts"), _counts("types").alias("types"), *[F.round(F.col("graph")[k], 6).alias(k) for k in ("headers", "questions", "answers", "nodes", "links", "branching", "roots", "density")])


# form: nodes Applicant, Name, Approval_Date, approval date, Total, one without a name and its empty child; values: one, two (and one that is no object), one.
# Edges: 2 + 0, 1, 3 (the odd one too), 1, 0, 1, 0 = 8; objects: 7 nodes and 4 values, links 3 children + 4 values; parents are Applicant, Name, Approval_Date, approval date, the unnamed.
TREE_ROWS = [
    ("form", "depth=2 edges=8 groups=0 labelled=2 multiple=1 selections=3", "check_box=1 checkbox=1 date=1 radio=1 text=1", 2.0, 5.0, 4.0, 11.0, 7.0, 1.4, 4.0, 0.636364),
    ("sectioned", "depth=0 edges=0 groups=0 labelled=0 multiple=0 selections=0", "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("mixed", "depth=0 edges=0 groups=0 labelled=0 multiple=0 selections=0", "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("broken", "depth=0 edges=0 groups=0 labelled=0 multiple=0 selections=0", "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
]

RELATION_TREES = [("nested", {"1": [2, {"3": 4}], "name": {"5": [5, True]}}), ("flat", [1, 2, 2]), ("none", "x")]


def relation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(n, json.dumps(v)) for n, v in RELATION_TREES], "name string, tree string")
    g = rowwise(t, ["tree"], {"g": "map<string,double>"}, lambda x: ([(k, float(v)) for k, v in M.relation_graph(read(x)).items()],))
    return g.select("name", *[F.round(F.col("g")[k], 6).alias(k) for k in ("nodes", "links", "depth", "branching", "roots", "density")])


RELATION_ROWS = [("nested", 5.0, 3.0, 3.0, 1.5, 2.0, 0.6), ("flat", 2.0, 0.0, 1.0, 0.0, 2.0, 0.0), ("none", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def layout_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, direction, order and repeated approvals of layouts, and the context score that they give."""

    def kernel(text):
        layout = M.part({"x": read(text)}, "x")
        return M.area_share(layout), M.direction_level(layout), M.is_unordered(layout), M.repeated_approvals(layout)

    c = rowwise(_layouts(spark), ["layout"], {"area": "double", "direction": "int", "unordered": "boolean", "approvals": "int"}, kernel)
    order = Y.reading_order(F.col("direction"), F.lit(2), F.lit(2), F.col("unordered"))
    score = Y.context_score(F.col("area"), F.lit(0.5), F.lit(2.0), F.lit(0), order, F.col("direction"), Y.cross_region(F.lit(2), F.col("approvals"), F.lit(0), F.lit(0), F.lit(0)))
    return c.select("name", F.round("area", 6).alias("area"), "direction", "unordered", "approvals", F.round(order, 4).alias("reading_order"), score.alias("score"))


# form: boxes reach from (0, 0) to (90, 100), 9000 of 20000; centres go 5, 25, 45, 5, 80: one of four steps goes back. 0.45 gives half a page: 0.1 + 0.075 + 0.075 + 0.15 * 0.33 + 0.05 * 0.15.
CONTEXT_ROWS = [("form", 0.45, 0, True, 1, 0.33, 0.307), ("sectioned", 0.5, 1, False, 0, 0.33, 0.3495), ("mixed", 0.0, 2, False, 0, 0.43, 0.3145), ("broken", 0.0, 0, False, 0, 0.08, 0.162)]

METADATA = [
    ("t1", {"S": {"cell_count": 4, "relation_edge_count": 9, "option_group_count": 2, "max_values_per_key": 5}, "V": {"quality_tag": ["fine", "Low-Contrast scan"]}}),
    ("t2", {"S": {"relation_edge_count": 3, "selection_control_count": 1}, "C": {"table_count_on_page": 1}, "layout_structure": {"section_count": 2}, "V": {"blurred": "no", "quality_tag": "blur"}}),
    ("t3", {"S": {"relation_edge_count": 1, "line_item_group_count": "2"}, "layout_structure": {"table_region_count": 1, "region_count": 1, "line_item_group_count": 1}, "difficulty": {"visual_score": 1.5}}),
    ("t4", {"C": {"multi_table_page": True}, "V": {"my_degradation_note": "yes"}}),
    ("t5", None),
]


def constraint_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six flags of templates from their metadata; relations and widgets must reach the upper quarter over templates."""
    t = spark.createDataFrame([(n, json.dumps(m) if m is not None else None) for n, m in METADATA], "name string, metadata string")
    kernel = lambda x: (list(M.constraint_signals(M.part({"x": read(x)}, "x")).items()),)
    s = rowwise(t, ["metadata"], {"s": "map<string,double>"}, kernel)
    q = s.agg(F.percentile(F.col("s")["relations"], 0.75).alias("relations"), F.percentile(F.col("s")["options"], 0.75).alias("options"))
    v = lambda k: F.col("s")[k]
    return s.crossJoin(F.broadcast(q)).select(
        "name", (v("local_grids") > 0).alias("local_grids"), ((v("widgets") >= F.col("options")) & (v("widgets") > 0)).alias("widgets"), ((v("relations") >= F.col("relations")) & (v("relations") > 0)).alias("relations"),
        (v("line_items") > 0).alias("line_items"), (v("mixed") > 0).alias("mixed"), (v("damaged") > 0).alias("damaged"),
    )


# relations 9, 3, 1, 0, 0: the upper quarter begins at 3; options 2, 0, 0, 0, 0: at 0.
FLAG_ROWS = [("t1", True, True, True, False, False, True), ("t2", False, True, True, False, True, False), ("t3", True, False, False, True, False, True), ("t4", False, False, False, False, True, True), ("t5", False, False, False, False, False, False)]


def annotation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotations of a page: regions that match by place, topology of grids that do, and widgets of one type and state."""
    rows = spark.createDataFrame([("same", json.dumps(TRUTH), json.dumps(TRUTH)), ("partial", json.dumps(TRUTH), json.dumps(PARTIAL)), ("none", json.dumps(TRUTH), "{}"), ("both_none", "{}", "{}")], "page string, a string, b string")

    def kernel(a, b):
        left = truth_of(a)
        right = truth_of(b) if "fields" in (read(b) or {}) else S.parsed(read(b), "normalized_1", 1.0, 1.0)
        flat = lambda groups: [m for g in groups for m in g["members"]]
        regions = S.box_matches(left["regions"], right["regions"])
        grids = S.grid_agreement(left["grids"], right["grids"])
        x, y = flat(left["groups"]), flat(right["groups"])
        widgets = S.box_matches(x, y, lambda p, t: p["type"] == t["type"] and p["state"] == t["state"])
        return len(regions), grids, 2 * len(widgets) / (len(x) + len(y)) if x or y else None

    return rowwise(rows, ["a", "b"], {"regions": "int", "topology": "double", "widgets": "double"}, kernel).select("page", "regions", F.round("topology", 6).alias("topology"), F.round("widgets", 6).alias("widgets"))


AGREEMENT_ROWS = [("same", 2, 1.0, 1.0), ("partial", 1, 0.75, 0.5), ("none", 0, 0.0, 0.0), ("both_none", 0, None, None)]
KINDS = ["Title", "section-header", "Field Label", "date", "check box", "table", "text", "other", "", "else"]


def region_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of region types as the truth and as a prediction name them."""
    t = spark.createDataFrame([(k,) for k in KINDS], "type string")
    return rowwise(t, ["type"], {"truth": "string", "predicted": "string"}, lambda k: (S.TRUTH_CATEGORIES.get(S.kind_of({"type": k}), "unknown"), S.PREDICTED_CATEGORIES.get(S.kind_of({"type": k}), "unknown")))


CATEGORY_ROWS = [
    ("Title", "unknown", "group"), ("section-header", "unknown", "group"), ("Field Label", "unknown", "label"), ("date", "value", "value"), ("check box", "widget", "widget"), ("table", "table", "table"), ("text", "value", "text"),
    ("other", "unknown", "other"), ("", "unknown", "unknown"), ("else", "unknown", "unknown"),
]

QUERIES = {f.__name__: f for f in (annotation_trees, relation_trees, layout_context, constraint_flags, annotation_agreement, region_categories)}
SQL = {
    "annotation_trees": values(TREE_ROWS, "name, counts, types, headers, questions, answers, nodes, links, branching, roots, density"),
    "relation_trees": values(RELATION_ROWS, "name, nodes, links, depth, branching, roots, density"),
    "layout_context": values(CONTEXT_ROWS, "name, area, direction, unordered, approvals, reading_order, score"),
    "constraint_flags": values(FLAG_ROWS, "name, local_grids, widgets, relations, line_items, mixed, damaged"),
    "annotation_agreement": values(AGREEMENT_ROWS, "page, regions, topology, widgets"),
    "region_categories": values(CATEGORY_ROWS, '"type", truth, predicted'),
}
