"""Queries: structure of predictions, their scores, and older spellings and metrics.

Inputs are small pages with results worked out by hand; the rollup deals them to all orders.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import layout as L
from quillmark.operators import predictions as P
from quillmark.sources import derived as X

BOXES = {"c00": [0, 0.5, 0.5, 0.75], "c01": [0.5, 0.5, 1, 0.75], "c10": [0, 0.75, 0.5, 1], "c11": [0.5, 0.75, 1, 1]}
TRUTH = {
    "regions": [{"id": "A", "type": "group", "bbox": [0, 0, 1, 0.5]}, {"id": "B", "type": "table", "bbox": [0, 0.5, 1, 1]}],
    "grids": [{"id": "G1", "region": "B", "bbox": [0, 0.5, 1, 1], "cells": [{"id": k, "r": int(k[1]), "c": int(k[2]), "h": 1, "w": 1, "bbox": b} for k, b in BOXES.items()]}],
    "groups": [{"id": "W", "type": "checkbox", "members": [{"id": "w1", "type": "checkbox", "state": "selected", "bbox": [0.1, 0.1, 0.2, 0.2]}, {"id": "w2", "type": "checkbox", "state": "unselected", "bbox": [0.3, 0.1, 0.4, 0.2]}]}],
    "relations": [["f1", "w1", "field-widget"], ["f1", "c00", "key-to-cell"], ["A", "f1", "section-membership"]],
    "line_items": [{"id": "L1", "bbox": [0, 0.5, 1, 0.75]}],
    "fields": {"name": "f1"},
}
#: As good as the truth, in older spellings, with indexes from 1.
OLDER = {
    "region_boxes": [{"id": "ra", "type": "section", "box": [0, 0, 1, 0.5]}, {"id": "rb", "type": "table", "bbox": [0, 0.5, 1, 1]}],
    "grids": [{"id": "g", "parent": "rb", "cells": [{"id": "x" + k[1:], "row": int(k[1]) + 1, "col": int(k[2]) + 1, "bbox": b} for k, b in BOXES.items()]}],
    "widgets": [{"id": "p1", "type": "check_box", "mark": "x", "bbox": [0.1, 0.1, 0.2, 0.2], "group_id": "q"}, {"id": "p2", "type": "checkbox", "checked": False, "bbox": [0.3, 0.1, 0.4, 0.2], "group_id": "q"}],
    "answer": {"name": "v"},
    "edges": [{"from": "answer.name", "to": "widgets.p1", "type": "label-to-widget"}, {"source": "name", "target": "cells.x00", "type": "key_to_cell"}, {"u": "ra", "v": "answer.name"}],
}
#: One row of the grid as one wide cell, no parent named, one wrong state, widgets without a group, no edges.
PARTIAL = {
    "regions": [{"id": "r", "type": "table", "bbox": [0, 0.5, 1, 1]}],
    "local_grids": [{"id": "g", "cells": [{"row": 0, "col": 0, "colspan": 2, "bbox": [0, 0.5, 1, 0.75]}, {"row": 1, "col": 0, "bbox": BOXES["c10"]}, {"row": 1, "col": 1, "bbox": BOXES["c11"]}]}],
    "widgets": [{"id": "p1", "type": "checkbox", "selected": True, "bbox": [0.1, 0.1, 0.2, 0.2]}, {"id": "p2", "type": "checkbox", "selected": True, "bbox": [0.3, 0.1, 0.4, 0.2]}],
}
#: Parts of wrong kinds, repeated ids, spans by their ends, a piece without a box.
MESSY = {
    "regions": [{"id": "z", "type": "line-item-group", "bbox": [0, 0, 0.5, 0.5]}, "no", {"id": "y", "type": "text", "bbox": [0.5, 0.5, 0.4, 0.6]}],
    "local_grids": [{"id": "h", "cells": []}, 7, {"id": "h", "bbox": [0, 0, 0.5, 0.5], "cells": [{"id": "k", "row_start": 2, "row_end": 3, "col": 0}, {"id": "k", "row": 2, "col": 1, "rowspan": 2}, "odd"]}],
    "widgets": [{"type": "blankline", "text": "no"}, {"id": "s", "type": "signature", "blank": False}, "odd", {"id": "s", "type": "radio_button", "mark": "Unchecked"}],
    "widget_groups": [{"type": "Choice", "members": ["s", "nobody", {"id": "t", "type": "radio", "state": " Selected "}]}, None],
    "line_item_groups": [{"line_item_group_id": "li", "bbox": [0, 0, 0.5, 0.5]}, {"bbox": [0.1, 0.1, 0.2, 0.2]}],
    "relations": [{"source": "z", "target": "s"}, {"source": "z", "from": "y", "target": "s"}, 3],
}
PAGES = [("older", OLDER), ("partial", PARTIAL), ("messy", MESSY), ("broken", None)]


def _pages(spark: SparkSession) -> DataFrame:
    rows = [(name, json.dumps(TRUTH), json.dumps(page) if page is not None else "oops {") for name, page in PAGES]
    return spark.createDataFrame(rows, "page string, truth string, raw string")


def _listed(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: F.round(v, 4).cast("string")), " ")


def _counts(m: Column | str) -> Column:
    """k=v of a map, in order."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), " ")


def prediction_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each cell of the predicted grids."""
    p = P.parsed(_pages(spark), "raw").select("page", F.explode("grids").alias("g")).select("page", F.col("g.id").alias("grid"), F.col("g.region").alias("region"), _listed(F.col("g.bbox")).alias("grid_box"), F.explode("g.cells").alias("c"))
    return p.select("page", "grid", "region", "grid_box", F.col("c.id").alias("cell"), "c.r", "c.c", "c.h", "c.w")


GRID_ROWS = [
    *[("older", "g", "rb", "0.0 0.5 1.0 1.0", f"x{r}{c}", r, c, 1, 1) for r in (0, 1) for c in (0, 1)],
    ("partial", "g", "", "0.0 0.5 1.0 1.0", "g:cell:0", 0, 0, 1, 2), ("partial", "g", "", "0.0 0.5 1.0 1.0", "g:cell:1", 1, 0, 1, 1), ("partial", "g", "", "0.0 0.5 1.0 1.0", "g:cell:2", 1, 1, 1, 1),
    ("messy", "h", "", "0.0 0.0 0.5 0.5", "k", 2, 0, 2, 1), ("messy", "h", "", "0.0 0.0 0.5 0.5", "h/k", 2, 1, 2, 1), ("messy", "h", "", "0.0 0.0 0.5 0.5", "h:cell:2", -1, -1, -1, -1),
]


def prediction_widget_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each member of the predicted groups; a group without members has one too."""
    p = P.parsed(_pages(spark), "raw").select("page", F.explode("groups").alias("g")).select("page", F.col("g.id").alias("group_id"), F.col("g.type").alias("group_type"), F.explode_outer("g.members").alias("m"))
    return p.select("page", "group_id", "group_type", F.col("m.id").alias("member"), F.col("m.type").alias("type"), F.col("m.state").alias("state"))


GROUP_ROWS = [
    ("older", "q", "checkbox", "p1", "checkbox", "selected"), ("older", "q", "checkbox", "p2", "checkbox", "unselected"),
    ("partial", "singleton:p1", "checkbox", "p1", "checkbox", "selected"), ("partial", "singleton:p2", "checkbox", "p2", "checkbox", "selected"),
    ("messy", "pred-widget-group-0", "choice", "s", "signature", "filled"), ("messy", "pred-widget-group-0", "choice", "t", "radio", "selected"), ("messy", "pred-widget-group-1", "unknown", None, None, None),
    ("messy", "singleton:pred-widget-0", "blank_line", "pred-widget-0", "blank_line", "unknown"), ("messy", "singleton:pred-widget-2", "unknown", "pred-widget-2", "unknown", "unknown"),
    ("messy", "singleton:s#3", "radio", "s#3", "radio", "unselected"),
]


def prediction_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as told, typed regions and grids; equal boxes once."""
    p = P.parsed(_pages(spark), "raw").select("page", F.explode("line_items").alias("l"))
    return p.select("page", F.col("l.id").alias("id"), _listed(F.col("l.bbox")).alias("box"))


LINE_ROWS = [("older", "g", "0.0 0.5 1.0 1.0"), ("partial", "g", "0.0 0.5 1.0 1.0"), ("messy", "li", "0.0 0.0 0.5 0.5"), ("messy", "pred-line-item-1", "0.1 0.1 0.2 0.2")]


def prediction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was adapted, dropped or rejected, and the edges that are left."""
    p = P.parsed(_pages(spark), "raw")
    return p.select("page", F.array_join(F.transform("relations", lambda e: F.concat_ws(">", e["source"], e["target"], e["type"])), " ").alias("edges"), _counts("audit").alias("audit"))


AUDIT_ROWS = [
    ("older", "name>cells.x00>key-to-cell name>widgets.p1>field-widget ra>name>section-membership",
     "endpoint_aliases=4 grid_offsets_removed=1 parts_renamed=2 relation_spellings=2 relation_types_inferred=1 relations_accepted=3 relations_declared=3 widget_groups_from_ids=1"),
    ("partial", "", ""),
    ("messy", "", "endpoints_ambiguous=1 grids_rejected=2 regions_dropped=2 relation_conflicts=1 relation_types_unresolved=1 relations_declared=3 relations_rejected=3"),
    ("broken", "", "not_an_object=1"),
]


def endpoint_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted names and the true ones that they are matched with."""
    m = P.mappings(_pages(spark), "truth", "raw")
    return m.select("page", *[_counts(c).alias(c) for c in ("region_map", "widget_map", "line_item_map", "field_map")])


MAP_ROWS = [("older", "ra=A rb=B", "p1=w1 p2=w2", "g=L1", "name=f1"), ("partial", "r=B", "p1=w1 p2=w2", "g=L1", ""), ("messy", "", "", "", ""), ("broken", "", "", "", "")]


def lg_grits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local grids, widget groups and relations of each page against the truth."""
    s = P.page_scores(_pages(spark), "truth", "raw")
    return s.select("page", "valid", *[F.round(c, 6).alias(c) if c.endswith("total") else F.col(c) for c in P.COUNTS])


SCORE_ROWS = [
    ("older", True, 1.0, 1, 1, 1, 1.0, 1, 1, 3, 3, 3, 3, 3, 0),
    ("partial", True, 0.75, 1, 1, 1, 0.666667, 2, 1, 0, 0, 3, 0, 0, 1),
    ("messy", True, 0.0, 1, 1, 0, 0.0, 5, 1, 0, 0, 3, 0, 0, 0),
    ("broken", False, 0.0, 0, 1, 0, 0.0, 0, 1, 0, 0, 3, 0, 0, 0),
]


def hierarchical_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order has one of the first two pages or a broken one: scores by template."""
    own = _pages(spark).where("page <> 'messy'").withColumn("n", F.when(F.col("page") == "older", 0).when(F.col("page") == "partial", 1).otherwise(2))
    p = X.pages(spark, sf_dir).select(F.col("template_name").alias("model"), F.pmod("o_orderkey", F.lit(3)).cast("int").alias("n"))
    r = P.run_rollup(P.page_scores(p.join(F.broadcast(own), "n"), "truth", "raw"))
    return r.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in r.schema])


ROLLUP_SQL = f"""WITH {X.INDEX_SQL}, s(n, valid, lg, lp, wg, wp, rm, rp, rk, tk, pr) AS (VALUES (0, true, 1.0::DOUBLE, 1, 1.0::DOUBLE, 1, 3, 3, 3, 3, 0), (1, true, 0.75, 1, 2 / 3.0::DOUBLE, 2, 0, 0, 0, 0, 1), (2, false, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0)),
p AS (SELECT n_name AS model, s.* FROM pg JOIN s ON o_orderkey % 3 = n)
SELECT model, count(*) AS n_pages, count(*) FILTER (valid) AS n_valid, round(avg(2 * lg / (lp + 1)), 6) AS lg_macro, round(avg(2 * wg / (wp + 1)), 6) AS wg_macro, round(avg(2.0 * rm / (rp + 3)), 6) AS rel_macro, round(avg(CASE WHEN rk + tk > 0 THEN 2.0 * rm / (rk + tk) END), 6) AS rel_known_macro,
  round(2 * sum(lg) / (sum(lp) + count(*)), 6) AS lg_corpus, round(2 * sum(wg) / (sum(wp) + count(*)), 6) AS wg_corpus, round(2 * sum(rm) / (sum(rp) + 3.0 * count(*)), 6) AS rel_corpus, round(CASE WHEN sum(rk + tk) > 0 THEN 2.0 * sum(rm) / sum(rk + tk) END, 6) AS rel_known_corpus,
  round(CASE WHEN sum(rp) > 0 THEN sum(rm) / sum(rp) END, 6) AS rel_precision, round(sum(rm) / (3.0 * count(*)), 6) AS rel_recall, sum(pr)::BIGINT AS parents_recovered FROM p GROUP BY 1"""

SPECS = [
    {"id": "yes", "bbox": [0, 0, 1, 1], "type": "checkbox", "group": "g1", "group_type": "checkbox", "field": ["Member", "Yes"], "owner": ["Member"], "labels": ["Yes", "yes_box"], "rule": "option_membership"},
    {"id": "no", "bbox": [0, 2, 1, 3], "type": "checkbox", "group": "g1", "group_type": "checkbox", "field": ["Member", "No"], "owner": ["Member"], "labels": ["No"], "rule": "option_membership"},
    {"id": "row_b", "bbox": [0, 9, 1, 10], "type": "checkbox", "group": "g2", "group_type": "checkbox", "field": ["Rows", "Item", "Paid"], "owner": ["Rows", "Item"], "labels": [], "rule": "answer_presence"},
    {"id": "row_a", "bbox": [0, 5, 1, 6], "type": "checkbox", "group": "g2", "group_type": "checkbox", "field": ["Rows", "Item", "Paid"], "owner": ["Rows", "Item"], "labels": [], "rule": "answer_presence"},
]
ANSWERS = [("option", {"member": " yes "}), ("leaves", {"member": {"yes": "no", "other": 1}, "rows": [{"item": {"paid": ""}}, {"item": {"paid": "x"}}]}), ("empty", {})]


def widget_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a template's widgets on three pages, and where they come from."""
    rows = spark.createDataFrame([(n, json.dumps(SPECS), json.dumps(a)) for n, a in ANSWERS], "page string, specs string, answer string")
    g = P.resolved_groups(rows, "specs", "answer").select("page", _counts("sources").alias("sources"), F.explode("groups").alias("g"))
    return g.select("page", "sources", F.col("g.id").alias("group_id"), F.array_join(F.transform("g.members", lambda m: F.concat_ws("=", m["id"], m["state"])), " ").alias("states"))


STATE_ROWS = [
    ("option", "option_membership=2 unknown=2", "g1", "yes=selected no=unselected"), ("option", "option_membership=2 unknown=2", "g2", "row_b=unknown row_a=unknown"),
    ("leaves", "answer_presence=3 option_membership=1", "g1", "yes=unselected no=unselected"), ("leaves", "answer_presence=3 option_membership=1", "g2", "row_b=selected row_a=unselected"),
    ("empty", "unknown=4", "g1", "yes=unknown no=unknown"), ("empty", "unknown=4", "g2", "row_b=unknown row_a=unknown"),
]

OLD_TRUTH = {"widgets": [{"type": "checkbox", "mark": "check", "bbox": [0, 0, 10, 10]}, {"type": "checkbox", "bbox": [0, 100, 10, 110]}], "line_item_groups": [{"bbox": [0, 0, 100, 50]}], "relations": [{"source": "a/field_Name", "target": "anything", "type": "key-value"}, {"source": "root", "target": "b__Date", "type": "parent-child"}]}
OLD_PAGES = [
    ("same", OLD_TRUTH),
    ("near", {"widgets": [{"type": "checkbox", "selected": True, "bbox": [30, 0, 40, 10]}, {"type": "checkbox", "selected": True, "bbox": [0, 100, 10, 110]}], "grids": [{"cells": [{"bbox": [0, 0, 50, 50]}, {"bbox": [100, 50, 50, 0]}]}], "answer": {"Form": {"Name": "x", "Date": "y"}}}),
    ("none", {}),
]


def legacy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widgets, line items and relations of three pages in the older metrics."""
    rows = spark.createDataFrame([(n, json.dumps(OLD_TRUTH), json.dumps(p)) for n, p in OLD_PAGES], "page string, truth string, raw string")
    s = P.older_scores(rows, "truth", "raw")
    return s.select("page", *[F.round(c, 6).alias(c) for c in ("widget_f1", "line_item_f1", "relation_f1")])


# near: the first box is 30 off, within 35, and selected as the truth's; the second contradicts it: 1 of 2 and 2. The cells together are the line item.
# The answer tells Form>Name, Form>Date (children Name, Date) and the values of Name and Date: 4 edges, of which (Name, value) and (child Date) are true.
OLD_ROWS = [("same", 1.0, 1.0, 1.0), ("near", 0.5, 1.0, 0.666667), ("none", 0.0, 0.0, 0.0)]

PIECES = [
    ("merged", {"grids": [{"id": "t", "bbox": [0, 0, 1, 1], "cells": [{"id": "a", "row": 0, "col": 0}, {"id": "b", "row": 0, "col": 1}]}, {"id": "u", "parent": "t", "cells": [{"id": "c", "row": 1, "col": 0, "colspan": 2}]}], "relations": [{"source": "u", "target": "grid:u", "type": "reading-order"}]}),
    ("overlap", {"grids": [{"id": "t", "cells": [{"row": 0, "col": 0}]}, {"id": "u", "parent": "t", "cells": [{"row": 0, "col": 0}]}], "relations": []}),
    ("region", {"regions": [{"id": "t"}], "grids": [{"id": "t", "cells": [{"row": 0, "col": 0}]}, {"id": "u", "parent": "t", "cells": [{"row": 1, "col": 0}]}], "edges": []}),
    ("filled", {"local_grids": [{"id": "g", "cells": [{"id": "c"}, {"id": "d", "row": 0}]}], "cells": [{"id": "c", "row_index": 2, "column": 1}, {"id": "d"}, {"id": "d"}], "relations": [{"source": "c", "target": "d"}]}),
    ("fields", {"fields": [{"id": "f", "items": ["w"]}, {"id": "x"}], "widgets": [{"id": "w"}, {"id": "w"}], "relation_edges": [{"u": "w", "v": "w", "r": "field_widget"}, {"source": "region.nobody", "target": "x", "type": "odd"}]}),
]


def grid_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older predictions: pieces of grids, cells filled in, groups from fields, and edges with ambiguous or unknown ends."""
    a = P.adapted(spark.createDataFrame([(n, json.dumps(p)) for n, p in PIECES], "page string, raw string"), "raw")
    part = lambda p: F.coalesce(F.get_json_object("envelope", p), F.lit("none"))
    return a.select("page", part("$.local_grids[*].id").alias("grids"), part("$.relations").alias("relations"), part("$.widget_groups[*].id").alias("groups"), _counts("audit").alias("audit"))


PIECE_ROWS = [
    ("merged", '"t"', '[{"source":"local_grids.t","target":"local_grids.t","type":"reading-order"}]', "none", "endpoint_aliases=2 grid_groups_merged=1 grid_pieces_merged=1 parts_renamed=1 relations_accepted=1 relations_declared=1"),
    ("overlap", '["t","u"]', "[]", "none", "grid_merges_rejected=1 parts_renamed=1"),
    ("region", '["t","u"]', "[]", "none", "parts_renamed=1"),
    ("filled", '"g"', "[]", "none", "grid_cells_filled=1 relation_types_unresolved=1 relations_declared=1 relations_rejected=1"),
    ("fields", "none", '[{"source":"__legacy_ambiguous_source_0__","target":"__legacy_ambiguous_target_0__","type":"field-widget"},{"source":"__legacy_unresolved_source_1__","target":"x","type":"odd"}]', '"f"', "endpoints_ambiguous=2 endpoints_unresolved=1 relation_spellings=1 relations_accepted=2 relations_declared=2 widget_groups_from_fields=1"),
]

ROLES = ("key", "value", "section", "widget", "line_item_group", "cell", "table", "unknown")


def relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, t) for s in ROLES for t in ROLES], "source string, target string").withColumn("type", L.relation_type(F.col("source"), F.col("target")))


#: What the roles tell, pair by pair; all other pairs tell nothing.
TOLD = {("key", "widget"): "field-widget", ("section", "widget"): "field-widget", ("key", "key"): "parent-child", ("key", "value"): "key-value", ("key", "cell"): "key-to-cell"}
TOLD |= {("section", t): "section-membership" for t in ("section", "key", "value", "table", "cell", "line_item_group")}
TOLD |= {("line_item_group", t): "line-item-membership" for t in ROLES} | {(s, "line_item_group"): "line-item-membership" for s in ROLES if s != "section"}


def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


def widget_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as widgets whose kind and evidence differ: said, flagged, marked, filled or written."""
    line = X.table(spark, sf_dir, "lineitem")
    n = F.pmod("l_linenumber", F.lit(6))
    kind = F.when(n < 3, "checkbox").otherwise("blank_line")
    none = F.lit(None).cast("boolean")
    s = L.widget_state(
        kind, F.when(n == 0, F.when(F.col("l_returnflag") == "A", " Checked ").otherwise("off")), F.when(n.isin(1, 5), F.col("l_linestatus") == "O"),
        F.when(n == 2, F.when(F.col("l_tax") > 0.06, "x").when(F.col("l_tax") > 0.03, "Unselected").otherwise(" ")), F.when(n == 3, F.col("l_returnflag") == "N"), none,
        F.when(n == 4, F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")).when(F.col("l_discount") > 0.02, "No")),
    )
    return line.select(n.cast("int").alias("evidence"), s.alias("state")).groupBy("evidence", "state").agg(F.count("*").alias("n"))


STATE_SQL = """WITH s AS (SELECT (l_linenumber % 6)::INT AS evidence, CASE l_linenumber % 6
  WHEN 0 THEN CASE WHEN l_returnflag = 'A' THEN 'checked' ELSE 'off' END
  WHEN 1 THEN CASE WHEN l_linestatus = 'O' THEN 'selected' ELSE 'unselected' END
  WHEN 2 THEN CASE WHEN l_tax > 0.06 THEN 'selected' WHEN l_tax > 0.03 THEN 'unselected' ELSE 'unknown' END
  WHEN 3 THEN CASE WHEN l_returnflag = 'N' THEN 'filled' ELSE 'blank' END
  WHEN 4 THEN CASE WHEN l_discount > 0.05 THEN 'filled' ELSE 'unknown' END
  ELSE CASE WHEN l_linestatus = 'O' THEN 'filled' ELSE 'blank' END END AS state FROM lineitem) SELECT evidence, state, count(*) AS n FROM s GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (prediction_grids, prediction_widget_groups, prediction_line_items, prediction_audit, endpoint_maps, lg_grits, hierarchical_rollup, widget_resolution, legacy_metrics, grid_pieces, relation_types, widget_states)}
SQL = {
    "prediction_grids": values(GRID_ROWS, "page, grid, region, grid_box, cell, r, c, h, w"),
    "prediction_widget_groups": values(GROUP_ROWS, "page, group_id, group_type, member, type, state"),
    "prediction_line_items": values(LINE_ROWS, "page, id, box"),
    "prediction_audit": values(AUDIT_ROWS, "page, edges, audit"),
    "endpoint_maps": values(MAP_ROWS, "page, region_map, widget_map, line_item_map, field_map"),
    "lg_grits": values(SCORE_ROWS, "page, valid, " + ", ".join(P.COUNTS)),
    "hierarchical_rollup": ROLLUP_SQL,
    "widget_resolution": values(STATE_ROWS, "page, sources, group_id, states"),
    "legacy_metrics": values(OLD_ROWS, "page, widget_f1, line_item_f1, relation_f1"),
    "grid_pieces": values(PIECE_ROWS, "page, grids, relations, groups, audit"),
    "relation_types": values([(s, t, TOLD.get((s, t))) for s in ROLES for t in ROLES], "source, target, type"),
    "widget_states": STATE_SQL,
}
