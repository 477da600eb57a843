"""Layout structure: annotations, fields, cells, grids, widgets, relations and older prediction formats."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.boxes import area
from quillmark.functions.metadata import part
from quillmark.functions.structures import EMPTY_MARKS, NO_WORDS, SECTION_MEMBERS, dicts
from quillmark.operators.lineage import cut
from quillmark.operators.pages import rowwise

def relation_type(source: Column, target: Column) -> Column:
    """Type of a relation by the roles of its ends; null if they don't tell."""
    return (
        F.when((target == "widget") & source.isin("key", "section"), "field-widget")
        .when((source == "key") & (target == "key"), "parent-child")
        .when((source == "key") & (target == "value"), "key-value")
        .when((source == "key") & (target == "cell"), "key-to-cell")
        .when((source == "section") & target.isin(*SECTION_MEMBERS), "section-membership")
        .when((source == "line_item_group") | (target == "line_item_group"), "line-item-membership")
    )


def folded(rows: DataFrame, key: str, name: str, value: str, order: str, names: list[str]) -> DataFrame:
    """One row an annotated item: of each named property the last value."""
    return rows.where(F.col(name).isin(names)).groupBy(key).agg(*[F.max_by(value, F.when(F.col(name) == n, F.col(order))).alias(n) for n in names])


def turned(edges: DataFrame, direction: str = "direction") -> DataFrame:
    """Edges with a left direction reversed."""
    left = F.col(direction) == "left"
    return edges.select(*[c for c in edges.columns if c not in ("source", "target", direction)], F.when(left, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(left, F.col("source")).otherwise(F.col("target")).alias("target"))


def field_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path, ambiguous): labels from a root to each node along edges (source, target), the shortest, then the first in order.

    A path that several nodes have is ambiguous. Breadth first, one join a level, as many levels as there are, each cut from its
    lineage. A node is reached once, so cycles end; what no root leads to has no row.
    """
    roots = nodes.join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    level = cut(roots.select("id", F.array("label").alias("path")))
    found = level
    labels = nodes.select(F.col("id").alias("target"), "label")
    while True:
        step = level.join(edges, F.col("id") == F.col("source")).join(labels, "target").select(F.col("target").alias("id"), F.array_append("path", F.col("label")).alias("path"))
        level = cut(step.join(found.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if level.isEmpty():
            return found.withColumn("ambiguous", F.count("*").over(Window.partitionBy("path")) > 1)
        found = found.union(level)


def grid_places(cells: DataFrame, page: str, row: str, x: str) -> DataFrame:
    """cells with r and c from 0: rows in the order of their ids, columns in the order of their centres."""
    return cells.withColumns({"r": (F.dense_rank().over(Window.partitionBy(page).orderBy(row)) - 1).cast("int"), "c": (F.dense_rank().over(Window.partitionBy(page).orderBy(x)) - 1).cast("int")})


def implicit_cells(cells: DataFrame, page: str) -> DataFrame:
    """(page, r, c) of positions inside a grid's bounds that no cell (r, c, h, w) covers."""
    bounds = cells.groupBy(page).agg(F.max(F.col("r") + F.col("h")).alias("rows"), F.max(F.col("c") + F.col("w")).alias("columns"))
    spread = lambda d, a, b, e, f: d.select(page, F.explode(F.sequence(a, b - 1)).alias("r"), e, f).select(page, "r", F.explode(F.sequence("__a", F.col("__b") - 1)).alias("c"))
    every = spread(bounds, F.lit(0), F.col("rows"), F.lit(0).alias("__a"), F.col("columns").alias("__b"))
    taken = spread(cells, F.col("r"), F.col("r") + F.col("h"), F.col("c").alias("__a"), (F.col("c") + F.col("w")).alias("__b"))
    return every.join(taken, [page, "r", "c"], "left_anti")


def tiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, whole: whether cells (r, c, h, w) fill their bounding rectangle exactly."""
    size = F.sum(F.col("h") * F.col("w"))
    around = (F.max(F.col("r") + F.col("h")) - F.min("r")) * (F.max(F.col("c") + F.col("w")) - F.min("c"))
    taken = cells.select(*by, F.explode(F.sequence("r", F.col("r") + F.col("h") - 1)).alias("i"), "c", "w").select(*by, "i", F.explode(F.sequence("c", F.col("c") + F.col("w") - 1)).alias("j"))
    distinct = taken.distinct().groupBy(*by).agg(F.count("*").alias("n"))
    return cells.groupBy(*by).agg(size.alias("size"), around.alias("around")).join(distinct, by).select(*by, ((F.col("size") == F.col("around")) & (F.col("n") == F.col("size"))).alias("whole"))


def recovered_parents(grids: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """(page, grid, region): the only region that holds all cells of a grid. Inputs: page, grid, box; page, region, box."""
    around = grids.groupBy(page, "grid").agg(*[(F.min if s in ("x1", "y1") else F.max)(f"box.{s}").alias(s) for s in ("x1", "y1", "x2", "y2")])
    r = regions.select(F.col(page).alias("__p"), "region", "box")
    inside = (F.col("x1") >= F.col("box.x1")) & (F.col("y1") >= F.col("box.y1")) & (F.col("x2") <= F.col("box.x2")) & (F.col("y2") <= F.col("box.y2"))
    return around.join(r, (F.col(page) == F.col("__p")) & inside).groupBy(page, "grid").agg(F.count("*").alias("n"), F.min("region").alias("region")).where("n = 1").drop("n")


def cell_components(df: DataFrame, cells: str, gap: float = 0.015, slack: float = -0.002) -> DataFrame:
    """df with ``component`` array<int>: for each cell (r, c, h, w, box) of a page the first cell that touching cells lead to.

    Cells touch if their boxes are at most ``gap`` apart in one direction and overlap in the other, and their rows and columns meet.
    """

    def kernel(own):
        own = own or []
        root = list(range(len(own)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        apart = lambda a, b, lo, hi: max(a["box"][lo], b["box"][lo]) - min(a["box"][hi], b["box"][hi])
        meets = lambda a, b, at, n: a[at] <= b[at] + b[n] and b[at] <= a[at] + a[n]
        for i, a in enumerate(own):
            for j in range(i):
                b = own[j]
                dx, dy = apart(a, b, "x1", "x2"), apart(a, b, "y1", "y2")
                if meets(a, b, "r", "h") and meets(a, b, "c", "w") and (dx <= gap and -dy >= slack or dy <= gap and -dx >= slack):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
        return ([find(i) for i in range(len(own))],)

    return rowwise(df, [cells], {"component": "array<int>"}, kernel)


def widget_state(kind: Column, state: Column, selected: Column, mark: Column, filled: Column, blank: Column, text: Column) -> Column:
    """State of a predicted widget: as said; of a checkbox or radio by its flag or mark; of others by their flags or text; ``unknown`` else."""
    form = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    flag = lambda x, yes, no: F.when(x, yes).otherwise(no)
    box = F.when(selected.isNotNull(), flag(selected, "selected", "unselected")).when(form(mark) == "", "unknown").otherwise(flag(form(mark).isin(*EMPTY_MARKS), "unselected", "selected"))
    line = F.when(filled.isNotNull(), flag(filled, "filled", "blank")).when(blank.isNotNull(), flag(blank, "blank", "filled")).when(selected.isNotNull(), flag(selected, "filled", "blank")).otherwise(flag(truthy(text), "filled", "unknown"))
    return F.when(form(state) != "", form(state)).when(kind.isin("checkbox", "radio"), box).otherwise(line)


def truthy(value: Column) -> Column:
    """Whether an answer's text stands for yes."""
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*NO_WORDS)


def reading_direction(language: Column, vertical: Column) -> Column:
    vertical_script = language.isin("zh", "ja", "ko")
    return F.when(language.isin("ar", "he", "fa", "ur"), "right_to_left").when(vertical & vertical_script, "top_to_bottom_right_to_left").otherwise("left_to_right")


def orientation(boxes: DataFrame, by: list[str], ratio: float = 1.35) -> DataFrame:
    """by, orientation: which way most text boxes are clearly longer."""
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    votes = boxes.groupBy(*by).agg(F.count_if(w >= ratio * h).alias("horizontal"), F.count_if(h >= ratio * w).alias("vertical"))
    return votes.withColumn("orientation", F.when(F.col("vertical") > F.col("horizontal"), "vertical").when(F.col("horizontal") > 0, "horizontal").otherwise("unknown"))


def graph_statistics(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, links, nodes, branching (children a parent), density."""
    ends = edges.select(*by, F.explode(F.array("source", "target")).alias("node")).groupBy(*by).agg(F.count_distinct("node").alias("nodes"))
    out = edges.groupBy(*by).agg(F.count("*").alias("links"), (F.count("*") / F.count_distinct("source")).alias("branching"))
    return out.join(ends, by).withColumn("density", F.when(F.col("nodes") > 1, F.col("links") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def geometry(boxes: DataFrame, by: list[str]) -> DataFrame:
    """by, means and deviations of width, height and area, and the summed area."""
    w, h, a = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"), area(F.col("box"))
    return boxes.groupBy(*by).agg(F.count("*").alias("n_boxes"), *[f(c).alias(f"{n}_{k}") for n, c in (("width", w), ("height", h), ("area", a)) for k, f in (("mean", F.avg), ("deviation", F.stddev_pop))], F.sum(a).alias("coverage"))


def occupancy(boxes: Column, size: int = 8) -> Column:
    """Raster of size x size: 1 where the middle of a place lies in a box of the unit page."""
    step = 1.0 / size
    middle = lambda k: (k.cast("double") + 0.5) * step
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    return F.transform(places, lambda p: F.exists(boxes, lambda b: (middle(p % size) >= b["x1"]) & (middle(p % size) <= b["x2"]) & (middle((p / size).cast("int")) >= b["y1"]) & (middle((p / size).cast("int")) <= b["y2"])).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 1 if both are zero, 0 if one is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    na, nb = dot(a, a), dot(b, b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(na * nb))))


def layout_elements(df: DataFrame, layout: str) -> DataFrame:
    """A row for each element of a recursive layout: element, path, kind, depth. Fields nest in keys; values hang on fields; sections hold tables."""

    def kernel(text):
        try:
            value = json.loads(text or "")
        except (ValueError, RecursionError):
            return ([],)
        if not isinstance(value, dict):
            return ([],)
        out = []
        stack = [((), f, 0) for f in reversed(dicts(value.get("fields")))]
        while stack:
            above, f, depth = stack.pop()
            path = (*above, str(f.get("semantic_key") or f.get("original_label") or "").strip())
            out.append(("region", path, "key", depth))
            values = [v for v in (f.get("value"), *dicts(f.get("values"))) if isinstance(v, dict)]
            for v in values:
                kind = str(v.get("data_type") or f.get("data_type") or "text")
                out.append(("widget" if re.search("check|radio|select", kind) else "cell" if "row_id" in v else "region", path, kind, depth + 1))
                out.append(("relation", path, "key-value", depth))
            children = dicts(f.get("keys"))
            out += [("relation", path, "parent-child", depth)] * len(children)
            stack += [(path, k, depth + 1) for k in reversed(children)]
        for s in dicts(part(part(value, "metadata"), "layout_structure").get("sections")):
            out.append(("region", (str(s.get("title")),), "section", 0))
            out += [("region", (str(s.get("title")),), "table", 1)] * len(s["table_regions"] if isinstance(s.get("table_regions"), list) else ())
        return ([{"element": e, "path": list(p), "kind": k, "depth": d} for e, p, k, d in out],)

    rows = rowwise(df, [layout], {"__e": "array<struct<element:string,path:array<string>,kind:string,depth:int>>"}, kernel)
    return rows.select(*[c for c in df.columns if c != layout], F.explode("__e").alias("e")).select("*", "e.*").drop("e")
