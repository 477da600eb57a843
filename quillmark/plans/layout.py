"""Queries: layout structure, annotations, indexes and release records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import boxes as B
from quillmark.functions.hashing import chosen
from quillmark.operators import layout as L
from quillmark.operators import structure as S
from quillmark.sources import derived as X
from quillmark.sources import files as Z
from quillmark.sources.derived import _u

GONE = 0.3


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as rows of a page: k, and whether the row is gone."""
    held = X.with_items(spark, sf_dir).select("sample_id", "template_name", F.posexplode("items").alias("k", "x"))
    return held.withColumn("gone", chosen(GONE, "row", F.col("sample_id"), F.col("k").cast("string")))


ROWS = f"WITH {X.INDEX_SQL}, rw AS (SELECT sample_id, template_name, k, l_quantity, l_linenumber, l_extendedprice, {_u("'row|' || sample_id || '|' || k")} < {int(GONE * 2**64)}::HUGEINT AS gone FROM it JOIN pg ON l_orderkey = o_orderkey)"


def grid_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by line number, columns by the middle of the box; sums over each template."""
    cells = _rows(spark, sf_dir).select("sample_id", "template_name", F.col("x.l_linenumber").alias("row_id"), (F.col("x.l_quantity") * 10 + 20).alias("middle"))
    g = L.grid_places(cells, "sample_id", "row_id", "middle")
    return g.groupBy("template_name").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("c").alias("c"), F.max("r").alias("last_r"), F.max("c").alias("last_c"))


def implicit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-column cells of rows that aren't gone; what is missing inside the bounds."""
    kept = _rows(spark, sf_dir).where("not gone").select("sample_id", F.col("k").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1).alias("h"), F.lit(2).alias("w"))
    return L.implicit_cells(kept, "sample_id").groupBy("sample_id").agg(F.count("*").alias("n_missing"), F.min("r").alias("first_row"))


def tiled_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rows that aren't gone still tile their bounds, by template."""
    kept = _rows(spark, sf_dir).where("not gone").select("template_name", "sample_id", F.col("k").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1).alias("h"), F.lit(2).alias("w"))
    return L.tiles(kept, ["template_name", "sample_id"]).groupBy("template_name").agg(F.count("*").alias("n"), F.count_if("whole").alias("n_whole"))


def cell_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes a hundredth apart: runs of rows that aren't gone are components."""
    held = X.with_items(spark, sf_dir)
    row = F.transform("items", lambda x, i: F.struct(i.alias("r"), F.lit(0).alias("c"), F.lit(1).alias("h"), F.lit(1).alias("w"), B.box(F.lit(0.1), i * 0.05, F.lit(0.9), i * 0.05 + 0.04).alias("box"), chosen(GONE, "row", F.col("sample_id"), i.cast("string")).alias("gone")))
    kept = held.select("sample_id", "template_name", F.filter(row, lambda c: ~c["gone"]).alias("cells"))
    parts = L.cell_components(kept, "cells")
    return parts.groupBy("template_name").agg(F.sum(F.size("cells")).alias("n_cells"), F.sum(F.size(F.array_distinct("component"))).alias("n_components"))


def smallest_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item boxes in nested sections of 300, 600 and 1200 high: the smallest that holds the middle."""
    rows = _rows(spark, sf_dir).select("sample_id", F.concat(F.lit("item"), "k").alias("id"), B.box(F.lit(20.0), F.col("k") * 50.0, 20.0 + F.col("x.l_quantity") * 10, F.col("k") * 50.0 + 35).alias("box"))
    sections = X.pages(spark, sf_dir).select("sample_id", F.explode(F.array(*[F.struct(F.lit(f"s{h}").alias("id"), B.box(F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(float(h))).alias("box")) for h in (300, 600, 1200)])).alias("s")).select("sample_id", "s.*")
    return S.smallest_parent(rows, sections).groupBy("parent").agg(F.count("*").alias("n"))


def recovered_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's items as one grid: the only one of two disjoint sections that holds all of them, if one does."""
    grids = _rows(spark, sf_dir).select("sample_id", F.lit("g").alias("grid"), B.box(F.lit(20.0), F.col("k") * 50.0, F.lit(90.0), F.col("k") * 50.0 + 35).alias("box"))
    sections = X.pages(spark, sf_dir).select("sample_id", F.explode(F.array(F.struct(F.lit("top").alias("region"), B.box(F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(200.0)).alias("box")), F.struct(F.lit("page").alias("region"), B.box(F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(500.0)).alias("box")))).alias("s")).select("sample_id", "s.*")
    return L.recovered_parents(grids, sections, "sample_id").groupBy("region").agg(F.count("*").alias("n"))


def annotation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotation rows: a user's last value of each kind."""
    e = X.table(spark, sf_dir, "events").withColumn("value", F.round("value", 4))
    return L.folded(e, "user_id", "event_type", "value", "event_id", ["view", "click", "error"])


def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, segment: labels along the edges; segments of a nation that share a label are ambiguous."""
    r = X.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("label"))
    n = X.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.concat(F.lit("r"), "n_regionkey").alias("source"))
    c = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.concat(F.lit("n"), "c_nationkey").alias("source"))
    edges = n.union(c).select("source", F.col("id").alias("target"))
    p = L.field_paths(r.union(n.select("id", "label")).union(c.select("id", "label")), edges)
    return p.select("id", F.array_join("path", "/").alias("path"), "ambiguous")


def text_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts by brand: which way most are longer."""
    p = X.table(spark, sf_dir, "part").select("p_brand", B.box(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.pmod("p_partkey", F.lit(50)) + 1.0).alias("box"))
    return L.orientation(p, ["p_brand"])


def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer").join(X.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.concat(F.lit("s"), "c_mktsegment").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target"))
    g = L.graph_statistics(c, ["n_name"])
    return g.withColumns({"branching": F.round("branching", 6), "density": F.round("density", 8)})


def geometry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("template_name", B.box(F.lit(20.0), F.col("k") * 50.0, 20.0 + F.col("x.l_quantity") * 10, F.col("k") * 50.0 + 35).alias("box"))
    g = L.geometry(rows, ["template_name"])
    return g.select("template_name", "n_boxes", *[F.round(c, 4).alias(c) for c in ("width_mean", "width_deviation", "area_mean", "coverage")])


def page_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' rasters against their template's first page: places taken, and mean cosine."""
    held = X.with_items(spark, sf_dir)
    r = held.select("template_name", "o_orderkey", L.occupancy(F.transform("items", lambda x, i: B.box(F.lit(0.0), i * 0.125, x["l_quantity"] / 50, i * 0.125 + 0.1)), 4).alias("v"))
    first = r.groupBy("template_name").agg(F.min_by("v", "o_orderkey").alias("w"))
    return r.join(first, "template_name").groupBy("template_name").agg(F.sum(F.aggregate("v", F.lit(0), lambda a, x: a + x)).alias("taken"), F.round(F.avg(L.cosine(F.col("v"), F.col("w"))), 6).alias("cosine"))


def degraded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of degraded pages, some broken: pairs by variant and level, and what was left out by reason."""
    p = X.pages(spark, sf_dir).select("template_name", F.col("o_orderkey").cast("string").alias("o"), "sample_id")
    n = F.pmod(F.col("o").cast("long"), F.lit(10))
    path = F.when(n == 0, F.concat_ws("/", F.lit("x"), "o")).when(n == 1, F.concat_ws("/", F.lit("test"), F.lit("dilate"), F.lit("extreme"), "template_name", "o")).when(n == 2, F.concat_ws("/", F.lit("test"), F.lit("dilate"), F.lit("low"), F.lit("NOWHERE"), "o")).otherwise(F.concat_ws("/", F.lit("test"), F.lit("erode"), F.when(n > 6, "high").otherwise("low"), "template_name", "o"))
    index, reasons = Z.degraded_index(p.select(path.alias("path")), p)
    kept = index.groupBy(F.concat_ws("/", "degradation_variant", "degradation_level").alias("what")).agg(F.count("*").alias("n"))
    return kept.union(reasons.select(F.col("reason").alias("what"), "n"))


def inherited_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("base", "pixel", None), ("child", None, "base"), ("grandchild", None, "child"), ("own", "normalized_1", "base"), ("loop1", None, "loop2"), ("loop2", None, "loop1"), ("lost", None, "nothing")]
    return Z.resolved_spaces(spark.createDataFrame(rows, "run string, source_space string, inherits string"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have a line item, a large total or an open state: distinct ids by template."""
    p = X.pages(spark, sf_dir)
    lines = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(p, "o_orderkey", "left_semi").join(p.select("o_orderkey", "sample_id"), "o_orderkey")
    ids = Z.attempted(lines, p.where("o_totalprice > 300000"), p.where("o_orderstatus = 'O'"))
    return ids.groupBy(F.substring_index("sample_id", "__", 1).alias("template_name")).agg(F.count("*").alias("n"))


def latest_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last error event."""
    e = X.table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", F.round("value", 4).alias("value"), "props")
    return Z.latest(e, "user_id", "event_id")


def meta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed keys of each event's JSON, by kind of event."""
    e = X.table(spark, sf_dir, "events").select("event_type", Z.summary_of(F.col("props"), ["k", "other"])["k"].cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def dedup_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that nearly coincide with a section go; half the rows have such a one."""
    row = F.flatten(F.transform("items", lambda x, i: F.array(F.struct(F.lit("section").alias("kind"), B.box(F.lit(0.0), i * 50.0, F.lit(100.0), i * 50.0 + 40).alias("box")), F.struct(F.lit("region").alias("kind"), B.box(F.lit(0.0), i * 50.0, F.when(x["l_returnflag"] == "A", 99.0).otherwise(60.0), i * 50.0 + 40).alias("box")))))
    held = X.with_items(spark, sf_dir).select("template_name", F.size("items").alias("n"), F.size(S.deduplicated(row)).alias("kept"))
    return held.groupBy("template_name").agg(F.sum("n").alias("n_rows"), F.sum("kept").alias("n_kept"))


def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout for each nation: fields are its segments with values of its customers; elements by kind."""
    c = X.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("boxes"))
    value = lambda kind: F.struct(F.lit(kind).alias("data_type"))
    field = F.struct(F.col("c_mktsegment").alias("semantic_key"), F.concat(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: value("text")), F.array(value("checkbox"))).alias("values"), F.array(F.struct(F.lit("sub").alias("semantic_key"))).alias("keys"))
    layouts = c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(field)).alias("fields"))).alias("layout"))
    return L.layout_elements(layouts, "layout").groupBy("c_nationkey", "element", "kind", "depth").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (grid_inference, implicit_cells, tiled_grids, cell_components, smallest_parents, recovered_parents, annotation_fold, field_paths, text_orientation, graph_statistics, geometry_features, page_occupancy, degraded_index, inherited_spaces, attempts, latest_error, meta_summary, dedup_regions, layout_elements)}
SQL = {
    "grid_inference": f"{ROWS}, g AS (SELECT template_name, dense_rank() OVER (PARTITION BY sample_id ORDER BY l_linenumber) - 1 AS r, dense_rank() OVER (PARTITION BY sample_id ORDER BY l_quantity * 10 + 20) - 1 AS c FROM rw) SELECT template_name, count(*) AS n, sum(r)::BIGINT AS r, sum(c)::BIGINT AS c, max(r)::INT AS last_r, max(c)::INT AS last_c FROM g GROUP BY 1",
    "implicit_cells": f"{ROWS}, b AS (SELECT sample_id, max(k) AS m, count(*) AS n FROM rw WHERE NOT gone GROUP BY 1), g AS (SELECT rw.sample_id, min(k) AS f FROM rw JOIN b USING (sample_id) WHERE gone AND k < m GROUP BY 1) SELECT sample_id, 2 * (m + 1 - n) AS n_missing, f::INT AS first_row FROM b JOIN g USING (sample_id)",
    "tiled_grids": f"{ROWS}, b AS (SELECT template_name, sample_id, max(k) - min(k) + 1 = count(*) AS whole FROM rw WHERE NOT gone GROUP BY ALL) SELECT template_name, count(*) AS n, count(*) FILTER (whole) AS n_whole FROM b GROUP BY 1",
    "cell_components": f"{ROWS}, v AS (SELECT *, k - lag(k) OVER (PARTITION BY sample_id ORDER BY k) IS DISTINCT FROM 1 AS starts FROM rw WHERE NOT gone), n AS (SELECT template_name, count(*) AS a, count(*) FILTER (starts) AS b FROM v GROUP BY 1) SELECT template_name, coalesce(a, 0)::BIGINT AS n_cells, coalesce(b, 0)::BIGINT AS n_components FROM (SELECT DISTINCT template_name FROM pg) LEFT JOIN n USING (template_name)",
    "smallest_parents": f"{ROWS} SELECT CASE WHEN k * 50 + 17.5 <= 300 THEN 's300' WHEN k * 50 + 17.5 <= 600 THEN 's600' ELSE 's1200' END AS parent, count(*) AS n FROM rw GROUP BY 1",
    "recovered_parents": f"{ROWS}, m AS (SELECT sample_id, max(k) * 50 + 35 AS y FROM rw GROUP BY 1) SELECT 'page' AS region, count(*) AS n FROM m WHERE y > 200 AND y <= 500",
    "annotation_fold": "SELECT user_id, arg_max(round(value, 4), event_id) FILTER (event_type = 'view') AS view, arg_max(round(value, 4), event_id) FILTER (event_type = 'click') AS click, arg_max(round(value, 4), event_id) FILTER (event_type = 'error') AS error FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1",
    "field_paths": "WITH p AS (SELECT 'r' || r_regionkey AS id, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT *, count(*) OVER (PARTITION BY path) > 1 AS ambiguous FROM p",
    "text_orientation": "WITH v AS (SELECT p_brand, count(*) FILTER (p_size >= 1.35 * (p_partkey % 50 + 1)) AS horizontal, count(*) FILTER (p_partkey % 50 + 1 >= 1.35 * p_size) AS vertical FROM part GROUP BY 1) SELECT *, CASE WHEN vertical > horizontal THEN 'vertical' WHEN horizontal > 0 THEN 'horizontal' ELSE 'unknown' END AS orientation FROM v",
    "graph_statistics": "WITH g AS (SELECT n_name, count(*) AS links, count(DISTINCT c_mktsegment) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_name, links, round(links / s, 6) AS branching, links + s AS nodes, round(links / ((links + s) * (links + s - 1)), 8) AS density FROM g",
    "geometry_features": f"{ROWS} SELECT template_name, count(*) AS n_boxes, round(avg(l_quantity * 10), 4) AS width_mean, round(stddev_pop(l_quantity * 10), 4) AS width_deviation, round(avg(l_quantity * 350), 4) AS area_mean, round(sum(l_quantity * 350), 4) AS coverage FROM rw GROUP BY 1",
    "page_occupancy": f"""WITH {X.INDEX_SQL}, v AS (SELECT template_name, o_orderkey, p, coalesce(bool_or((p % 4 + 0.5::DOUBLE) * 0.25 <= l_quantity / 50 AND (p // 4 + 0.5::DOUBLE) * 0.25 >= k * 0.125::DOUBLE AND (p // 4 + 0.5::DOUBLE) * 0.25 <= k * 0.125::DOUBLE + 0.1::DOUBLE), false)::INT AS t
          FROM pg CROSS JOIN (SELECT unnest(range(16)) AS p) LEFT JOIN it ON l_orderkey = o_orderkey GROUP BY ALL),
        f AS (SELECT template_name, min(o_orderkey) AS o FROM pg GROUP BY 1), w AS (SELECT v.template_name, v.p, v.t FROM v JOIN f ON v.template_name = f.template_name AND v.o_orderkey = f.o),
        d AS (SELECT v.template_name, v.o_orderkey, sum(v.t) AS taken, sum(v.t * w.t) AS vw, sum(v.t * v.t) AS vv, sum(w.t * w.t) AS ww FROM v JOIN w ON v.template_name = w.template_name AND v.p = w.p GROUP BY ALL)
        SELECT template_name, sum(taken)::BIGINT AS taken, round(avg(CASE WHEN vv = 0 AND ww = 0 THEN 1.0 WHEN vv = 0 OR ww = 0 THEN 0.0 ELSE vw / sqrt(vv * ww) END), 6) AS cosine FROM d GROUP BY 1""",
    "degraded_index": f"""WITH {X.INDEX_SQL}, w AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'short_path' WHEN o_orderkey % 10 = 1 THEN 'unknown_level' WHEN o_orderkey % 10 = 2 THEN 'no_clean_page' WHEN o_orderkey % 10 > 6 THEN 'erode/high' ELSE 'erode/low' END AS what FROM pg) SELECT what, count(*) AS n FROM w GROUP BY 1""",
    "inherited_spaces": "SELECT * FROM (VALUES ('base', 'pixel'), ('child', 'pixel'), ('grandchild', 'pixel'), ('own', 'normalized_1'), ('loop1', NULL), ('loop2', NULL), ('lost', NULL)) AS t(run, source_space)",
    "attempts": f"WITH {X.INDEX_SQL} SELECT template_name, count(*) AS n FROM pg WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) OR o_totalprice > 300000 OR o_orderstatus = 'O' GROUP BY 1",
    "latest_error": "SELECT user_id, event_id, round(value, 4) AS value, props FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "meta_summary": "SELECT event_type, count(json_extract(props, '$.k')) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1",
    "dedup_regions": f"WITH {X.INDEX_SQL}, n AS (SELECT template_name, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'A') AS a FROM pg LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT template_name, n AS n_rows, 2 * n - a AS n_kept FROM n",
    "layout_elements": """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS v FROM customer GROUP BY ALL), t AS (SELECT c_nationkey, count(*) AS f, sum(v)::BIGINT AS v FROM c GROUP BY 1)
        SELECT c_nationkey, 'region' AS element, 'key' AS kind, 0 AS depth, f AS n FROM t UNION ALL SELECT c_nationkey, 'region', 'key', 1, f FROM t UNION ALL SELECT c_nationkey, 'region', 'text', 1, v FROM t UNION ALL SELECT c_nationkey, 'widget', 'checkbox', 1, f FROM t
        UNION ALL SELECT c_nationkey, 'relation', 'key-value', 0, v + f FROM t UNION ALL SELECT c_nationkey, 'relation', 'parent-child', 0, f FROM t""",
}
