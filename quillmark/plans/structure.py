"""Queries: boxes, regions, groups, topology and relations of the derived pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import boxes as B
from quillmark.functions.hashing import chosen, code, mark
from quillmark.functions.text import let
from quillmark.operators import structure as S
from quillmark.sources import derived as X
from quillmark.sources.derived import _u

#: Shift of a predicted box by the fourth of its hash, and the severity of a wrong type.
SHIFTS, WRONG = (0, 4, 60, 400), 0.1
QUARTER = 1 << 62


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, sample_id, truth, predicted: regions of each page as arrays. Item k lies in a lane of its own."""
    held = X.with_items(spark, sf_dir).crossJoin(F.broadcast(X.models(spark).where("model <> 'm0'").select("model")))
    kind = lambda x: F.when(x["l_returnflag"] == "A", "label").when(x["l_returnflag"] == "N", "value").when(x["l_linestatus"] == "O", "group").otherwise("table")
    box = lambda x, i, dx: B.box(F.lit(20.0) + dx, i * 50.0, F.lit(20.0) + dx + x["l_quantity"] * 10, i * 50.0 + 35)

    def shift(i: Column) -> Column:
        quarter = lambda u: reduce(lambda out, q: F.when(u < F.lit(mark((q + 1) * QUARTER)), float(SHIFTS[q])).otherwise(out), (2, 1, 0), F.lit(float(SHIFTS[3])))
        return let(code("box", F.col("model"), F.col("sample_id"), i.cast("string")), quarter)

    moved = lambda x, i: let(shift(i), lambda dx: box(x, i, dx))
    guess = lambda x, i: F.when(chosen(WRONG, "type", F.col("model"), F.col("sample_id"), i.cast("string")), "figure").when(x["l_returnflag"] == "R", "table").otherwise("text")
    return held.select(
        "model", "sample_id", "template_name",
        F.transform("items", lambda x, i: F.struct(kind(x).alias("kind"), box(x, i, F.lit(0.0)).alias("box"))).alias("truth"),
        F.transform("items", lambda x, i: F.struct(guess(x, i).alias("kind"), moved(x, i).alias("box"))).alias("predicted"),
    )


BOX_SQL = f"""
bx AS (SELECT model, sample_id, template_name, it.*, l_quantity * 10 AS w, CASE WHEN l_returnflag = 'A' THEN 'label' WHEN l_returnflag = 'N' THEN 'value' WHEN l_linestatus = 'O' THEN 'group' ELSE 'table' END AS gk,
    CASE WHEN {_u("'type|' || model || '|' || sample_id || '|' || k")} < {int(WRONG * 2**64)}::HUGEINT THEN 'figure' WHEN l_returnflag = 'R' THEN 'table' ELSE 'text' END AS pk,
    CASE {_u("'box|' || model || '|' || sample_id || '|' || k")} // {QUARTER}::HUGEINT WHEN 0 THEN {SHIFTS[0]} WHEN 1 THEN {SHIFTS[1]} WHEN 2 THEN {SHIFTS[2]} ELSE {SHIFTS[3]} END AS dx
  FROM it JOIN pg ON l_orderkey = o_orderkey CROSS JOIN (SELECT model FROM mo WHERE model <> 'm0')),
ov AS (SELECT *, greatest(0, w - dx) / (w + dx) AS iou, (pk = 'text' AND gk IN ('label', 'value')) OR (pk = 'table' AND gk IN ('table', 'group')) AS fits FROM bx),
pr AS (SELECT mo.model, pg.sample_id, count(o.k) AS n, count(*) FILTER (fits AND iou >= 0.5) AS tp_50, count(*) FILTER (fits AND iou >= 0.75) AS tp_75
  FROM pg CROSS JOIN (SELECT model FROM mo WHERE model <> 'm0') mo LEFT JOIN ov o ON o.model = mo.model AND o.sample_id = pg.sample_id GROUP BY ALL)
"""
PAGES = f"WITH {X.INDEX_SQL}, {X.MODELS_SQL}, {BOX_SQL}"


def region_f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.region_matches(boxed(spark, sf_dir), "truth", "predicted")
    return m.groupBy("model").agg(*[F.round(F.avg(B.f1(F.col(f"tp_{t}"), F.col("n_pred"), F.col("n_gt"))), 6).alias(f"r_f1_{t}") for t in (50, 75)])


def region_prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.region_matches(boxed(spark, sf_dir), "truth", "predicted").groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp_50", "n_pred", "n_gt")])
    return m.select("model", "tp_50", "n_pred", "n_gt", F.round(F.try_divide("tp_50", "n_pred"), 6).alias("precision"), F.round(F.try_divide("tp_50", "n_gt"), 6).alias("recall"), F.round(B.f1(F.col("tp_50"), F.col("n_pred"), F.col("n_gt")), 6).alias("f1"))


def lig_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item groups: the box around a page's tables and groups; pages without one don't apply."""
    part = lambda c, kinds: F.transform(F.filter(c, lambda r: r["kind"].isin(*kinds)), lambda r: r["box"])
    p = boxed(spark, sf_dir).select("model", "sample_id", S.union_box(part("truth", ("table", "group"))).alias("g"), S.union_box(part("predicted", ("table",))).alias("p"))
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit("group").alias("kind"), F.col(c).alias("box"))))
    m = S.region_matches(p.where("g is not null").select("model", "sample_id", one("g").alias("truth"), one("p").alias("predicted")), "truth", "predicted", (0.5,), typed=False)
    return m.groupBy("model").agg(F.count("*").alias("n_pages"), F.round(F.avg(B.f1(F.col("tp_50"), F.col("n_pred"), F.col("n_gt"))), 6).alias("lig_f1"))


LIG_SQL = f"""{PAGES},
g AS (SELECT model, sample_id, min(20) AS x1, min(k * 50) AS y1, max(20 + w) AS x2, max(k * 50 + 35) AS y2 FROM bx WHERE gk IN ('table', 'group') GROUP BY ALL),
p AS (SELECT model, sample_id, min(20 + dx) AS x1, min(k * 50) AS y1, max(20 + dx + w) AS x2, max(k * 50 + 35) AS y2 FROM bx WHERE pk = 'table' GROUP BY ALL),
j AS (SELECT g.model, p.model IS NOT NULL AS said, greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i,
    (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa FROM g LEFT JOIN p ON g.model = p.model AND g.sample_id = p.sample_id)
SELECT model, count(*) AS n_pages, round(avg(CASE WHEN said AND i / (ga + pa - i) >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS lig_f1 FROM j GROUP BY model"""


def topology_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (row, column, rows, columns): one row an item, three columns; a damaged row is predicted as one wide cell."""
    held = X.with_items(spark, sf_dir).crossJoin(F.broadcast(X.models(spark)))
    cell = lambda r, c, w: F.struct(r.cast("int").alias("r"), F.lit(c).alias("c"), F.lit(1).alias("h"), F.lit(w).alias("w"))
    gold = F.flatten(F.transform("items", lambda x, i: F.array(*[cell(i, c, 1) for c in range(3)])))
    said = F.flatten(F.transform("items", lambda x, i: F.when(chosen(F.col("severity"), "grid", F.col("model"), F.col("sample_id"), i.cast("string")), F.array(cell(i, 0, 3))).otherwise(F.array(*[cell(i, c, 1) for c in range(3)]))))
    scored = held.select("model", S.set_f1(said, gold).alias("f"))
    return scored.groupBy("model").agg(F.count("f").alias("n_pages"), F.round(F.avg("f"), 6).alias("topology_f1"))


TOPOLOGY_SQL = f"""WITH {X.INDEX_SQL}, {X.MODELS_SQL},
c AS (SELECT model, sample_id, count(*) AS n, count(*) FILTER ({_u("'grid|' || model || '|' || sample_id || '|' || k")} < severity) AS bad FROM it JOIN pg ON l_orderkey = o_orderkey CROSS JOIN mo GROUP BY ALL)
SELECT model, count(*) AS n_pages, round(avg(2.0 * 3 * (n - bad) / (3 * n + 3 * (n - bad) + bad)), 6) AS topology_f1 FROM c GROUP BY model"""


def bbox_normalize_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = X.table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag")
    x1, y1 = F.col("l_quantity") * 30 - 200, F.col("l_linenumber") * 150.0
    coords = F.array(x1, y1, x1 + F.pmod(F.floor("l_extendedprice"), F.lit(400)) - 60, F.when(F.col("l_linenumber") == 6, F.lit(float("nan"))).otherwise(y1 + 120))
    space = F.when(F.col("l_returnflag") == "A", "pixel").when(F.col("l_returnflag") == "N", "normalized_1000").otherwise("none")
    s = line.select(space.alias("space"), B.strict(coords, space, F.lit(1240.0), F.lit(900.0)).alias("s"))
    return s.groupBy("space", F.col("s.status").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("s.box.x1"), 4).alias("x1"), F.round(F.sum("s.box.x2"), 4).alias("x2"), F.round(F.sum("s.box.y2"), 4).alias("y2"))


BBOX_SQL = """
WITH r AS (SELECT CASE l_returnflag WHEN 'A' THEN 'pixel' WHEN 'N' THEN 'normalized_1000' ELSE 'none' END AS space, l_linenumber = 6 AS broken,
    CASE l_returnflag WHEN 'A' THEN 1240.0 WHEN 'N' THEN 1000.0 END AS w, CASE l_returnflag WHEN 'A' THEN 900.0 WHEN 'N' THEN 1000.0 END AS h,
    l_quantity * 30 - 200 AS x1, l_linenumber * 150.0 AS y1, l_quantity * 30 - 200 + floor(l_extendedprice)::BIGINT % 400 - 60 AS x2, l_linenumber * 150.0 + 120 AS y2 FROM lineitem),
n AS (SELECT space, broken, w, x1 / w AS x1, y1 / h AS y1, x2 / w AS x2, y2 / h AS y2 FROM r),
c AS (SELECT *, least(1, greatest(0, x1)) AS a1, least(1, greatest(0, y1)) AS b1, least(1, greatest(0, x2)) AS a2, least(1, greatest(0, y2)) AS b2 FROM n),
s AS (SELECT *, CASE WHEN broken THEN 'malformed' WHEN w IS NULL THEN 'unsupported_space' WHEN x2 <= x1 OR y2 <= y1 THEN 'reversed_or_degenerate' WHEN a2 <= a1 OR b2 <= b1 THEN 'outside_page'
    WHEN a1 = x1 AND a2 = x2 AND b1 = y1 AND b2 = y2 THEN 'ok' ELSE 'clipped' END AS status FROM c)
SELECT space, status, count(*) AS n, round(sum(a1) FILTER (status IN ('ok', 'clipped')), 4) AS x1, round(sum(a2) FILTER (status IN ('ok', 'clipped')), 4) AS x2, round(sum(b2) FILTER (status IN ('ok', 'clipped')), 4) AS y2 FROM s GROUP BY ALL"""


def rel_f1_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges region -> nation -> customer -> order; predicted ones are retyped, reversed or lose an endpoint by hash."""
    nation = X.table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"), F.lit("section-membership").alias("type"))
    customer = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target"), F.lit("parent-child").alias("type"))
    orders = X.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"), F.lit("key-value").alias("type"))
    truth = nation.union(customer).union(orders)
    own = lambda what: (what, F.col("source"), F.col("target"))
    flip, odd = chosen(0.1, *own("flip")), chosen(0.15, *own("type"))
    seen = truth.select(F.concat(F.lit("p"), F.when(flip, F.col("target")).otherwise(F.col("source"))).alias("source"), F.concat(F.lit("p"), F.when(flip, F.col("source")).otherwise(F.col("target"))).alias("target"), F.when(odd, F.lit("key-value")).otherwise(F.col("type")).alias("type"))
    ids = truth.select(F.explode(F.array("source", "target")).alias("truth")).distinct().where(~chosen(0.05, "lost", F.col("truth")))
    counts = S.typed_edges(truth, seen, ids.select(F.concat(F.lit("p"), "truth").alias("predicted"), "truth"))
    return counts.withColumn("f1", F.round(B.f1(F.col("tp"), F.col("pred"), F.col("gt"), None), 6))


RELATION_SQL = f"""
WITH t AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t, 'section-membership' AS k FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'parent-child' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'key-value' FROM orders),
p AS (SELECT *, {_u("'flip|' || s || '|' || t")} < {int(0.1 * 2**64)}::HUGEINT AS flip, CASE WHEN {_u("'type|' || s || '|' || t")} < {int(0.15 * 2**64)}::HUGEINT THEN 'key-value' ELSE k END AS pk,
   {_u("'lost|' || s")} >= {int(0.05 * 2**64)}::HUGEINT AND {_u("'lost|' || t")} >= {int(0.05 * 2**64)}::HUGEINT AS known FROM t),
u AS (SELECT k AS type, count(*) FILTER (NOT flip AND pk = k AND known) AS tp, 0 AS pred, count(*) AS gt FROM p GROUP BY k UNION ALL SELECT pk, 0, count(*), 0 FROM p GROUP BY pk)
SELECT type, sum(tp)::BIGINT AS tp, sum(pred)::BIGINT AS pred, sum(gt)::BIGINT AS gt, round(2 * sum(tp) / (sum(pred) + sum(gt)), 6) AS f1 FROM u GROUP BY type"""

QUERIES = {f.__name__: f for f in (bbox_normalize_audit, region_f1_macro, region_prf_micro, lig_f1, topology_f1, rel_f1_typed)}
SQL = {
    "bbox_normalize_audit": BBOX_SQL,
    "region_f1_macro": f"{PAGES} SELECT model, round(avg(CASE WHEN n = 0 THEN 1 ELSE 1.0 * tp_50 / n END), 6) AS r_f1_50, round(avg(CASE WHEN n = 0 THEN 1 ELSE 1.0 * tp_75 / n END), 6) AS r_f1_75 FROM pr GROUP BY model",
    "region_prf_micro": f"{PAGES} SELECT model, sum(tp_50)::BIGINT AS tp_50, sum(n)::BIGINT AS n_pred, sum(n)::BIGINT AS n_gt, round(sum(tp_50) / sum(n), 6) AS precision, round(sum(tp_50) / sum(n), 6) AS recall, round(sum(tp_50) / sum(n), 6) AS f1 FROM pr GROUP BY model",
    "lig_f1": LIG_SQL,
    "topology_f1": TOPOLOGY_SQL,
    "rel_f1_typed": RELATION_SQL,
}
