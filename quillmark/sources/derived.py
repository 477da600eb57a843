"""Pages, answers and predictions derived from the star schema, so that every operator has real input.

A page is an order: its template is the customer's nation, its answer a nested JSON object of the order,
the customer and the line items. Models are gold with seeded damage: a leaf is altered if the hash of
(model, page, path) falls below the model's severity, and a page is missing or cut short likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.hashing import bound, chosen, code, mark

#: model: (severity of leaves, share of pages missing, share of pages cut short)
MODELS = {"m0": (0.0, 0.0, 0.0), "m1": (0.1, 0.02, 0.03), "m2": (0.3, 0.05, 0.05)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, items): each order's line items as an array in a fixed order."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*order).alias("i")), "l_orderkey")
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items"))


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df shuffled by a key into a number of partitions that is asked for.

    What follows costs much for a row and little for a byte, so adaptive execution must not put it into few tasks by its size, nor
    leave it in as many as the file has. The grouping and the join on the key use this very shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: sample_id, template_name and the page's source columns."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.withColumns({"sample_id": F.concat_ws("__", "n_name", F.col("o_orderkey").cast("string")), "template_name": F.col("n_name")})


def with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = dealt(pages(spark, sf_dir), "o_orderkey").join(items(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    empty = F.array().cast(held.schema["items"].dataType)
    return held.withColumn("items", F.coalesce("items", empty))


def answer(text: Column | None = None, number=None) -> Column:
    """The answer's struct; text(path, value) and number(path, value) may alter leaves."""
    text, number = text or (lambda path, v: v), number or (lambda path, v: v)
    at = lambda i, leaf: F.concat(F.lit("items/"), i.cast("string"), F.lit(f"/{leaf}"))
    return F.struct(
        F.struct(text(F.lit("order/status"), F.col("o_orderstatus")).alias("status"), text(F.lit("order/priority"), F.col("o_orderpriority")).alias("priority"), number(F.lit("order/total"), F.col("o_totalprice")).alias("total")).alias("order"),
        F.struct(text(F.lit("customer/name"), F.col("c_name")).alias("name"), text(F.lit("customer/segment"), F.col("c_mktsegment")).alias("segment"), number(F.lit("customer/balance"), F.col("c_acctbal")).alias("balance")).alias("customer"),
        F.transform("items", lambda x, i: F.struct(number(at(i, "qty"), x["l_quantity"]).alias("qty"), number(at(i, "price"), x["l_extendedprice"]).alias("price"), text(at(i, "flag"), x["l_returnflag"]).alias("flag"))).alias("items"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, template_name, answer_json."""
    return with_items(spark, sf_dir).select("sample_id", "template_name", F.to_json(answer()).alias("answer_json"))


def models(spark: SparkSession, only: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """model and the marks of its severity and of its missing and broken pages."""
    return spark.createDataFrame([(m, mark(bound(s)), mark(bound(a)), mark(bound(a + b))) for m, (s, a, b) in MODELS.items() if m in only], "model string, severity string, missing string, bad string")


def page_pairs(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """model, sample_id, template_name, answer_json, raw_text: every page of every model asked for, derived in one pass; what a model missed is null."""
    each = with_items(spark, sf_dir).crossJoin(F.broadcast(models(spark, only)))
    hit = lambda path: chosen(F.col("severity"), F.col("model"), F.col("sample_id"), path)
    damaged = answer(lambda p, v: F.when(hit(p), F.concat(v, F.lit("~"))).otherwise(v), lambda p, v: F.when(hit(p), v + 1).otherwise(v))
    fate = code("page", F.col("model"), F.col("sample_id"))
    whole = each.withColumn("fate", fate).withColumn("j", F.when(F.col("fate") >= F.col("missing"), F.to_json(damaged)))
    raw = F.when(F.col("fate") < F.col("bad"), F.expr("substring(j, 1, length(j) - 1)")).otherwise(F.col("j"))
    return whole.select("model", "sample_id", "template_name", F.to_json(answer()).alias("answer_json"), raw.alias("raw_text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, sample_id, raw_text: what each model returned; pages that it missed have no row."""
    return page_pairs(spark, sf_dir).select("model", "sample_id", "raw_text").where("raw_text is not null")


def _u(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 16))::UBIGINT::HUGEINT"


#: DuckDB: the same index, gold leaves, models and predicted leaves, in long form.
INDEX_SQL = """
pg AS (SELECT n_name || '__' || o_orderkey AS sample_id, n_name AS template_name, * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
it AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS k FROM lineitem),
leaf AS (
  SELECT sample_id, template_name, 'order/status' AS path, o_orderstatus AS s, NULL::DOUBLE AS v FROM pg
  UNION ALL SELECT sample_id, template_name, 'order/priority', o_orderpriority, NULL FROM pg
  UNION ALL SELECT sample_id, template_name, 'order/total', NULL, o_totalprice FROM pg
  UNION ALL SELECT sample_id, template_name, 'customer/name', c_name, NULL FROM pg
  UNION ALL SELECT sample_id, template_name, 'customer/segment', c_mktsegment, NULL FROM pg
  UNION ALL SELECT sample_id, template_name, 'customer/balance', NULL, c_acctbal FROM pg
  UNION ALL SELECT sample_id, template_name, 'items/' || k || '/qty', NULL, l_quantity FROM it JOIN pg ON l_orderkey = o_orderkey
  UNION ALL SELECT sample_id, template_name, 'items/' || k || '/price', NULL, l_extendedprice FROM it JOIN pg ON l_orderkey = o_orderkey
  UNION ALL SELECT sample_id, template_name, 'items/' || k || '/flag', l_returnflag, NULL FROM it JOIN pg ON l_orderkey = o_orderkey)
"""
MODELS_SQL = "mo(model, severity, missing, bad) AS (VALUES " + ", ".join(f"('{m}', {bound(s)}::HUGEINT, {bound(a)}::HUGEINT, {bound(a + b)}::HUGEINT)" for m, (s, a, b) in MODELS.items()) + ")"
PREDICTED_SQL = f"""
fate AS (SELECT model, sample_id, template_name, severity, CASE WHEN u < missing THEN 'missing_prediction' WHEN u < bad THEN 'invalid_json' ELSE 'ok' END AS status
  FROM (SELECT *, {_u("'page|' || model || '|' || sample_id")} AS u FROM pg CROSS JOIN mo)),
both_leaves AS (SELECT f.model, l.*, f.status, CASE WHEN hit THEN l.s || '~' ELSE l.s END AS ps, CASE WHEN hit THEN l.v + 1 ELSE l.v END AS pv
  FROM (SELECT f0.model, f0.status, l0.sample_id AS sid, l0.path AS lp, {_u("f0.model || '|' || l0.sample_id || '|' || l0.path")} < f0.severity AS hit FROM fate f0 JOIN leaf l0 ON f0.sample_id = l0.sample_id) f
  JOIN leaf l ON f.sid = l.sample_id AND f.lp = l.path),
toks AS (SELECT model, sample_id, t, sum(g) AS g, sum(p) AS p FROM (
    SELECT model, sample_id, lower(coalesce(s, v::VARCHAR)) AS t, 1 AS g, 0 AS p FROM both_leaves
    UNION ALL SELECT model, sample_id, lower(coalesce(ps, pv::VARCHAR)), 0, 1 FROM both_leaves WHERE status = 'ok') GROUP BY ALL),
pm AS (
  SELECT f.model, f.sample_id, f.template_name, f.status, f.status = 'ok' AS valid, l.n_gt, CASE WHEN f.status = 'ok' THEN l.n_equal ELSE 0 END AS n_equal,
    CASE WHEN f.status = 'ok' THEN v.hits ELSE 0 END AS v_hits, v.total AS v_total, f.status = 'ok' AND l.n_equal = l.n_gt AS exact,
    CASE WHEN f.status = 'ok' THEN l.w_equal ELSE 0 END AS w_equal, l.w_total
  FROM fate f
  JOIN (SELECT model, sample_id, count(*) AS n_gt, count(*) FILTER (s IS NOT DISTINCT FROM ps AND v IS NOT DISTINCT FROM pv) AS n_equal,
          count(*) FILTER (path IN ('order/status', 'order/priority')) AS w_total,
          count(*) FILTER (path IN ('order/status', 'order/priority') AND s IS NOT DISTINCT FROM ps) AS w_equal FROM both_leaves GROUP BY ALL) l ON f.model = l.model AND f.sample_id = l.sample_id
  JOIN (SELECT model, sample_id, sum(least(g, p)) AS hits, sum(g) AS total FROM toks GROUP BY ALL) v ON f.model = v.model AND f.sample_id = v.sample_id)
"""
PAGE_METRICS_SQL = f"WITH {INDEX_SQL}, {MODELS_SQL}, {PREDICTED_SQL}"
