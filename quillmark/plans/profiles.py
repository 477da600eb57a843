"""Queries: numeric and shape profiles, calibration levels, extremes, fallbacks, text neighbours and the gold identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import boxes as B
from quillmark.functions.text import dedup_form, holds_all, signature, words
from quillmark.operators import profile as P
from quillmark.operators.semantic import leaf_rows
from quillmark.plans.semantic import page_metrics
from quillmark.sources import derived as X

docs = lambda spark, d: X.table(spark, d, "documents")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.numeric_summary(docs(spark, sf_dir).withColumn("x", F.col("n_chars").cast("double")), ["lang"], "x"))


def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shape_profile(leaf_rows(X.answers(spark, sf_dir), "sample_id", "answer_json"), "sample_id")


def cross_modal_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("items"))
    p = X.pages(spark, sf_dir).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return _rounded(P.centred_correlation(p, "template_name", "o_totalprice", "items"))


def price_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extremes(X.pages(spark, sf_dir).select("template_name", "o_orderkey", "o_totalprice"), ["template_name"], "o_totalprice", "o_orderkey")


def five_level_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.five_levels(X.table(spark, sf_dir, "orders"), "o_totalprice")
    return p.groupBy("level").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"))


def clean_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' discounts by (order, line), or else by order alone from the first line."""
    line = X.table(spark, sf_dir, "lineitem")
    first = line.where("l_linenumber < 4").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("tax"))
    second = line.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_tax").alias("tax"))
    out = P.with_fallback(line.select("l_orderkey", "l_linenumber"), first, second, ["l_orderkey", "l_linenumber"], ["l_orderkey"], "tax")
    return out.groupBy("matched_by").agg(F.count("*").alias("n"), F.round(F.sum("tax"), 4).alias("tax"))


def signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the signature of segment and sign of balance."""
    c = X.table(spark, sf_dir, "customer").select("c_custkey", signature(F.array("c_mktsegment", F.when(F.col("c_acctbal") < 0, "minus").otherwise("plus"))).alias("signature"))
    return c.groupBy("signature").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_id"))


def sidecar_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's own text has its address, by the scheme's host."""
    p = X.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return p.select(host.alias("host"), holds_all(F.col("html"), F.array(F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit("<p>"))).alias("ok")).groupBy("host").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def dedup_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names in the form that ignores digits' values."""
    return X.table(spark, sf_dir, "customer").groupBy(dedup_form(F.col("c_name")).alias("form")).agg(F.count("*").alias("n"))


def box_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of polygons, their thousandths, and how near neighbouring parts' boxes are."""
    p = X.table(spark, sf_dir, "part").select("p_brand", F.array(F.lit(0.0), F.lit(0.0), F.col("p_size") / 100.0, F.lit(0.1), F.lit(0.05), F.col("p_size") / 50.0).alias("poly"))
    b = p.select("p_brand", B.around(F.col("poly")).alias("b"))
    s = b.select("p_brand", B.compact(F.col("b")).alias("c"), B.pair_score(F.col("b"), B.box(F.lit(0.0), F.lit(0.0), F.lit(0.3), F.lit(0.4))).alias("s"))
    return s.groupBy("p_brand").agg(F.sum(F.col("c")[2]).alias("x2"), F.sum(F.col("c")[3]).alias("y2"), F.round(F.avg("s"), 6).alias("score"))


def tfidf_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against each other and by words of four letters or more: the nearest three others."""
    b = X.table(spark, sf_dir, "benchmark")
    grams = F.filter(words(F.lower("text")), lambda w: F.length(w) >= 4)
    near = P.text_neighbours(b.withColumnRenamed("item_id", "query_id"), b, "query_id", "item_id", grams, 3, apart=True)
    return near.select("query_id", "item_id", "cosine")


def gold_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold model must score one wherever a metric applies."""
    m = page_metrics(spark, sf_dir).where("model = 'm0'").unpivot(["sample_id"], ["tsr_path", "vacc", "wacc", "page_em"], "metric", "value")
    return m.groupBy("metric").agg(F.count("value").alias("n"), F.count_if(F.abs(F.col("value") - 1) > 1e-12).alias("n_wrong"))


QUERIES = {f.__name__: f for f in (numeric_summary, schema_profile, cross_modal_correlation, price_extremes, five_level_calibration, clean_fallback, signature_groups, sidecar_check, dedup_forms, box_scores, tfidf_neighbours, gold_identity)}
SQL = {
    "numeric_summary": "SELECT lang, count(x) AS n, min(x) AS least, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.95), 6) AS p95, round(avg(x), 6) AS mean, max(x) AS most FROM (SELECT lang, n_chars::DOUBLE AS x FROM documents) GROUP BY lang",
    "schema_profile": f"WITH {X.INDEX_SQL} SELECT regexp_replace(path, '/[0-9]+/', '/*/') AS path, CASE WHEN v IS NULL THEN 'string' ELSE 'number' END AS kind, count(*) AS n, count(DISTINCT sample_id) AS n_rows FROM leaf GROUP BY ALL",
    "cross_modal_correlation": f"WITH {X.INDEX_SQL}, l AS (SELECT l_orderkey, count(*)::DOUBLE AS items FROM lineitem GROUP BY 1), p AS (SELECT template_name, o_totalprice AS a, items AS b FROM pg JOIN l ON o_orderkey = l_orderkey), c AS (SELECT a, b, a - avg(a) OVER w AS ca, b - avg(b) OVER w AS cb FROM p WINDOW w AS (PARTITION BY template_name)) SELECT round(corr(a, b), 6) AS overall, round(corr(ca, cb), 6) AS within FROM c",
    "price_extremes": f"WITH {X.INDEX_SQL}, r AS (SELECT template_name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY template_name ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (PARTITION BY template_name ORDER BY o_totalprice DESC, o_orderkey) AS b FROM pg) SELECT template_name, 'bottom' AS side, a::INT AS place, o_orderkey, o_totalprice FROM r WHERE a <= 3 UNION ALL SELECT template_name, 'top', b::INT, o_orderkey, o_totalprice FROM r WHERE b <= 3",
    "five_level_calibration": "WITH c AS (SELECT round(quantile_cont(o_totalprice, 0.15), 4) AS a, round(quantile_cont(o_totalprice, 0.35), 4) AS b, round(quantile_cont(o_totalprice, 0.65), 4) AS c, round(quantile_cont(o_totalprice, 0.85), 4) AS d FROM orders) SELECT 1 + (o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT + (o_totalprice >= d)::INT AS level, count(*) AS n, min(o_totalprice) AS least FROM orders CROSS JOIN c GROUP BY 1",
    "clean_fallback": "WITH a AS (SELECT l_orderkey, l_linenumber, max(l_tax) AS t FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL), b AS (SELECT l_orderkey, min(l_tax) AS t FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), j AS (SELECT a.t AS ta, b.t AS tb FROM lineitem l LEFT JOIN a ON l.l_orderkey = a.l_orderkey AND l.l_linenumber = a.l_linenumber LEFT JOIN b ON l.l_orderkey = b.l_orderkey) SELECT CASE WHEN ta IS NOT NULL THEN 'first' WHEN tb IS NOT NULL THEN 'second' END AS matched_by, count(*) AS n, round(sum(coalesce(ta, tb)), 4) AS tax FROM j GROUP BY 1",
    "signature_groups": "SELECT substr(sha256(c_mktsegment || chr(10) || CASE WHEN c_acctbal < 0 THEN 'minus' ELSE 'plus' END), 1, 16) AS signature, count(*) AS n, min(c_custkey) AS first_id FROM customer GROUP BY 1",
    "sidecar_check": "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n, count(*) FILTER (contains(html, regexp_extract(url, '/([a-z]{2})/', 1)) AND (contains(html, '<p>') OR contains(html, '&lt;p&gt;'))) AS n_ok FROM pages GROUP BY 1",
    "dedup_forms": "SELECT trim(regexp_replace(regexp_replace(lower(c_name), '[0-9]', '#', 'g'), '[^a-z#]+', ' ', 'g')) AS form, count(*) AS n FROM customer GROUP BY 1",
    "box_scores": """WITH b AS (SELECT p_brand, greatest(p_size / 100.0, 0.05)::DOUBLE AS x, greatest(0.1, p_size / 50.0)::DOUBLE AS y FROM part),
        s AS (SELECT *, least(x, 0.3) * least(y, 0.4) AS i, greatest(0, 1 - sqrt(((x - 0.3) / 2) ^ 2 + ((y - 0.4) / 2) ^ 2) / 0.5) AS near FROM b)
        SELECT p_brand, sum(round(x * 1000))::BIGINT AS x2, sum(round(y * 1000))::BIGINT AS y2, round(avg(greatest(i / (x * y + 0.12 - i), near)), 6) AS score FROM s GROUP BY 1""",
    "tfidf_neighbours": r"""WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: length(x) >= 4)) AS g FROM benchmark), t AS (SELECT item_id, g, count(*) AS tf FROM w GROUP BY ALL),
        i AS (SELECT g, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY 1), v AS (SELECT item_id, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS x FROM t JOIN i USING (g)),
        c AS (SELECT a.item_id AS query_id, b.item_id, round(sum(a.x * b.x), 6) AS cosine FROM v a JOIN v b USING (g) WHERE a.item_id <> b.item_id GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS r FROM c)
        SELECT query_id, item_id, cosine FROM k WHERE r <= 3""",
    "gold_identity": f"WITH {X.INDEX_SQL} SELECT unnest(['tsr_path', 'vacc', 'wacc', 'page_em']) AS metric, count(*) AS n, 0::BIGINT AS n_wrong FROM pg GROUP BY 1",
}
