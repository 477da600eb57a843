"""Queries: answer scores by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import semantic as S
from quillmark.sources import derived as X

WIDGETS = frozenset({("order", "status"), ("order", "priority")})


def page_metrics(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = tuple(X.MODELS)) -> DataFrame:
    """The fact: model, sample_id, template_name, counts and metrics. A filter on the model doesn't pass the kernel, so models that aren't wanted are to be left out here."""
    return S.with_metrics(S.score(X.page_pairs(spark, sf_dir, only), widgets=WIDGETS))


def _mean(name: str, metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = page_metrics(spark, sf_dir)
        return facts.groupBy("model").agg(F.count("*").alias("n_total"), F.count_if("valid").alias("n_valid"), F.round(F.avg(metric), 6).alias(name), F.round(F.avg(F.when(F.col("valid"), F.col(metric))), 6).alias(f"{name}_valid"))

    return query


def _mean_sql(name: str, metric: str) -> str:
    return f"{X.PAGE_METRICS_SQL} SELECT model, count(*) AS n_total, count(*) FILTER (valid) AS n_valid, round(avg({metric}), 6) AS {name}, round(avg({metric}) FILTER (valid), 6) AS {name}_valid FROM pm GROUP BY model"


def page_em_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_metrics(spark, sf_dir).groupBy("model").agg(F.count_if("exact").alias("n_exact"), F.count("*").alias("n_total"), F.round(F.avg("page_em"), 6).alias("page_em"))


def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by status, and each model's kind of run: comparable if all pages were tried and enough are valid."""
    pages = S.paired(X.answers(spark, sf_dir), X.models(spark), X.predictions(spark, sf_dir))
    facts = S.with_metrics(S.score(pages, widgets=WIDGETS))
    runs = facts.groupBy("model").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "invalid_json", "missing_prediction")], F.count("*").alias("n_total"))
    enough = F.col("n_ok") >= F.least(F.lit(5000), F.col("n_total"))
    kind = F.when(F.lower("model").contains("smoke"), "smoke").when(F.lower("model").contains("aligned"), "aligned_diagnostic").when(F.col("n_ok") == 0, "failed").when((F.col("n_missing_prediction") == 0) & enough, "comparable_raw").otherwise("partial_raw")
    return runs.withColumns({"invalid_rate": F.round(F.col("n_invalid_json") / F.col("n_total"), 6), "run_status": kind})


CDS = {"tsr_path": 0.4, "vacc": 0.4, "wacc": 0.2}


def cds_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_metrics(spark, sf_dir).withColumn("cds", S.weighted(CDS)).groupBy("model").agg(F.round(F.avg("cds"), 6).alias("cds"), F.round(F.min("cds"), 6).alias("lowest"), F.round(F.max("cds"), 6).alias("highest"))


QUERIES = {
    "tsr_path_by_model": _mean("tsr_path", "tsr_path"),
    "vacc_by_model": _mean("vacc", "vacc"),
    "wacc_by_model": _mean("wacc", "wacc"),
    "page_em_by_model": page_em_by_model,
    "coverage_status": coverage_status,
    "cds_by_model": cds_by_model,
}
SQL = {
    "tsr_path_by_model": _mean_sql("tsr_path", "n_equal / n_gt"),
    "vacc_by_model": _mean_sql("vacc", "v_hits / v_total"),
    "wacc_by_model": _mean_sql("wacc", "w_equal / w_total"),
    "page_em_by_model": f"{X.PAGE_METRICS_SQL} SELECT model, count(*) FILTER (exact) AS n_exact, count(*) AS n_total, round(avg(exact::INT), 6) AS page_em FROM pm GROUP BY model",
    "coverage_status": f"""{X.PAGE_METRICS_SQL}, r AS (SELECT model, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'invalid_json') AS n_invalid_json,
        count(*) FILTER (status = 'missing_prediction') AS n_missing_prediction, count(*) AS n_total FROM pm GROUP BY model)
        SELECT *, round(n_invalid_json / n_total, 6) AS invalid_rate, CASE WHEN n_ok = 0 THEN 'failed' WHEN n_missing_prediction = 0 AND n_ok >= least(5000, n_total) THEN 'comparable_raw' ELSE 'partial_raw' END AS run_status FROM r""",
    "cds_by_model": f"""{X.PAGE_METRICS_SQL}, c AS (SELECT model, (0.4 * n_equal / n_gt + 0.4 * v_hits / v_total + 0.2 * w_equal / w_total) AS cds FROM pm)
        SELECT model, round(avg(cds), 6) AS cds, round(min(cds), 6) AS lowest, round(max(cds), 6) AS highest FROM c GROUP BY model""",
}
