"""Queries: difficulty, constraints, ablation, robustness, selection and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.hashing import unit
from quillmark.operators import rollup as R
from quillmark.operators import summaries as Y
from quillmark.plans.semantic import page_metrics
from quillmark.sources import derived as X
from quillmark.sources.derived import _u

# --- difficulty ------------------------------------------------------------------------------------

FEATURES = ("n_pages", "n_items", "n_parts", "n_open", "max_items")
GROUPS = {"size": ["n_pages_norm"], "rows": ["n_items_norm", "max_items_norm"], "content": ["n_parts_norm"], "state": ["n_open_norm"]}


def template_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    parts = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    own = X.pages(spark, sf_dir).select("template_name", "o_orderkey", "o_orderstatus")
    sizes = own.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("template_name").agg(F.count("*").alias("n_pages"), F.sum(F.coalesce("lines", F.lit(0))).alias("n_items"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.max(F.coalesce("lines", F.lit(0))).alias("max_items"))
    distinct = own.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("template_name").agg(F.count_distinct("l_partkey").alias("n_parts"))
    return sizes.join(distinct, "template_name")


def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with structural and context score and level. What a layout would tell of sections, regions and direction follows from the counts."""
    f = template_features(spark, sf_dir)
    normed = f.withColumns({f"{c}_norm": R.midrank(F.col(c)) for c in FEATURES})
    order = Y.reading_order(F.col("n_pages") % 4, F.col("n_items") % 6, F.col("n_pages") % 5, F.col("n_items") % 3 == 0)
    regions = Y.cross_region(F.col("n_items") % 6, F.col("n_pages") % 8, F.col("n_open") % 2, F.col("n_items"), 4 * F.col("n_pages"))
    context = Y.context_score(F.col("max_items") / 12, F.col("n_parts_norm"), F.greatest(F.col("max_items") - 5, F.lit(0)).cast("double"), F.col("n_open_norm") > 0.5, order, F.col("n_pages") % 4, regions)
    scored = normed.withColumns({"s_form": R.structural(GROUPS), "c_context": context})
    total = scored.withColumn("d_main", F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("s_form") + F.col("c_context"))))
    return R.leveled(total, "d_main")


def difficulty_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difficulty(spark, sf_dir).select("template_name", "s_form", "c_context", F.round("d_main", 6).alias("d_main"), "level")


FEATURE_SQL = f"""WITH {X.INDEX_SQL},
ln AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1),
ft AS (SELECT template_name, count(*) AS n_pages, sum(coalesce(lines, 0))::BIGINT AS n_items, count(*) FILTER (o_orderstatus = 'O') AS n_open, max(coalesce(lines, 0)) AS max_items FROM pg LEFT JOIN ln ON o_orderkey = l_orderkey GROUP BY 1),
fp AS (SELECT template_name, count(DISTINCT l_partkey) AS n_parts FROM pg JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
fx AS (SELECT * FROM ft JOIN fp USING (template_name)),
nm AS (SELECT *, {", ".join(f"CASE WHEN {c} <= 0 THEN 0.0 WHEN min({c}) OVER () = max({c}) OVER () THEN 0.5 ELSE (rank() OVER (ORDER BY {c}) - 1 + count(*) OVER (PARTITION BY {c}) / 2.0) / count(*) OVER () END AS {c}_norm" for c in FEATURES)} FROM fx),
sc AS (SELECT *, round(0.25 * n_pages_norm + 0.25 * greatest(n_items_norm, max_items_norm) + 0.25 * n_parts_norm + 0.25 * n_open_norm, 4) AS s_form,
    round(0.2::DOUBLE * CASE WHEN max_items / 12 >= 0.75 THEN 1 WHEN max_items / 12 >= 0.4 THEN 0.5 ELSE 0 END + 0.15::DOUBLE * n_parts_norm + 0.15::DOUBLE * least(1, greatest(max_items - 6, 0) / 2) + 0.15::DOUBLE * (n_open_norm > 0.5)::INT
      + 0.15::DOUBLE * (CASE n_pages % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.25 ELSE 0.35 END + CASE n_items % 6 WHEN 2 THEN 0.04 WHEN 3 THEN 0.08 WHEN 4 THEN 0.12 WHEN 5 THEN 0.12 ELSE 0 END + CASE WHEN n_pages % 5 >= 3 THEN 0.08 WHEN n_pages % 5 = 2 THEN 0.04 ELSE 0 END + CASE WHEN n_items % 3 = 0 THEN 0.25 ELSE 0 END)
      + 0.15::DOUBLE * (n_pages % 4) / 3 + 0.05::DOUBLE * (CASE WHEN n_items % 6 >= 2 AND n_pages % 8 > 0 THEN least(0.35, 0.1 + 0.05 * (n_pages % 8)) ELSE 0 END + CASE WHEN n_items % 6 > 2 AND n_open % 2 > 0 THEN 0.1 ELSE 0 END + CASE WHEN n_items % 6 > 2 AND n_items > 4 * n_pages THEN 0.05 ELSE 0 END), 4) AS c_context FROM nm),
dm AS (SELECT *, least(2.0, greatest(0.0, s_form + c_context)) AS d_main FROM sc),
ct AS (SELECT quantile_cont(d_main, 0.158655) AS a, quantile_cont(d_main, 0.5) AS b, quantile_cont(d_main, 0.841345) AS c FROM dm),
df AS (SELECT dm.*, CASE WHEN round(d_main, 4) < a THEN 'L1' WHEN round(d_main, 4) < b THEN 'L2' WHEN round(d_main, 4) < c THEN 'L3' ELSE 'L4' END AS level FROM dm CROSS JOIN ct)"""
FACT_SQL = f"{FEATURE_SQL}, {X.MODELS_SQL}, {X.PREDICTED_SQL}, ft2 AS (SELECT pm.*, df.level, df.n_items, df.max_items, df.n_open, df.n_parts, n_equal / n_gt AS tsr_path, v_hits / v_total AS vacc, w_equal / w_total AS wacc FROM pm JOIN df USING (template_name))"
METRICS = ["tsr_path", "vacc"]


def _leveled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.annotated(page_metrics(spark, sf_dir), difficulty(spark, sf_dir).select("template_name", "level", *FEATURES), "template_name")[0]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def difficulty_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.by_level(_leveled_facts(spark, sf_dir), METRICS))


def difficulty_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.diagnostics(R.by_level(_leveled_facts(spark, sf_dir), METRICS), METRICS))


ROLLUP_SQL = "SELECT model, level, count(*) AS n_pages, count(DISTINCT template_name) AS n_templates, avg(tsr_path) AS tsr_path, avg(vacc) AS vacc FROM ft2 GROUP BY ALL"
DIAGNOSTIC_SQL = f"""{FACT_SQL}, rl AS ({ROLLUP_SQL}), lg AS (SELECT model, level, 'tsr_path' AS metric, tsr_path AS v FROM rl UNION ALL SELECT model, level, 'vacc', vacc FROM rl),
w AS (SELECT model, metric, max(v) FILTER (level = 'L1') AS L1, max(v) FILTER (level = 'L2') AS L2, max(v) FILTER (level = 'L3') AS L3, max(v) FILTER (level = 'L4') AS L4 FROM lg GROUP BY ALL)
SELECT model, metric, round(L1, 6) AS "L1", round(L2, 6) AS "L2", round(L3, 6) AS "L3", round(L4, 6) AS "L4", round(L1 - L4, 6) AS drop, round((L1 - L4) / L1, 6) AS relative_drop, (coalesce(L1 >= L2, false)::INT + coalesce(L2 >= L3, false)::INT + coalesce(L3 >= L4, false)::INT)::BIGINT AS adjacent_drops FROM w"""

# --- constraints and ablation ----------------------------------------------------------------------

FLAGS = ["many_parts", "long_tables", "many_open"]


def constraint_flags(features: DataFrame) -> DataFrame:
    """template_name and FLAGS: a signal reaches the upper quarter over templates and isn't zero, or a fixed bound."""
    cuts = features.agg(F.percentile("n_parts", 0.75).alias("p"), F.percentile("n_open", 0.75).alias("o"))
    held = features.crossJoin(F.broadcast(cuts))
    return held.select("template_name", ((F.col("n_parts") >= F.col("p")) & (F.col("n_parts") > 0)).alias("many_parts"), (F.col("max_items") > 11).alias("long_tables"), ((F.col("n_open") >= F.col("o")) & (F.col("n_open") > 0)).alias("many_open"))


def constraint_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = constraint_flags(template_features(spark, sf_dir))
    return _rounded(R.slices(page_metrics(spark, sf_dir).join(flags, "template_name"), FLAGS, METRICS))


_SLICE = '''SELECT model, '{f}' AS "constraint", count(DISTINCT template_name) FILTER ({f}) AS templates_with, count(DISTINCT template_name) FILTER (NOT {f}) AS templates_without, avg(tsr_path) FILTER ({f}) AS tw, avg(tsr_path) FILTER (NOT {f}) AS to_, avg(vacc) FILTER ({f}) AS vw, avg(vacc) FILTER (NOT {f}) AS vo FROM fl GROUP BY model'''
CONSTRAINT_SQL = f"""{FACT_SQL}, q AS (SELECT quantile_cont(n_parts, 0.75) AS p, quantile_cont(n_open, 0.75) AS o FROM df),
fl AS (SELECT ft2.*, n_parts >= p AND n_parts > 0 AS many_parts, max_items > 11 AS long_tables, n_open >= o AND n_open > 0 AS many_open FROM ft2 CROSS JOIN q),
s AS ({" UNION ALL ".join(_SLICE.format(f=f) for f in FLAGS)})
SELECT model, "constraint", templates_with, templates_without, round(tw, 6) AS tsr_path_with, round(to_, 6) AS tsr_path_without, round(vw, 6) AS vacc_with, round(vo, 6) AS vacc_without, round(to_ - tw, 6) AS tsr_path_delta, round(vo - vw, 6) AS vacc_delta FROM s"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page metrics with two components: one on every page, one only where the page is long."""
    return page_metrics(spark, sf_dir).withColumn("long_wacc", F.when(F.col("n_gt") > 15, F.col("wacc")))


def ablation_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.targeted(_components(spark, sf_dir), METRICS, {"widgets": "wacc", "long_pages": "long_wacc"}))


def ablation_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.targeted(_components(spark, sf_dir), METRICS, {"widgets": "wacc", "long_pages": "long_wacc"})
    return _rounded(R.over_models(t, ["component"], "delta"))


ABLATION_SQL = f"""{X.PAGE_METRICS_SQL}, m AS (SELECT *, n_equal / n_gt AS t, v_hits / v_total AS v, w_equal / w_total AS w FROM pm),
tg AS (SELECT model, 'widgets' AS component, count(*) AS n_pages, avg((t + v + w) / 3) AS w1, avg((t + v) / 2) AS w0 FROM m GROUP BY model
  UNION ALL SELECT model, 'long_pages', count(*), avg((t + v + w) / 3), avg((t + v) / 2) FROM m WHERE n_gt > 15 GROUP BY model)"""

# --- robustness ------------------------------------------------------------------------------------

#: Degradations, and those that move things on the page, so that places can't be compared.
VARIANTS, MOVING = ("blur_noise", "dilate", "erode", "occlusion_stain", "perspective_skew"), ("dilate", "perspective_skew")
SEVERITIES = {"low": 0.1, "medium": 0.25, "high": 0.5}


def degraded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with each variant and level: clean and degraded metrics; the spatial one is null for moving variants."""
    facts = page_metrics(spark, sf_dir).where("model <> 'm0'").select("model", "sample_id", "template_name", "tsr_path", "wacc", "n_gt")
    grid = spark.createDataFrame([(v, n, i, s) for v in VARIANTS for i, (n, s) in enumerate(SEVERITIES.items())], "variant string, level string, level_no int, severity double")
    each = facts.crossJoin(F.broadcast(grid))
    u = unit(F.col("variant"), F.col("level"), F.col("model"), F.col("sample_id")) / F.lit(str(1 << 64)).cast("decimal(20,0)")
    kept = 1 - F.col("severity") * F.round(u.cast("double"), 6)
    spatial = ~F.col("variant").isin(*MOVING)
    return each.select("model", "sample_id", "template_name", "variant", "level", "level_no", "n_gt", F.col("tsr_path").alias("tsr_path_clean"), (F.col("tsr_path") * kept).alias("tsr_path_degraded"), F.when(spatial, F.col("wacc")).alias("wacc_clean"), F.when(spatial, F.col("wacc") * kept).alias("wacc_degraded"))


PAIR_SQL = f"""{X.PAGE_METRICS_SQL},
lv(level, level_no, severity) AS (VALUES ('low', 0, 0.1::DOUBLE), ('medium', 1, 0.25), ('high', 2, 0.5)), vr(variant) AS (VALUES {", ".join(f"('{v}')" for v in VARIANTS)}),
kp AS (SELECT pm.*, variant, level, level_no, variant NOT IN ('dilate', 'perspective_skew') AS spatial, n_equal / n_gt AS t, w_equal / w_total AS w,
  1 - severity * round({_u("variant || '|' || level || '|' || model || '|' || sample_id")}::DOUBLE / 18446744073709551616.0, 6) AS keep FROM pm CROSS JOIN vr CROSS JOIN lv WHERE model <> 'm0'),
dp AS (SELECT model, sample_id, template_name, variant, level, level_no, n_gt, t AS tc, t * keep AS td, CASE WHEN spatial THEN w END AS wc, CASE WHEN spatial THEN w * keep END AS wd FROM kp)"""
BOTH = ["tsr_path", "wacc"]


def robustness_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.drops(degraded_pairs(spark, sf_dir), ["model", "variant", "level"], BOTH)).select("model", "variant", "level", "n_pairs", "tsr_path_clean", "tsr_path_degraded", "tsr_path_drop", "tsr_path_relative", "wacc_drop")


def robustness_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weight for each model; the share is that of the macro means."""
    by_model = R.drops(degraded_pairs(spark, sf_dir), ["model", "variant", "level"], BOTH)
    macro = by_model.groupBy("variant", "level").agg(F.count("*").alias("n_models"), F.avg("tsr_path_clean").alias("clean"), F.avg("tsr_path_degraded").alias("degraded"), F.avg("wacc_drop").alias("wacc_drop"))
    return _rounded(macro.withColumn("relative", F.when(F.col("clean") != 0, (F.col("clean") - F.col("degraded")) / F.col("clean"))))


def excess_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more pages with a component (many leaves) lose than pages without, by model, then over models."""
    pairs = degraded_pairs(spark, sf_dir).withColumn("present", F.col("n_gt") > 15)
    side = R.drops(pairs, ["model", "level", "present"], BOTH)
    wide = side.groupBy("model", "level").pivot("present", [True, False]).agg(F.first("tsr_path_drop"))
    return _rounded(wide.withColumn("excess", F.col("true") - F.col("false")).groupBy("level").agg(F.count("*").alias("n_models"), F.avg("true").alias("drop_with"), F.avg("false").alias("drop_without"), F.avg("excess").alias("excess_drop")))


def failure_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First level, from low to high, whose mean drop reaches a tenth or whose score falls below half the clean mean."""
    d = R.drops(degraded_pairs(spark, sf_dir), ["model", "variant", "level", "level_no"], BOTH)
    fails = (F.col("tsr_path_drop") >= 0.1) | (F.col("tsr_path_degraded") < 0.5 * F.col("tsr_path_clean"))
    return d.groupBy("model", "variant").agg(F.coalesce(F.min_by("level", F.when(fails, F.col("level_no"))), F.lit("not_reached")).alias("boundary"), F.round(F.max("tsr_path_drop"), 6).alias("largest_drop"))


# --- selection and comparison ----------------------------------------------------------------------


def best_run_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are suppliers: several a model, whose name differs in case."""
    s = X.table(spark, sf_dir, "supplier")
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Model").otherwise("model"), F.lit("_"), F.pmod("s_suppkey", F.lit(7)).cast("string"))
    runs = s.select(F.col("s_suppkey").alias("run_id"), name.alias("model_id"), F.pmod(F.col("s_suppkey") * 37, F.lit(11)).alias("n_valid"), F.floor(F.abs("s_acctbal") / 1000).cast("long").alias("schema_nted"), F.when(F.col("s_nationkey") > 3, F.col("s_nationkey").cast("long")).alias("value_ned"))
    return R.best_run(runs.where("n_valid > 0"), "model_id", ["n_valid", "schema_nted", "value_ned"], "run_id")


def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m1 against m2 on the same pages: wins, ties and losses of m1, and the mean difference."""
    facts = page_metrics(spark, sf_dir).where("model in ('m1', 'm2')").unpivot(["model", "sample_id"], ["tsr_path", "vacc", "wacc"], "metric", "value")
    pairs = facts.groupBy("metric", "sample_id").agg(F.max(F.when(F.col("model") == "m1", F.col("value"))).alias("a"), F.max(F.when(F.col("model") == "m2", F.col("value"))).alias("b")).where("a is not null and b is not null")
    d = F.col("a") - F.col("b")
    return pairs.groupBy("metric").agg(F.count("*").alias("n"), F.count_if(d > 1e-9).alias("wins"), F.count_if(F.abs(d) <= 1e-9).alias("ties"), F.count_if(d < -1e-9).alias("losses"), F.round(F.avg(d), 6).alias("mean_delta"))


def metric_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman (mean ranks) of metric pairs over templates and models."""
    m = page_metrics(spark, sf_dir).groupBy("model", "template_name").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("tsr_path", "vacc", "wacc")])
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    r = m.withColumns({f"{c}_rank": rank(c) for c in ("tsr_path", "vacc", "wacc")})
    pairs = [("tsr_path", "vacc"), ("tsr_path", "wacc"), ("vacc", "wacc")]
    row = r.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], *[F.corr(f"{a}_rank", f"{b}_rank").alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.round(f"p{i}", 5).alias("pearson"), F.round(f"s{i}", 5).alias("spearman")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


_CORR = "SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 5) AS pearson, round(corr({a}_rank, {b}_rank), 5) AS spearman FROM r"
QUERIES = {f.__name__: f for f in (difficulty_levels, difficulty_rollup, difficulty_diagnostics, constraint_slices, ablation_targeted, ablation_macro, robustness_pairs, robustness_macro, excess_drop, failure_boundary, best_run_per_model, paired_compare, metric_correlation)}
SQL = {
    "difficulty_levels": f"{FEATURE_SQL} SELECT template_name, s_form, c_context, round(d_main, 6) AS d_main, level FROM df",
    "difficulty_rollup": f"{FACT_SQL} SELECT model, level, count(*) AS n_pages, count(DISTINCT template_name) AS n_templates, round(avg(tsr_path), 6) AS tsr_path, round(avg(vacc), 6) AS vacc FROM ft2 GROUP BY ALL",
    "difficulty_diagnostics": DIAGNOSTIC_SQL,
    "constraint_slices": CONSTRAINT_SQL,
    "ablation_targeted": f'{ABLATION_SQL} SELECT model, component, n_pages, round(w1, 6) AS "with", round(w0, 6) AS "without", round(w1 - w0, 6) AS delta FROM tg',
    "ablation_macro": f"{ABLATION_SQL} SELECT component, count(*) AS n_models, round(avg(w1 - w0), 6) AS mean, round(stddev_pop(w1 - w0), 6) AS deviation, round(min(w1 - w0), 6) AS lowest, round(max(w1 - w0), 6) AS highest FROM tg GROUP BY component",
    "robustness_pairs": f"{PAIR_SQL} SELECT model, variant, level, count(*) AS n_pairs, round(avg(tc), 6) AS tsr_path_clean, round(avg(td), 6) AS tsr_path_degraded, round(avg(tc) - avg(td), 6) AS tsr_path_drop, round((avg(tc) - avg(td)) / avg(tc), 6) AS tsr_path_relative, round(avg(wc) - avg(wd), 6) AS wacc_drop FROM dp GROUP BY ALL",
    "robustness_macro": f"{PAIR_SQL}, b AS (SELECT model, variant, level, avg(tc) AS c, avg(td) AS d, avg(wc) - avg(wd) AS w FROM dp GROUP BY ALL) SELECT variant, level, count(*) AS n_models, round(avg(c), 6) AS clean, round(avg(d), 6) AS degraded, round(avg(w), 6) AS wacc_drop, round((avg(c) - avg(d)) / avg(c), 6) AS relative FROM b GROUP BY ALL",
    "excess_drop": f"{PAIR_SQL}, b AS (SELECT model, level, avg(tc - td) FILTER (n_gt > 15) AS w, avg(tc - td) FILTER (n_gt <= 15) AS o FROM dp GROUP BY ALL) SELECT level, count(*) AS n_models, round(avg(w), 6) AS drop_with, round(avg(o), 6) AS drop_without, round(avg(w - o), 6) AS excess_drop FROM b GROUP BY ALL",
    "failure_boundary": f"{PAIR_SQL}, b AS (SELECT model, variant, level, level_no, avg(tc) AS c, avg(td) AS d FROM dp GROUP BY ALL) SELECT model, variant, coalesce(arg_min(level, level_no) FILTER (c - d >= 0.1 OR d < 0.5 * c), 'not_reached') AS boundary, round(max(c - d), 6) AS largest_drop FROM b GROUP BY ALL",
    "best_run_per_model": """WITH r AS (SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Model' ELSE 'model' END || '_' || (s_suppkey % 7) AS model_id, (s_suppkey * 37) % 11 AS n_valid, floor(abs(s_acctbal) / 1000)::BIGINT AS schema_nted, CASE WHEN s_nationkey > 3 THEN s_nationkey::BIGINT END AS value_ned FROM supplier)
        SELECT * FROM r WHERE n_valid > 0 QUALIFY row_number() OVER (PARTITION BY lower(model_id) ORDER BY n_valid DESC, schema_nted DESC, coalesce(value_ned, 0) DESC, run_id) = 1""",
    "paired_compare": f"""{X.PAGE_METRICS_SQL}, l AS (SELECT model, sample_id, 'tsr_path' AS metric, n_equal / n_gt AS v FROM pm UNION ALL SELECT model, sample_id, 'vacc', v_hits / v_total FROM pm UNION ALL SELECT model, sample_id, 'wacc', w_equal / w_total FROM pm),
        d AS (SELECT a.metric, a.v - b.v AS d FROM l a JOIN l b ON a.metric = b.metric AND a.sample_id = b.sample_id AND a.model = 'm1' AND b.model = 'm2')
        SELECT metric, count(*) AS n, count(*) FILTER (d > 1e-9) AS wins, count(*) FILTER (abs(d) <= 1e-9) AS ties, count(*) FILTER (d < -1e-9) AS losses, round(avg(d), 6) AS mean_delta FROM d GROUP BY metric""",
    "metric_correlation": f"""{X.PAGE_METRICS_SQL}, m AS (SELECT model, template_name, round(avg(n_equal / n_gt), 9) AS tsr_path, round(avg(v_hits / v_total), 9) AS vacc, round(avg(w_equal / w_total), 9) AS wacc FROM pm GROUP BY ALL),
        r AS (SELECT *, {", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}_rank" for c in ("tsr_path", "vacc", "wacc"))} FROM m)
        {" UNION ALL ".join(_CORR.format(a=a, b=b) for a, b in (("tsr_path", "vacc"), ("tsr_path", "wacc"), ("vacc", "wacc")))}""",
}
