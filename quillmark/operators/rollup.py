"""Rollups of page scores by model, difficulty level, structural constraint and ablation variant.

Nulls mean "does not apply" and stay out of means. Slices are conditional aggregates over one pass, not
repeated group-bys; dimensions are joined by name, and what has no dimension row is reported apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("L1", "L2", "L3", "L4")
#: Percentiles of a normal distribution at -1, 0 and +1 deviations.
CUTS = (0.158655, 0.5, 0.841345)


def midrank(value: Column, order: Window | None = None) -> Column:
    """Share of values below plus half of those equal; 0 for values of 0 or less where none is negative; one half (or 0) where all are equal."""
    everything = Window.partitionBy()
    by = Window.orderBy(value)
    below, ties, n = F.rank().over(by) - 1, F.count(F.lit(1)).over(Window.partitionBy(value)), F.count(F.lit(1)).over(everything)
    least, most = F.min(value).over(everything), F.max(value).over(everything)
    return F.when((value <= 0) & (least >= 0), 0.0).when(least == most, F.when(value > 0, 0.5).otherwise(0.0)).otherwise((below + ties / 2) / n)


def structural(groups: dict[str, list[str]]) -> Column:
    """Mean over the groups of the largest normalised feature in each, to four places."""
    share = 1.0 / len(groups)
    return F.round(sum((F.greatest(*[F.col(f) for f in fs]) if len(fs) > 1 else F.col(fs[0])) * share for fs in groups.values()), 4)


def leveled(df: DataFrame, score: str, out: str = "level") -> DataFrame:
    """df with the level of ``score`` among all rows, cut at CUTS; the thresholds are one row, joined to all."""
    cuts = df.agg(F.percentile(score, F.array(*[F.lit(c) for c in CUTS])).alias("__cuts"))
    rounded = F.round(F.col(score), 4)
    level = F.when(rounded < F.col("__cuts")[0], "L1").when(rounded < F.col("__cuts")[1], "L2").when(rounded < F.col("__cuts")[2], "L3").otherwise("L4")
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, level).drop("__cuts")


def parsed_level(text: Column) -> Column:
    """L1 to L4 of a text or number: 0 and 1 are L1, 4 and more L4."""
    n = F.regexp_extract(text.cast("string"), r"(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("L"), F.least(F.lit(4), F.greatest(F.lit(1), n.cast("int"))).cast("string")))


def annotated(facts: DataFrame, dimension: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(facts with their dimension, the keys that have none)."""
    return facts.join(dimension, on), facts.select(on).distinct().join(dimension, on, "left_anti")


def by_level(facts: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """key x level: pages, templates and means; every level has a row for every key."""
    grid = facts.select(key).distinct().crossJoin(F.broadcast(facts.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")))
    means = facts.groupBy(key, "level").agg(F.count("*").alias("n_pages"), F.count_distinct("template_name").alias("n_templates"), *[F.avg(m).alias(m) for m in metrics])
    return grid.join(means, [key, "level"], "left").na.fill(0, ["n_pages", "n_templates"])


def diagnostics(levels: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """key x metric: the four levels side by side, the drop from first to last, its share, and how many neighbours don't rise (ties count)."""
    long = levels.unpivot([key, "level"], metrics, "metric", "value")
    wide = long.groupBy(key, "metric").pivot("level", list(LEVELS)).agg(F.first("value"))
    pairs = list(zip(LEVELS, LEVELS[1:], strict=False))
    held = reduce(lambda a, b: a + b, [F.when(F.col(a) >= F.col(b), 1).otherwise(0) for a, b in pairs])
    return wide.withColumns({"drop": F.col("L1") - F.col("L4"), "relative_drop": F.when(F.col("L1") != 0, (F.col("L1") - F.col("L4")) / F.col("L1")), "adjacent_drops": held.cast("long")})


def slices(facts: DataFrame, flags: list[str], metrics: list[str], key: str = "model") -> DataFrame:
    """key x flag: means with and without the flag, their difference (without less with), and templates on each side."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("constraint"), F.col(f).alias("present")) for f in flags])).alias("s")
    long = facts.select(key, "template_name", *metrics, named).select(key, "template_name", *metrics, "s.*")
    side = {"with": F.col("present"), "without": ~F.col("present")}
    out = long.groupBy(key, "constraint").agg(*[F.count_distinct(F.when(c, F.col("template_name"))).alias(f"templates_{n}") for n, c in side.items()], *[F.avg(F.when(c, F.col(m))).alias(f"{m}_{n}") for m in metrics for n, c in side.items()])
    return out.withColumns({f"{m}_delta": F.col(f"{m}_without") - F.col(f"{m}_with") for m in metrics})


def mean_of(metrics: list[str]) -> Column:
    """Mean of the metrics that apply to a row; null if none does."""
    n = reduce(lambda a, b: a + b, [F.col(m).isNotNull().cast("int") for m in metrics])
    return F.when(n > 0, reduce(lambda a, b: a + b, [F.coalesce(F.col(m), F.lit(0.0)) for m in metrics]) / n)


def targeted(facts: DataFrame, base: list[str], parts: dict[str, str], key: str = "model") -> DataFrame:
    """key x component: over the pages where the component applies, the composite with it and without it, and with less without."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(c).isNotNull().alias("applies"), mean_of([*base, c]).alias("with"), mean_of(base).alias("without")) for n, c in parts.items()])).alias("v")
    long = facts.select(key, rows).select(key, "v.*").where("applies")
    return long.groupBy(key, "component").agg(F.count("*").alias("n_pages"), F.avg("with").alias("with"), F.avg("without").alias("without")).withColumn("delta", F.col("with") - F.col("without"))


def over_models(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Equal-weight summary over models."""
    return rows.groupBy(*by).agg(F.count(value).alias("n_models"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def drops(pairs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Clean and degraded means over pages where both apply, their difference (clean less degraded), and its share of clean."""
    both = lambda m: F.col(f"{m}_clean").isNotNull() & F.col(f"{m}_degraded").isNotNull()
    out = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), *[F.avg(F.when(both(m), F.col(f"{m}_{s}"))).alias(f"{m}_{s}") for m in metrics for s in ("clean", "degraded")])
    return out.withColumns({f"{m}_drop": F.col(f"{m}_clean") - F.col(f"{m}_degraded") for m in metrics} | {f"{m}_relative": F.when(F.col(f"{m}_clean") != 0, (F.col(f"{m}_clean") - F.col(f"{m}_degraded")) / F.col(f"{m}_clean")) for m in metrics})


def best_run(runs: DataFrame, name: str, order: list[str], tie: str) -> DataFrame:
    """One row for each name, whatever its case: the largest by ``order`` (nulls as 0), the smallest ``tie`` on equality."""
    rank = Window.partitionBy(F.lower(name)).orderBy(*[F.coalesce(F.col(c), F.lit(0)).desc() for c in order], F.col(tie))
    return runs.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def merged(parts: list[DataFrame], on: str = "model") -> DataFrame:
    """Inner join of reports that must have the same keys; a key that one lacks raises when rows are read."""
    out = parts[0]
    for p in parts[1:]:
        both = out.withColumn("__l", F.lit(True)).join(p.withColumn("__r", F.lit(True)), on, "full_outer")
        out = both.where(F.expr(f"assert_true(__l and __r, concat('no row for ', {on})) is null")).drop("__l", "__r")
    return out
