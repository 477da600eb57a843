"""Summaries over page scores, templates and runs: ablation, components, levels, pairs of runs, checks, resampling and diagnostics.

All of them are aggregates with map-side combination; what is joined back is one row for a model, template or level.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import kernels as K
from quillmark.operators.distributions import wasserstein
from quillmark.operators.lineage import components as connected
from quillmark.operators.lineage import cut
from quillmark.operators.rollup import drops, mean_of

# --- ablation --------------------------------------------------------------------------------------


def components(facts: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """key, component: mean over the pages where it applies, their number, all pages, and their share."""
    long = facts.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("component"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("c")).select(key, "c.*")
    return long.groupBy(key, "component").agg(F.avg("value").alias("mean"), F.count("value").alias("n_numeric"), F.count("*").alias("n_total"), (F.count("value") / F.count("*")).alias("coverage"))


def variants(facts: DataFrame, parts: dict[str, list[str]], key: str = "model") -> DataFrame:
    """key, variant: mean over pages of the equal mean of the variant's components that apply."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), mean_of(ms).alias("score")) for v, ms in parts.items()])).alias("v")
    return facts.select(key, each).select(key, "v.*").groupBy(key, "variant").agg(F.count("*").alias("n_total"), F.avg("score").alias("score"))


def deltas(scores: DataFrame, comparisons: list[tuple[str, str, str]], key: str = "model") -> DataFrame:
    """key, comparison (name, variant with, variant without): both scores, their difference, its share in percent, and what it means."""
    wide = scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("variant", "score"))).alias("s"))
    rows = wide.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("comparison"), F.col("s")[a].alias("score_with"), F.col("s")[b].alias("score_without")) for n, a, b in comparisons])).alias("c")).select(key, "c.*")
    delta = F.col("score_with") - F.col("score_without")
    meaning = F.when(delta.isNull(), "insufficient_data").when(delta < 0, "stricter_lower_score").when(delta > 0, "higher_score_under_added_dimension").otherwise("no_change")
    return rows.withColumns({"delta": delta, "relative_delta_pct": F.when(F.col("score_without") != 0, 100 * delta / F.col("score_without")), "interpretation": meaning})


# --- components of degraded pages ------------------------------------------------------------------


def component_slices(pairs: DataFrame, flags: dict[str, Column], by: list[str], metrics: list[str]) -> DataFrame:
    """by, component, present: means and drops of the pairs with and without each component, and templates."""
    sides = [c for m in metrics for c in (f"{m}_clean", f"{m}_degraded")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), c.alias("present")) for n, c in flags.items()])).alias("f")
    long = pairs.select(*by, "template_name", *sides, each).select(*by, "template_name", *sides, "f.*")
    keys = [*by, "component", "present"]
    return drops(long, keys, metrics).join(long.groupBy(*keys).agg(F.count_distinct("template_name").alias("n_templates")), keys)


def contrasts(slices: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by, component: pairs and templates with and without, both drops, the excess of the one with, and whether both sides exist."""
    side = {"with": F.col("present"), "without": ~F.col("present")}
    pick = lambda c, s: F.max(F.when(side[s], F.col(c)))
    out = slices.groupBy(*by, "component").agg(
        *[F.coalesce(pick("n_pairs", s), F.lit(0)).alias(f"n_{s}") for s in side], *[F.coalesce(pick("n_templates", s), F.lit(0)).alias(f"templates_{s}") for s in side],
        *[pick(f"{m}_drop", s).alias(f"{m}_drop_{s}") for m in metrics for s in side],
    )
    status = F.when((F.col("n_with") > 0) & (F.col("n_without") > 0), "ok").otherwise("insufficient_contrast")
    return out.withColumns({f"{m}_excess_drop": F.col(f"{m}_drop_with") - F.col(f"{m}_drop_without") for m in metrics} | {"status": status})


def over_models(rows: DataFrame, by: list[str], metrics: list[str], models: int) -> DataFrame:
    """by: equal-weight means over models of what each has; raises when rows are read if a group hasn't all models."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n_models"), F.max("n_templates").alias("n_templates"), F.min("n_templates").alias("__least"), *[F.avg(c).alias(c) for c in metrics])
    return out.where(F.expr(f"assert_true(n_models = {models} and n_templates = __least, 'models or templates are missing') is null")).drop("__least")


def clean_summary(facts: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """key: pages, valid ones, their share, exact ones, and means; for each metric also the pages where it applies."""
    return facts.groupBy(key).agg(F.count("*").alias("n_total"), F.count_if("valid").alias("n_valid"), (F.count_if("valid") / F.count("*")).alias("coverage"), F.count_if("exact").alias("n_exact"), *[f(m).alias(f"{n}{m}") for m in metrics for n, f in (("", F.avg), ("n_", F.count))])


# --- templates -------------------------------------------------------------------------------------


def level_summary(templates: DataFrame, level: str, score: str, pages: str) -> DataFrame:
    """level: templates and pages with their shares in percent, and least, median, mean and largest score."""
    out = templates.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("templates"), F.sum(pages).alias("pages"), F.min(score).alias("lowest"), F.median(score).alias("median"), F.avg(score).alias("mean"), F.max(score).alias("highest"))
    whole = Window.partitionBy()
    return out.withColumns({"template_pct": 100 * F.col("templates") / F.sum("templates").over(whole), "page_pct": 100 * F.col("pages") / F.sum("pages").over(whole)})


def cross_tab(df: DataFrame, row: str, column: str, names: list[str]) -> DataFrame:
    """row: how many there are of each name of ``column``, and in all; null rows are Unknown."""
    return df.groupBy(F.coalesce(F.col(row).cast("string"), F.lit("Unknown")).alias(row)).agg(*[F.count_if(F.col(column) == n).alias(n) for n in names], F.count("*").alias("total"))


def composition(df: DataFrame, split: str, domain: str, first: str = "train", second: str = "test") -> DataFrame:
    """split, domain: count, size of the split, share in percent, share of the second split less that of the first, and the domain's rank by size."""
    domains = df.groupBy(domain).agg(F.count("*").alias("__all")).withColumn("domain_order", F.row_number().over(Window.orderBy(F.desc("__all"), domain)))
    sizes = df.where(F.col(split).isin(first, second)).groupBy(split).agg(F.count("*").alias("split_total"))
    counts = df.groupBy(split, domain).agg(F.count("*").alias("n"))
    full = domains.crossJoin(F.broadcast(sizes)).join(counts, [split, domain], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = 100 * F.col("n") / F.col("split_total")
    both = Window.partitionBy(domain)
    of = lambda s: F.sum(F.when(F.col(split) == s, F.col("share"))).over(both)
    return full.withColumn("share", share).withColumn("difference", of(second) - of(first)).select(split, domain, "n", "split_total", F.round("share", 2).alias("share_pct"), F.round("difference", 2).alias("test_minus_train_pp"), "domain_order")


def tag_distribution(df: DataFrame, tags: list[str], template: str = "template_name") -> DataFrame:
    """tag: rows that have it, their share in percent, and templates in which some rows have it and some don't."""
    long = df.select(template, F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.coalesce(F.col(t), F.lit(False)).alias("has")) for t in tags])).alias("t")).select(template, "t.*")
    each = long.groupBy("tag", template).agg(F.count("*").alias("n"), F.count_if("has").alias("k"))
    return each.groupBy("tag").agg(F.sum("k").alias("rows"), (100 * F.sum("k") / F.sum("n")).alias("pct"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("varying_templates"))


def fifth(score: Column) -> Column:
    """Interval of a score between 0 and 1, a fifth wide; the last one holds 1."""
    edges = ("0.0", "0.2", "0.4", "0.6", "0.8", "1.0")
    pairs = list(zip(edges, edges[1:], strict=False))
    return reduce(lambda out, p: out.when(score < float(p[1]), f"[{p[0]},{p[1]})"), pairs[1:-1], F.when(score < 0.2, "[0.0,0.2)")).otherwise("[0.8,1.0]")


def extent(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by: least, median, mean (two places) and largest of whole numbers."""
    return df.groupBy(*by).agg(F.min(value).alias("lowest"), F.round(F.median(value), 2).alias("median"), F.round(F.avg(value), 2).alias("mean"), F.max(value).alias("highest"))


def indexed_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each share the value at that place of the ordered rows (counted from 0, rounded down), without interpolation."""
    order = Window.partitionBy(*by).orderBy(value)
    placed = df.withColumns({"__r": F.row_number().over(order) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    at = lambda s: F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.lit(s)))
    return placed.groupBy(*by).agg(F.min(value).alias("lowest"), F.avg(value).alias("mean"), *[F.max(F.when(F.col("__r") == at(s), F.col(value))).alias(n) for n, s in shares.items()], F.max(value).alias("highest"))


# --- runs ------------------------------------------------------------------------------------------


def paired_fields(first: DataFrame, second: DataFrame, fields: list[str], counts: list[str]) -> DataFrame:
    """field: values of two one-row reports where both have one, their difference, and whether it is a count or a metric."""
    long = lambda df, name: df.unpivot([], [F.col(f).cast("double").alias(f) for f in fields], "field", name)
    both = long(first.select(*[F.col(f).cast("double").alias(f) for f in fields]), "tuned").join(long(second.select(*[F.col(f).cast("double").alias(f) for f in fields]), "base"), "field")
    return both.where("tuned is not null and base is not null").select("field", "tuned", "base", (F.col("tuned") - F.col("base")).alias("delta"), F.when(F.col("field").isin(*counts), "count").otherwise("metric").alias("kind"))


def paired_types(first: DataFrame, second: DataFrame) -> DataFrame:
    """type, field: tp, pred, gt and f1 of two runs and their differences; raises when rows are read if types or true counts differ."""
    with_f1 = lambda df, s: df.select("type", *[F.col(c).cast("double").alias(f"{c}_{s}") for c in ("tp", "pred", "gt")], F.try_divide(2 * F.col("tp"), F.col("pred") + F.col("gt")).alias(f"f1_{s}"))
    both = with_f1(first, "a").join(with_f1(second, "b"), "type", "full_outer").where(F.expr("assert_true(gt_a is not null and gt_b is not null and gt_a = gt_b, 'relation types or true counts differ') is null"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_a").alias("tuned"), F.col(f"{c}_b").alias("base")) for c in ("tp", "pred", "gt", "f1")])).alias("x")
    return both.select("type", each).select("type", "x.*").withColumn("delta", F.col("tuned") - F.col("base"))


def compacted_types(rows: DataFrame, models: DataFrame) -> DataFrame:
    """model, type, kind, tp, pred, gt: a row for every type that any truth has (scored or not), and one for all predicted types that none has."""
    canonical = rows.where("gt > 0").select("type").distinct()
    known = models.crossJoin(F.broadcast(canonical)).join(rows, ["model", "type"], "left").withColumn("kind", F.when(F.col("gt").isNull(), "canonical_not_scored").otherwise("canonical"))
    other = rows.join(F.broadcast(canonical), "type", "left_anti").where("pred > 0").groupBy("model").agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"))
    rest = other.select("model", F.lit("__unsupported_prediction_types__").alias("type"), F.lit("unsupported_aggregate").alias("kind"), "tp", "pred", F.lit(0).cast("long").alias("gt"))
    return known.select("model", "type", "kind", "tp", "pred", "gt").unionByName(rest)


def joined_sources(sources: dict[str, DataFrame], on: str) -> DataFrame:
    """All sources by one key, which must occur in each; raises when rows are read if one lacks a key."""
    parts = [df.withColumn(f"__in_{n}", F.lit(True)) for n, df in sources.items()]
    out = reduce(lambda a, b: a.join(b, on, "full_outer"), parts)
    has_all = " and ".join(f"coalesce(__in_{n}, false)" for n in sources)
    return out.where(F.expr(f"assert_true({has_all}, concat('a source lacks ', {on})) is null")).drop(*[f"__in_{n}" for n in sources])


def reconstructed(levels: DataFrame, official: DataFrame, metrics: list[str], key: str = "model", tolerance: float = 5.1e-7) -> DataFrame:
    """key, n_total, largest difference: scores by level, weighted by pages, give the official ones; raises when rows are read if they don't."""
    again = levels.groupBy(key).agg(F.sum("n_pages").alias("n_total"), *[(F.sum(F.col(m) * F.col("n_pages")) / F.sum(F.when(F.col(m).isNotNull(), F.col("n_pages")))).alias(m) for m in metrics])
    other = official.select(key, F.col("n_total").alias("__n"), *[F.col(m).alias(f"__{m}") for m in metrics])
    apart = F.greatest(*[F.abs(F.col(m) - F.col(f"__{m}")) for m in metrics]) if len(metrics) > 1 else F.abs(F.col(metrics[0]) - F.col(f"__{metrics[0]}"))
    both = again.join(other, key).withColumn("largest_difference", apart)
    return both.where(F.expr(f"assert_true(n_total = __n and largest_difference <= {tolerance}, 'levels do not add up to the official result') is null")).select(key, "n_total", "largest_difference")


def checked_counts(df: DataFrame, key: str, expected: dict[str, int]) -> DataFrame:
    """key, n: rows of each key; raises when rows are read if they aren't the expected ones, or one is missing."""
    known = df.sparkSession.createDataFrame([(k, n) for k, n in expected.items()], f"{key} string, expected long")
    both = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n")).join(known, key, "full_outer")
    return both.where(F.expr("assert_true(n is not null and expected is not null and n = expected, 'the partition has changed') is null")).select(key, "n")


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: count of rows and an order-free digest of their columns' texts, to see whether a source has changed."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("decimal(20,0)"))
    return df.agg(F.count("*").alias("n"), part(1).alias("low"), part(9).alias("high"))


# --- resampling ------------------------------------------------------------------------------------


def drawn(*parts: Column | str) -> Column:
    """A 32-bit number that the parts decide, the same in any engine with SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256), 1, 8), 16, 10).cast("long")


def resampled(clusters: DataFrame, by: list[str], cluster: str, total: str, weight: str, rounds: int = 10_000, seed: int = 20260720, ends: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """by, estimate, low, high, n_clusters: sum of totals over sum of weights, with an interval from resampled clusters.

    Round and slot decide by hash which cluster is drawn, the same for all groups of equal size. Clusters number tens; a round's
    draws are rows, so rounds are spread over tasks.
    """
    order = Window.partitionBy(*by).orderBy(cluster)
    placed = clusters.withColumns({"__i": (F.row_number().over(order) - 1).cast("long"), "__n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    sizes = placed.groupBy(*by).agg(F.count("*").alias("__n"))
    spark = clusters.sparkSession
    slots = sizes.crossJoin(spark.range(rounds).withColumnRenamed("id", "__round")).select(*by, "__round", "__n", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))).alias("__slot"))
    draws = slots.select(*by, "__round", F.pmod(drawn(str(seed), F.col("__round").cast("string"), F.col("__slot").cast("string")), F.col("__n")).alias("__i"))
    each = draws.join(F.broadcast(placed.select(*by, "__i", total, weight)), [*by, "__i"]).groupBy(*by, "__round").agg((F.sum(total) / F.sum(weight)).alias("__e"))
    interval = each.groupBy(*by).agg(F.percentile("__e", F.array(*[F.lit(e) for e in ends])).alias("__q"))
    whole = placed.groupBy(*by).agg((F.sum(total) / F.sum(weight)).alias("estimate"), F.count("*").alias("n_clusters"))
    return whole.join(interval, by).select(*by, "estimate", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"), "n_clusters")


def wasserstein_interval(values: DataFrame, value: str, side: Column, rounds: int = 1000, seed: int = 20260720) -> DataFrame:
    """One row: distance of the two sides' values, and a 95 % interval of it with the values of the first side resampled. ``side`` is true for the reference."""
    marked = values.select(F.col(value).cast("double").alias("x"), side.alias("ref")).where("x is not null")
    placed = marked.where("not ref").withColumns({"i": (F.row_number().over(Window.orderBy("x")) - 1).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    spark = values.sparkSession
    turns = spark.range(rounds).withColumnRenamed("id", "round")
    slots = turns.crossJoin(placed.select(F.col("i").alias("slot"), "n"))
    draws = slots.select("round", F.pmod(drawn(str(seed), F.col("round").cast("string"), F.col("slot").cast("string")), F.col("n")).alias("i"))
    sampled = draws.join(F.broadcast(placed.select("i", "x")), "i").select("round", "x", F.lit(False).alias("ref"))
    every = sampled.union(turns.crossJoin(marked.where("ref").select("x")).select("round", "x", F.lit(True)))
    each = wasserstein(every, ["round"], "x", F.col("ref")).agg(F.percentile("distance", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    own = wasserstein(marked.withColumn("all", F.lit(1)), ["all"], "x", F.col("ref")).select("distance", "normalised")
    return own.crossJoin(F.broadcast(each)).select("distance", "normalised", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def chosen_feature(candidates: dict[str, Column]) -> Column:
    """struct<value, source>: the first candidate that is a number, and where it comes from; 0 and ``default`` if none is."""
    number = lambda c: c.try_cast("double")
    given = [(n, c) for n, c in candidates.items()]
    source = reduce(lambda out, x: out.when(number(x[1]).isNotNull(), x[0]), given[1:], F.when(number(given[0][1]).isNotNull(), given[0][0])).otherwise("default")
    return F.struct(F.coalesce(*[number(c) for _, c in given], F.lit(0.0)).alias("value"), source.alias("source"))


def derived_seed(*parts: Column | str) -> Column:
    """First eight bytes, as a number, of the SHA-256 of the parts with zero bytes between them."""
    whole = F.concat_ws("\x00", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(whole, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def allocated(target: dict[str, int], reference: dict[str, int], size: int) -> dict[str, int]:
    """How many of each stratum two disjoint samples of ``size`` take from a reference, near the target's shares: at most half of each stratum, floors first, then the largest remainders."""
    half = {k: n // 2 for k, n in reference.items()}
    want = {k: size * target.get(k, 0) / max(sum(target.values()), 1) for k in half}
    out = {k: min(int(want[k]), half[k]) for k in half}
    for _ in range(size - sum(out.values())):
        able = [k for k in half if out[k] < half[k]]
        if not able:
            raise ValueError("the strata are too small for two disjoint samples")
        out[max(able, key=lambda k: (want[k] - out[k], target.get(k, 0), half[k] - out[k], k))] += 1
    return {k: n for k, n in out.items() if n}


def matched_samples(reference: DataFrame, key: str, stratum: str, counts: dict[str, int], seed: str, rounds: int = 1) -> DataFrame:
    """(round, key, stratum, side): two disjoint samples a round, as many of each stratum as told, chosen by hash."""
    sizes = reference.sparkSession.createDataFrame(list(counts.items()), f"{stratum} string, __k int")
    each = reference.select(key, F.col(stratum).cast("string").alias(stratum)).crossJoin(reference.sparkSession.range(rounds).withColumnRenamed("id", "round")).join(F.broadcast(sizes), stratum)
    order = Window.partitionBy("round", stratum).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col("round").cast("string"), F.col(key).cast("string")), 256), key)
    placed = each.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= 2 * F.col("__k"))
    return placed.select("round", key, stratum, F.when(F.col("__r") <= F.col("__k"), "first").otherwise("second").alias("side"))


def calibration(rounds: DataFrame, measured: DataFrame, value: str) -> DataFrame:
    """One row: median and 95 % interval of a distance between reference samples, the measured distance, and the share of rounds that don't exceed it."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    own = measured.select(F.col(value).alias("measured"))
    return rounds.crossJoin(F.broadcast(own)).agg(F.count("*").alias("rounds"), q[1].alias("median"), q[0].alias("low"), q[2].alias("high"), F.max("measured").alias("measured"), F.avg((F.col(value) <= F.col("measured")).cast("int")).alias("percentile"))


def shares_divergence(counts: DataFrame, by: list[str], category: str, side: str, sides: tuple[str, str], small: float = 1e-12) -> DataFrame:
    """by, js: divergence in bits of the two sides' categories; counts hold by, category, side and n."""
    wide = counts.groupBy(*by, category).agg(*[F.coalesce(F.sum(F.when(F.col(side) == s, F.col("n"))), F.lit(0)).alias(c) for s, c in zip(sides, ("__a", "__b"), strict=True)])
    over = Window.partitionBy(*by)
    p = wide.withColumns({c: F.col(c) / F.sum(c).over(over) + small for c in ("__a", "__b")}).withColumns({c: F.col(c) / F.sum(c).over(over) for c in ("__a", "__b")})
    m = (F.col("__a") + F.col("__b")) / 2
    return p.groupBy(*by).agg((F.sum(F.col("__a") * F.log2(F.col("__a") / m) + F.col("__b") * F.log2(F.col("__b") / m)) / 2).alias("js"))


# --- diagnostics -----------------------------------------------------------------------------------


def template_means(rows: DataFrame, by: list[str], template: str = "template_name", pages: str | None = None) -> DataFrame:
    """by, metric, template: mean drop in percentage points of the pages where a metric applies. A row stands for one page, or for as many as ``pages`` says."""
    n = F.col(pages) if pages else F.lit(1)
    some = rows.where("clean is not null and corrupted is not null and eligible > 0")
    return some.groupBy(*by, "metric", template).agg((100 * F.sum((F.col("clean") - F.col("corrupted")) * n) / F.sum(n)).alias("drop"), F.sum(n).alias("n"))


def response_matrix(rows: DataFrame, metrics: list[str], severity: float, pages: str | None = None) -> DataFrame:
    """error: mean drop of each metric over templates, at one severity."""
    means = template_means(rows.where(F.col("severity") == severity), ["error"], pages=pages).groupBy("error", "metric").agg(F.avg("drop").alias("drop"))
    return means.groupBy("error").agg(*[F.max(F.when(F.col("metric") == m, F.col("drop"))).alias(m) for m in metrics])


def monotonicity(rows: DataFrame, pages: str | None = None) -> DataFrame:
    """error, metric, spearman: rank correlation of severity and mean drop (over templates, then seeds); null if the drops are all equal."""
    by_seed = template_means(rows, ["error", "severity", "seed"], pages=pages).groupBy("error", "metric", "severity", "seed").agg(F.avg("drop").alias("drop"))
    means = by_seed.groupBy("error", "metric", "severity").agg(F.avg("drop").alias("drop"))
    group = Window.partitionBy("error", "metric")
    rank = lambda c: F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("error", "metric", c)) - 1) / 2
    ranked = means.withColumns({"x": rank("severity"), "y": rank("drop")})
    return ranked.groupBy("error", "metric").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("spearman"))


def selectivity(rows: DataFrame, targets: dict[str, list[str]], expected: dict[str, list[str]], severity: float, pages: str | None = None) -> DataFrame:
    """error: mean drop of its target metrics, the largest drop of the metrics that it shouldn't touch, and the margin between them."""
    spark = rows.sparkSession
    roles = spark.createDataFrame([(e, m, "target") for e, ms in targets.items() for m in ms] + [(e, m, "expected") for e, ms in expected.items() for m in ms], "error string, metric string, role string")
    means = template_means(rows.where(F.col("severity") == severity), ["error"], pages=pages).groupBy("error", "metric").agg(F.avg("drop").alias("drop")).join(F.broadcast(roles), ["error", "metric"], "left")
    off = F.when(F.col("role").isNull(), F.struct("drop", "metric"))
    out = means.groupBy("error").agg(F.avg(F.when(F.col("role") == "target", F.col("drop"))).alias("target_drop"), F.max(off).alias("off"))
    return out.select("error", "target_drop", F.col("off.metric").alias("off_metric"), F.col("off.drop").alias("off_drop"), (F.col("target_drop") - F.col("off.drop")).alias("margin"))


# --- duplicates of pages ---------------------------------------------------------------------------

#: What makes two pages duplicates, by bits that differ, likeness of layout and text, and entities.


def page_reason(exact_file: Column, exact_image: Column, bits: Column, layout: Column, text: Column, entities: Column) -> Column:
    """Why two pages are duplicates, the strongest reason first; null if they aren't."""
    return (
        F.when(exact_file, "exact_file_sha256").when(exact_image, "exact_normalized_image_sha256").when((bits <= 4) & (layout >= 0.90), "phash_le_4_and_layout_ge_0.90")
        .when((bits <= 8) & (layout >= 0.95) & (text >= 0.45), "phash_le_8_layout_ge_0.95_text_ge_0.45")
        .when((layout >= 0.985) & (text >= 0.82) & (entities >= 0.75), "layout_ge_0.985_text_ge_0.82_count_ratio_ge_0.75")
    )


def relaxed_edge(bits: Column, layout: Column, text: Column) -> Column:
    return ((bits <= 10) & (layout >= 0.88)) | ((bits <= 14) & (layout >= 0.93) & (text >= 0.35)) | ((layout >= 0.97) & (text >= 0.65))


def strict_edge(bits: Column, layout: Column, text: Column) -> Column:
    return ((bits <= 3) & (layout >= 0.93)) | ((bits <= 6) & (layout >= 0.97) & (text >= 0.55)) | ((layout >= 0.992) & (text >= 0.88))


def cohesive(bits: Column, layout: Column, text: Column, aspect: Column) -> Column:
    """Whether two pages may stand in one cluster."""
    return (((bits <= 16) & (layout >= 0.78)) | ((layout >= 0.92) & (text >= 0.30)) | ((layout >= 0.84) & (text >= 0.72))) & (aspect <= 0.20)


def medoids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, representative: the member that is nearest to the others by bits, layout and text, the smallest on a tie. pairs hold a, b, bits, layout, text both ways of a cluster."""
    far = 0.45 * F.col("bits") / 64 + 0.40 * (1 - F.col("layout")) + 0.15 * (1 - F.col("text"))
    both = pairs.select("a", "b", far.alias("far")).union(pairs.select("b", "a", far.alias("far")))
    own = members.select("cluster", F.col("id").alias("a"))
    inside = both.join(own, "a").join(members.select(F.col("cluster").alias("c"), F.col("id").alias("b")), "b").where("cluster = c")
    mean = inside.groupBy("cluster", "a").agg(F.avg("far").alias("far"))
    return own.join(mean, ["cluster", "a"], "left").groupBy("cluster").agg(F.min(F.struct(F.coalesce("far", F.lit(0.0)).alias("far"), "a"))["a"].alias("representative"))


def cohesive_clusters(edges: DataFrame, cohesive: DataFrame) -> DataFrame:
    """(id, cluster): edges (a, b, place) merge clusters in the order of ``place`` where all pairs across them are in ``cohesive`` (a, b, a < b).

    Each connected component is worked on by one task, as merges depend on those before; a component is a group of near copies.
    """
    roots = cut(connected(edges, "a", "b"))
    own = lambda d: d.join(roots, F.col("a") == F.col("node"), "left").select("a", "b", *[c for c in d.columns if c not in ("a", "b")], F.coalesce("root", "a").alias("root"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(*(left.column(c).to_pylist() for c in ("place", "a", "b")), strict=True))
        pairs = set(zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True))
        found = K.cohesive_clusters([(a, b) for _, a, b in rows], pairs)
        return pa.Table.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["id", "cluster"])

    each = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "place")
    other = cohesive.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return own(each).groupBy("root").cogroup(own(other).groupBy("root")).applyInArrow(run, "id long, cluster long")


def overlap_status(exact: Column, alias: Column, train: Column, bits: Column, layout: Column, jaccard: Column, cosine: Column, entities: Column) -> Column:
    """Whether pages of two datasets overlap: confirmed, suspected, or a candidate only."""
    confirmed = ((bits <= 8) & (layout >= 0.65)) | ((bits <= 14) & (layout >= 0.65) & ((entities >= 0.75) | (cosine >= 0.35))) | ((bits <= 14) & (cosine >= 0.70)) | ((layout >= 0.90) & (jaccard >= 0.35))
    strong = sum((c.cast("int") for c in (layout >= 0.88, cosine >= 0.55, jaccard >= 0.45)), (bits <= 14).cast("int"))
    signals = ((bits <= 8) & (layout >= 0.82)) | (strong >= 3) | ((layout >= 0.96) & (cosine >= 0.70))
    return F.when(exact | (alias & train), "confirmed_overlap").when((alias & confirmed) | signals, "suspected_overlap").otherwise("candidate_only")


def blocked_pairs(units: DataFrame, neighbours: DataFrame, near: DataFrame, hashes: list[str], key: str = "id") -> DataFrame:
    """Different (a, b), a < b: units of one hash, of fingerprints that are near, or layout neighbours; a hash that very many share gives star pairs to its smallest unit, which connect them."""
    stars = []
    for h in hashes:
        least = units.groupBy(h).agg(F.min(key).alias("a"), F.count("*").alias("__n")).where("__n > 1")
        stars.append(units.join(least, h).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b")))
    every = reduce(lambda x, y: x.union(y), [*stars, near.select("a", "b"), neighbours.select("a", "b")])
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


# --- difficulty ------------------------------------------------------------------------------------

#: Weights of the parts of the context score.
CONTEXT = {"page_scope": 0.20, "sections": 0.15, "tables": 0.15, "mixed": 0.15, "reading_order": 0.15, "direction": 0.15, "cross_region": 0.05}


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))


def reading_order(direction: Column, sections: Column, regions: Column, unordered: Column) -> Column:
    """How much a page depends on its reading order: direction, sections, regions, and boxes that don't follow the order."""
    return clamp(
        F.when(direction >= 2, 0.35).when(direction == 1, 0.25).otherwise(0.0) + F.when(sections >= 4, 0.12).when(sections >= 3, 0.08).when(sections > 1, 0.04).otherwise(0.0)
        + F.when(regions >= 3, 0.08).when(regions > 1, 0.04).otherwise(0.0) + F.when(unordered, 0.25).otherwise(0.0)
    )


def cross_region(sections: Column, approvals: Column, multi_values: Column, relations: Column, key_values: Column) -> Column:
    """How much regions depend on each other: repeated approval fields, several values, more relations than key-value pairs."""
    repeated = F.when((sections >= 2) & (approvals > 0), F.least(F.lit(0.35), 0.10 + 0.05 * approvals)).otherwise(0.0)
    return clamp(repeated + F.when((sections > 2) & (multi_values > 0), 0.10).otherwise(0.0) + F.when((sections > 2) & (relations > key_values), 0.05).otherwise(0.0))


def page_scope(area: Column) -> Column:
    return F.when(area >= 0.75, 1.0).when(area >= 0.40, 0.5).otherwise(0.0)


def context_score(area: Column, sections_norm: Column, tables: Column, mixed: Column, order: Column, direction: Column, regions: Column) -> Column:
    """Weighted context score, to four places."""
    parts = {"page_scope": page_scope(clamp(area)), "sections": sections_norm, "tables": clamp(F.greatest(tables - 1.0, F.lit(0.0)) / 2), "mixed": clamp(mixed), "reading_order": order, "direction": clamp(direction / 3), "cross_region": regions}
    return F.round(reduce(lambda a, b: a + b, [F.lit(CONTEXT[n]) * c for n, c in parts.items()]), 4)


def large_difference(a: Column, b: Column) -> Column:
    """At least 3 apart, and by a quarter of the larger."""
    apart = F.abs(a - b)
    return (apart >= 3) & (apart / F.greatest(F.abs(a), F.abs(b), F.lit(1)) >= 0.25)


#: Language, script and direction of a template by the beginning of its name; the first that fits.
PREFIXES = (
    ("Arabic-", "Arabic", "Arabic", "RTL"), ("zn_en_", "Chinese--English", "Han + Latin", "LTR"), ("zn_", "Chinese", "Han", "LTR"), ("en_", "English", "Latin", "LTR"), ("de_", "German", "Latin", "LTR"),
    ("ja_", "Japanese", "Han + Hiragana + Katakana", "LTR"), ("pt_", "Portuguese", "Latin", "LTR"), ("es_", "Spanish", "Latin", "LTR"),
)


def template_language(name: Column) -> Column:
    """struct<language, script, direction> of a template's name; null if it begins like none."""
    of = lambda p: F.struct(*[F.lit(v).alias(n) for n, v in zip(("language", "script", "direction"), p[1:], strict=True)])
    return reduce(lambda out, p: out.when(name.startswith(p[0]), of(p)), PREFIXES[1:], F.when(name.startswith(PREFIXES[0][0]), of(PREFIXES[0])))


def distinct_texts(texts: Column, form) -> Column:
    """The texts, trimmed, of which an earlier one hasn't the same form; empty forms are left out."""
    each = F.transform(texts, lambda t: F.struct(F.trim(t).alias("t"), form(t).alias("f")))
    kept = F.filter(F.filter(each, lambda x: F.coalesce(x["f"], F.lit("")) != ""), lambda x: F.lit(True))
    first = F.transform(F.array_distinct(F.transform(kept, lambda x: x["f"])), lambda f: F.get(F.filter(kept, lambda x: x["f"] == f), F.lit(0))["t"])
    return first


def grouped_gower(left: str, right: str, groups: dict[str, dict[str, list[str]]], ranges: str) -> Column:
    """Mean over groups of the mean difference of their features: numbers as a share of the reference's range, at most 1, names as equal or not."""

    def feature(f: str, kind: str) -> Column:
        a, b = F.col(f"{left}.{f}"), F.col(f"{right}.{f}")
        return F.least(F.lit(1.0), F.abs(a - b) / F.greatest(F.col(f"{ranges}.{f}"), F.lit(1e-12))) if kind == "continuous" else F.when(a.eqNullSafe(b), 0.0).otherwise(1.0)

    means = []
    for kinds in groups.values():
        each = [feature(f, kind) for kind, fs in kinds.items() for f in fs]
        means.append(reduce(lambda x, y: x + y, each) / len(each))
    return reduce(lambda x, y: x + y, means) / len(means)


def fitted_ranges(reference: DataFrame, features: list[str], out: str = "ranges") -> DataFrame:
    """One row with a struct of each feature's range over the reference."""
    return reference.agg(F.struct(*[(F.max(f) - F.min(f)).cast("double").alias(f) for f in features]).alias(out))
