"""Distances between distributions, agreement, nearest neighbours in mixed features, and allocation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 1e-12


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """by, entropy in bits of the counts in each group."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def jensen_shannon(df: DataFrame, group: str, category: str) -> DataFrame:
    """(group, js): divergence in bits of each group's categories from those of all rows; every category gets a little mass."""
    counts = df.groupBy(group, category).agg(F.count("*").alias("n"))
    whole = counts.groupBy(category).agg(F.sum("n").alias("all"))
    grid = counts.select(group).distinct().crossJoin(F.broadcast(whole)).join(counts, [group, category], "left")
    over = Window.partitionBy(group)
    share = lambda c: (F.col(c) / F.sum(c).over(over) + SMALL)
    p = grid.withColumns({"n": F.coalesce("n", F.lit(0))}).withColumns({"p": share("n"), "q": share("all")})
    p = p.withColumns({"p": F.col("p") / F.sum("p").over(over), "q": F.col("q") / F.sum("q").over(over)}).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda c: F.col(c) * F.log2(F.col(c) / F.col("m"))
    return p.groupBy(group).agg(F.greatest(F.lit(0.0), F.sum(term("p") + term("q")) / 2).alias("js"))


def wasserstein(df: DataFrame, by: list[str], value: str, side: Column) -> DataFrame:
    """by, distance, normalised: area between the two sides' distribution functions, and its share of the reference side's 5-95 % span.

    ``side`` is true for the reference. Values are counted first, so the ordered pass sees distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("x")
    upto = lambda c: F.try_divide(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum(c).over(whole))
    steps = counts.withColumns({"gap": F.lead("x").over(order) - F.col("x"), "fa": upto("a"), "fb": upto("b")})
    area = steps.groupBy(*by).agg(F.sum(F.abs(F.col("fa") - F.col("fb")) * F.col("gap")).alias("distance"))
    span = df.where(side).groupBy(*by).agg(F.percentile(F.col(value).cast("double"), F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return area.join(span, by).withColumn("normalised", F.col("distance") / (F.col("q")[1] - F.col("q")[0] + SMALL)).drop("q")


def gower(left: DataFrame, right: DataFrame, features: list[str], ranges: DataFrame) -> DataFrame:
    """(l, r, distance) of template-level rows: mean over the features of the difference as a share of the reference range, at most 1. Both sides hold ``id``; small tables only."""
    a, b = (d.select(F.col("id").alias(i), *[F.col(f).alias(f"{i}_{f}") for f in features]) for d, i in ((left, "l"), (right, "r")))
    each = [F.least(F.lit(1.0), F.abs(F.col(f"l_{f}") - F.col(f"r_{f}")) / F.when(F.col(f"{f}_range") > 0, F.col(f"{f}_range")).otherwise(1.0)) for f in features]
    return a.crossJoin(F.broadcast(b)).where("l <> r").crossJoin(F.broadcast(ranges)).select("l", "r", (reduce(lambda x, y: x + y, each) / len(features)).alias("distance"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, kappa; kappa is null if chance agreement is certain."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = counts.groupBy("a").agg(F.sum("n").alias("x")).join(counts.groupBy("b").agg(F.sum("n").alias("y")), F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def quotas(rows: dict[str, int], ratios: dict[str, float], columns: dict[str, int]) -> dict[tuple[str, str], int]:
    """Whole numbers for rows x columns near rows * ratios with both margins kept: floors first, then one at a time to the largest remainder (ties: first row, first column)."""
    raw = {(r, c): n * ratios[c] for r, n in rows.items() for c in columns}
    out = {k: math.floor(v) for k, v in raw.items()}
    while True:
        row_gap = {r: n - sum(out[r, c] for c in columns) for r, n in rows.items()}
        column_gap = {c: n - sum(out[r, c] for r in rows) for c, n in columns.items()}
        open_cells = [k for k in out if row_gap[k[0]] > 0 and column_gap[k[1]] > 0]
        if not open_cells:
            if any(row_gap.values()):
                raise ValueError("margins cannot be met")
            return out
        out[max(open_cells, key=lambda k: raw[k] - out[k])] += 1  # max keeps the first of equals


def keyword_class(text: Column, rules: list[tuple[str, list[str]]], otherwise: str = "other") -> Column:
    """The class with the most of its keywords in the text; the first one on a tie."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    hits = [reduce(lambda a, b: a + b, [lower.contains(w).cast("int") for w in words]) for _, words in rules]
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    out = F.when(best == 0, otherwise)
    for (name, _), h in zip(rules, hits, strict=True):
        out = out.when(h == best, name)
    return out
