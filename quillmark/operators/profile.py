"""Summaries of numbers, shapes and relations between features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, least, quartiles, mean, p95, most."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.95)]))
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), q.alias("q"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return s.select(*by, "n", "least", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p95"))], "mean", "most")


def shape_profile(leaves: DataFrame, key: str) -> DataFrame:
    """(path, kind, n, n_rows): kinds of values by path, list positions as *."""
    path = F.array_join(F.transform("path", lambda p: F.when(p.rlike("^[0-9]+$"), "*").otherwise(p)), "/")
    return leaves.groupBy(path.alias("path"), "kind").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_rows"))


def centred_correlation(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """One row: Pearson correlation of two features as they are and after each group's mean is taken off."""
    group = Window.partitionBy(by)
    off = lambda c: F.col(c) - F.avg(c).over(group)
    return df.select(a, b, off(a).alias("ca"), off(b).alias("cb")).agg(F.corr(a, b).alias("overall"), F.corr("ca", "cb").alias("within"))


def extremes(df: DataFrame, by: list[str], order: str, name: str, k: int = 3) -> DataFrame:
    """by, side, place, name, order: the k largest and the k smallest of each group; ties by name."""
    up, down = (Window.partitionBy(*by).orderBy(o, name) for o in (F.col(order).asc(), F.col(order).desc()))
    sides = [df.withColumns({"side": F.lit(s), "place": F.row_number().over(w)}).where(F.col("place") <= k) for s, w in (("bottom", up), ("top", down))]
    return sides[0].unionByName(sides[1]).select(*by, "side", "place", name, order)


def five_levels(df: DataFrame, value: str, out: str = "level") -> DataFrame:
    """df with levels 1 to 5 cut at the 15th, 35th, 65th and 85th percentile, thresholds rounded to four places."""
    cuts = df.agg(F.transform(F.percentile(value, F.array(*[F.lit(p) for p in (0.15, 0.35, 0.65, 0.85)])), lambda c: F.round(c, 4)).alias("__c"))
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, F.size(F.filter("__c", lambda c: F.col(value) >= c)) + 1).drop("__c")


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], other: list[str], value: str) -> DataFrame:
    """rows with ``value`` from the first table by ``keys`` or else from the second by ``other``, and which one gave it."""
    a, b = first.select(*keys, F.col(value).alias("__a")), second.select(*other, F.col(value).alias("__b"))
    both = rows.join(a, keys, "left").join(b, other, "left")
    return both.withColumns({value: F.coalesce("__a", "__b"), "matched_by": F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second")}).drop("__a", "__b")


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two DataFrames have the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def text_neighbours(left: DataFrame, right: DataFrame, left_key: str, right_key: str, grams: Column, k: int, apart: bool = False) -> DataFrame:
    """(left_key, rank, right_key, cosine): nearest right rows by TF-IDF of ``grams``, an array column of either side. Only pairs that share a gram are made; with ``apart`` rows of one key are no neighbours."""
    count = lambda d, key: d.select(F.col(key), F.explode(grams).alias("g")).groupBy(key, "g").agg(F.count("*").alias("tf"))
    l, r = count(left, left_key), count(right, right_key)  # noqa: E741
    n = right.count()
    idf = r.groupBy("g").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    weigh = lambda d, key: d.join(idf, "g").withColumn("w", F.col("tf") * F.col("idf")).withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(key, "g", "w")
    a, b = weigh(l, left_key).withColumnRenamed("w", "wa"), weigh(r, right_key).withColumnRenamed("w", "wb")
    both = a.join(b, "g")
    scored = (both.where(F.col(left_key) != F.col(right_key)) if apart else both).groupBy(left_key, right_key).agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine"))
    rank = Window.partitionBy(left_key).orderBy(F.desc("cosine"), right_key)
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(left_key, "rank", right_key, "cosine")
