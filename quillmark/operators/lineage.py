"""Lineage cuts in the folder that all executors share, and connected components that need them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of one node from which it counts as a hub; no graph has more than 2 * HUBS of them.
HUB, HUBS = 100_000, 10_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of this machine if the session is local, as in tests, and an error else."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/quillmark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def with_least(edges: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """edges joined to ``least`` (key, m, n: rows of the key). The rows of a hub stay where they are: hubs are broadcast, and there are few of them at any size."""
    if total <= HUB:
        return edges.join(least.drop("n"), key)
    hubs = F.broadcast(least.where(F.col("n") > max(HUB, total // HUBS)).drop("n"))
    return edges.join(hubs, key).unionByName(edges.join(hubs.select(key), key, "left_anti").join(least.drop("n"), key))


def components(edges: DataFrame, a: str = "u", b: str = "v", rounds: int = 60) -> DataFrame:
    """(node, root): each node of the edges but the smallest of each component, with that smallest one.

    Large-star and small-star steps in turn; a step never grows the edge count, no neighbour list is ever
    collected, and a hub's edges are spread over tasks. Each round is cut from its lineage. Raises if it
    hasn't settled after ``rounds``, which are logarithmic in the longest path.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    total, last = now.count(), None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_least(both.where("v > u"), low, "u", total).select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        back = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = with_least(large, back, "v", total).select(F.explode(F.array(F.struct("m", "v"), F.struct("m", F.col("u").alias("v")))).alias("e")).select(F.col("e.m").alias("u"), F.col("e.v").alias("v")).where("u <> v").distinct()
        now = cut(small)
        sums = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as bigint))")).first()
        if tuple(sums) == last:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        last, total = tuple(sums), sums[0]
    raise RuntimeError(f"components have not settled after {rounds} rounds")
