"""A stated set of query vectors against all rows, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.lineage import cut

#: Query vectors that are broadcast at a time.
BLOCK = 4096


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _blocks(rows: DataFrame, is_query: Column, kind):
    """(ids, values, whether there are more): query blocks, one at a time; how many there are follows from a count, so each stays within BLOCK in expectation."""
    queries = rows.where(is_query)
    parts = max(1, -(-queries.count() * 5 // (4 * BLOCK)))
    for p in range(parts):
        got = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).collect()
        if got:
            yield np.array([r["id"] for r in got]), np.array([r["v"] for r in got], kind), parts > 1


def _searched(rows: DataFrame, is_query: Column, kind, search, schema: str) -> DataFrame:
    """search((ids, values), batches) for every block over all rows. With several blocks, what one finds is written before the next is broadcast."""
    spark, found = rows.sparkSession, None
    for ids, values, more in _blocks(rows, is_query, kind):
        shared = spark.sparkContext.broadcast((ids, values))
        part = rows.mapInArrow(lambda batches, shared=shared: search(shared.value, batches), schema)
        if more:
            part = cut(part)
            shared.unpersist()
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def whole_vectors(rows: DataFrame) -> DataFrame:
    """Rows (id, v) whose vector has no null component and the commonest length."""
    good = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (length["n"] if length else 0))


def cosine_top(df: DataFrame, is_query: Column, k: int, key: str, vector: str) -> DataFrame:
    """(query_id, rank, key, cosine): the k rows of largest cosine for each query, itself left out; ties go to smaller ids. Zero vectors have cosine 0."""
    rows = whole_vectors(df.select(F.col(key).alias("id"), F.col(vector).alias("v")))

    def search(block, batches):
        ids, q = block
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        best_id, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                own, x = part.column(0).to_numpy(), _matrix(part.column(1))
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                s = np.clip(q @ x.T, -1, 1).round(6)
                s[ids[:, None] == own[None]] = -2
                # Only the best of this task so far are kept, so it gives k rows a query at most.
                all_id, all_s = np.concatenate([best_id, np.broadcast_to(own, s.shape)], axis=1), np.concatenate([best, s], axis=1)
                order = np.lexsort((all_id, -all_s), axis=1)[:, :k]
                best_id, best = np.take_along_axis(all_id, order, 1), np.take_along_axis(all_s, order, 1)
        keep = best > -2
        who = np.broadcast_to(ids[:, None], best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(best_id[keep]), pa.array(best[keep])], names=["query_id", "id", "cosine"])

    found = _searched(rows, is_query, np.float64, search, "query_id long, id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "cosine")


def sign_code(v: Column) -> Column:
    """Sign bits of a vector of up to 64 components as a number."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hamming_neighbours(df: DataFrame, is_query: Column, radius: int, key: str, vector: str) -> DataFrame:
    """(query_id, n_within, nearest): how many other rows' sign codes are within the radius, and the least distance."""
    rows = whole_vectors(df.select(F.col(key).alias("id"), F.col(vector).alias("v"))).select("id", sign_code(F.col("v")).alias("v"))

    def search(block, batches):
        ids, codes = block[0], block[1].view(np.uint64)
        within, nearest = np.zeros(len(ids), np.int64), np.full(len(ids), 65)
        for b in batches:
            own, x = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(x), 4096):
                d = np.bitwise_count(codes[:, None] ^ x[None, at : at + 4096]).astype(np.int64)
                d[ids[:, None] == own[None, at : at + 4096]] = 65
                within += (d <= radius).sum(axis=1)
                nearest = np.minimum(nearest, d.min(axis=1, initial=65))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(within), pa.array(nearest)], names=["query_id", "n_within", "nearest"])

    found = _searched(rows, is_query, np.int64, search, "query_id long, n_within long, nearest long")
    return found.groupBy("query_id").agg(F.sum("n_within").alias("n_within"), F.min("nearest").alias("nearest"))
