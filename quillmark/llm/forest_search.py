"""Approximate nearest neighbours with a forest of random-projection trees (operator 4).

A node projects the vectors, less its own mean, on random orthogonal directions, and a vector goes to the
child of the direction, or its opposite, that it leans to most. A node is cut into as many children as give
about ROWS rows each, so leaves hold few *rows* at every size of table: the trees are fitted on a sample
bounded by SAMPLE vectors (in expectation, chosen by hash), and where a node has too few points of the
sample but still many rows, further cuts along random directions follow that need no fitting.

A query walks all trees through one shared priority queue. A child's priority is by how much the query
leans less to it than to the best child, squared and summed along the path; it stops after a number of
leaves. That number is *calibrated*: the true neighbours of CALIBRATED queries are found by brute force
over all rows, and as many leaves are opened as find TARGET of them. So recall is measured on every table,
and candidates are as few as its structure lets them be: a few hundred a query on clustered vectors of any
number, about N ** 0.6 on vectors without any structure (the README has figures).

Every row is in one leaf of each tree. What travels to the leaves is a code of one byte a component with
the length of its rounding error, which bounds the true distance from both sides; a query keeps the
candidates that these bounds leave possible, and they alone are reranked by exact Euclidean distance, in
double precision on the original vectors.

Equal vectors are indexed once, with their smallest k + 1 ids: no more of them can be among the k nearest,
as ties go to smaller ids. Equal queries are searched once. So a vector that a third of all rows have
weighs as one. Leaves are dealt to buckets of bounded size by their number.

Null and zero vectors, and those with null, NaN or infinite components, take no part, neither do those
of another length than the commonest one. Null ids take no part. An empty table gives no rows; fewer than
k candidates are all returned that the search found. Repeated ids are separate candidates. Very long vectors are
worked on like others. Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.repeats import spread
from quillmark.llm.shared import cut, partitions, tidy

#: Trees; rows that a leaf should have; children of a node at most; levels with directions of their own.
TREES, ROWS, WAYS, LEVELS = 12, 12, 64, 12
#: Bound of the sample; points that a node is fitted on at least.
SAMPLE, FEWEST = 65_536, 16
#: Queries that are calibrated on, the share of their neighbours that must be found, and leaves that a calibration opens at most.
CALIBRATED, TARGET, OPENED = 128, 0.95, 200_000
EVERY = 100
#: Bytes of codes that a bucket should have at most, rows that are indexed at a time, and pairs that are compared at a time.
BUCKET_BYTES, SLICE, PAIRS = 16 << 20, 4096, 1 << 14
WORD, MIX = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def child_key(key, child):
    """Name of a child: a 64-bit hash of its parent's name and its number, for ints and for arrays alike."""
    if isinstance(key, int):
        x = ((key ^ (child + 1) * MIX[0]) * MIX[1]) & WORD
        return x ^ (x >> 29)
    x = (key ^ (child.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[0])) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(29))


def ways_of(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.clip((np.minimum(rows / ROWS, points / 4) / 2).astype(np.int64) * 2, 4, WAYS)


def directions(rng: np.random.Generator, d: int) -> np.ndarray:
    """WAYS / 2 random directions, orthogonal in sets of d at most."""
    width = min(d, WAYS // 2)
    sets = [np.linalg.qr(rng.normal(size=(d, width)))[0] for _ in range(-(-WAYS // (2 * width)))]
    return np.concatenate(sets, axis=1)[:, : WAYS // 2].astype(np.float32)


def leaning(p: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Child of each row of projections: twice the number of the direction, one more for its opposite."""
    size = np.where(np.arange(p.shape[1])[None] < (ways // 2)[:, None], np.abs(p), -1.0)
    best = size.argmax(axis=1)
    return 2 * best + (p[np.arange(len(p)), best] < 0)


@dataclass
class Tree:
    """Nodes as arrays: ways (0: not fitted further), first child, level, row of ``centre`` (-1: none); ``deeper``: ways of the cuts that follow below a node without fitting."""

    turns: np.ndarray
    centre: np.ndarray
    ways: np.ndarray
    child: np.ndarray
    level: np.ndarray
    row: np.ndarray
    deeper: np.ndarray
    seed: int

    def project(self, x: np.ndarray, node: np.ndarray, level: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.turns.shape[2]))
        for l in np.unique(level).tolist():
            at = np.flatnonzero(level == l)
            out[at] = (x[at] - self.centre[self.row[node[at]]]) @ self.turns[l % LEVELS]
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Name of the leaf of each row of x."""
        at, key = np.zeros(len(x), np.int64), np.full(len(x), self.seed, np.uint64)
        while len(go := np.flatnonzero(self.ways[at])):
            kid = leaning(self.project(x[go], at[go], self.level[at[go]]), self.ways[at[go]])
            at[go], key[go] = self.child[at[go]] + kid, child_key(key[go], kid)
        for step in range(self.deeper.shape[1]):
            go = np.flatnonzero(self.deeper[at, step])
            if len(go):
                kid = leaning(self.project(x[go], at[go], self.level[at[go]] + step), self.deeper[at[go], step])
                key[go] = child_key(key[go], kid)
        return key

    def opened(self, q: np.ndarray, node: int, step: int) -> tuple[list[int], list[float]] | None:
        """Children of a node (below the fitted part: of its cut ``step``), the likeliest first, and what each costs; None for a leaf."""
        ways = int(self.ways[node]) if step == 0 and self.ways[node] else int(self.deeper[node, step]) if step < self.deeper.shape[1] else 0
        if not ways:
            return None
        p = (q - self.centre[self.row[node]]) @ self.turns[(int(self.level[node]) + step) % LEVELS][:, : ways // 2]
        both = np.empty(ways)
        both[::2], both[1::2] = p, -p
        gap = both.max() - both
        order = np.argsort(gap, kind="stable")
        return order.tolist(), (gap[order] ** 2).tolist()


def fit(sample: np.ndarray, ratio: float, seed: int) -> Tree:
    """A tree for ``ratio`` rows a point of the sample."""
    rng = np.random.default_rng(seed)
    turns = np.stack([directions(rng, sample.shape[1]) for _ in range(LEVELS)])
    means, ways, child, level, row, rest = [], [], [], [], [], []
    at, node, count, first, rows_at = np.arange(len(sample)), np.zeros(len(sample), np.int64), 1, 0, 0
    for l in range(LEVELS):
        size = np.bincount(node, minlength=count)
        rows = size * ratio
        split = (rows > 2 * ROWS) & (size >= FEWEST) & (l + 1 < LEVELS)
        more = ~split & (rows > 2 * ROWS)
        centred = np.flatnonzero(split | more)
        order = np.argsort(node, kind="stable")
        starts = (np.cumsum(size) - size)[centred]
        held = np.zeros((count, sample.shape[1]))
        if len(centred):
            sums = np.add.reduceat(sample[at[order]], np.c_[starts, starts + size[centred]].ravel().clip(max=len(order) - 1), axis=0)[::2]
            last = starts + size[centred] == len(order)
            if last.any():  # reduceat has no end beyond the last row
                sums[last] = sample[at[order[starts[last][0] :]]].sum(axis=0)
            held[centred] = sums / size[centred, None]
        w = np.where(split, ways_of(rows, size), 0)
        kids = first + count + np.cumsum(w) - w
        number = np.full(count, -1)
        number[centred] = rows_at + np.arange(len(centred))
        rows_at += len(centred)
        means.append(held[centred])
        ways.append(w)
        child.append(np.where(split, kids, -1))
        level.append(np.full(count, l))
        row.append(number)
        rest.append(np.where(more, rows, 0.0))
        go = split[node]
        at, node = at[go], node[go]
        if not len(at):
            break
        kid = leaning((sample[at] - held[node]) @ turns[l], w[node])
        node = (kids[node] - first - count) + kid
        first, count = first + count, int(w.sum())
    rest_all = np.concatenate(rest)
    deeper = []
    while (rest_all > 2 * ROWS).any():
        w = np.where(rest_all > 2 * ROWS, ways_of(rest_all, rest_all), 0)
        deeper.append(w)
        rest_all = np.where(w > 0, rest_all / np.maximum(w, 1), 0.0)
    total = len(rest_all)
    return Tree(turns, np.concatenate(means).astype(np.float32), *(np.concatenate(x) for x in (ways, child, level, row)), np.stack(deeper, axis=1) if deeper else np.zeros((total, 0), np.int64), seed)


def leaf_order(forest: list[Tree], q: np.ndarray):
    """Names of leaves in the order in which a query opens them: a priority queue over all trees."""
    queue, number = [], 0

    def enter(cost: float, t: int, node: int, step: int, key: int):
        nonlocal number
        number += 1
        kids = forest[t].opened(q, node, step)
        heapq.heappush(queue, (cost, number, t, node, step, key, 0, *(kids or (None, None))))

    for t, tree in enumerate(forest):
        enter(0.0, t, 0, 0, tree.seed)
    while queue:
        cost, _, t, node, step, key, i, kids, costs = heapq.heappop(queue)
        if kids is None:
            yield key
            continue
        if i + 1 < len(kids):
            number += 1
            heapq.heappush(queue, (cost - costs[i] + costs[i + 1], number, t, node, step, key, i + 1, kids, costs))
        name = child_key(key, kids[i])
        if forest[t].ways[node]:
            enter(cost, t, int(forest[t].child[node]) + kids[i], 0, name)
        else:
            enter(cost, t, node, step + 1, name)


def usable(v: Column) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, good) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error): x is codes * scale but for a difference of length ``error`` at most."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0  # of numbers so small that a 127th of them is none
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + 1e-9)


def possible(q: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The pairs, each once, that may be among the k nearest of their query, by bounds of their distances."""
    order = np.lexsort((row, q))
    q, row, low, high = (x[order] for x in (q, row, low, high))
    once = np.r_[True, (q[1:] != q[:-1]) | (row[1:] != row[:-1])] if len(q) else np.zeros(0, bool)
    q, row, low, high = (x[once] for x in (q, row, low, high))
    order = np.lexsort((high, q))
    begin = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(q)])
    limit = np.where(size >= k, high[order][np.minimum(begin + k - 1, max(len(q) - 1, 0))] if len(q) else 0.0, np.inf)
    keep = np.zeros(len(q), bool)
    keep[order] = low[order] <= np.repeat(limit, size)
    return q[keep], row[keep], low[keep], high[keep]


def compared(points: np.ndarray, asks: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of points, low, high): what the queries may have among their k nearest in the leaves that they ask for."""
    points, asks = points[np.argsort(points["leaf"], kind="stable")], asks[np.argsort(asks["leaf"], kind="stable")]
    start, stop = (np.searchsorted(points["leaf"], asks["leaf"], side) for side in ("left", "right"))
    who = np.searchsorted(vectors["qid"], asks["qid"])
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    ends, done, waiting = np.cumsum(stop - start), 0, 0
    while done < len(asks):
        stop_at = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        n = (stop - start)[done:stop_at]
        q = np.repeat(who[done:stop_at], n)
        row = np.repeat(start[done:stop_at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for at in range(0, len(q), PAIRS):
            a, b = q[at : at + PAIRS], row[at : at + PAIRS]
            d = np.sqrt(((vectors["v"][a] - points["code"][b] * points["scale"][b, None]) ** 2).sum(axis=1))
            held.append((a, b, d * (1 - 1e-12) - points["error"][b], d * (1 + 1e-12) + points["error"][b]))
            waiting += len(a)
            if waiting > 64 * PAIRS:
                held, waiting = [_kept(held, points, k)], 0
        done = stop_at
    q, row, low, high = _kept(held, points, k)
    return vectors["qid"][q], points["rep"][row], low, high


def _kept(held, points: np.ndarray, k: int):
    q, row, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
    # The same vector comes from several trees: it is one candidate.
    _, first = np.unique(points["rep"][row], return_index=True) if len(row) else (row, row)
    same = row[first][np.searchsorted(points["rep"][row][first], points["rep"][row])] if len(row) else row
    return possible(q, same, low, high, k)


def _blobs(kind: int, rows: np.ndarray, bucket: np.ndarray):
    """(bucket, kind, bytes) of structured rows."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[s]), kind, rows[s:e].tobytes()


def _batch(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, kind, data = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


def nearest_of(points: DataFrame, asked: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(qid, rep, d): the k nearest of each of a few queries among all ``points`` (rep, v), other than an equal vector, by brute force."""
    qid, q = np.array([i for i, _ in asked]), np.array([v for _, v in asked])

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                x, rep = matrix(part.column(1)), part.column(0).to_numpy()
                d = np.maximum((q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * q @ x.T, 0.0)
                near = np.argsort(d, axis=1)[:, : k + 1]
                best.append((np.repeat(np.arange(len(q)), near.shape[1]), rep[near.ravel()], np.take_along_axis(d, near, 1).ravel()))
            i, rep, d = (np.concatenate(c) for c in zip(*best, strict=True))
            order = np.lexsort((d, i))
            first = np.searchsorted(i[order], i[order])
            best = [tuple(c[order][np.arange(len(order)) - first <= k] for c in (i, rep, d))]
        i, rep, d = best[0]
        yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(rep), pa.array(d)], names=["qid", "rep", "d"])

    found = points.select("rep", "v").mapInArrow(run, "qid long, rep long, d double")
    by = Window.partitionBy("qid").orderBy("d", "rep")
    return found.withColumn("r", F.row_number().over(by)).where(F.col("r").between(2, k + 1)).drop("r")  # the first is the query's own vector


def calibrated(points: DataFrame, asked: DataFrame, shared, k: int) -> int:
    """Leaves that a query must open so that TARGET of the neighbours of CALIBRATED queries are found."""
    spark = points.sparkSession
    few = [(r["qid"], np.array(r["v"], float)) for r in asked.orderBy(F.xxhash64("qid"), "qid").limit(CALIBRATED).collect()]
    near = nearest_of(points, few, k).join(points.select("rep", "v"), "rep").select("qid", "v")
    mine = dict(few)

    def run(batches):
        forest = shared.value
        for b in batches:
            qid, x = b.column(0).to_numpy(), matrix(b.column(1))
            names = [tree.leaves(x) for tree in forest] if len(x) else []
            ranks = np.full(len(x), OPENED + 1, np.int64)
            for i in np.unique(qid).tolist():
                at = np.flatnonzero(qid == i).tolist()
                where: dict[int, list[int]] = {}
                for leaves in names:
                    for a in at:
                        where.setdefault(int(leaves[a]), []).append(a)
                left = set(at)
                for n, key in zip(range(1, OPENED + 1), leaf_order(forest, mine[i])):
                    for a in where.get(key, ()):
                        if a in left:
                            left.discard(a)
                            ranks[a] = n
                    if not left:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(ranks)], names=["rank"])

    ranks = sorted(r["rank"] for r in near.repartition(partitions(spark), "qid").mapInArrow(run, "rank long").collect())
    return min(OPENED, ranks[math.ceil(TARGET * len(ranks)) - 1]) if ranks else 1


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids): each vector once, with its smallest k + 1 ids, under a number of its own."""
    nearest_ids = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(nearest_ids)).where(F.col("r") <= k + 1)
    return cut(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("rep"), "v", "ids"))


def planted(points: DataFrame, count: int):
    """The forest for ``points``, broadcast; its size is bounded by the sample."""
    part = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE / count) * (1 << 30))
    chosen = points.where(part).select("v").toArrow().column("v").combine_chunks()
    if not len(chosen):
        chosen = points.select("v").limit(1).toArrow().column("v").combine_chunks()
    sample = matrix(chosen)
    sample = sample[np.lexsort(sample.T[:2])]
    return points.sparkSession.sparkContext.broadcast([fit(sample, count / len(sample), 1000 + t) for t in range(TREES)])


def search(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row for which ``is_query`` holds."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(F.col("id").isNotNull()).where(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    size = lengths["n"]
    rows = rows.where(F.size("v") == size)
    points = distinct_vectors(rows, k)
    count = points.count()
    queries = rows.where("q").select("id", "v")
    asked = cut(queries.groupBy("v").agg(F.min("id").alias("qid")))
    if asked.isEmpty():
        return empty
    shared = planted(points, count)
    want = calibrated(points, asked, shared, k)
    point = np.dtype([("leaf", "<u8"), ("rep", "<i8"), ("scale", "<f8"), ("error", "<f8"), ("code", "i1", (size,))])
    ask, query = np.dtype([("qid", "<i8"), ("leaf", "<u8")]), np.dtype([("qid", "<i8"), ("v", "<f8", (size,))])
    buckets = max(partitions(spark), -(-count * TREES * point.itemsize // BUCKET_BYTES))

    def index(batches):
        forest = shared.value
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                x = matrix(part.column(1))
                codes, scale, error = coded(x)
                out = np.empty(len(x) * len(forest), point)
                for t, tree in enumerate(forest):
                    own = out[t * len(x) : (t + 1) * len(x)]
                    with np.errstate(over="ignore"):
                        own["leaf"] = tree.leaves(x)
                    own["rep"], own["scale"], own["error"], own["code"] = part.column(0).to_numpy(), scale, error, codes
                yield _batch(list(_blobs(0, out, spread(out["leaf"], buckets))))

    def route(batches):
        forest = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                x, qid = matrix(part.column(0)), part.column(1).to_numpy()
                found = []
                for q, i in zip(x, qid.tolist(), strict=True):
                    own = np.fromiter((key for _, key in zip(range(want), leaf_order(forest, q))), np.uint64)
                    found.append(np.rec.fromarrays([np.full(len(own), i), own], dtype=ask))
                asks = np.concatenate(found)
                where = spread(asks["leaf"], buckets)
                place, who = (c.ravel() for c in np.unique(np.c_[where, np.searchsorted(np.sort(qid), asks["qid"])], axis=0).T)
                vectors = np.empty(len(x), query)
                vectors["qid"], vectors["v"] = qid, x
                vectors = vectors[np.argsort(qid)]
                yield _batch([*_blobs(1, asks, where), *_blobs(2, vectors[who], place)])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        data = lambda t, kind, dtype: np.frombuffer(b"".join(d for n, d in zip(t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True) if n == kind), dtype)
        points_here, asks, vectors = data(left, 0, point), data(right, 1, ask), data(right, 2, query)
        out = compared(points_here, asks, vectors[np.argsort(vectors["qid"])], k + 1)
        tidy()
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out], names=["qid", "rep", "low", "high"])

    blob = "bucket int, kind int, data binary"
    indexed = points.select("rep", "v").mapInArrow(index, blob)
    routed = asked.select("v", "qid").repartition(partitions(spark), "qid").mapInArrow(route, blob)
    near = indexed.groupBy("bucket").cogroup(routed.groupBy("bucket")).applyInArrow(rerank, "qid long, rep long, low double, high double")
    each = near.groupBy("qid", "rep").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    mine = Window.partitionBy("qid")
    ranked = each.withColumn("r", F.row_number().over(mine.orderBy("high", "rep")))
    limit = F.coalesce(F.min(F.when(F.col("r") == k + 1, F.col("high"))).over(mine), F.lit(float("inf")))
    left = ranked.withColumn("limit", limit).where("low <= limit").select("qid", "rep")
    exact = _distances(left.join(points, "rep").join(asked.withColumnRenamed("v", "w"), "qid").select("qid", "v", "w", "ids"))
    flat = exact.select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy("score", "vec_id")
    top = flat.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("top"))
    # Each query takes the list of its vector, leaves itself out and numbers the rest.
    named = queries.join(asked, "v").select(F.col("id").alias("query_id"), "qid").join(top, "qid")
    rest = F.slice(F.filter("top", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(rest).alias("p", "c")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def _distances(pairs: DataFrame) -> DataFrame:
    """(qid, score, ids) of (qid, v, w, ids): exact distances of v and w."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                score = np.sqrt(((matrix(part.column(2)) - matrix(part.column(1))) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), part.column(3)], names=["qid", "score", "ids"])

    return pairs.mapInArrow(run, "qid long, score double, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)
