"""SimHash near-duplicate classes with the generalised pigeonhole principle (operator 9).

Fingerprint: A-Z lower-cased, words between ASCII white space, 4-word shingles with repeats (a shorter
text is one shingle), XXH64 with seed 42 of each; a bit is 1 where over half the hashes have it.

Search, over *distinct* fingerprints only (copies have met in a partial aggregate before):
the 64 bits are grouped into m parts by their correlation over all fingerprints, correlated bits
together, so that parts are as independent as they can be. If the thresholds t of the parts sum to
radius - m + 1, any two fingerprints within the radius differ by at most t in one part at least.
Thresholds are unequal: dynamic programming minimises the estimated candidates, where a part's
collisions are counted over all fingerprints and a threshold multiplies them by the values probed
(by Cauchy-Schwarz an upper bound). Fingerprints meet under (part, value); all pairs of a bucket are
verified by popcount in blocks, and only star edges of the bucket's own components leave it, at most
one a member. A bucket of over CELL rows is dealt as chunk pairs to many tasks, so that no task has
more than 2 * CELL rows whatever the skew; every pair of chunks is compared, so no link is lost.
Components of the edges are then found by label contraction (``shared.components``).

Null, empty and wordless texts have fingerprint zero and are linked like any other. Ties and repeated
rows share a class. An empty table gives no rows. Rows without an id link others like any row and get the
class's smallest id, null if no row of it has one. Very long texts are hashed whole; other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.shared import components, cut, documents, partitions, portions

BITS, RADIUS, SHINGLE = 64, 4, 4
#: Rows of a bucket beyond which it is dealt to several tasks.
CELL = 2048
#: Cost of writing and moving one signature, in compared pairs.
ROW_COST = 400


def hashed(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; of all its words, if they are fewer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, in both steps
    if not words:
        return np.zeros(0, np.uint64)
    joined, code = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([code(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    a, b = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return np.fromiter((code(joined[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint, unsigned: a bit is 1 where over half the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(hashed(text, shingle))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """df with ``out`` long: the fingerprint's 64 bits as a signed number."""
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.LongType())])

    def run(batches):
        for b in portions(batches):
            fps = np.array([fingerprint(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(fps)], names=schema.names)

    return df.mapInArrow(run, schema)


def _bits(fps: np.ndarray) -> np.ndarray:
    """n x 64 of 0 and 1; column b is bit b, the lowest first."""
    return np.unpackbits(fps.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and the absolute correlation of each two bits, over all fingerprints."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            both, n = both + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.r_[both.ravel(), n])], names=["k", "v"])

    got = {r["k"]: r["v"] for r in fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n = got.get(BITS * BITS, 0)
    if not n:
        return 0, np.zeros((BITS, BITS))
    both = np.array([got[k] for k in range(BITS * BITS)]).reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    out = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(out, 0)
    return int(n), np.round(out, 9)


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal size; each begins with the most correlated bit left and takes those that correlate with it most."""
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (corr[b, part].mean(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def probes(width: int, t: int) -> int:
    return sum(comb(width, j) for j in range(t + 1))


def allocate(widths: list[int], collisions: list[float], n: int, radius: int = RADIUS) -> tuple[float, list[int]]:
    """(cost, thresholds): thresholds of -1 or more that sum to radius - parts + 1 at the least estimated cost, by dynamic programming."""
    want = radius - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for w, pairs in zip(widths, collisions, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, ts) in best.items():
            for t in range(-1, radius + 1):
                c = cost + (0 if t < 0 else probes(w, t) * (pairs + ROW_COST * n))
                if total + t not in step or (c, [*ts, t]) < step[total + t]:
                    step[total + t] = (c, [*ts, t])
        best = step
    return best[want]


def values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    """The part's bits of each fingerprint, packed."""
    u, out = fps.view(np.uint64), np.zeros(len(fps), np.int64)
    for k, b in enumerate(part):
        out |= (((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).view(np.int64)
    return out


def _masks(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in pick) for j in range(1, t + 1) for pick in combinations(range(width), j)]


def plan(fps: DataFrame, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """(parts, thresholds) for these distinct fingerprints."""
    n, corr = correlations(fps)
    widths = lambda m: [BITS // m + (k < BITS % m) for k in range(m)]
    m = min(range(2, radius + 2), key=lambda m: (allocate(widths(m), [n * n / 2 ** w for w in widths(m)], n, radius)[0], m))
    parts = group_bits(corr, m)

    def run(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for i, part in enumerate(parts):
                v, c = np.unique(values(x, part), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(c.astype(np.int64))], names=["part", "v", "c"])

    counted = fps.select("fp").mapInArrow(run, "part int, v long, c long").groupBy("part", "v").agg(F.sum("c").cast("double").alias("c"))
    pairs = {r["part"]: r["s"] for r in counted.groupBy("part").agg(F.sum(F.col("c") * F.col("c")).alias("s")).collect()}
    return parts, allocate([len(p) for p in parts], [pairs.get(i, 0.0) for i in range(m)], n, radius)[1]


def signatures(fps: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(bucket, probe, fp, id): each fingerprint under its value in each part in use, and as a probe under the values within the threshold."""
    masks = [_masks(len(p), t) for p, t in zip(parts, thresholds, strict=True)]

    def run(batches):
        for b in batches:
            x, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i, part in enumerate(parts):
                if thresholds[i] < 0:
                    continue
                v = values(x, part)
                for k, mask in enumerate([0, *masks[i]]):
                    yield pa.RecordBatch.from_arrays([pa.array((v ^ mask) | (i << 58)), pa.array(np.full(len(v), k > 0)), pa.array(x), pa.array(ids)], names=["bucket", "probe", "fp", "id"])

    return fps.select("fp", "id").mapInArrow(run, "bucket long, probe boolean, fp long, id long")


def star_edges(fp: np.ndarray, ids: np.ndarray, probe: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the components that a cell's rows form; two probes aren't compared."""
    order = np.argsort(ids, kind="stable")
    fp, ids, probe = fp[order].view(np.uint64), ids[order], probe[order]
    n, block = len(fp), max(1, (1 << 21) // max(1, len(fp)))
    near = np.empty((n, n), bool)
    for at in range(0, n, block):
        near[at : at + block] = np.bitwise_count(fp[at : at + block, None] ^ fp[None]) <= radius
        near[at : at + block] &= ~(probe[at : at + block, None] & probe[None])
    np.fill_diagonal(near, True)
    keep = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(keep):
        return ids[:0], ids[:0]
    near, label = near[np.ix_(keep, keep)], np.arange(len(keep))
    while True:
        new = np.empty_like(label)
        for at in range(0, len(keep), block):
            new[at : at + block] = np.where(near[at : at + block], label[None], len(keep)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(keep))
    return ids[keep][moved], ids[keep][label[moved]]


def _cells(batches):
    """Rows come sorted by cell; those of whole cells are worked off as soon as the next cell begins."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if len(rest[0]) < 50_000:
            continue
        last = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1]) & (rest[2] == rest[2][-1])
        at = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        yield from _worked([x[:at] for x in rest])
        rest = [x[at:] for x in rest]
    if rest is not None:
        yield from _worked(rest)


def _worked(rows: list[np.ndarray]):
    bucket, a, b, probe, fp, ids = rows
    if not len(bucket):
        return
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    starts = np.flatnonzero(new)
    us, vs = [], []
    for s, e in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
        if e - s > 1 and not probe[s:e].all():
            u, v = star_edges(fp[s:e], ids[s:e], probe[s:e].astype(bool))
            us.append(u)
            vs.append(v)
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """(u, v): edges between ids of distinct fingerprints ``fps`` (fp, id) whose components are those of all links."""
    parts, thresholds = plan(fps)
    signed = signatures(fps, parts, thresholds)
    heavy = signed.groupBy("bucket").count().where(F.col("count") > CELL).select("bucket", F.ceil(F.col("count") / CELL).cast("int").alias("k"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("k").cast("long")).cast("int")
    dealt = signed.join(heavy, "bucket", "left").withColumn("c", F.when(F.col("k").isNull(), 0).otherwise(chunk))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)).alias("o")
    cells = dealt.select("bucket", "probe", "fp", "id", "c", other).select("bucket", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "probe", "fp", "id")
    by = ["bucket", "a", "b"]
    return cells.repartition(partitions(fps.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(_cells, "u long, v long")


def classes(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) of each row of df; component_id is the smallest id that links lead to."""
    marked = cut(with_fingerprint(df.select(F.col(key).alias("id"), F.col(text).alias("text"))).select("id", "fp"))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("id")))
    # Fingerprints name the nodes, so that those of rows without an id link others too.
    roots = components(links(distinct.select("fp", F.col("fp").alias("id"))))
    every = roots.union(roots.select("root", "root").distinct())  # a root is a member too
    linked = distinct.join(every, F.col("fp") == F.col("node")).select("fp", "root", "id")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    met = linked.join(least, "root").select("fp", "least", F.lit(True).alias("met"))
    named = distinct.join(met, "fp", "left").select("fp", F.when(F.col("met"), F.col("least")).otherwise(F.col("id")).alias("component_id"))
    return marked.join(named, "fp").select(F.col("id").alias(key), "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
