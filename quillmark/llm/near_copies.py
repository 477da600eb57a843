"""Near copies by exact Jaccard similarity of word shingles, beginning with operator 9's search.

A text's set: A-Z lower-cased, words between ASCII white space, XXH64 with seed 42 of each five words
(a shorter text is one shingle, a wordless one none). Two texts are linked if their sets have a Jaccard
similarity of 0.8 or more; classes are the components of all links.

Operator 9's generalised pigeonhole (``simhash_dedup.links``) over the sets' SimHash fingerprints proposes
links first, which are verified on the whole sets; that settles most copies. A similarity of 0.8 lies near
10 differing bits of 64, where random fingerprints of a large corpus begin to meet by chance, so no radius
is both complete and cheap there. What the fingerprints leave apart goes through an exact prefix filter:
sets are ordered alike, shingles that are frequent in a sample last (the order decides cost alone), and two
sets that are similar enough share a shingle among the first s - ceil(0.8 s) + 1 of each. Under such a
shingle all pairs of different components are compared by size and by a sketch of parities, whose distance
is never more than the symmetric difference; of large sets the sketch holds a share, chosen by hash, and the
bound allows seven deviations, so that it drops a true link with a chance below 1e-9. What is left is
verified on the whole sets. Of a crowd of near copies each member is first tried with its nearest earlier
one only; all pairs that these links leave in different components follow.

Sets are told apart by a 64-bit digest. Rows are named by any column, a struct too; null names keep their class; wordless texts are one
class. An empty table gives no rows. Very long texts are worked on whole; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import simhash_dedup
from quillmark.llm.shared import components, cut, partitions, portions

SHINGLE = 5
#: Bits of a sketch, and shingles that it may hold: of larger sets it holds the half, quarter and so on that fits.
SKETCH, HELD = 1024, 1024
#: Deviations by which a sketch's distance may be above what the similarity allows.
DEVIATIONS = 7
#: Texts that frequencies are learnt from, in expectation; a shingle counts as frequent from LEAST of them, and MOST are kept.
SAMPLE, LEAST, MOST = 4_000, 3, 200_000
#: Rows of a bucket beyond which it is dealt to several tasks.
CELL = 2048
#: Nodes up to which a list of them is broadcast.
SMALL = 50_000


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(simhash_dedup.hashed(text, shingle))


def rate_of(size):
    """k of the sketch of a set: it holds the shingles whose second hash ends in k zeros."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / HELD))).astype(np.int64)


def sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    """Parities of the hashes that the sketch holds, in two halves: first those that the next coarser sketch holds too."""
    rate = int(rate_of(len(hashes)))
    second = hashes >> np.uint64(20)
    held = (second & np.uint64((1 << rate) - 1)) == 0
    coarser = (second[held] >> np.uint64(rate)) & np.uint64(1)
    place = (hashes[held] % np.uint64(bits // 2)).astype(np.int64) + (bits // 2) * coarser.astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1).tobytes()


def may_be_similar(size_x: np.ndarray, x: np.ndarray, size_y: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each x and y (sizes and sketches, broadcast against each other) may be similar."""
    rate_x, rate_y = rate_of(size_x), rate_of(size_y)
    half = x.shape[-1] // 2
    count = lambda z: np.bitwise_count(z).sum(axis=-1, dtype=np.int64)
    same = count(x ^ y)
    # A finer sketch's first half is of the shingles that the next coarser one holds in both halves.
    finer_x = count(x[..., :half] ^ y[..., :half] ^ y[..., half:])
    finer_y = count(y[..., :half] ^ x[..., :half] ^ x[..., half:])
    far = np.where(rate_x == rate_y, same, np.where(rate_x < rate_y, finer_x, finer_y))
    coarse = np.maximum(rate_x, rate_y)
    expected = (size_x + size_y) / 9 / 2.0**coarse
    limit = np.where(coarse == 0, expected, expected + DEVIATIONS * (np.sqrt(expected) + 1))
    return (far <= limit) & (5 * np.minimum(size_x, size_y) >= 4 * np.maximum(size_x, size_y)) & (np.abs(rate_x - rate_y) <= 1), far


def digest(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 7)], np.uint64).view(np.int64)[0])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 9 * both >= 4 * (len(x) + len(y))


def frequent(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted, and texts with each) of shingles that are frequent in a sample of different texts."""
    every = max(1, df.count() // SAMPLE)
    sample = df.where(F.pmod(F.xxhash64(text, F.lit(7)), F.lit(every)) == 0).select(F.col(text).alias("text")).distinct()

    def run(batches):
        for b in portions(batches):
            found = [shingles(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["h"])

    top = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "h").limit(MOST).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def with_heads(df: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, code, node, fp, size, prefix, sketch) of each row (id, code, text): the set's digest, its SimHash fingerprint, and its first shingles in the common order, of which two similar sets share one at least."""

    def run(batches):
        common, counts = often
        for b in portions(batches):
            out = []
            for x in b.column(2).to_pylist():
                h = shingles(x)
                order = h
                if len(common) and len(h):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    order = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
                out.append((digest(h), simhash_dedup.majority(h), len(h), order[: len(h) - (4 * len(h) + 4) // 5 + 1].tobytes(), sketch(h)))
            node, fp, size, prefix, sketches = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(prefix, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "code", "node", "fp", "size", "prefix", "sketch"])

    return df.select("id", "code", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, code long, node long, fp long, size long, prefix binary, sketch binary")


def prefixes(heads: DataFrame) -> DataFrame:
    """(bucket, node): the shingles of the prefixes."""

    def run(batches):
        for b in portions(batches):
            nodes, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for node, prefix in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                buckets.append(np.frombuffer(prefix, np.int64))
                nodes.append(np.full(len(buckets[-1]), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(nodes))], names=["bucket", "node"])

    return heads.select("node", "prefix").mapInArrow(run, "bucket long, node long")


def near_pairs(node: np.ndarray, size: np.ndarray, root: np.ndarray, bits: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell's rows in different components that may be similar; with ``nearest``, of each row the nearest earlier one only."""
    order = np.argsort(node, kind="stable")
    node, size, root, bits = node[order], size[order], root[order], bits[order]
    n, us, vs = len(node), [], []
    block = max(1, (1 << 20) // (n * bits.shape[1]))
    for at in range(0, n, block):
        rows = np.arange(at, min(at + block, n))
        may, far = may_be_similar(size[rows, None], bits[rows, None], size[None], bits[None])
        may &= (root[rows, None] != root[None]) & (rows[:, None] > np.arange(n)[None])
        if nearest:
            i = np.flatnonzero(may.any(axis=1))
            j = np.where(may[i], far[i], np.iinfo(np.int64).max).argmin(axis=1)
        else:
            i, j = np.nonzero(may)
        us.append(node[j])
        vs.append(node[rows[i]])
    return np.concatenate(us), np.concatenate(vs)


def candidates(rows: DataFrame, nearest: bool) -> DataFrame:
    """Different (u, v) of rows (bucket, k, node, size, root, sketch), k tasks to a bucket and side."""

    def worked(t: pa.Table):
        bucket, a, b, node, size, root = (t.column(c).to_numpy() for c in ("bucket", "a", "b", "node", "size", "root"))
        if not len(bucket):
            return
        bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(bucket), -1)
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        for s, e in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
            if e - s > 1:
                u, v = near_pairs(node[s:e], size[s:e], root[s:e], bits[s:e], nearest)
                if len(u):
                    yield u, v

    def packed(t: pa.Table):
        found = list(worked(t))
        if found:
            u, v = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 20_000:
                continue
            t = pa.Table.from_batches(held)
            last = np.logical_and.reduce([x[-1] == x for x in (t.column(c).to_numpy() for c in ("bucket", "a", "b"))])
            at = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            yield from packed(t.slice(0, at))
            held = t.slice(at).to_batches()
        if held:
            yield from packed(pa.Table.from_batches(held))

    chunk = F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int").alias("c")
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    cells = rows.select("bucket", chunk, other, "node", "size", "root", "sketch").select("bucket", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "node", "size", "root", "sketch")
    by = ["bucket", "a", "b"]
    return cells.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, heads: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar; only the texts of the pairs' nodes are read again."""

    def sets(batches):
        for b in portions(batches):
            found = [shingles(x) for x in b.column(1).to_pylist()]
            same = [digest(h) == node for h, node in zip(found, b.column(0).to_pylist(), strict=True)]  # not so for another text of the same code
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in found], pa.binary())], names=["node", "hashes"]).filter(pa.array(same, pa.bool_()))

    def run(batches):
        for b in portions(batches):
            u, v, x, y = (b.column(i) for i in range(4))
            keep = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = cut(heads.select("node", "code").join(ends, "node", "left_semi"))
    read = rows.join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted, "code").select("node", "text").mapInArrow(sets, "node long, hashes binary")
    held = cut(read.dropDuplicates(["node"]))
    x, y = held.select(F.col("node").alias("u"), F.col("hashes").alias("x")), held.select(F.col("node").alias("v"), F.col("hashes").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def proposed(heads: DataFrame) -> DataFrame:
    """Different (u, v) of operator 9: nodes of one fingerprint with the smallest of them, and the star edges of fingerprints within its radius."""
    fps = cut(heads.groupBy("fp").agg(F.min("node").alias("id")))
    equal = heads.join(fps, "fp").where("node <> id").select(F.col("id").alias("u"), F.col("node").alias("v"))
    return simhash_dedup.links(fps).union(equal).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def links(heads: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): edges between nodes of ``heads`` (one row each) whose components are those of all links; ``texts`` (code, text) has their texts."""
    rows = prefixes(heads)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / CELL).cast("int").alias("k"))
    rows = cut(rows.join(shared, "bucket").join(heads.select("node", "size", "sketch"), "node").select("bucket", "k", "node", "size", "sketch"))
    known = cut(verified(cut(proposed(heads)), heads, texts))
    for nearest in (True, False):
        roots = components(known).select("node", F.col("root").alias("reached"))
        rest = rows.join(roots, "node", "left").withColumn("root", F.coalesce("reached", "node"))
        known = known.union(cut(verified(cut(candidates(rest, nearest)), heads, texts)))
    return known


def classes(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, code, class) of each row of df: the text's hash, and a number that near copies share."""
    rows = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("code"), F.col(text).alias("text"))
    sets = cut(with_heads(rows, frequent(df, text)))
    heads = cut(sets.drop("id").dropDuplicates(["node"]))
    roots = components(links(heads, rows.select("code", "text")))
    return sets.select("id", "code", "node").join(roots, "node", "left").select(F.col("id").alias(key), "code", F.coalesce("root", "node").alias("class"))
