"""Exact and near duplicates, links and their components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import word_shingles
from quillmark.operators.lineage import components, cut

#: Texts that the order of shingles is learnt from, in expectation, and how many frequent shingles are kept; both decide cost alone.
SAMPLE, MOST = 8_000, 200_000
#: Rows of a bucket beyond which it is dealt to several tasks.
CELL = 2048
#: Bits of the set of wanted ids that saves moving other texts.
SLOTS = 1 << 22


def exact_clusters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(hash, n, first_id, last_id) of texts that occur more than once. Members aren't collected: a cluster may hold any share of the rows."""
    hashed = df.select(F.col(key).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def hashed_shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted set of a text's runs of n words, as XXH64; all words if there are fewer, none if there are none. Words are what lies between ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, code = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, last = np.r_[0, ends[:-1] + 1].tolist(), ends[n - 1 :].tolist() or [len(joined)]
    return np.unique(np.fromiter((code(joined[i:j]) for i, j in zip(starts, last, strict=False)), np.uint64, len(last)))


def sliced(batches, rows: int = 512):
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def frequent_shingles(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted, and in how many texts) of shingles that are frequent in a sample. They only say in which order shingles are taken, so they decide cost and no result."""
    every = max(1, whole.count() // SAMPLE)

    def run(batches):
        for b in sliced(batches):
            found = [hashed_shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["x"])

    sample = whole.where(F.pmod(F.xxhash64("t", F.lit(7)), F.lit(every)) == 0).select("t").distinct().mapInArrow(run, "x long")
    top = sample.groupBy("x").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "x").limit(MOST).toArrow()
    x, n = top.column("x").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def first_shingles(rows: DataFrame, often: tuple[np.ndarray, np.ndarray], least: float) -> DataFrame:
    """(id, h, n, s): how many shingles each row (id, h, c, t) has, and the first of them, the frequent ones last, with the group's code c in each."""

    def run(batches):
        common, counts = often
        for b in sliced(batches):
            size, first = [], []
            for c, t in zip(b.column(2).to_numpy().view(np.uint64), b.column(3).to_pylist(), strict=True):
                x = hashed_shingles(t)
                size.append(len(x))
                if len(common) and len(x):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    x = x[np.argsort(np.where(common[at] == x, counts[at], 0), kind="stable")]
                first.append((x[: len(x) - math.ceil(least * len(x) - 1e-9) + 1] * np.uint64(0x9E3779B97F4A7C15) + c).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(first, pa.binary())], names=["id", "h", "n", "s"])

    return rows.select("id", "h", "c", "t").mapInArrow(run, f"id {_kind(rows)}, h string, n int, s binary")


def _kind(df: DataFrame, column: str = "id") -> str:
    return df.schema[column].dataType.simpleString()


def exploded(first: DataFrame) -> DataFrame:
    """(x, id, n): a row for each of the first shingles."""

    def run(batches):
        for b in sliced(batches):
            each = [np.frombuffer(s, np.int64) for s in b.column(2).to_pylist()]
            at = np.repeat(np.arange(len(each)), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["x", "id", "n"])

    return first.select("id", "n", "s").mapInArrow(run, f"x long, id {_kind(first)}, n int")


def met(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """(a, b, x, n, chunk) of rows (*by, id, n, perhaps chunk) with equal ``by``: the pairs a < b whose sizes are close enough; without chunks, the rows of a bucket of
    over CELL of them are told as they are, in a, with the chunk that they are in. Each row moves once."""
    kind, names = _kind(rows), ["a", "b", "x", "n", "chunk"]
    whole = "chunk" not in rows.columns

    def worked(t: pa.Table):
        t = t.combine_chunks()
        keys = [t.column(c).to_numpy() for c in by]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        ends = np.r_[starts[1:], t.num_rows]
        n, ids = t.column("n").to_numpy(), t.column("id").combine_chunks()

        def told(i, j):
            near = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[near], j[near]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), *(pa.nulls(len(i), k) for k in (pa.int64(), pa.int32(), pa.int64()))], names=names)

        two = starts[ends - starts == 2]
        left, right, held = [two], [two + 1], len(two)
        more = ends - starts > 2
        for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            if whole and e - s > CELL:
                for at in range(s, e, CELL):
                    m = min(CELL, e - at)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, m), pa.nulls(m, ids.type), pa.array(keys[0][at : at + m]), pa.array(n[at : at + m]), pa.array(np.full(m, (at - s) // CELL))], names=names)
                continue
            i, j = np.triu_indices(e - s, 1)
            left.append(i + s)
            right.append(j + s)
            held += len(i)
            if held > 1 << 20:
                yield told(np.concatenate(left), np.concatenate(right))
                left, right, held = [], [], 0
        if held:
            yield told(np.concatenate(left), np.concatenate(right))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 50_000:
                continue
            t = pa.Table.from_batches(held)
            last = np.logical_and.reduce([k[-1] == k for k in (t.column(c).to_numpy() for c in by)])
            at = 0 if last.all() else len(last) - int(last[::-1].argmin())
            if at:
                yield from worked(t.slice(0, at))
            held = t.slice(at).to_batches()
        if sum(x.num_rows for x in held):
            yield from worked(pa.Table.from_batches(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by).sortWithinPartitions(*by, "id").mapInArrow(run, f"a {kind}, b {kind}, x long, n int, chunk long")


def bucket_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Different (a, b), a < b, of rows (x, id, n) with an equal x and sizes that are close enough."""
    found = cut(met(rows, ["x"], least))
    large = found.where("chunk is not null").select("x", F.col("a").alias("id"), "n", "chunk")
    chunks = large.groupBy("x").agg((F.max("chunk") + 1).alias("k"))
    cells = large.join(chunks, "x").select("x", "id", "n", "chunk", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    cells = cells.select("x", F.least("chunk", "o").alias("c"), F.greatest("chunk", "o").alias("d"), "id", "n", "chunk")
    return found.where("chunk is null").select("a", "b").union(met(cells, ["x", "c", "d"], least).select("a", "b")).where("a < b").distinct()


def of_ids(whole: DataFrame, ids: DataFrame, columns: str, made) -> DataFrame:
    """(id, h, g, columns) of the rows (id, h, g, t) whose id is one of ``ids``, and perhaps of others whose hash is equal; ``made`` gives the columns from a list of sets. Texts don't move."""
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(SLOTS))
    bits = np.zeros(SLOTS, bool)
    bits[ids.select(slot("id").alias("x")).distinct().toArrow().column("x").to_numpy()] = True
    packed = np.packbits(bits)
    names = ["id", "h", "g", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches):
        wanted = np.unpackbits(packed).view(bool)
        for b in sliced(batches):
            b = b.filter(pa.array(wanted[b.column(4).to_numpy()]))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made([hashed_shingles(t) for t in b.column(3).to_pylist()])], names=names)

    return whole.select("id", "h", F.col("g").cast("string").alias("g"), "t", slot("id").alias("x")).mapInArrow(run, f"id {_kind(whole)}, h string, g string, {columns}")


def parities(x: np.ndarray) -> bytes:
    """Parity bits of a set, as many as it has members to twice that, 64 to 8192: two sets differ in as many members at least as in bits."""
    bits = min(8192, max(64, 1 << (len(x) - 1).bit_length()))
    return np.packbits(np.bincount(((x >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two sets differ; the finer bits are folded to the coarser ones."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    m = min(len(p), len(q))
    fold = lambda z: np.bitwise_xor.reduce(z.reshape(-1, m), axis=0)
    return int(np.bitwise_count(fold(p) ^ fold(q)).sum())


def without_distant(near: DataFrame, whole: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """near without pairs whose parities show that they aren't similar enough; none that are is dropped."""
    ids = near.select(F.explode(F.array("a", "b")).alias("id"))
    made = lambda sets: [pa.array([len(x) for x in sets], pa.int32()), pa.array([parities(x) for x in sets], pa.binary())]
    held = cut(of_ids(whole, ids, "n int, s binary", made).join(texts.select("id", "h"), ["id", "h"], "left_semi"))

    def run(batches):
        for b in batches:
            each = zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)
            keep = [bits_apart(s, t) * (1 + least) <= (n + m) * (1 - least) + 1e-6 for n, s, m, t in each]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (held.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    return near.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, f"a {_kind(near, 'a')}, b {_kind(near, 'a')}").distinct()


def scored_pairs(near: DataFrame, whole: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach ``least`` and are of one group. Pairs are dealt to cells by both ends, and a set goes once to each cell that has a pair of it, not to each pair."""
    ids = near.select(F.explode(F.array("a", "b")).alias("id"))
    made = lambda sets: [pa.array([x.tobytes() for x in sets], pa.binary())]
    held = cut(of_ids(whole, ids, "s binary", made).join(texts.select("id", "h"), ["id", "h"], "left_semi"))
    side = max(4, math.ceil(math.sqrt(2 * int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(13)), F.lit(side))
    dealt = near.select((place("a") * side + place("b")).alias("cell"), "a", "b")
    sets = dealt.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("id")).distinct().join(held, "id").select("at", "id", "g", "s")

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        of: dict = {}
        for i, g, s in zip(*(sets.column(c).to_pylist() for c in ("id", "g", "s")), strict=True):
            of.setdefault(i, []).append((g, np.frombuffer(s, np.uint64)))
        left, right, score = [], [], []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            for ga, x in of.get(a, ()):
                for gb, y in of.get(b, ()):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if ga == gb and both / (len(x) + len(y) - both) >= least:
                        left.append(a)
                        right.append(b)
                        score.append(both / (len(x) + len(y) - both))
        return pa.table([pa.array(left, pairs.schema.field("a").type), pa.array(right, pairs.schema.field("b").type), pa.array(score, pa.float64())], names=["a", "b", "jaccard"])

    return dealt.groupBy("cell").cogroup(sets.groupBy("at")).applyInArrow(run, f"a {_kind(near, 'a')}, b {_kind(near, 'a')}, jaccard double").distinct()


def similar_pairs(df: DataFrame, key: str, group: str, text: str, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): the distinct texts of each group, by SHA-256, with their smallest id, and (a, b, jaccard) of ids whose word shingles are that similar.

    Exact: with shingles in any fixed order, two sets that reach ``least`` share one of the first n - ceil(least * n) + 1 of each, so only
    those meet, each moved once; sizes must be close enough too. Frequent shingles come last, so that few other sets meet. Of those that
    do most are told apart by parities, and what is left is verified on the whole sets. Texts never move.
    """
    whole = df.select(F.col(key).alias("id"), F.col(group).alias("g"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.sha2("t", 256))
    texts = cut(whole.groupBy("g", "h").agg(F.min("id").alias("id")))
    linked = whole.where("g is not null and id is not null").withColumn("c", F.xxhash64("g"))
    first = first_shingles(linked, frequent_shingles(linked), least).join(texts.select("id", "h"), ["id", "h"], "left_semi")
    near = cut(bucket_pairs(exploded(first), least))
    near = cut(without_distant(near, linked, texts, least))
    return texts, scored_pairs(near, linked, texts, least)


def classes(df: DataFrame, key: str, group: str, text: str, least: float = 0.8) -> DataFrame:
    """(key, class_id, n_links) of each row: the class's smallest id, and to how many different texts its text is linked."""
    texts, pairs = similar_pairs(df, key, group, text, least)
    pairs = cut(pairs)
    roots = components(pairs, "a", "b")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = texts.join(roots, texts["id"] == roots["node"], "left").join(degree, "id", "left").select("g", "h", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = df.select(F.col(key), F.col(group).alias("g"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))
    return rows.join(named, (rows["g"].eqNullSafe(named["g"])) & (rows["h"] == named["h"])).select(key, "class_id", "n_links")


def overlap_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str = "text", n: int = 8, least: float = 0.5) -> DataFrame:
    """(left_key, right_key, n_shared, share): rows of two datasets that share at least this part of the right one's word n-grams.

    N-grams are joined as they are, not by a hash; of a small right side they are broadcast by size, and the left side isn't moved at all.
    """
    grams = lambda df, k: df.select(F.col(k), F.explode(word_shingles(F.col(text), n)).alias("x"))
    sizes = right.select(F.col(right_key), F.size(word_shingles(F.col(text), n)).alias("size"))
    shared = grams(left, left_key).join(grams(right, right_key), "x").groupBy(left_key, right_key).agg(F.count("*").alias("n_shared"))
    return shared.join(sizes, right_key).select(left_key, right_key, "n_shared", (F.col("n_shared") / F.col("size")).alias("share")).where(F.col("share") >= least)


def first_seen_mode(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, mode, modal_share: the commonest value, the one seen first on a tie."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    rank = Window.partitionBy(*by).orderBy(F.desc("n"), "seen")
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumns({"r": F.row_number().over(rank), "modal_share": F.col("n") / total}).where("r = 1").select(*by, F.col(value).alias("mode"), "modal_share")
