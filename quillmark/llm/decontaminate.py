"""Benchmark decontamination with item-sized SimHash windows (operator 2).

For each benchmark item, documents are read in windows of the item's own length. A window's SimHash over
its SHINGLE-word shingles, BITS bits, is looked up in multi-index Hamming blocks: the fingerprint is in BLOCKS
blocks of a byte, each with a table of all items within one bit of a value there. Two fingerprints within
RADIUS bits have at most RADIUS // 2 blocks that differ in two bits or more, so at least AGREE = BLOCKS - RADIUS // 2 blocks in
which they are within one bit: the items that so many tables name are all items within RADIUS, and of
unrelated ones less than three in a hundred. Hits are verified with
the exact weighted Jaccard similarity (shingle counts as weights), which must reach SIMILARITY.

At a similarity of 0.8 the share of differing bits is arccos(8 / 9) / pi = 0.151, 38.8 of 256 bits with a
deviation of 5.7, so RADIUS = 57 passes by 99.9 % of windows at the very limit, and all that are more similar (the README has the measured recall).

A window that shares no shingle with an item has similarity zero, so windows are only formed around
shared shingles; that loses nothing. Words are ASCII-lower-cased and freed of punctuation at their ends;
words of punctuation alone are left out. An item or document of fewer words than a shingle is one
shingle; a document shorter than an item is one window.

The benchmark is worked on in blocks of bounded count and size, one pass over the documents a block; what one
block finds is written before the next is broadcast, so neither the driver nor a worker holds more than one.
Null and empty texts, on either side, match nothing. An empty benchmark or table gives no rows. Ties
between windows go to the first one. Repeated documents are matched each, repeated items too. Very long texts are
read whole. A column named like the output is replaced, others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.shared import cut, documents, portions

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 256, 32, 57
AGREE = BLOCKS - RADIUS // 2
#: Items, and bytes of their texts, that are broadcast at a time.
ITEMS, ITEM_BYTES = 10_000, 16 << 20
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KNOWN = 1 << 18
#: Windows that are worked on at a time.
BLOCK = 4096
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Lower-cased word -> hash of it without outer punctuation, 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN:
            self.clear()
        core = word.strip(PUNCTUATION)
        self[word] = h = (xxhash.xxh64_intdigest(core, 11) | 1) if core else 0
        return h


_words = Words()


def word_hashes(text: str | bytes | None) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = data.lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of ``size`` words in a row; of all words, if there are fewer."""
    size = min(size, len(words))
    if not size:
        return words
    n, h = len(words) - size + 1, np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = (h ^ (words[i : i + n] >> np.uint64(3))) * M1 + words[i : i + n]
        h ^= h >> np.uint64(32)
        return h * M2


def bit_matrix(h: np.ndarray) -> np.ndarray:
    """BITS bits of each hash, made of BITS / 64 mixes of it."""
    with np.errstate(over="ignore"):
        mixed = [h]
        for _ in range(BITS // 64 - 1):
            x = (mixed[-1] ^ (mixed[-1] >> np.uint64(31))) * M1 + M2
            mixed.append(x ^ (x >> np.uint64(29)))
    return np.unpackbits(np.stack(mixed, axis=1).astype("<u8").view(np.uint8), axis=1, bitorder="little")


def simhashes(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every ``size`` shingles in a row, as bytes."""
    sums = np.zeros((len(h) + 1, BITS), np.int32)
    np.cumsum(bit_matrix(h), axis=0, out=sums[1:])
    ones = 2 * (sums[size:] - sums[:-size]) > size
    return np.packbits(ones, axis=1, bitorder="little")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class HammingBlocks:
    """Items by the values of their fingerprint's blocks, neighbours of one bit included; a bit for each item."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps, self.words = fps, -(-len(fps) // 64)
        self.table = np.zeros((BLOCKS, 256, self.words), np.uint64)
        near = np.array([0, *(1 << b for b in range(8))])
        for i, fp in enumerate(fps):
            self.table[np.arange(BLOCKS)[:, None], fp[:, None] ^ near[None], i // 64] |= np.uint64(1 << (i % 64))

    def named(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprint, word of items): the items that AGREE blocks name at least."""
        at_least = np.zeros((AGREE, len(fps), self.words), np.uint64)
        for b in range(BLOCKS):
            x = self.table[b, fps[:, b]]
            for k in range(AGREE - 1, 0, -1):
                at_least[k] |= at_least[k - 1] & x
            at_least[0] |= x
        return at_least[-1]

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item): all pairs within RADIUS."""
        q, i = np.nonzero(np.unpackbits(self.named(fps).view(np.uint8), axis=1, bitorder="little")[:, : len(self.fps)])
        true = np.bitwise_count(fps[q] ^ self.fps[i]).sum(axis=1, dtype=np.int64) <= RADIUS
        return q[true], i[true]


@dataclass
class Index:
    """ids and shingles of items; known: all their shingles, sorted; owners of each; by size: the Hamming blocks."""

    ids: list[int]
    items: list[np.ndarray]
    known: np.ndarray
    owners: list[np.ndarray]
    sizes: np.ndarray
    blocks: dict[int, tuple[np.ndarray, HammingBlocks]]
    short: dict[int, int]  # shingle lengths of items of fewer words: words -> 1

    def matches(self, text: str | None):
        """(item number, similarity, first word, words) of the best window for each item that is in the text."""
        words = word_hashes(text)
        for size in sorted({min(size, len(words)) for size in (SHINGLE, *self.short)} - {0}, reverse=True):
            yield from self._matches(words, size)

    def _matches(self, words: np.ndarray, size: int):
        h = shingles(words, size)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == h)
        if not len(hits):
            return
        items = np.unique(np.concatenate([self.owners[k] for k in np.unique(at[hits]).tolist()]))
        best: dict[int, tuple[float, int, int]] = {}
        for n in np.unique(self.sizes[items]).tolist():
            have = min(n, len(h))
            around = np.zeros(len(h) - have + 2, np.int64)
            np.add.at(around, np.maximum(hits - have + 1, 0), 1)
            np.add.at(around, np.minimum(hits, len(h) - have) + 1, -1)
            starts = np.flatnonzero(np.cumsum(around)[:-1] > 0)
            numbers, index = self.blocks[n]
            for s in range(0, len(starts), BLOCK):
                part = starts[s : s + BLOCK]
                low, high = int(part[0]), int(part[-1]) + have
                for a in range(low, high - have + 1, BLOCK):
                    inside = part[(part >= a) & (part < a + BLOCK)]
                    if not len(inside):
                        continue
                    fps = simhashes(h[a : min(a + BLOCK - 1, high - have) + have], have)[inside - a]
                    q, i = index.near(fps)
                    for w, k in zip(inside[q].tolist(), numbers[i].tolist(), strict=True):
                        score = similarity(h[w : w + have], self.items[k])
                        if score >= SIMILARITY and score > best.get(k, (0.0,))[0]:
                            best[k] = (score, w, have + min(size, len(words)) - 1)
        for k in sorted(best):
            yield k, *best[k]


def index_of(rows: list[tuple[int, str | None]]) -> Index | None:
    own = [(i, word_hashes(t)) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))]
    own = [(i, w) for i, w in own if len(w)]
    if not own:
        return None
    items = [shingles(w) for _, w in own]
    sizes = np.array([len(x) for x in items])
    known = np.unique(np.concatenate(items))
    owners: list[list[int]] = [[] for _ in known]
    for k, x in enumerate(items):
        for s in np.unique(np.searchsorted(known, x)).tolist():
            owners[s].append(k)
    blocks = {}
    for n in np.unique(sizes).tolist():
        numbers = np.flatnonzero(sizes == n)
        blocks[n] = numbers, HammingBlocks(np.stack([simhashes(items[k], n)[0] for k in numbers.tolist()]))
    return Index([i for i, _ in own], items, known, [np.array(o) for o in owners], sizes, blocks, {len(w): 1 for _, w in own if len(w) < SHINGLE})


MATCH = "struct<item_id:bigint,similarity:double,start:bigint,n_words:bigint>"


def indexes(benchmark: DataFrame, item: str, text: str):
    """The blocks of the benchmark, one after another, each as an Index; how many blocks there are comes first."""
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // ITEMS), -(-size["b"] // ITEM_BYTES))
    yield parts
    for p in range(parts):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        yield index_of([(r["item"], r["text"]) for r in block.collect()])


def mark(df: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "matches", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """df with ``out`` array<MATCH>: the items that each text holds, each with its best window in words."""
    done = df.withColumn(out, F.array().cast(f"array<{MATCH}>"))
    blocks = indexes(benchmark, item, item_text)
    if next(blocks) == 1:
        index = next(blocks)
        return done.mapInArrow(_search(df.sparkSession.sparkContext.broadcast(index), text, out), done.schema) if index else done
    # Only texts with matches are kept of each block; they come back to the rows by the text's digest.
    texts = df.select(F.xxhash64(text).alias("__digest"), F.col(text).alias("__text"), F.array().cast(f"array<{MATCH}>").alias("__own"))
    found = None
    for index in blocks:
        if index:
            shared = df.sparkSession.sparkContext.broadcast(index)
            some = cut(texts.mapInArrow(_search(shared, "__text", "__own"), texts.schema).where(F.size("__own") > 0).dropDuplicates(["__digest", "__text"]))
            shared.unpersist()
            found = some if found is None else found.union(some)
    if found is None:
        return done
    own = found.groupBy("__digest", "__text").agg(F.flatten(F.collect_list("__own")).alias("__own"))
    rows = df.withColumn("__digest", F.xxhash64(text))
    met = rows.join(own, (rows["__digest"] == own["__digest"]) & (rows[text] == own["__text"]), "left")
    return met.select(*[rows[c] for c in df.columns if c != out], F.coalesce("__own", F.array().cast(f"array<{MATCH}>")).alias(out))


def _search(shared, text: str, out: str):
    def run(batches):
        index = shared.value
        for b in portions(batches):
            own, at = b.schema.get_field_index(text), b.schema.get_field_index(out)
            found = [[{"item_id": index.ids[m[0]], "similarity": m[1], "start": m[2], "n_words": m[3]} for m in index.matches(t)] if t else [] for t in b.column(own).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(found, b.schema.field(at).type))

    return run


def find(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, similarity, start, n_words): each document with each item it holds."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return mark(docs, benchmark).select(F.col("key").alias(key), F.explode("matches").alias("m")).select(key, "m.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("similarity", F.round("similarity", 9))


#: DuckDB: shingles as strings, every window around a shared one, and the best of them.
SQL = rf"""
WITH text AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT side, r, id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: trim(x, '{PUNCTUATION.decode().replace("'", "''")}')), lambda x: x <> '') AS w FROM text),
z AS (SELECT DISTINCT least(len(w), {SHINGLE}) AS z FROM w WHERE side = 'i' AND len(w) > 0 UNION SELECT {SHINGLE}),
s AS (SELECT DISTINCT side, r, id, w, least(len(w), z) AS z FROM w, z WHERE len(w) > 0 AND (side = 'd' OR z = {SHINGLE})),
g AS (SELECT side, r, id, z, len(w) - z + 1 AS n, p, array_to_string(w[p + 1:p + z], ' ') AS g FROM (SELECT *, unnest(range(len(w) - z + 1)) AS p FROM s)),
c AS (SELECT r, id, n, g, count(*) AS times FROM g WHERE side = 'i' GROUP BY ALL),
h AS (SELECT d.r, d.id, d.z, c.r AS ir, c.id AS item, d.n AS dn, c.n AS n, p, g, times FROM (SELECT * FROM g WHERE side = 'd') d JOIN c USING (g)),
a AS (SELECT DISTINCT r, id, z, ir, item, dn, n, unnest(range(greatest(p - least(n, dn) + 1, 0), least(p, dn - least(n, dn)) + 1)) AS f FROM h),
b AS (SELECT a.r, a.id, a.z, a.ir, a.item, a.dn, a.n, f, g, least(count(*), any_value(times)) AS shared FROM a JOIN h ON a.r = h.r AND a.z = h.z AND a.ir = h.ir AND p >= f AND p < f + least(a.n, a.dn) GROUP BY a.r, a.id, a.z, a.ir, a.item, a.dn, a.n, f, g),
j AS (SELECT r, id, z, ir, item, n, dn, f, sum(shared) / (least(n, dn) + n - sum(shared)) AS similarity FROM b GROUP BY r, id, z, ir, item, n, dn, f),
best AS (SELECT * FROM j WHERE similarity >= {SIMILARITY} QUALIFY row_number() OVER (PARTITION BY r, z, ir ORDER BY similarity DESC, f) = 1)
SELECT id AS doc_id, item AS item_id, round(similarity, 9) AS similarity, f::BIGINT AS start, (least(n, dn) + z - 1)::BIGINT AS n_words FROM best
"""
