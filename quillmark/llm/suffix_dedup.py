"""Removal of repeated byte strings with a hash-compared suffix sort (operator 3).

A byte goes if a string of WINDOW bytes covers it that also starts earlier: in a smaller doc_id, or in
the same document before. Strings are judged on the input, and never cross documents.

``repeats`` finds runs of strings whose whole contents have one hash, as copies have, and verifies them at their
sources; where an anchor has several contents, all strings of these are sorted here as suffixes. Two
suffixes are compared by their longest common extension, which a binary search over prefix polynomial
hashes finds in logarithmic time, and the byte after it. A bottom-up mergesort merges all runs of all
groups at once: each suffix finds its rank in the neighbouring run by binary search. In the sorted
order equal strings are neighbours; every pair that the hashes call equal is verified byte by byte,
and a group in which one isn't is sorted by its bytes instead. The earliest of equal strings stays.

Null texts count as empty; texts shorter than WINDOW keep all. Rows with equal id and text count as one
document, each with the same result. An empty table gives no rows. Very long texts are worked on in chunks that
overlap. Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import repeats as R
from quillmark.llm.shared import documents

WINDOW, GRAM = 100, 24
#: Different contents of one anchor that a group of suffixes should have at most.
SHARD = 2048
#: Strings that are sorted at a time, whole anchors.
AT_ONCE = 1 << 18
RULE = R.Rule(WINDOW, GRAM, by_doc=False)


@lru_cache(1)
def letters() -> np.ndarray:
    """A random odd number for each byte."""
    return np.random.default_rng(7).integers(1 << 20, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def symbols(text: bytes) -> np.ndarray:
    return letters()[np.frombuffer(text, np.uint8)]


class Suffixes:
    """Suffixes of a buffer, each WINDOW long, with a strict total order: by bytes, then by their number."""

    def __init__(self, data: bytes, at: np.ndarray, window: int = WINDOW) -> None:
        self.bytes, self.at, self.window = np.frombuffer(data, np.uint8), at, window
        # Chunks bound the table of powers: suffixes know the chunk that holds them.
        self.step = R.CHUNK
        self.sums = [R.Prefix(letters()[self.bytes[s : s + self.step + window]]) for s in range(0, max(1, len(self.bytes)), self.step)]
        self.flat = np.concatenate([p.sums for p in self.sums])
        sizes = np.cumsum([0] + [len(p.sums) for p in self.sums])
        self.base = sizes[at // self.step] + at % self.step
        self.down = self.sums[0].down[at % self.step]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes x and y, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.window, np.int64)
        bx, by, dx, dy = self.base[x], self.base[y], self.down[x], self.down[y]
        sx, sy = self.flat[bx], self.flat[by]
        for _ in range(int(self.window).bit_length()):
            mid = (low + high + 1) // 2
            same = (self.flat[bx + mid] - sx) * dx == (self.flat[by + mid] - sy) * dy
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        common = self.extension(x, y)
        end = common == self.window
        step = np.where(end, 0, common)
        return np.where(end, x < y, self.bytes[self.at[x] + step] < self.bytes[self.at[y] + step])

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Byte by byte, in blocks."""
        out = np.empty(len(x), bool)
        steps = np.arange(self.window)
        for s in range(0, len(x), 20_000):
            out[s : s + 20_000] = (self.bytes[self.at[x[s : s + 20_000], None] + steps] == self.bytes[self.at[y[s : s + 20_000], None] + steps]).all(axis=1)
        return out


def merge_sort(own: Suffixes, group: np.ndarray) -> np.ndarray:
    """Suffix numbers sorted within their groups (``group`` is non-decreasing)."""
    n = len(group)
    order = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    place = np.arange(n) - begin
    width = 1
    while width < (sizes.max() if n else 0):
        active = np.flatnonzero(size > width)
        run = place[active] // width
        mate = begin[active] + (run ^ 1) * width
        low, high = np.minimum(mate, begin[active] + size[active]), np.minimum(mate + width, begin[active] + size[active])
        first, me = low.copy(), order[active]
        while len(todo := np.flatnonzero(low < high)):
            mid = (low[todo] + high[todo]) // 2
            before = own.less(order[mid], me[todo])
            low[todo[before]] = mid[before] + 1
            high[todo[~before]] = mid[~before]
        target = begin[active] + (run // 2) * 2 * width + place[active] % width + (low - first)
        order[target] = me
        width *= 2
    return order


def repeated(data: bytes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Number of the first suffix that each one equals (its own, if none before it). Suffixes come in order of age, groups together."""
    own = Suffixes(data, at)
    order = merge_sort(own, group)
    first = np.arange(len(at))
    if len(order) < 2:
        return first
    same = (group[order][1:] == group[order][:-1]) & (own.extension(order[1:], order[:-1]) == own.window)
    pairs = np.flatnonzero(same)
    true = own.equal(order[pairs + 1], order[pairs])
    wrong = set(group[order[pairs[~true]]].tolist())
    starts = np.r_[True, ~same]
    first[order] = order[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
    for g in wrong:  # a collision of hashes: this group is sorted by its bytes
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(group == g).tolist():
            first[i] = seen.setdefault(data[at[i] : at[i] + own.window], i)
    return first


def answer(buckets: int):
    """The open records' bytes, dealt by anchor; the windows of an anchor with very many contents are dealt by their own hash."""

    def run(texts: list[bytes], cols: dict[str, np.ndarray]):
        where = R.by_document(cols)
        held: dict[int, tuple[list[np.ndarray], list[bytes]]] = {}
        rows, extra = [], []
        for doc, text in R.texts_of(texts):
            at = where.pop((doc, R.tagged(text)), None)
            if at is None:
                continue
            for i in range(at.start, at.stop):
                start, n, shards = int(cols["start"][i]), int(cols["n"][i]), int(cols["shards"][i])
                piece = text[start : start + n - 1 + WINDOW]
                which = [0]
                if shards > 1:
                    h = R.Prefix(symbols(piece)).of(np.arange(n), np.arange(n) + WINDOW)
                    which = np.unique(R.share(h, shards)).tolist()
                for s in which:
                    rows.append((i, s))
                    extra.append(piece)
        if rows:
            i, s = (np.array(x) for x in zip(*rows, strict=True))
            out = R.take({c: cols[c] for c, _ in R.KINDS[R.SORTED] if c != "shard"}, i) | {"shard": s.astype("<u4")}
            bucket = R.spread(out["anchor"] + s.astype(np.uint64) * R.C1, buckets)
            for b in np.unique(bucket).tolist():
                pick = np.flatnonzero(bucket == b)
                head = R.pack(R.SORTED, R.take(out, pick))
                held[b] = len(head).to_bytes(8, "little") + head + _pressed(b"".join(extra[k] for k in pick))
        return [(b, R.SORTED, blob) for b, blob in held.items()]

    return run


def _pressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def found_in(cols: dict[str, np.ndarray], pieces: list[bytes]) -> dict[str, np.ndarray]:
    """Marks of all but the earliest of equal strings, among the suffixes of some records' pieces; those of one anchor, shard and offset are a group."""
    data = b"".join(pieces)
    n = cols["n"].astype(np.int64)
    lengths = n - 1 + WINDOW
    record = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(lengths) - lengths)[record] + step
    split = cols["shards"][record] > 1
    if split.any():  # of an anchor with very many contents, only the strings that this shard has by their hash
        prefix = Suffixes(data, at)
        h = (prefix.flat[prefix.base + WINDOW] - prefix.flat[prefix.base]) * prefix.down
        keep = np.ones(len(at), bool)
        keep[split] = _spread_each(h[split], cols["shards"][record][split]) == cols["shard"][record][split]
        record, step, at = record[keep], step[keep], at[keep]
    places = {"doc": cols["doc"][record], "tag": cols["tag"][record], "start": (cols["start"][record] + step).astype("<u4")}
    offset = cols["offset"][record].astype(np.int64) - step
    order = np.lexsort((places["start"], places["tag"], places["doc"], offset, cols["shard"][record], cols["anchor"][record]))
    places, at = R.take(places, order), at[order]
    keys = [cols["anchor"][record][order], cols["shard"][record][order], offset[order]]
    group = np.cumsum(np.r_[False, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(order) else order
    first = repeated(data, at, group)
    late = np.any([x != x[first] for x in places.values()], axis=0) if len(first) else np.zeros(0, bool)
    return R.take(places, late) | {"n": np.ones(int(late.sum()), "<u1"), "src_doc": places["doc"][first[late]], "src_start": places["start"][first[late]]}


def sort_and_mark(rows: DataFrame, buckets: int) -> DataFrame:
    """Marks of the strings of open records that come later than an equal one. A bucket's anchors are worked on a bounded number of strings at a time."""
    import pyarrow as pa

    def run(table: pa.Table):
        import zstandard

        kinds = R.by_kind(table)
        bucket = table.column("bucket")[0].as_py()
        yield from R.arrow(R.passed(bucket, kinds))
        cuts = [(8 + int.from_bytes(b[:8], "little"), b) for b in kinds.get(R.SORTED, [])]
        cols = R.unpack(R.SORTED, [b[8:e] for e, b in cuts])
        data = b"".join(zstandard.ZstdDecompressor().decompress(b[e:]) for e, b in cuts)
        n = cols["n"].astype(np.int64)
        ends = np.cumsum(n - 1 + WINDOW)
        order = np.lexsort((cols["shard"], cols["anchor"]))
        anchor, shard, total = cols["anchor"][order], cols["shard"][order], np.cumsum(n[order])
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (shard[1:] != shard[:-1])]) if len(order) else np.zeros(0, np.int64)
        borders, have = [0], 0
        for s in new[1:].tolist():
            if total[s - 1] - have >= AT_ONCE:
                borders.append(s)
                have = int(total[s - 1])
        for s, e in pairwise([*borders, len(order)]):
            pick = order[s:e]
            marks = found_in(R.take(cols, pick), [data[ends[i] - n[i] + 1 - WINDOW : ends[i]] for i in pick.tolist()])
            yield from R.arrow(R.dealt(R.FULL, marks, R.spread(marks["doc"], buckets)))

    return R.grouped(rows, run)


def _spread_each(h: np.ndarray, shards: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), np.int64)
    for s in np.unique(shards).tolist():
        out[shards == s] = R.share(h[shards == s], s)
    return out


UNITS = R.Units(cut=lambda text: text, joined=lambda part: part, nodes=lambda text: None)


def finish(doc, text: bytes, starts, counts):
    spans, kept = covered(len(text), starts, counts, WINDOW)
    return doc, len(text), [{"start": s, "end": e} for s, e in spans], b"".join(text[s:e] for s, e in kept)


def covered(size: int, starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(removed, kept): maximal spans that the windows cover, and what is between them."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts.astype(np.int64), 1)
    np.add.at(edge, starts.astype(np.int64) + counts.astype(np.int64) - 1 + window, -1)
    gone = np.cumsum(edge)[:size] > 0
    cuts = [0, *(np.flatnonzero(gone[1:] != gone[:-1]) + 1).tolist(), size] if size else [0]
    runs = [(s, e) for s, e in zip(cuts, cuts[1:], strict=False)]
    return [r for r in runs if gone[r[0]]], [r for r in runs if not gone[r[0]]]


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, removed array<struct<start,end>>, kept binary) of each row: what goes and what stays of its bytes."""
    docs = R.id_and_text(df, key, text)
    buckets = R.bucket_count(docs)
    texts = R.packed_texts(docs, buckets)
    met = R.meet(R.records(docs, RULE, symbols, buckets), RULE, buckets, SHARD)
    marks = sort_and_mark(R.ask(texts, met, answer(buckets)), buckets)
    spans, _ = R.verified(texts, docs, marks, buckets, RULE, UNITS)
    schema = "id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary"
    return R.tell(texts, spans, finish, schema, ["id", "n_bytes", "removed", "kept"]).withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(documents(spark, sf_dir))
    return done.select(
        "doc_id", "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: DuckDB: every string of 100 bytes is written out, in hexadecimal, and the first place of each decides.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, p, h[2 * p + 1:2 * p + 200] AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM k) WHERE r > 1),
i AS (SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS starts FROM f)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, n),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT doc_id, max(b), 1000000000000 FROM s GROUP BY doc_id),
c AS (SELECT e.doc_id, string_agg(h[2 * x + 1:2 * least(y, length(h) // 2)], '' ORDER BY x) AS kept FROM e JOIN d USING (doc_id) WHERE least(y, length(h) // 2) > x GROUP BY e.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
