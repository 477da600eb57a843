"""Exact search for windows that occur more than once in a corpus, for the byte and the word deduplicator.

A document is a sequence of symbols (bytes or word hashes); a window is W symbols in a row. Comparing
every window through a shuffle would move many times the corpus, so windows travel in groups:

1. ``sketch``: of the K-grams in a window the one with the smallest hash is its anchor, the leftmost
   on a tie. Neighbouring windows mostly share an anchor; such a run is shipped as one record of anchor
   hash, content hash and place. The anchor depends on the window's symbols alone, so equal windows
   have equal anchors at equal offsets, and records with different anchor hashes share no window.
2. ``meet``: records of one anchor hash meet. A record whose whole content occurred earlier is repeated
   as a whole. Only where one anchor has several contents, the earliest record of each content must be
   compared window by window.
3. ``ask``: those records' symbols are fetched from the documents, and go to the deduplicator's own
   comparison (a suffix sort, or edges of a de Bruijn graph).
4. ``paths``: marks go back to their documents, where those whose sources also follow each other become paths.
5. ``verified``: at its source's coordinates a path's digest, 128 bits of what it covers, must be that of what stands
   there. The windows of a path that fails, because unlike contents had one hash, are looked up one by one in
   all documents (``looked_up``), so a collision costs a pass over the corpus and changes no result.

Rows between the steps are packed arrays for one bucket each, so their number depends on tasks and buckets, not on
windows. There are as many buckets as shuffle partitions, and more where a bucket's texts would be more than
BUCKET_BYTES. Copies that meet in one task are decided there and only their earliest record
goes on, so a content that a third of all documents have reaches its bucket once a task.

A document is (doc_id, 64-bit hash of its text), so rows that repeat a doc_id with another text
keep apart and identical rows count as one document; a null doc_id sorts before all others.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.shared import cut, partitions, tidy

NO_ID = -(1 << 63)
#: Symbols that are sketched at a time (position bits in a packed minimum), and records or bytes that a task holds before it ships them.
CHUNK_BITS = 18
CHUNK = 1 << CHUNK_BITS
HELD, HELD_BYTES = 300_000, 16 << 20
#: Bytes of texts that a bucket should have at most, and strings that are looked up at a time after a collision.
BUCKET_BYTES, LOOKED_UP = 64 << 20, 50_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
C1, C2, C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xFF51AFD7ED558CCD)
ROWS = "bucket int, kind int, data binary"
#: Kinds of packed rows and the columns of each. Integers of a place: doc, tag, start, count of windows.
FULL, OPEN, TEXTS, SORTED, EDGE, NODE, END = 1, 2, 4, 5, 6, 7, 8
PLACE = (("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("n", "<u1"))
KINDS = {
    0: (("anchor", "<u8"), ("content", "<u8"), *PLACE, ("offset", "<u1")),
    FULL: (*PLACE, ("src_doc", "<i8"), ("src_start", "<u4")),
    OPEN: (*PLACE, ("offset", "<u1"), ("anchor", "<u8"), ("shards", "<u4")),
    SORTED: (*PLACE, ("offset", "<u1"), ("anchor", "<u8"), ("shard", "<u4"), ("shards", "<u4")),
    EDGE: (("edge", "<u8"), *PLACE),
    NODE: (("doc", "<i8"), ("went", "<i8"), ("came", "<i8"), ("has", "<u1")),  # doc: the node; has: 1 an edge that leaves it, 2 one that enters it
    END: (("doc", "<i8"),),
}


@dataclass(frozen=True)
class Rule:
    """W symbols a window, K an anchor; by_doc: only a smaller doc_id counts as earlier, not an earlier start; bits: those of a content's hash that count (fewer where collisions are wanted)."""

    window: int
    gram: int
    by_doc: bool
    bits: int = 64


@lru_cache(2)
def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    n, inverse = CHUNK + 4096, np.uint64(pow(int(base), -1, 1 << 64))
    up, down = (np.full(n, b, np.uint64) for b in (np.uint64(base), inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Prefix:
    """Prefix polynomial hashes of a sequence: the hash of any part in constant time."""

    def __init__(self, symbols: np.ndarray, base: np.uint64 = BASES[0]) -> None:
        up, self.down = powers(int(base))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def sketch(symbols: np.ndarray, ends: np.ndarray, rule: Rule) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor. ``ends``: where each document of this chunk ends; windows stay in a document."""
    n, (w, k) = len(symbols), (rule.window, rule.gram)
    empty = {c: np.empty(0, t) for c, t in KINDS[0]}
    if n < w:
        return empty
    one, two = Prefix(symbols), Prefix(symbols, BASES[1])
    h = one.grams(k)
    low = np.uint64(CHUNK * 2 - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), w - k + 1)
    inside = np.ones(n - w + 1, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - w + 1) : e] = False
    new = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(least)])
    keep = inside[start]
    start, count = start[keep], count[keep]
    anchor = (least[start] & low).astype(np.int64)
    stop = start + count - 1 + w
    content = (one.of(start, stop) * C1) ^ ((two.of(start, stop) * C2) >> np.uint64(7)) ^ ((count * 256 + anchor - start).astype(np.uint64) * C3)
    return empty | {"anchor": h[anchor], "content": content >> np.uint64(64 - rule.bits), "start": start, "n": count.astype(np.uint8), "offset": (anchor - start).astype(np.uint8)}


def pack(kind: int, columns: dict[str, np.ndarray]) -> bytes:
    import zstandard

    doc = columns["doc"]
    parts = [np.diff(doc, prepend=doc[:1] * 0) if c == "doc" else columns[c] for c, _ in KINDS[kind]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x, t).tobytes() for x, (_, t) in zip(parts, KINDS[kind], strict=True)))


def unpack(kind: int, blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of several packed rows of one kind."""
    import zstandard

    width, out = sum(np.dtype(t).itemsize for _, t in KINDS[kind]), {c: [np.empty(0, t)] for c, t in KINDS[kind]}
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, at = len(data) // width, 0
        for c, t in KINDS[kind]:
            x = np.frombuffer(data, t, n, at)
            out[c].append(np.cumsum(x) if c == "doc" else x)
            at += x.nbytes
    return {c: np.concatenate(x) for c, x in out.items()}


def share(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal shares each number falls into."""
    with np.errstate(over="ignore"):
        y = x.astype(np.uint64) * C2
        return (((y ^ (y >> np.uint64(31))) * C3) >> np.uint64(33)).astype(np.int64) % n


@lru_cache(4)
def bucket_keys(n: int) -> np.ndarray:
    """n bucket numbers of which Spark's hash partitioning sends one to each of n partitions (its Murmur3 of an int, seed 42)."""
    found, at = np.full(n, -1, np.int64), 0
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    while (found < 0).any():
        ids = np.arange(at, at + 16 * n + 64, dtype=np.uint32)
        at += len(ids)
        with np.errstate(over="ignore"):
            h = turn(ids * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
            h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
        where = h.view(np.int32).astype(np.int64) % n
        first, index = np.unique(where, return_index=True)
        new = found[first] < 0
        found[first[new]] = ids[index[new]]
    return found


def spread(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each number."""
    return bucket_keys(buckets)[share(x, buckets)]


def dealt(kind: int, columns: dict[str, np.ndarray], bucket: np.ndarray):
    """(bucket, kind, bytes) for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for s, e in pairwise([*cuts, len(bucket)]):
        yield int(bucket[s]), kind, pack(kind, {c: columns[c][order[s:e]] for c, _ in KINDS[kind]})


def arrow(rows):
    """Batches of (bucket, kind, data) of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > 4 << 20 or len(held) >= 5000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "data"])


def earlier(cols: dict[str, np.ndarray], keys: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, late): rows sorted by keys and place; the place in that order of the first row of each run of equal keys; whether a row comes later than that first one, as the rule has it."""
    order = np.lexsort((cols["start"], cols["tag"], cols["doc"], *keys[::-1]))
    if not len(order):
        return order, order, np.zeros(0, bool)
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    doc = cols["doc"][order]
    late = doc != doc[first]
    if not rule.by_doc:
        late |= (cols["tag"][order] != cols["tag"][order][first]) | (cols["start"][order] != cols["start"][order][first])
    return order, first, late


def full_marks(cols: dict[str, np.ndarray], order: np.ndarray, first: np.ndarray, late: np.ndarray) -> dict[str, np.ndarray]:
    at, src = order[late], order[first[late]]
    return {c: cols[c][at] for c, _ in PLACE} | {"src_doc": cols["doc"][src], "src_start": cols["start"][src]}


def take(cols: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: x[at] for c, x in cols.items()}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tagged(text: bytes) -> int:
    import xxhash

    return signed(xxhash.xxh64_intdigest(text, 9))


def _rows(batches):
    """(doc, bytes of the text) of each row; null texts are empty."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                yield NO_ID if d is None else d, (x or "").encode("utf-8", "surrogatepass")


def records(docs: DataFrame, rule: Rule, symbols, buckets: int) -> DataFrame:
    """Step 1 over (id, text): packed records by anchor, and marks of what a task sees repeated. symbols(bytes) -> uint64 array."""

    def ship(held: list[dict[str, np.ndarray]]):
        cols = {c: np.concatenate([x[c] for x in held]) for c, _ in KINDS[0]}
        order, first, late = earlier(cols, [cols["anchor"], cols["content"]], rule)
        marks = full_marks(cols, order, first, late)
        yield from dealt(FULL, marks, spread(marks["doc"], buckets))
        rest = take(cols, np.sort(order[~late]))
        yield from dealt(0, rest, spread(rest["anchor"], buckets))

    def sketches(batches):
        """One chunk after another; a document longer than a chunk comes in parts that overlap by a window less one."""
        parts, keys, size = [], [], 0
        for doc, text in _rows(batches):
            s, tag = symbols(text), tagged(text)
            for at in range(0, max(1, len(s) - rule.window + 1), CHUNK):
                piece = s[at : at + CHUNK + rule.window - 1]
                if size and size + len(piece) > CHUNK:
                    yield _sketched(parts, keys, rule)
                    parts, keys, size = [], [], 0
                parts.append(piece)
                keys.append((doc, tag, at))
                size += len(piece)
        if parts:
            yield _sketched(parts, keys, rule)

    def run(batches):
        def rows():
            held, n = [], 0
            for cols in sketches(batches):
                held.append(cols)
                n += len(cols["start"])
                if n >= HELD:
                    yield from ship(held)
                    held, n = [], 0
                    tidy()
            if held:
                yield from ship(held)

        with np.errstate(over="ignore"):
            yield from arrow(rows())

    return docs.mapInArrow(run, ROWS)


def _sketched(parts: list[np.ndarray], keys: list[tuple[int, int, int]], rule: Rule) -> dict[str, np.ndarray]:
    ends = np.cumsum([len(p) for p in parts])
    cols = sketch(np.concatenate(parts), ends, rule)
    which = np.searchsorted(ends, cols["start"], side="right")
    doc, tag, at = (np.array([k[i] for k in keys], t) for i, t in enumerate(("<i8", "<i8", "<i8")))
    cols["start"] = (cols["start"] - np.r_[0, ends[:-1]][which] + at[which]).astype("<u4")
    return cols | {"doc": doc[which], "tag": tag[which]}


def packed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, data) of the whole texts, compressed, under the bucket of their id."""

    def run(batches):
        def rows():
            held, size = {}, 0
            for doc, text in _rows(batches):
                held.setdefault(int(spread(np.array([doc]), buckets)[0]), []).append((doc, text))
                size += len(text) + 64
                if size > HELD_BYTES:
                    yield from ((b, TEXTS, _squeeze(x)) for b, x in held.items())
                    held, size = {}, 0
                    tidy()
            yield from ((b, TEXTS, _squeeze(x)) for b, x in held.items())

        with np.errstate(over="ignore"):
            yield from arrow(rows())

    return docs.mapInArrow(run, ROWS)


def _squeeze(texts: list[tuple[int, bytes]]) -> bytes:
    import zstandard

    head = np.array([[d, len(t)] for d, t in texts], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(len(texts).to_bytes(8, "little") + head.tobytes() + b"".join(t for _, t in texts))


def texts_of(blobs: list[bytes]):
    """(doc, bytes) of packed texts."""
    import zstandard

    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(data[:8], "little")
        at = 8 + 16 * n
        for doc, size in np.frombuffer(data, "<i8", 2 * n, 8).reshape(-1, 2).tolist():
            yield doc, data[at : at + size]
            at += size


def by_kind(table: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        out.setdefault(kind, []).append(data)
    return out


def passed(bucket: int, kinds: dict[int, list[bytes]]):
    """Marks that only travel on."""
    return ((bucket, FULL, blob) for blob in kinds.get(FULL, ()))


def meet(rows: DataFrame, rule: Rule, buckets: int, shard: int) -> DataFrame:
    """Step 2. Records of one anchor with several contents are OPEN; ``shards`` says into how many parts the anchor's windows must be dealt so that a part has about ``shard`` contents."""

    def run(table: pa.Table):
        kinds = by_kind(table)
        cols = unpack(0, kinds.get(0, []))
        order, first, late = earlier(cols, [cols["anchor"], cols["content"]], rule)
        marks = full_marks(cols, order, first, late)
        out = [*passed(table.column("bucket")[0].as_py(), kinds), *dealt(FULL, marks, spread(marks["doc"], buckets))]
        left = take(cols, order[~late])
        if len(left["anchor"]):
            new = np.r_[True, left["anchor"][1:] != left["anchor"][:-1]]
            other = np.r_[True, (left["content"][1:] != left["content"][:-1]) | new[1:]]
            contents = np.add.reduceat(other.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
            left = take(left | {"shards": np.ceil(contents / shard).astype("<u4")}, contents > 1)
            out += dealt(OPEN, left, spread(left["doc"], buckets))
        yield from arrow(out)

    return grouped(rows, run)


def grouped(rows: DataFrame, run) -> DataFrame:
    """run(table of a bucket's rows) -> batches, for each bucket."""

    def whole(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            out = pa.Table.from_batches(list(run(table)), _SCHEMA)
        tidy()
        return out

    return rows.groupBy("bucket").applyInArrow(whole, ROWS)


def ask(texts: DataFrame, rows: DataFrame, answer) -> DataFrame:
    """Step 3. answer(documents with open records, columns of these) -> packed rows; marks travel on."""

    def run(key, left: pa.Table, right: pa.Table):
        bucket, kinds = key[0].as_py(), by_kind(right)
        out = list(passed(bucket, kinds))
        if OPEN in kinds:
            with np.errstate(over="ignore"):
                out += answer(by_kind(left).get(TEXTS, []), unpack(OPEN, kinds[OPEN]))
        return pa.Table.from_batches(list(arrow(out)), _SCHEMA)

    return texts.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(run, ROWS)


_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def by_document(cols: dict[str, np.ndarray]) -> dict[tuple[int, int], slice]:
    """Sorts the columns in place by document; where each document's rows are."""
    order = np.lexsort((cols["start"], cols["tag"], cols["doc"]))
    for c in cols:
        cols[c] = cols[c][order]
    doc, tag = cols["doc"], cols["tag"]
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else []
    return {(int(doc[s]), int(tag[s])): slice(s, e) for s, e in pairwise([*cuts, len(doc)])}


@dataclass(frozen=True)
class Units:
    """What windows are made of: cut(text) gives the units, joined(units) the bytes of some of them, nodes(units) a number for each window's first W - 1 (or none)."""

    cut: object
    joined: object
    nodes: object


PATHS = "bucket int, doc long, tag long, start int, n int, once int, src_bucket int, src_doc long, src_start int, tail long, head long, digest binary"
SOURCE = ["src_doc", "src_start", "once", "digest"]


def digest_of(units, start: int, n: int, rule: Rule, own: Units) -> bytes:
    return hashlib.blake2b(own.joined(units[start : start + n - 1 + rule.window]), digest_size=16).digest()


def paths(texts: DataFrame, marks: DataFrame, buckets: int, rule: Rule, own: Units) -> DataFrame:
    """Rows of PATHS: runs of repeated windows of a document whose sources run alike; the same run over and over is one path of several rounds."""
    names = [c.split()[0] for c in PATHS.split(", ")]
    kinds = _arrow_types(texts, PATHS)

    def run(key, left: pa.Table, right: pa.Table):
        cols = unpack(FULL, by_kind(right).get(FULL, []))
        where, out, done = by_document(cols), [], set()
        with np.errstate(over="ignore"):
            for doc, text in texts_of(by_kind(left).get(TEXTS, [])):
                if (at := where.get(k := (doc, tagged(text)))) is None or k in done:
                    continue
                done.add(k)
                units = own.cut(text)
                nodes = own.nodes(units)
                start, n, src, src_start = (cols[c][at].astype(np.int64) for c in ("start", "n", "src_doc", "src_start"))
                if (start[1:] < start[:-1] + n[:-1]).any():  # equal rows have marked the same windows more than once
                    each = np.repeat(np.arange(len(n)), n)
                    step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    start, first = np.unique(start[each] + step, return_index=True)
                    src, src_start, n = src[each][first], (src_start[each] + step)[first], np.ones(len(start), np.int64)
                new = np.r_[True, (start[1:] != start[:-1] + n[:-1]) | (src[1:] != src[:-1]) | (src_start[1:] != src_start[:-1] + n[:-1])]
                at = np.flatnonzero(new)
                first, once, src, src_start = start[at], np.add.reduceat(n, at), src[at], src_start[at]
                again = np.r_[False, (first[1:] == first[:-1] + once[:-1]) & (once[1:] == once[:-1]) & (src[1:] == src[:-1]) & (src_start[1:] == src_start[:-1])]
                for i in np.flatnonzero(again).tolist():
                    a, b, length = int(first[i - 1]), int(first[i]), int(once[i]) - 1 + rule.window
                    again[i] = units[a : a + length] == units[b : b + length]
                begin = np.flatnonzero(~again)
                rounds = np.diff(np.r_[begin, len(again)])
                to = spread(src[begin], buckets)
                for i, times, b in zip(begin.tolist(), rounds.tolist(), to.tolist(), strict=True):
                    a, k1 = int(first[i]), int(once[i])
                    total = k1 * times
                    tail, head = (signed(int(nodes[a])), signed(int(nodes[a + total]))) if nodes is not None else (0, 0)
                    out.append((key[0].as_py(), doc, k[1], a, total, k1, b, int(src[i]), int(src_start[i]), tail, head, digest_of(units, a, k1, rule, own)))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        tidy()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(run, PATHS)


def at_sources(texts: DataFrame, found: DataFrame, buckets: int, rule: Rule, own: Units) -> DataFrame:
    """(source, digest) of the paths that stand there; and, packed under their buckets, the graph's nodes that they cover with the edges that leave and enter each.

    What very many copies ask of one source is asked once. Rows with data are nodes, the others sources.
    """
    asked = found.select("src_bucket", *SOURCE).distinct()
    schema = f"src_doc long, src_start int, once int, digest binary, {ROWS}"
    kinds, names = _arrow_types(texts, schema), [c.split()[0] for c in schema.split(", ")]

    def run(key, left: pa.Table, right: pa.Table):
        rows: dict[int, list[int]] = {}
        for i, d in enumerate(right.column("src_doc").to_pylist()):
            rows.setdefault(d, []).append(i)
        start, n, digest = (right.column(c).to_pylist() for c in ("src_start", "once", "digest"))
        true: set[int] = set()
        met: list[dict[str, np.ndarray]] = [{c: np.zeros(0, t) for c, t in KINDS[NODE]}]
        with np.errstate(over="ignore"):
            for doc, text in texts_of(by_kind(left).get(TEXTS, [])) if rows else ():
                if not (mine := rows.get(doc)):
                    continue
                units = own.cut(text)
                good = [i for i in mine if digest_of(units, start[i], n[i], rule, own) == digest[i]]
                true.update(good)
                nodes = own.nodes(units) if good else None
                if nodes is not None:
                    inside = np.unique(np.concatenate([np.arange(start[i], start[i] + n[i]) for i in good]))
                    at = np.union1d(inside, inside + 1)
                    edge = lambda p: ((nodes[p] * C1) ^ nodes[p + 1]).view(np.int64)
                    went, came = np.isin(at, inside), np.isin(at - 1, inside)
                    met.append({"doc": nodes[at].view(np.int64), "went": edge(np.where(went, at, at - 1)), "came": edge(np.where(came, at - 1, at)), "has": (went + 2 * came).astype(np.uint8)})
            cols = {c: np.concatenate([m[c] for m in met]) for c, _ in KINDS[NODE]}
            packed = list(dealt(NODE, cols, spread(cols["doc"], buckets)))
        tidy()
        sources = right.select(SOURCE).take(pa.array(sorted(true), pa.int64()))
        first = pa.Table.from_arrays([*(sources.column(c).combine_chunks().cast(t) for c, t in zip(SOURCE, kinds, strict=False)), *(pa.nulls(len(sources), t) for t in kinds[4:])], names=names)
        columns = list(zip(*packed, strict=True)) if packed else [[]] * 3
        return pa.concat_tables([first, pa.Table.from_arrays([*(pa.nulls(len(packed), t) for t in kinds[:4]), *(pa.array(c, t) for c, t in zip(columns, kinds[4:], strict=True))], names=names)])

    return texts.groupBy("bucket").cogroup(asked.groupBy("src_bucket")).applyInArrow(run, schema)


def branchless(cols: dict[str, np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Nodes among ``ends`` that one edge leaves and one enters, however often each is told."""
    pick = np.isin(cols["doc"], ends)
    node, went, came, has = (cols[c][pick] for c in ("doc", "went", "came", "has"))
    order = np.argsort(node, kind="stable")
    node, went, came, has = (x[order] for x in (node, went, came, has))
    if not len(node):
        return node
    at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    one = np.ones(len(at), bool)
    for edge, bit in ((went, 1), (came, 2)):
        told = (has & bit) > 0
        low, high = np.minimum.reduceat(np.where(told, edge, most), at), np.maximum.reduceat(np.where(told, edge, least), at)
        one &= low == high  # most > least: a node that no edge leaves, or enters, is no such node
    return node[at][one]


def simple_nodes(seen: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """(node): where paths meet and the graph has no branch, counting the edges of ends and insides of all paths."""

    def ends(batches):
        for b in batches:
            tail = np.unique(b.column(0).to_numpy())
            with np.errstate(over="ignore"):
                yield from arrow(dealt(END, {"doc": tail}, spread(tail, buckets)))

    def run(table: pa.Table) -> pa.Table:
        kinds = by_kind(table)
        tails = np.unique(unpack(END, kinds.get(END, []))["doc"])
        # One packed row after another, so that a bucket never holds all its nodes at full length.
        held = [{c: np.zeros(0, t) for c, t in KINDS[NODE]}]
        for blob in kinds.get(NODE, []):
            cols = unpack(NODE, [blob])
            held.append(take(cols, np.isin(cols["doc"], tails)))
        nodes = branchless({c: np.concatenate([h[c] for h in held]) for c, _ in KINDS[NODE]}, tails)
        tidy()
        return pa.Table.from_arrays([pa.array(nodes, pa.int64())], names=["node"])

    rows = seen.where("data is not null").select("bucket", "kind", "data").union(found.select("tail").mapInArrow(ends, ROWS))
    return rows.groupBy("bucket").applyInArrow(run, "node long")


def verified(texts: DataFrame, docs: DataFrame, marks: DataFrame, buckets: int, rule: Rule, own: Units) -> tuple[DataFrame, DataFrame]:
    """(paths that stand at their sources, what was seen there): windows of the others are looked up."""
    found = cut(paths(texts, marks, buckets, rule, own))
    seen = cut(at_sources(texts, found, buckets, rule, own))
    sources = seen.where("data is null").select(*SOURCE)
    good = found.join(sources.distinct(), SOURCE, "left_semi")
    bad = cut(found.join(sources, SOURCE, "left_anti"))
    if bad.isEmpty():
        return good, seen
    return good.unionByName(looked_up(texts, docs, bad, buckets, rule, own)), seen


def looked_up(texts: DataFrame, docs: DataFrame, bad: DataFrame, buckets: int, rule: Rule, own: Units) -> DataFrame:
    """Rows of PATHS for the windows of failed paths: every place in all documents where such a string stands and has stood earlier.

    Others may repeat what a failed path holds and have been compared with its supposed source instead, so all places count.
    """
    w = rule.window

    def strings(key, left: pa.Table, right: pa.Table):
        rows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, t, a, n in zip(*(right.column(c).to_pylist() for c in ("doc", "tag", "start", "n")), strict=True):
            rows.setdefault((d, t), []).append((a, n))
        out: set[bytes] = set()
        for doc, text in texts_of(by_kind(left).get(TEXTS, [])) if rows else ():
            k = (doc, tagged(text))
            units = own.cut(text) if k in rows else []
            out.update(own.joined(units[p : p + w]) for a, n in rows.pop(k, ()) for p in range(a, a + n))
        return pa.Table.from_arrays([pa.array(list(out), pa.binary())], names=["window"])

    distinct = cut(texts.groupBy("bucket").cogroup(bad.groupBy("bucket")).applyInArrow(strings, "window binary").distinct())
    blocks = max(1, -(-distinct.count() // LOOKED_UP))
    late = F.col("doc") != F.col("s.doc") if rule.by_doc else F.struct("doc", "tag", "start") != F.col("s")
    one = F.lit(1).alias("n"), F.lit(1).alias("once")
    zero = lambda name, x=0: F.lit(x).cast("long").alias(name)
    out = None
    for b in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r["window"]) for r in distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect()))

        def search(batches, shared=shared):
            some = shared.value
            for batch in batches:
                out = []
                for doc, text in _rows([batch]):
                    units, tag = own.cut(text), tagged(text)
                    out += [(x, doc, tag, p) for p in range(len(units) - w + 1) if (x := own.joined(units[p : p + w])) in some]
                x, doc, tag, p = zip(*out, strict=True) if out else ((),) * 4
                with np.errstate(over="ignore"):
                    bucket = spread(np.array(doc, np.int64), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(bucket, pa.int32()), pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(p, pa.int32())], names=["window", "bucket", "doc", "tag", "start"])

        places = cut(docs.mapInArrow(search, "window binary, bucket int, doc long, tag long, start int"))
        earliest = places.groupBy("window").agg(F.min(F.struct("doc", "tag", "start")).alias("s"))
        part = cut(places.join(earliest, "window").where(late).select("bucket", "doc", "tag", "start", *one, F.lit(0).alias("src_bucket"), F.col("s.doc").alias("src_doc"), F.col("s.start").alias("src_start"), zero("tail"), zero("head", 1), F.lit(b"").alias("digest")))
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def tell(texts: DataFrame, spans: DataFrame, finish, schema: str, names: list[str]) -> DataFrame:
    """finish(doc id or None, bytes, starts, counts) -> tuples of the result's columns, for every document; spans hold bucket, doc, tag, start, n."""

    def run(key, left: pa.Table, right: pa.Table):
        cols = {c: right.column(c).to_numpy() for c in ("doc", "tag", "start", "n")}
        where, none, out = by_document(cols), slice(0, 0), []
        for doc, text in texts_of(by_kind(left).get(TEXTS, [])):
            at = where.get((doc, tagged(text)), none)
            out.append(finish(None if doc == NO_ID else doc, text, cols["start"][at], cols["n"][at]))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        tidy()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kinds = _arrow_types(texts, schema)
    return texts.groupBy("bucket").cogroup(spans.select("bucket", "doc", "tag", "start", "n").groupBy("bucket")).applyInArrow(run, schema)


def _arrow_types(df: DataFrame, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(schema)).types)


def bucket_count(docs: DataFrame) -> int:
    """Shuffle partitions, or more, so that a bucket's texts are BUCKET_BYTES at most in the mean."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    return max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def id_and_text(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
