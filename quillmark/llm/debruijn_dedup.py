"""Removal of word sequences that another document has before, with a compacted de Bruijn graph (operator 5).

A word goes if a window of WINDOW words covers it whose sequence also starts in a document with a
smaller doc_id. Windows are judged on the input and never cross documents.

Windows are the graph's edges, from the node of their first WINDOW - 1 words to that of their last.
``repeats`` finds the repeated edges, each with the coordinates of an earlier occurrence. Then:

* edges in a row whose sources are also in a row are compacted into one path inside their document, and
  a path that runs over and over (a loop, as repeated lines make) into one path of several rounds;
* each path is verified at its source's coordinates: a digest of the words there must be its own. The edges of a
  path that fails are looked up one by one in all documents;
* the verified sources tell all edges that enter and leave a node, of ends and insides of paths alike. Paths are
  compacted further through Spark joins: two paths that meet in a document at a node without a branch become
  one. What remains are long repeated spans of verified pieces; they, and only they, are removed.

Words are what lies between ASCII white space, unchanged. Null texts have none; a text shorter than
WINDOW words keeps all. Rows with equal id and text count as one document, each with the same result;
rows of one id with different texts never count as earlier than each other. An empty table gives no rows. Very long
texts are worked on in chunks that overlap. Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import repeats as R
from quillmark.llm.shared import documents
from quillmark.llm.suffix_dedup import covered

WINDOW, GRAM = 13, 5
RULE = R.Rule(WINDOW, GRAM, by_doc=True)
#: Distinct words whose hashes a Python worker keeps.
KNOWN = 1 << 18


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 5) | 1
        return h


_hashes = Words()


def symbols_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def symbols(text: bytes) -> np.ndarray:
    return symbols_of(text.split())


def edges_of(words: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Hash of each k words in a row, whatever the length of ``words``."""
    out = [np.empty(0, np.uint64)]
    for at in range(0, len(words) - k + 1, R.CHUNK):
        part = words[at : at + R.CHUNK + k - 1]
        out.append((R.Prefix(part).grams(k) * R.C1) ^ ((R.Prefix(part, R.BASES[1]).grams(k) * R.C2) >> np.uint64(7)))
    return np.concatenate(out)


def answer(buckets: int, rule: R.Rule):
    """The open records' edges, under the bucket of their hash."""

    def run(texts: list[bytes], cols: dict[str, np.ndarray]):
        where, found = R.by_document(cols), []
        for doc, text in R.texts_of(texts):
            if (at := where.pop((doc, R.tagged(text)), None)) is None:
                continue
            h = edges_of(symbols(text)) >> np.uint64(64 - rule.bits)
            n = cols["n"][at].astype(np.int64)
            start = np.repeat(cols["start"][at].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append({"edge": h[start], "doc": np.full(len(start), doc), "tag": np.full(len(start), cols["tag"][at.start]), "start": start, "n": np.ones(len(start), "<u1")})
        if not found:
            return []
        edges = {c: np.concatenate([x[c] for x in found]).astype(t) for c, t in R.KINDS[R.EDGE]}
        order, first, late = R.earlier(edges, [edges["edge"]], rule)
        marks, rest = R.full_marks(edges, order, first, late), R.take(edges, order[~late])
        return [*R.dealt(R.FULL, marks, R.spread(marks["doc"], buckets)), *R.dealt(R.EDGE, rest, R.spread(rest["edge"], buckets))]

    return run


def repeated_edges(rows: DataFrame, buckets: int, rule: R.Rule) -> DataFrame:
    def run(table: pa.Table):
        kinds = R.by_kind(table)
        edges = R.unpack(R.EDGE, kinds.get(R.EDGE, []))
        marks = R.full_marks(edges, *R.earlier(edges, [edges["edge"]], rule))
        yield from R.arrow([*R.passed(table.column("bucket")[0].as_py(), kinds), *R.dealt(R.FULL, marks, R.spread(marks["doc"], buckets))])

    return R.grouped(rows, run)


UNITS = R.Units(cut=bytes.split, joined=b" ".join, nodes=lambda words: edges_of(symbols_of(words), WINDOW - 1))


def compacted(found: DataFrame, simple: DataFrame) -> DataFrame:
    """(bucket, doc, tag, start, n) of spans: paths of a document that meet at one of the nodes ``simple`` become one."""
    # The node is re-made on both sides so that both are shuffled for this join, and a node that very many paths meet in can be split.
    known = simple.select(F.expr("node ^ 1").alias("node"), F.lit(True).alias("simple"))
    marked = found.withColumn("at", F.expr("tail ^ 1")).join(known, F.col("at") == F.col("node"), "left").drop("node", "at")
    along = Window.partitionBy("doc", "tag").orderBy("start")
    joined = F.coalesce("simple", F.lit(False)) & (F.lag(F.col("start") + F.col("n")).over(along) == F.col("start"))
    numbered = marked.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("bucket", "doc", "tag", "span").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"))


def finish(doc, text: bytes, starts, counts):
    words = text.split()
    gone, kept = covered(len(words), starts, counts, WINDOW)
    return doc, len(words), [{"start": s, "end": e} for s, e in gone], b" ".join(b" ".join(words[s:e]) for s, e in kept).decode("utf-8", "replace")


def repeated_spans(texts: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    met = R.meet(R.records(docs, RULE, symbols, buckets), RULE, buckets, 1 << 30)
    marks = repeated_edges(R.ask(texts, met, answer(buckets, RULE)), buckets, RULE)
    found, seen = R.verified(texts, docs, marks, buckets, RULE, UNITS)
    return compacted(found, R.simple_nodes(seen, found, buckets))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, removed array<struct<start,end>> in words, kept string) of each row."""
    docs = R.id_and_text(df, key, text)
    buckets = R.bucket_count(docs)
    texts = R.packed_texts(docs, buckets)
    schema = "id long, n_words long, removed array<struct<start:int,end:int>>, kept string"
    return R.tell(texts, repeated_spans(texts, docs, buckets), finish, schema, ["id", "n_words", "removed", "kept"]).withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: DuckDB: every window is written out, and the first document of each decides.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM k JOIN m USING (g) WHERE first < doc_id) CROSS JOIN (SELECT unnest(range(13)) AS j)),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
s AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(s.n, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
"""
