"""Language identification with bit-sliced Bloom filters of character n-grams (operator 7).

Each language has a Bloom filter of the trigrams that are typical of it. All filters lie side by
side: one table holds at each position a mask with one bit per language, so three
look-ups and two ANDs give the set of all languages whose filter has the n-gram. A text's count per
language is the popcount of its bit over all n-grams; the hits that a filter gives by chance (its
fill to the power of the hash count) are subtracted, and the largest corrected count decides.

Trigrams are taken over lower-cased letters, every run of other characters counting as one word
border. The filters are learnt from a sample bounded by SAMPLE_DOCS texts a language (in expectation;
chosen by a hash of doc_id): every trigram of the sample counts, and the table grows with the largest filter.

Null, empty and letterless texts give ``und`` with score 0. A text none of whose trigrams is known
gets the commonest learnt language with score 0; with nothing learnt (an empty table) every text is
``und``. Ties go to the language that sorts first. Very long texts are read in slices of bounded length,
each of which takes up the last two letters before it. The score is best / (best + second best) of the
corrected counts. Columns of the input named like an output are replaced; others pass through. A null id is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.shared import documents, portions

UNKNOWN = "und"
#: Texts a language from which filters are learnt, in expectation.
SAMPLE_DOCS = 1500
#: Positions of the table at least, and for each trigram of the largest filter; look-ups a trigram.
POSITIONS, ROOM, HASHES = 1 << 17, 16, 3
#: A trigram enters a language's filter if its rate there is at least this share of its highest rate.
SHARE = 0.2
#: Characters handled at a time.
SLICE = 1 << 19
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str):
    """Hashes of the trigrams of a text, in slices; a trigram has a letter in its middle."""
    low, after = text.lower(), False
    symbols, middle = np.array([32], np.uint64), np.zeros(1, bool)
    for at in range(0, len(low) + 1, SLICE):
        points = np.frombuffer(low[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        alpha = letters()[points]
        keep = alpha | np.r_[after, alpha[:-1]][: len(alpha)]  # of a run of other characters the first stays, as the border
        after = bool(alpha[-1]) if len(alpha) else after
        last = at + SLICE > len(low)
        symbols = np.concatenate([symbols, np.where(alpha, points, 32)[keep].astype(np.uint64), np.full(int(last), 32, np.uint64)])
        middle = np.concatenate([middle, alpha[keep], np.zeros(int(last), bool)])
        if len(symbols) > 2:
            h = symbols[:-2] * MIX[0] + symbols[1:-1] * MIX[1] + symbols[2:] * MIX[2]
            h = h[middle[1:-1]]
            h ^= h >> np.uint64(29)
            yield h * MIX[1]
            symbols, middle = symbols[-2:], middle[-2:]


@dataclass
class Filters:
    """languages, sorted by frequency; table[words, positions] of masks; chance: each filter's rate of false hits."""

    languages: list[str]
    table: np.ndarray
    chance: np.ndarray

    def places(self, h: np.ndarray):
        """HASHES positions of each trigram, of 30 bits at most."""
        last = np.uint64(self.table.shape[1] - 1)
        return (((h * m) >> np.uint64(34)) & last for m in MIX)

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """Trigrams of the text, and how many of them each language's filter has."""
        total, found = 0, np.zeros(len(self.languages), np.int64)
        for h in grams(text):
            total += len(h)
            places = list(self.places(h))
            for w, masks in enumerate(self.table):
                both = masks[places[0]]
                for p in places[1:]:
                    both = both & masks[p]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    found[i] += np.count_nonzero(both & (np.uint64(1) << np.uint64(i - 64 * w)))
        return total, found

    def decide(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        total, found = self.counts(text)
        if not total:
            return UNKNOWN, 0.0
        net = np.maximum(0.0, (found - total * self.chance) / (1 - self.chance))
        order = sorted(range(len(net)), key=lambda i: (-net[i], self.languages[i]))
        if net[order[0]] == 0:
            return self.languages[0], 0.0
        second = net[order[1]] if len(order) > 1 else 0.0
        return self.languages[order[0]], float(net[order[0]] / (net[order[0]] + second))


def build(languages: list[str], rows: list[tuple[str, int]]) -> Filters:
    """Filters from (language, trigram hash)."""
    words, own = max(1, -(-len(languages) // 64)), {lang: [] for lang in languages}
    for lang, h in rows:
        own[lang].append(h)
    positions = max(POSITIONS, 1 << (ROOM * max(map(len, own.values()), default=0)).bit_length())
    filters = Filters(languages, np.zeros((words, positions), np.uint64), np.zeros(len(languages)))
    for i, lang in enumerate(languages):
        row, bit = filters.table[i // 64], np.uint64(1) << np.uint64(i % 64)
        for p in filters.places(np.array(own[lang], np.int64).view(np.uint64)):
            np.bitwise_or.at(row, p, bit)
        filters.chance[i] = min(0.99, (np.count_nonzero(row & bit) / positions) ** HASHES)
    return filters


def _gram_counts(batches):
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).extend(grams(text))
        for lang, found in by.items():
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])


def learn(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filters:
    """Filters from all rows of ``train`` that have a text and a language."""
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang is not null and text is not null")
    sizes = sorted(((r["count"], r["lang"]) for r in rows.groupBy("lang").count().collect()), key=lambda x: (-x[0], x[1]))
    if not sizes:
        return build([], [])
    share = F.create_map(*[F.lit(x) for n, name in sizes for x in (name, min(1.0, SAMPLE_DOCS / n))])
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(1 << 30))
    counted = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    typical = counted.withColumn("rate", rate).withColumn("best", F.max("rate").over(Window.partitionBy("h"))).where(F.col("rate") >= SHARE * F.col("best"))
    return build([name for _, name in sizes], [(r["lang"], r["h"]) for r in typical.select("lang", "h").collect()])


def identify(df: DataFrame, filters: Filters, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the columns ``out``: the language, string, and the score, double."""
    rest = [c for c in df.columns if c not in out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def run(batches):
        for b in portions(batches):
            found = [filters.decide(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    filters = learn(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), filters).select("doc_id", "held_out", "lang_pred", "score")
