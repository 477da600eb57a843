"""A cleaning pipeline over ``documents``: each stage applies one training-data operator to what the last one kept.

1. ``language_id``: documents in no learnt language go; a missing ``lang`` is filled in.
2. ``simhash_dedup``: of each class of near copies (five-word shingles, Jaccard similarity 0.8 or more, exact) the document with the smallest id stays;
   of several rows with that id the one whose digest is smallest, rows without an id come last. Wordless texts are one class.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``pii``: personal data are replaced by their kind in brackets; ``n_chars`` follows.
5. ``sentencepiece``: the texts' token ids, and whether they decode to the text again.

All stages but the last return the columns of ``documents``; further columns pass through, whatever they
are called. Each handles null and empty texts, repeated rows and empty tables as its operator does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, language_id, near_copies, pii, sentencepiece_codec
from quillmark.llm.shared import shared_folder


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    filters = language_id.learn(docs.where(~F.coalesce(held, F.lit(False))))
    named = language_id.identify(docs, filters, out=("__lang", "__score"))
    kept = named.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") > 0))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digest = F.xxhash64(*docs.columns)
    rows = docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), digest.alias("digest")))
    stay = near_copies.classes(rows, key="__row").groupBy("class").agg(F.min("__row").alias("__row")).select(F.col("__row.digest").alias("__digest"))
    return docs.withColumn("__digest", digest).join(stay, "__digest").dropDuplicates(["__digest"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="__items")
    return marked.where(F.size("__items") == 0).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(pii.find(docs, out="__pii"), spans="__pii")
    return clean.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = sentencepiece_codec.round_trip(docs, sentencepiece_codec.model_bytes())
    return done.withColumns({"n_tokens": F.size("token_ids").cast("long"), "lossless": F.col("decoded") == F.coalesce("text", F.lit(""))}).drop("decoded")


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", keep_one_of_each_class),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode),
]

#: SQL has neither the tokenizer nor the seeded XXH64 of the fingerprints.
ORACLE_SQL = None


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The rows from Parquet files in the shared folder."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written in spark.checkpoint.dir and read again."""
    base = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
