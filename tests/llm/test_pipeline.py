"""The pipeline against a plain version of its stages."""

import re

import corpus_pipeline as P
from plain_versions import base_spans, components
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, sentencepiece_codec

SF = "/root/testdata/sf0.001"


def contaminated(text, items):
    marks = decontaminate.PUNCTUATION.decode()
    words = lambda x: [w for w in (w.strip(marks) for w in re.findall(r"[^\x20\x09-\x0D]+", x.encode().lower().decode())) if w]
    mine = " ".join(words(text))
    return any(f" {' '.join(words(i))} " in f" {mine} " for i in items)


def grams(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_is_its_stages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: r.text for i, r in docs.items() if r.text and any(c.isalpha() for c in r.text)}
    sets = {i: grams(t) for i, t in kept.items()}
    ids = sorted(kept)
    roots = components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    kept = {i: t for i, t in kept.items() if not contaminated(t, items)}
    library = sentencepiece_codec.codec(sentencepiece_codec.model_bytes()).library
    rows = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert set(rows) == set(kept)
    for i, r in rows.items():
        assert r.token_ids == library.encode(r.text) and r.n_tokens == len(r.token_ids) and r.lossless and r.n_chars >= 0
        assert not list(base_spans(r.text)) and (r.text == kept[i]) == (not list(base_spans(kept[i])))
    assert [name for name, _ in P.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "pii", "sentencepiece"]


def test_stages_take_odd_rows(spark):
    rows = [(1, "the cat and the dog sat on the mat", "en", "s", 34), (1, "the cat and the dog sat on the mat", "en", "s", 34), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "the dog and the cat ran with the ball", None, "s", 5), (5, "123 456", "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    done = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in done) == [(False, 1), (True, 0)]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_repeated_and_missing_ids_and_clashing_columns(spark):
    """Of a class one row stays: that of the smallest id, and among rows of one id always the same one; rows without an id come last."""
    copy = "one two three four five six seven eight nine ten eleven twelve"
    other = " ".join(f"word{i}" for i in range(30))
    rows = [(1, copy, "a"), (1, other, "b"), (1, copy, "c"), (2, copy, "d"), (None, other, "e"), (None, "quite another text of seven words here", "f"), (None, "quite another text of seven words here", "f"), (4, None, "g"), (5, " ", "h"), (6, "w " * 50_000, "i"), (7, "w " * 50_000 + "end", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("class", F.col("score"))
    kept = [sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in P.keep_one_of_each_class(spark, docs.repartition(n), "").collect()) for n in (1, 3)]
    assert kept[0] == kept[1] and [(x[0], x[1]) for x in kept[0]] == [(False, 1), (False, 1), (False, 4), (False, 6), (False, 7), (True, 0)]
    named = spark.createDataFrame([(1, "the cat and the dog sat on the mat", None, "kept", "own")], "doc_id long, text string, lang string, score string, lang_pred string")
    r = P.keep_known_languages(spark, named, SF)
    assert r.columns == named.columns
