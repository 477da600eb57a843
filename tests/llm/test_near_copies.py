"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline as P
from plain_versions import components

from quillmark.llm import near_copies

rng = random.Random(8)
vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = "CHANGED" + str(rng.randint(0, 99))
    return words


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def test_classes_are_those_of_all_similar_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CELL", 16)  # so that buckets are dealt to several cells
    texts = [" ".join(prose(rng.randint(1, 150))) for _ in range(60)]
    shared = prose(60)
    texts += [" ".join(shared + prose(rng.randint(1, 40))) for _ in range(80)]  # about as similar as the limit, some above it and some below
    base = [prose(n) for n in (6, 30, 120, 120, 3000)]
    texts += [" ".join(edited(b, min(len(b), rng.randint(0, 1 + len(b) // 40)))) for b in base for _ in range(30)]
    texts += [None, "", " \t\n", "x", "X", "one two", "One\x0bTWO", texts[0].upper()]
    sets = [grams(t) for t in texts]
    ids = range(len(texts))
    near = [(i, j) for i in ids for j in range(i + 1, len(texts)) if alike(sets[i], sets[j])]
    want = components(ids, near)
    assert 20 < len(set(want.values())) < len(texts) and any(sets[i] != sets[j] for i, j in near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in near_copies.classes(docs).collect():
        got.setdefault(r["class"], []).append(r.doc_id)
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(i for i in ids if want[i] == w) for w in set(want.values()))


def test_stage_drops_near_copies_of_many_bits_and_keeps_what_is_not_similar(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert alike(grams(docs[1].text), grams(docs[177].text))
    pair = spark.createDataFrame([docs[1], docs[177], docs[2]])
    assert sorted(r.doc_id for r in P.keep_one_of_each_class(spark, pair, "").collect()) == [1, 2]
