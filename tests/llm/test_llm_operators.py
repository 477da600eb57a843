"""Operators against brute force on small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import collections
import dataclasses
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from plain_versions import WORD, base_spans, brute_fingerprint, components
from pyspark.sql import functions as F

from quillmark.llm import chat_format, debruijn_dedup, decontaminate, forest_search, language_id, pii, repeats, sentencepiece_codec, simhash_dedup, suffix_dedup, toxicity

rng = random.Random(5)
vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(rng.randint(5, 120)) for _ in range(30)]
    passage = prose(40)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5]) for i in range(12)]  # copies
    rows += [(200 + i, prose(9) + " " + passage + " " + prose(9)) for i in range(10)]  # a shared passage
    rows += [(300, None), (301, ""), (302, "   \t\n"), (303, "x"), (304, None)]
    rows += [(400, "For " * 300), (401, "For " * 90 + "end"), (402, "a b " * 200), (403, "ab" * 4000), (404, "z" * 30000)]
    rows += [(500, passage), (500, passage), (None, passage + " tail"), (7, base[7])]  # repeated rows, no id
    rows += [(600, passage.replace(" ", "\x0b")), (601, passage.upper()), (602, "é" * 150 + prose(5))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1.5) for i, t in texts], "doc_id long, text string, lang_pred string, score double").repartition(3)


def test_sentencepiece_is_the_library(docs, texts):
    model = sentencepiece_codec.model_bytes()
    library = sentencepiece_codec.codec(model).library
    odd = docs.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate([" ", "  a  b ", "▁ ▁x▁", "\n\n a\t", "<s> </s> <unk> <0x41>", "\x00é𝔸😀 😀", "　x​", "tail "])], "doc_id long, text string")
    rows = sentencepiece_codec.round_trip(docs.select("doc_id", "text").union(odd), model).collect()
    assert len(rows) == len(texts) + 8
    for r in rows:
        ids = library.encode(r.text or "")
        assert r.token_ids == ids and r.decoded == library.decode(ids)
    loose = docs.sparkSession.createDataFrame([(1, [1, 5, 0, 400]), (2, [200, 131]), (3, None), (4, [])], "doc_id long, token_ids array<int>")
    for r in sentencepiece_codec.decode(loose, model).collect():
        assert r.decoded == library.decode(r.token_ids or [])


def expected_bytes(texts):
    seen, out = set(), {}
    order = sorted({(-1 if i is None else i, (t or "").encode()) for i, t in texts}, key=lambda x: (x[0], repeats.tagged(x[1])))
    for i, x in order:
        gone = bytearray(len(x))
        for p in range(len(x) - 99):
            w = x[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        out[i, x] = gone
    return out


def test_suffix_dedup(docs, texts):
    want = expected_bytes(texts)
    by = collections.defaultdict(list)
    for (i, x), gone in want.items():
        by[i].append((len(x), sum(gone), bytes(c for c, g in zip(x, gone) if not g)))
    rows = suffix_dedup.dedup(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_bytes, sum(s.end - s.start for s in r.removed), bytes(r.kept))
        assert got in by[-1 if r.doc_id is None else r.doc_id], r.doc_id


def test_suffix_order_and_collisions():
    data = b"".join(bytes(rng.choice(b"ab") for _ in range(260)) for _ in range(6)) * 2
    at = np.arange(0, len(data) - 100, 3)
    group = np.sort(np.arange(len(at)) % 5)
    order = suffix_dedup.merge_sort(suffix_dedup.Suffixes(data, at), group)
    for g in range(5):
        mine = order[group[order] == g]
        assert list(mine) == sorted(np.flatnonzero(group == g), key=lambda k: (data[at[k] : at[k] + 100], k))
    first = suffix_dedup.repeated(data, at, np.zeros(len(at), np.int64))
    seen = {}
    assert [seen.setdefault(data[a : a + 100], i) for i, a in enumerate(at)] == first.tolist()


def test_suffix_shards_of_a_hot_anchor(spark, monkeypatch):
    passage = prose(25)
    rows = [(i, prose(6) + " " + passage + " " + prose(6)) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "SHARD", 4)
    want = expected_bytes(rows)
    for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        x = dict(rows)[r.doc_id].encode()
        assert sum(s.end - s.start for s in r.removed) == sum(want[r.doc_id, x])


def test_collisions_change_nothing(docs, texts, monkeypatch):
    """With four bits of a content's hash unlike runs and edges meet as if they were equal; verification finds them out and the look-up mends it."""
    plain = {name: sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept) if name == "bytes" else r.kept.encode()) for r in op.dedup(docs).collect()) for name, op in (("bytes", suffix_dedup), ("words", debruijn_dedup))}
    for name, op in (("bytes", suffix_dedup), ("words", debruijn_dedup)):
        monkeypatch.setattr(op, "RULE", dataclasses.replace(op.RULE, bits=4))
        assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept) if name == "bytes" else r.kept.encode()) for r in op.dedup(docs).collect()) == plain[name]


def test_graph_compacts_only_without_branches(spark):
    """A row of paths becomes one span where no other edge leaves or enters the node between, also inside another path."""
    path = "bucket int, doc long, tag long, start int, n int, tail long, head long"
    found = spark.createDataFrame([(0, 9, 1, 0, 3, 10, 20), (0, 9, 1, 3, 4, 20, 30), (0, 9, 1, 7, 2, 30, 40), (0, 9, 1, 20, 1, 40, 50)], path)
    told = [(20, 1, 2, 3), (20, 1, 0, 1), (30, 3, 5, 3), (30, 4, 0, 1), (40, 6, 0, 1), (50, 0, 7, 2), (60, 8, 9, 3)]
    cols = {c: np.array(x, t) for (c, t), x in zip(repeats.KINDS[repeats.NODE], zip(*told))}
    nodes = repeats.branchless(cols, np.array([10, 20, 30, 40]))
    assert nodes.tolist() == [20]
    simple = spark.createDataFrame([(int(n),) for n in nodes], "node long")
    assert sorted((r.start, r.n) for r in debruijn_dedup.compacted(found, simple).collect()) == [(0, 7), (7, 2), (20, 1)]


def test_debruijn_dedup(docs, texts):
    seen, want = {}, collections.defaultdict(list)
    for i, t in sorted(((-1 if i is None else i, t) for i, t in texts), key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            seen.setdefault(tuple(w[p : p + 13]), i)
    for i, t in texts:
        w, i = WORD.findall(t or ""), -1 if i is None else i
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if seen[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        want[i].append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    rows = debruijn_dedup.dedup(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, sum(s.end - s.start for s in r.removed), r.kept) in want[-1 if r.doc_id is None else r.doc_id], r.doc_id


def test_simhash_classes(docs, texts):
    fp = {}
    for i, t in texts:
        fp.setdefault(i, set()).add(brute_fingerprint(t))
    ids = [i for i in fp if i is not None]
    near = [(a, b) for a in ids for b in ids if a < b and any(bin(x ^ y).count("1") <= 4 for x in fp[a] for y in fp[b])]
    want = components(ids, near)
    rows = simhash_dedup.classes(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.fp & (2**64 - 1)) in fp[r.doc_id]
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]


def test_simhash_search_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CELL", 16)  # so that buckets are dealt to several cells
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    near = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, id long")
    got = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(df)).collect()}
    want = components(range(len(fps)), near)
    assert all(got.get(i, i) == want[i] for i in range(len(fps)))


def test_thresholds_obey_the_pigeonhole():
    for m in range(2, 6):
        widths = [64 // m + (k < 64 % m) for k in range(m)]
        _, t = simhash_dedup.allocate(widths, [1000.0 * (k + 1) for k in range(m)], 10_000)
        assert sum(t) == simhash_dedup.RADIUS - m + 1


def test_decontamination(spark):
    items = [(1, prose(30)), (2, prose(7)), (3, "only three words"), (4, ""), (5, None), (6, prose(60)), (6, prose(12))]
    held = lambda t, k: " ".join(w if j % 25 != k else "CHANGED" for j, w in enumerate(t.split()))
    rows = [(10, prose(20) + " " + items[0][1].upper() + ". " + prose(5)), (11, held(items[5][1], 24)), (12, "we saw Only three, words."), (13, prose(200)), (14, None), (15, ""), (16, items[0][1][: len(items[0][1]) // 2]), (10, items[1][1]), (17, items[5][1] * 1)]
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    P = decontaminate.PUNCTUATION.decode()
    words = lambda x: [w for w in (w.strip(P) for w in WORD.findall((x or "").lower())) if w]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    want = collections.Counter()
    for d, t in rows:
        for i, x in items:
            w, y = words(t), words(x)
            if not w or not y:
                continue
            size = min(5, len(y))
            a, b = grams(w, size), collections.Counter(grams(y, size))
            n = min(len(a), sum(b.values()))
            best = max(sum((collections.Counter(a[s : s + n]) & b).values()) / (n + sum(b.values()) - sum((collections.Counter(a[s : s + n]) & b).values())) for s in range(len(a) - n + 1))
            want[d, i] += best >= 0.8
    assert got == +want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), empty).count() == 0


def test_hamming_blocks_are_complete_and_select():
    generator = np.random.default_rng(2)
    fps = generator.integers(0, 256, (150, 32), dtype=np.uint8)
    bits = np.unpackbits(fps, axis=1)
    asked = bits[np.arange(900) % 150].copy()
    for row in asked:
        row[generator.choice(256, generator.integers(0, 64), replace=False)] ^= 1
    q, i = decontaminate.HammingBlocks(fps).near(np.packbits(asked, axis=1))
    far = (asked[:, None, :] != bits[None]).sum(axis=2)
    assert set(zip(q.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS))))
    named = np.bitwise_count(decontaminate.HammingBlocks(fps).named(generator.integers(0, 256, (2000, 32), dtype=np.uint8))).sum()
    assert named < 0.05 * 2000 * 150  # of unrelated windows and items


def test_decontamination_in_blocks_is_that_in_one(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(rng.randint(3, 40))) for i in range(30)] + [(40, None)], "item_id long, text string")
    held = {r.item_id: r.text for r in items.collect()}
    docs = spark.createDataFrame([(i, prose(10) + " " + held[i % 30] + " " + held[(7 * i + 1) % 30], "clash") for i in range(40)] + [(50, None, ""), (51, "", ""), (1, held[1] * 1, "x"), (60, prose(40_000) + " " + held[3], "long")], "doc_id long, text string, item_id string")
    rows = lambda df: collections.Counter((r.doc_id, r.text, r.item_id, tuple(sorted((m.item_id, round(m.similarity, 9), m.start, m.n_words) for m in r.matches))) for r in df.collect())
    one = rows(decontaminate.mark(docs, items))
    assert sum(len(k[3]) for k in one) >= 81 and one[50, None, "", ()] == 1
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert rows(decontaminate.mark(docs, items)) == one


def test_forest_search(spark):
    generator = np.random.default_rng(3)
    x = (generator.normal(size=(1500, 16)) + 3 * generator.integers(0, 8, 1500)[:, None]).astype(np.float32)
    x[1000:1400] = x[0]  # one vector that very many rows have
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in forest_search.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    found = total = 0
    for q, g in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        near = [j for j in np.lexsort((np.arange(1500), d)) if j != q][:10]
        assert [r for r, _, _ in g] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in g)
        assert [(s, v) for _, v, s in g] == sorted((s, v) for _, v, s in g) and q not in [v for _, v, _ in g]
        found, total = found + len(set(near) & {v for _, v, _ in g}), total + 10
    assert found / total >= 0.9
    assert [v for _, v, _ in got[0]] == list(range(1000, 1010))
    few = spark.createDataFrame([(100, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in forest_search.search(few, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1, 1.0)]
    assert forest_search.search(few.where("vec_id < 0"), F.lit(True)).count() == 0


def test_forest_names_leaves_alike_for_rows_and_queries():
    generator = np.random.default_rng(4)
    sample = generator.normal(size=(400, 12))
    for ratio in (1.0, 3.0, 500.0):  # of more rows than points: cuts below the fitted part
        forest = [forest_search.fit(sample, ratio, 7 + t) for t in range(3)]
        assert (ratio == 1.0) == all(t.deeper.shape[1] == 0 for t in forest)
        asked = np.concatenate([generator.normal(size=(20, 12)), sample[:20]])
        with np.errstate(over="ignore"):
            own = np.stack([t.leaves(asked) for t in forest], axis=1)
        for q, names in zip(asked, own, strict=True):
            first = [n for n, _ in zip(forest_search.leaf_order(forest, q), range(3))]
            assert sorted(first) == sorted(names.tolist())  # a query's own leaf costs nothing
    every = list(forest_search.leaf_order([forest_search.fit(sample, 1.0, 3)], sample[0]))
    with np.errstate(over="ignore"):
        assert set(forest_search.fit(sample, 1.0, 3).leaves(sample).tolist()) <= set(every) and len(every) == len(set(every))


def test_forest_bounds_keep_the_nearest():
    generator = np.random.default_rng(6)
    x = generator.normal(size=(300, 5)) * 10.0 ** generator.integers(-3, 3, 300)[:, None]
    codes, scale, error = forest_search.coded(x)
    size = np.dtype([("leaf", "<u8"), ("rep", "<i8"), ("scale", "<f8"), ("error", "<f8"), ("code", "i1", (5,))])
    points = np.empty(600, size)
    for half in (slice(0, 300), slice(300, 600)):  # as from two trees
        points["leaf"][half], points["rep"][half], points["scale"][half], points["error"][half], points["code"][half] = np.arange(300) % 7 + half.start, np.arange(300), scale, error, codes
    asks = np.array([(q, leaf) for q in range(20) for leaf in (0, 1, 2, 300, 304)], [("qid", "<i8"), ("leaf", "<u8")])
    vectors = np.empty(20, [("qid", "<i8"), ("v", "<f8", (5,))])
    vectors["qid"], vectors["v"] = np.arange(20), x[:20]
    q, rep, low, high = forest_search.compared(points, asks, vectors, 6)
    assert len(set(zip(q.tolist(), rep.tolist()))) == len(q)
    seen = np.flatnonzero(np.isin(np.arange(300) % 7, (0, 1, 2, 4)))
    for i in range(20):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        mine = rep[q == i]
        assert set(seen[np.lexsort((seen, d[seen]))][:6].tolist()) <= set(mine.tolist()) and len(mine) < len(seen)
        assert (low[q == i] <= d[mine]).all() and (d[mine] <= high[q == i]).all()


def test_forest_recall_on_clusters_opens_few_leaves(spark):
    generator = np.random.default_rng(8)
    x = generator.normal(size=(300, 24))[generator.integers(0, 300, 9000)] + 0.3 * generator.normal(size=(9000, 24))
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    points = forest_search.distinct_vectors(rows, 10)
    shared = forest_search.planted(points, 9000)
    asked = rows.where("id % 100 = 0").select("v", F.col("id").alias("qid"))
    assert forest_search.calibrated(points, asked, shared, 10) < 80  # of about 9,000 leaves of all trees
    got = collections.defaultdict(list)
    for r in forest_search.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append(r.vec_id)
    found = sum(len(set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) & set(g)) for q, g in got.items())
    assert len(got) == 90 and found >= 0.9 * 900


def test_toxicity(spark):
    clean = [prose(30) for _ in range(300)]
    bad = [" ".join(w for w in (prose(12), rng.choice(["zurkling", "blaffer"]), prose(8))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(clean + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows] + [(0, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert set(model.terms) == {"zurkling", "blaffer"}
    probe = spark.createDataFrame([(1, bad[0]), (2, clean[0]), (3, None), (4, ""), (5, prose(10) + " zurklink " + prose(3)), (1, bad[0])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[1] >= 0.7 > 0.3 > got[2] and got[3] == got[4] == got[2]
    assert model.hit("zurkling") > 1 and model.hit("zurklink") == -1 and model.hit("zurk") == 0
    none = toxicity.learn(docs, labels.where("toxic = 7"))
    assert none.score("zurkling") < 1e-9


def test_lexicon_automaton_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 13))) for _ in range(30)]
    own = toxicity.Lexicon(terms)
    for _ in range(2000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 13)))
        want = min((d for t in terms if (d := distance(w, t)) <= toxicity.allowed(t)), default=-1)
        assert own.edits(w) == want, (w, terms)


def test_language_id(spark, docs, texts):
    rows = [(i, " ".join(rng.choice(["the", "and", "house", "tree", "with"]) for _ in range(12)), "en") for i in range(40)] + [(50 + i, " ".join(rng.choice(["der", "und", "haus", "baum", "mit"]) for _ in range(12)), "de") for i in range(40)] + [(99, "x y", None)]
    filters = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(filters.languages) == ["de", "en"]
    probe = spark.createDataFrame([(1, "the house and the tree"), (2, "der baum und das haus"), (3, None), (4, "123 ... !!"), (5, ""), (6, "ЖЖЖЖ ЩЩЩ"), (7, "the house " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(probe, filters).collect()}
    assert got[1][0] == got[7][0] == "en" and got[2][0] == "de"
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][1] == 0.0
    assert language_id.identify(docs, filters).count() == len(texts)
    nothing = language_id.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert nothing.decide("words") == ("und", 0.0)


def test_pii(spark):
    letters = "a.@+-1 2%(4)xé😀_:9/0"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(1500)] + [None, "", "a@b.c%x@d.e", "1.2.3.4.5.6.7.8", "😀 4111 1111 1111 1111 +1 (132) 555-1352", "1" * 5000, "a" * 50_000 + "@", "1 " * 20_000, "mail a.b+c@x-y.co.uk!", "DE89 3704 0044 0532 0130 00", "DE00370400440532013000", "ssn 123-45-6789", "123-45-6789"]
    found = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    for r in found.collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in pii.BASE] == list(base_spans(r.text or ""))
    more = {r.doc_id: [s.kind for s in r.pii if s.kind not in pii.BASE] for r in found.collect()}
    assert [more[len(rows) - 4 + i] for i in range(4)] == [["iban"], [], ["ssn"], []]
    clean = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert clean[1500] is None and clean[1504].startswith("😀 [CARD] [PHONE]") and clean[len(rows) - 1] == "123-45-6789"


def test_chat_format(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "bye"), (1, 1, "assistant", "hello"), (1, 0, "user", "hi"), (1, 2, "user", "<|im_end|>"), (1, 3, "assistant", "no"), (2, 0, None, None), (4, 0, "user", "same"), (5, 0, "user", "same"), (7, 0, "assistant", "alone"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, pair_id int").drop("pair_id")
    sides = df.where("conv_id is not null").withColumns({"pair_id": F.floor(F.col("conv_id") / 2).cast("long"), "side": F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected")})
    got = {r.pair_id: r for r in chat_format.format_pairs(sides).collect()}
    a = got[0]
    assert a.n_prompt_turns == 2 and a.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert a.chosen == "<|im_start|>user\nbye<|im_end|>\n" and a.chosen_loss == ""
    start, end = map(int, a.rejected_loss.split(":"))
    assert a.rejected[start:end] == "no<|im_end|>" and "<| im_end|>" in a.rejected
    assert got[1].rejected is None and got[1].chosen == "<|im_start|>user\n<|im_end|>\n" and got[1].n_prompt_turns == 0
    assert got[2].chosen == got[2].rejected == "" and got[2].n_prompt_turns == 1
    assert got[3].chosen is None and got[3].rejected_loss == "22:37"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = sentencepiece_codec.model_bytes()
    assert sentencepiece_codec.round_trip(empty, model).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0 and debruijn_dedup.dedup(empty).count() == 0
    assert simhash_dedup.classes(empty).count() == 0 and pii.find(empty).count() == 0
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    turns = spark.createDataFrame([], "pair_id long, side string, conv_id long, turn long, role string, text string")
    assert chat_format.format_pairs(turns).count() == 0


def test_digests_follow_the_operators(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    library = sentencepiece_codec.codec(sentencepiece_codec.model_bytes()).library
    for r in sentencepiece_codec.query(spark, d).collect():
        ids = library.encode(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    ids = sorted(fps)
    root = components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 4])
    for r in simhash_dedup.query(spark, d).collect():
        assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == root[r.doc_id]


def test_decontamination_at_the_limit_loses_next_to_nothing():
    """Windows whose similarity lies between 0.8 and 0.9: those that the blocks and the radius let pass."""
    generator = random.Random(12)
    found = total = 0
    for _ in range(300):
        words = [generator.choice(vocabulary) + str(generator.randint(0, 99)) for _ in range(generator.randint(45, 120))]
        changed = list(words)
        for _ in range(generator.randint(1, 2)):
            changed[generator.randrange(len(changed))] = "CHANGED"
        index = decontaminate.index_of([(1, " ".join(words))])
        score = decontaminate.similarity(decontaminate.shingles(decontaminate.word_hashes(" ".join(changed))), index.items[0])
        if 0.8 <= score < 0.9:
            total += 1
            found += any(True for _ in index.matches(" ".join(changed)))
    assert total > 100 and found >= 0.99 * total


SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def crc(x):
    return zlib.crc32(str(x).encode())


def trigrams(text):
    """Trigrams of lower-cased letters with a letter in the middle; what lies between letters is one border."""
    out, word = [], re.sub("\\0+", "\0", "".join(c if c.isalpha() else "\0" for c in text.lower()))
    word = f"\0{word.strip(chr(0))}\0"
    return [word[i : i + 3] for i in range(len(word) - 2) if word[i + 1] != "\0"] if len(word) > 2 else out


def test_language_query_is_plain_counting(spark):
    """The query against sets of trigrams without filters: the same language wherever the plain scores aren't next to equal."""
    docs = table(spark, "documents")
    counts = collections.defaultdict(collections.Counter)
    for d in docs:
        if crc(d.doc_id) % 5 and d.lang is not None and d.text is not None:
            counts[d.lang].update(trigrams(d.text))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    best = collections.Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            best[g] = max(best[g], n / totals[lang])
    typical = {lang: {g for g, n in c.items() if n / totals[lang] >= language_id.SHARE * best[g]} for lang, c in counts.items()}
    plain = {}
    for d in docs:
        own = trigrams(d.text or "")
        hits = sorted(((sum(g in t for g in own), lang) for lang, t in typical.items()), key=lambda x: (-x[0], x[1]))
        plain[d.doc_id] = (hits, len(own))
    rows = language_id.query(spark, SF).collect()
    assert len(rows) == len(docs) == len({r.doc_id for r in rows})
    right = total = 0
    langs = {d.doc_id: d.lang for d in docs}
    for r in rows:
        hits, n = plain[r.doc_id]
        assert r.held_out == (crc(r.doc_id) % 5 == 0)
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            (a, first), (b, _) = hits[:2]
            assert r.lang_pred == first or a - b <= 0.02 * n
            assert abs(r.score - (a / (a + b) if a else 0.0)) < 0.05
        if r.held_out and langs[r.doc_id]:
            total, right = total + 1, right + (r.lang_pred == langs[r.doc_id])
    assert total > 20 and right / total > 0.97


def test_language_of_very_long_texts_without_spaces(spark):
    words = {"en": ["the", "and", "house", "tree", "with"], "de": ["der", "und", "haus", "baum", "mit"]}
    generator = random.Random(2)
    rows = [(i, " ".join(generator.choice(words[k]) for _ in range(12)), k) for k in words for i in range(40 * (k == "de"), 40 + 40 * (k == "de"))]
    filters = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "theandhousetree" * 90_000  # over two slices, no border anywhere
    plain = trigrams(text)
    assert sum(len(h) for h in language_id.grams(text)) == len(plain) and filters.decide(text)[0] == "en"
    monkey = language_id.SLICE
    assert monkey < len(text)
    for size in (1, 2, 3, 5, 1000):
        language_id.SLICE = size
        short = "Ab1 cde--F\u0130g hij  "
        sliced = np.concatenate(list(language_id.grams(short)))
        language_id.SLICE = monkey
        assert sliced.tolist() == np.concatenate(list(language_id.grams(short))).tolist()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_toxicity_query_is_plain_counting(spark):
    """Scores of the query against a plain reading with edit distances; the lexicon against plain counts of the labelled words."""
    docs = table(spark, "documents")
    labels = collections.defaultdict(list)
    for r in table(spark, "labels"):
        if r.toxic is not None and r.doc_id is not None:
            labels[r.doc_id].append(r.toxic)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet").where(~held), spark.read.parquet(f"{SF}/labels.parquet"))
    train = {}
    for d in docs:
        if crc(d.doc_id) % 3 != 1 and d.doc_id in labels and d.text is not None:
            train[d.text] = max(train.get(d.text, 0), *labels[d.doc_id])
    n, p = sum(v == 0 for v in train.values()), sum(v == 1 for v in train.values())
    seen = collections.defaultdict(lambda: [0, 0])
    for text, toxic in train.items():
        for w in set(toxicity.TOKEN.findall(text.lower())):
            seen[w][toxic] += 1
    able = {w: c for w, c in seen.items() if c[1] >= toxicity.MIN_TEXTS and len(w) >= 3 and not re.fullmatch("[0-9_]+", w)}
    log = lambda k, share: k * math.log(share) if k else 0.0
    sure = {w: log(t, t / (c + t) / (p / (n + p))) + log(c, c / (c + t) / (n / (n + p)) if c else 1.0) for w, (c, t) in able.items()}
    ratio = {w: ((t + 0.5) / (p + 1)) / ((c + 0.5) / (n + 1)) for w, (c, t) in able.items()}
    assert set(model.terms) == {w for w in able if ratio[w] >= toxicity.RATIO and sure[w] >= math.log(max(len(able), 1)) + toxicity.SURE}
    rows = {r.doc_id: r for r in toxicity.query(spark, SF).collect()}
    assert len(rows) == len(docs)
    known = {}

    def hit(w):
        if w not in known:
            near = [distance(w, t) for t in model.terms if abs(len(w) - len(t)) <= toxicity.allowed(t) and distance(w, t) <= toxicity.allowed(t)]
            known[w] = 0 if not near else 1 if w in model.terms else -1
        return known[w]

    for d in docs[:60] + [d for d in docs if labels.get(d.doc_id) == [1]]:
        tokens = toxicity.TOKEN.findall((d.text or "").lower())
        at = [i for i, w in enumerate(tokens) if hit(w)]
        counts = dict.fromkeys(toxicity.FEATURES, 0.0)
        for i in at:
            before, after = tokens[max(0, i - toxicity.BEFORE) : i], tokens[i + 1 : i + 1 + toxicity.AFTER]
            quoted = bool(set(before) & toxicity.QUOTES and set(after) & toxicity.QUOTES or set(before) & toxicity.REPORTING)
            weight = math.log(ratio[tokens[i]]) if hit(tokens[i]) > 0 else 1.0
            counts["quoted" if quoted else "exact" if hit(tokens[i]) > 0 else "misspelt"] += 1 if quoted else weight
            if not quoted and hit(tokens[i]) > 0:
                counts["surest"] = max(counts["surest"], weight)
            counts["addressed"] += not quoted and bool(toxicity.ADDRESS & {*before, *after})
        z = model.bias + sum(w * math.log1p(x) for w, x in zip(model.weights, counts.values(), strict=True))
        r = rows[d.doc_id]
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        assert r.predicted == (r.score >= 0.7) and r.held_out == (crc(d.doc_id) % 3 == 1)
    own = [(r, labels[i][0]) for i, r in rows.items() if r.held_out and i in labels]
    assert sum(r.predicted == y for r, y in own) >= 0.8 * len(own)  # of 35 texts, by a lexicon from 66


def test_toxicity_takes_odd_labels_very_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"calm words here w{i} " + ("zurkling blaffer" if i % 2 else "quiet"), "clash", i) for i in range(60)] + [(None, "zurkling", "x", 0), (90, "zurkling " * 200_000, "x", 0)], "doc_id long, text string, score string, counts int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 7), (5, -1), (None, 1), (90, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert set(model.terms) == {"zurkling", "blaffer"}
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 62 and {r.counts for r in rows} == set(range(60)) and all(0 <= r.score <= 1 for r in rows)
    terms = spark.createDataFrame([(i, " ".join(f"bad{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(600)) + f" w{i}" if i % 2 else f"calm w{i}") for i in range(40)], "doc_id long, text string")
    assert len(toxicity.learn(terms, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")).terms) == 600


def test_simhash_rows_without_an_id_link_others(spark, monkeypatch):
    chain = [(7, 0), (None, 0b1111), (9, 0b11111111), (20, (1 << 40) * 0b111111)]  # 7 and 9 are eight bits apart, each four from the one without an id
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in chain], "id long, fp long")
    monkeypatch.setattr(simhash_dedup, "with_fingerprint", lambda d, text="text", out="fp": d.withColumn("fp", F.col("text").cast("long")))
    docs = df.select(F.col("id").alias("doc_id"), F.col("fp").cast("string").alias("text"))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash_dedup.classes(docs).collect()}
    assert got == {(7, 0): 7, (None, 15): 7, (9, 255): 7, (20, (1 << 40) * 63): 20}


def test_pii_of_very_many_matches_and_context_on_both_sides(spark):
    n = 20_000
    rows = [(1, "a@b.cc " * n), (2, "4111 1111 1111 1111;" + "12 " * n), (3, "1.2.3.4 " * n), (4, "123-45-6789 is my social security number"), (5, "123-45-6789" + " " * 60 + "ssn"), (6, "acct DE89 3704 0044 0532 0130 00 AND MORE"), (7, "GB82 WEST 1234 5698 7654 32"), (8, "DE89 3704 0044 0532 0130 000")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, pii string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert [(s.start, s.end) for s in got[1].pii] == [(7 * i, 7 * i + 6) for i in range(n)]
    assert [(s.kind, s.start, s.end) for s in got[2].pii if s.kind == "card"] == [("card", 0, 19)]
    assert [(s.start, s.end) for s in got[3].pii if s.kind == "ip"] == [(8 * i, 8 * i + 7) for i in range(n)]
    kinds = {i: [s.kind for s in got[i].pii if s.kind in ("ssn", "iban")] for i in range(4, 9)}
    assert kinds == {4: ["ssn"], 5: [], 6: ["iban"], 7: ["iban"], 8: []}
    clean = {r.doc_id: r.text for r in pii.redact(pii.find(df)).collect()}
    assert clean[1] == "[EMAIL] " * n and clean[6] == "acct [IBAN] AND MORE"


def test_redaction_merges_overlapping_spans(spark):
    span = "pii array<struct<kind:string,start:int,end:int,score:double>>"
    text = "é" * 5000 + "0123456789" * 500
    rows = [(1, text, [("b", 4090, 4100, 1.0), ("a", 4095, 4098, 1.0), ("c", 4099, 5003, 1.0), ("d", 9999, 10000, 1.0)]), (2, "abc", [("x", 0, 3, 1.0)]), (3, "abc", []), (4, None, [])]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, f"doc_id long, text string, {span}")).collect()}
    assert got == {1: text[:4090] + "[B]" + text[5003:9999] + "[D]", 2: "[X]", 3: "abc", 4: None}


def test_running_sums_and_maxima(spark):
    from quillmark.llm.shared import before_each, sums_before

    rows = [(i, [rng.randint(0, 50) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 7, 8, 9, 26, 27, 28, 64, 65, 1000])]
    df = spark.createDataFrame(rows, "id int, x array<int>").select("id", "x", sums_before(F.col("x")).alias("s"), before_each(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m"))
    for r in df.collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))] and r.m == [max([0, *r.x[:i]]) for i in range(len(r.x))]


def test_chat_pairs_share_their_beginning(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"), (1, 0, "user", "x"), (1, 1, "assistant", "c"), (2, 0, "assistant", "alone"), (4, 0, "user", "mute"), (5, 0, "assistant", "z"), (None, 0, "assistant", "n")]
    long = [(8, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)] + [(9, 0, "assistant", "end")]
    df = spark.createDataFrame([(*r, "clash") for r in rows + long], "conv_id long, turn long, role string, text string, chosen_id string")
    got = {r.pair_id: r for r in chat_format.format_sides(chat_format.with_answers_swapped(df)).collect()}
    assert set(got) == {0, 1, 2, 5, 8, 9}
    turn = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    a = got[0]
    assert a.n_prompt_turns == 3 and a.prompt == turn("user", "hi") + turn("assistant", "a") + turn("user", "more") and a.rejected_id == 1
    assert a.chosen == turn("assistant", "b") + turn("user", "bye") and a.rejected == turn("assistant", "c") + turn("user", "bye")
    assert got[1].rejected == turn("assistant", "b") and got[2].rejected is None and got[5].rejected is None and got[2].n_prompt_turns == 0
    assert got[8].n_prompt_turns == 2999 and got[9].n_prompt_turns == 0
    whole = chat_format.format_pairs(df.where("conv_id = 8").withColumns({"pair_id": F.lit(1), "side": F.lit("chosen")})).first()
    spans = [tuple(map(int, x.split(":"))) for x in whole.chosen_loss.split(",")]
    assert [whole.chosen[s:e] for s, e in spans] == [f"t{i}<|im_end|>" for i in range(1, 3000, 2)]


def test_search_of_very_long_vectors(spark):
    generator = np.random.default_rng(1)
    x = generator.normal(size=(120, 3000))
    df = spark.createDataFrame([(i, v.tolist(), 0.5, i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score double, query_id int")
    got = forest_search.search(df, F.col("vec_id") % 100 == 0, k=3).collect()
    assert len(got) == 6
    for r in got:
        assert abs(r.score - np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum())) < 1e-9
