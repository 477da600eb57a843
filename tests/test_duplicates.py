"""Near duplicates move digests and candidates, not every text."""

from pyspark.sql import functions as F

from quillmark.operators import duplicates as U


def test_texts_are_told_by_their_digest(spark):
    w = [f"w{i}" for i in range(60)]
    docs = [(1, "s", " ".join(w)), (2, "s", " ".join(w)), (3, "s", " ".join([*w[:-1], "x"])), (4, "t", " ".join(w)), (5, None, " ".join(w)), (6, None, " ".join(w)), (7, "s", None), (8, "s", "")]
    df = spark.createDataFrame(docs, "id long, source string, text string")
    texts, pairs = U.similar_pairs(df, "id", "source", "text")
    assert "t" not in texts.columns and [(r.a, r.b) for r in pairs.collect()] == [(1, 3)]
    got = {r.id: (r.class_id, r.n_links) for r in U.classes(df, "id", "source", "text").select("id", "class_id", F.col("n_links")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0), 5: (5, 0), 6: (5, 0), 7: (7, 0), 8: (7, 0)}


def test_pairs_are_those_of_brute_force_and_common_passages_make_no_candidates(spark, monkeypatch):
    """Copies of a crowd, texts that share a long passage only, and buckets that are dealt in chunks."""
    import random

    rng = random.Random(5)
    passage, base = [f"p{i}" for i in range(40)], [f"b{i}" for i in range(90)]
    docs = [(i, "s", " ".join([*passage, *[f"d{i}_{j}" for j in range(60)]])) for i in range(120)]
    for i in range(120, 170):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(90)] = f"x{rng.randrange(9)}"
        docs.append((i, "st"[i % 2], " ".join(w)))
    docs += [(170, "s", "a b c"), (171, "s", "a  b\tc"), (172, "t", "a b c"), (173, "s", ""), (174, "s", None), (175, "s", "B b c"), (176, "s", "é" * 9)]
    df = spark.createDataFrame(docs, "id long, source string, text string")

    def sets(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = {(g, t or ""): i for i, g, t in reversed(docs)}
    known = sorted((i, g, sets(t)) for (g, t), i in kept.items())
    want = {(a, b) for a, g, x in known for b, h, y in known if a < b and g == h and x & y and len(x & y) / len(x | y) >= 0.8}
    seen = []
    real = U.bucket_pairs
    monkeypatch.setattr(U, "CELL", 8)
    monkeypatch.setattr(U, "bucket_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    assert {(r.a, r.b) for r in U.similar_pairs(df, "id", "source", "text")[1].collect()} == want and len(want) > 40
    assert not seen[0].where("a < 120").count()  # before, 120 * 119 / 2 pairs were compared on their whole sets
