"""Operators that have no table of their own: sources, sinks, quotas, perturbation and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.functions import boxes as B
from quillmark.functions import text as T
from quillmark.functions.hashing import chosen, unit
from quillmark.operators import distributions as Q
from quillmark.operators import duplicates as U
from quillmark.operators import perturb as P
from quillmark.operators import rollup as R
from quillmark.sources import files as Z
from quillmark.streaming import ingest


def test_scan_and_selection(spark, tmp_path):
    for t, i, files in (("form", "1", ["a.json", "a.png"]), ("form", "2", ["a.json", "a.png", "b.png"]), ("other", "1", ["x.json"]), ("bad", "1", ["a.png"])):
        (tmp_path / t / i).mkdir(parents=True)
        for f in files:
            (tmp_path / t / i / f).write_text("{}")
    rows = {r.sample_id: r for r in Z.scan_pages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"form__1", "form__2", "other__1"}
    assert rows["form__1"].image_path and rows["form__2"].image_path is None
    index = Z.scan_pages(spark, str(tmp_path))
    assert Z.select_pages(index, ["form"]).count() == 2 and Z.select_pages(index, limit=1).count() == 1
    assert sum(Z.shard(index, 3, k).count() for k in range(3)) == 3


def test_shapes_of_masked_texts_are_those_of_the_values(spark):
    from quillmark.functions import kernels as K
    from quillmark.operators import pages as G

    rows = [('{"a": 1, "b": [1, "x", null]}', '{"a": "1,2", "b": ["}", true]}'), ('{"a,1,b": {"c": -1.5e3}}', '{"a,2,b": {"c": 7}}'), ('{"a": 1}', "{"), ('{"a": 1}', None), (None, '{"a": 1}'), ('{"a": "q\\"[1,2]"}', '{"a": [1, 2]}'), ('{"a": 1}', '{"a": 01}'), ("no", "[1]"), ('{ "x" : {"y":[ 1 , 2.0 ]}, "z":"\\u00e9:" }', '{"x": {"y": [[], {}]}, "z": 0}')]
    got = G.shape_similarity(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, t string, r string"), "t", "r").collect()
    assert len(got) == len(rows)
    for x in got:
        said = G._parsed(x.r)
        assert x.schema_nted == (0.0 if said is None else K.tree_similarity(G._parsed(x.t) or {}, said)), x


def test_small_sources_and_sets(spark, tmp_path):
    from quillmark.operators import profile

    (tmp_path / "x.json").write_text('{"model": "a", "n": 1}')
    assert json.loads(Z.read_json(spark, str(tmp_path / "x.json")).first().text)["n"] == 1
    old, new = (spark.createDataFrame(r, "model string, x int") for r in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert sorted(map(tuple, Z.merged_results(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert profile.same_multiset(old.union(old), old.unionAll(old)) and not profile.same_multiset(old.union(old), old)


def test_layouts_and_long_chains(spark, tmp_path):
    for name in ("a", "b_c"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name}, indent=1))
    (tmp_path / "notes.txt").write_text("no")
    assert {r.template_name: json.loads(r.layout)["name"] for r in Z.layouts(spark, str(tmp_path)).collect()} == {"a": "a", "b_c": "b_c"}
    chain = [("r0", "pixel", None)] + [(f"r{i}", None, f"r{i - 1}") for i in range(1, 40)] + [("x", None, "y"), ("y", None, "x")]
    got = {r.run: r.source_space for r in Z.resolved_spaces(spark.createDataFrame(chain, "run string, source_space string, inherits string")).collect()}
    assert got["r39"] == "pixel" and got["x"] is None and got["y"] is None and sum(v == "pixel" for v in got.values()) == 40


def test_field_paths_of_any_depth(spark):
    from quillmark.operators import layout as L

    nodes = spark.createDataFrame([(f"n{i}", f"l{i}") for i in range(16)], "id string, label string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(15)], "source string, target string")
    got = {r.id: r.path for r in L.field_paths(nodes, edges).collect()}
    assert len(got) == 16 and got["n15"] == [f"l{i}" for i in range(16)]


def test_parsers_take_broken_texts(spark):
    from quillmark.operators import layout as L
    from quillmark.operators import pages as G
    from quillmark.operators import predictions as D

    df = spark.createDataFrame([(None,), ("{",), ("[1]",), ("7",), ('{"fields": 3, "local_grids": {"a": 1}, "widgets": [1], "relations": "x"}',)], "raw string")
    assert D.adapted(df, "raw").count() == D.parsed(df, "raw").count() == 5 and L.layout_elements(df, "raw").count() == 0
    assert [r.answer_hash is None for r in G.hashed_answers(df, "raw").collect()] == [True, True, False, False, False]
    assert G.repeated_members(df, "raw").count() == 0 and G.pipeline_pages(df, "raw").count() == 5
    scored = D.page_scores(df.withColumn("truth", F.lit(None).cast("string")), "truth", "raw")
    assert [r.valid for r in scored.collect()] == [False, False, False, False, True]


def test_a_grid_takes_its_other_shape(spark):
    cell = lambda r, c, h=1, w=1: {"r": r, "c": c, "h": h, "w": w}
    rows = [(1, [cell(0, 0), cell(0, 1)]), (2, [cell(0, 0), cell(1, 0), cell(2, 0)]), (3, [cell(0, 0)]), (4, [cell(0, 0, 2, 1), cell(0, 1), cell(1, 1)])]
    df = spark.createDataFrame(rows, "id int, cells array<struct<r:int,c:int,h:int,w:int>>").select("id", P.reshaped_grid(F.col("cells")).alias("g"))
    got = {r.id: r.g and [(x.r, x.c, x.h, x.w) for x in r.g] for r in df.collect()}
    assert got == {1: [(0, 0, 1, 1), (1, 0, 1, 1)], 2: [(0, 0, 1, 1), (0, 1, 1, 1), (0, 2, 1, 1)], 3: None, 4: [(0, 0, 1, 1), (1, 0, 1, 1), (2, 0, 1, 1)]}


def test_checks_raise_when_read(spark):
    from quillmark.operators import summaries as Y

    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert Y.checked_counts(df, "k", {"a": 2, "b": 1}).count() == 2
    with pytest.raises(Exception, match="partition has changed"):
        Y.checked_counts(df, "k", {"a": 2, "b": 2}).collect()
    one, two = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string"), spark.createDataFrame([(1, "z")], "id int, b string")
    with pytest.raises(Exception, match="a source lacks"):
        Y.joined_sources({"one": one, "two": two}, "id").collect()
    levels = spark.createDataFrame([("m", "L1", 2, 0.5), ("m", "L2", 2, 1.0)], "model string, level string, n_pages int, s double")
    good, bad = (spark.createDataFrame([("m", 4, x)], "model string, n_total int, s double") for x in (0.75, 0.7))
    assert Y.reconstructed(levels, good, ["s"]).first().n_total == 4
    with pytest.raises(Exception, match="do not add up"):
        Y.reconstructed(levels, bad, ["s"]).collect()
    a, b = spark.createDataFrame([("t", 1, 2, 3)], "type string, tp int, pred int, gt int"), spark.createDataFrame([("t", 1, 2, 4)], "type string, tp int, pred int, gt int")
    with pytest.raises(Exception, match="relation types"):
        Y.paired_types(a, b).collect()


def test_hubs_of_a_graph(spark, monkeypatch):
    from quillmark.operators import lineage

    monkeypatch.setattr(lineage, "HUB", 20)
    monkeypatch.setattr(lineage, "HUBS", 2)
    edges = [(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(10)] + [(150, 400), (400, 401)]
    got = {r.node: r.root for r in lineage.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(1, 200), 400, 401]} | {i: 300 for i in range(301, 311)}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, 3), ("n", None, None)], "model string, score double, n int")
    assert [tuple(r) for r in Z.report_columns(df, ["model", "score", "n"]).collect()] == [("m", "0.5000", "3"), ("n", "NA", "NA")]
    Z.write_report(df, str(tmp_path / "r"), ["model", "score"])
    Z.write_jsonl(df, str(tmp_path / "j"))
    Z.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert Z.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 4
    assert {r.model: r.score for r in Z.read_report(spark, str(tmp_path / "r")).collect()} == {"m": "0.5000", "n": "NA"}
    (tmp_path / "twice.csv").write_text("model,x\na,1\nb,2\na,3\n")
    assert {r.model: r.x for r in Z.read_report(spark, str(tmp_path / "twice.csv")).collect()} == {"a": "3", "b": "2"}
    rows = [{"model": "a_b", "x": 0.25}, {"model": "c", "x": None}]
    assert "| a_b | 0.2500 |" in Z.markdown(rows, ["model", "x"]) and r"a\_b & 0.2500 \\" in Z.latex(rows, ["model", "x"])
    (tmp_path / "c.yaml").write_text("models:\n  - name: a\n    aliases: [x]\n  - name: b\n    enabled: false\n")
    models = Z.load_config(str(tmp_path / "c.yaml"))["models"]
    assert [m["name"] for m in Z.chosen_models(models)] == ["a"] and [m["name"] for m in Z.chosen_models(models, ["x", "b"])] == ["a", "b"]
    with pytest.raises(KeyError):
        Z.chosen_models(models, ["zz"])
    record = Z.chat_records(df, F.lit("ask"), F.col("model"), "model").first().value
    assert json.loads(record)["messages"] == [{"role": "user", "content": "ask"}, {"role": "assistant", "content": "m"}]


def test_hashing_is_seeded(spark):
    import hashlib

    r = spark.range(50).select(unit("s", F.col("id").cast("string")).alias("u"), chosen(0.3, "s", F.col("id").cast("string")).alias("c"), chosen(0.6, "s", F.col("id").cast("string")).alias("d")).collect()
    for i, x in enumerate(r):
        want = int.from_bytes(hashlib.sha256(f"s|{i}".encode()).digest()[:8], "big")
        assert int(x.u) == want and x.c == (want < int(0.3 * 2**64)) and (x.d or not x.c)


def test_box_columns(spark):
    b = lambda *v: B.box(*[F.lit(float(x)) for x in v])
    r = spark.range(1).select(B.iou(b(0, 0, 2, 2), b(1, 0, 3, 2)).alias("i"), B.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)).alias("z"), B.repaired(b(2, 3, 1, 0)).alias("r"), B.strict(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit("pixel"), F.lit(10.0), F.lit(10.0))["status"].alias("s")).first()
    assert r.i == pytest.approx(1 / 3) and r.z == 0 and tuple(r.r) == (1, 0, 2, 3) and r.s == "malformed"


def test_text_columns(spark):
    df = spark.createDataFrame([("  A   b\n",), ("1, 000 x",), ("",)], "t string")
    assert [r[0] for r in df.select(T.value_token(F.col("t"))).collect()] == ["a b", "1000 x", ""]
    assert [r[0] for r in df.select(T.char_shingles(F.col("t"))).collect()][2] == []
    assert spark.createDataFrame([("a b c",)], "t string").select(T.word_shingles(F.col("t"), 2)).first()[0] == ["a b", "b c"]
    assert spark.createDataFrame([("<think>x</think>```json\n{\"a\":1,}\n```",)], "t string").select(T.without_trailing_commas(T.strip_fences(F.col("t")))).first()[0] == '{"a":1}'


def test_quotas():
    q = Q.quotas({"L1": 5, "L2": 5}, {"a": 0.7, "b": 0.3}, {"a": 7, "b": 3})
    assert q == {("L1", "a"): 4, ("L1", "b"): 1, ("L2", "a"): 3, ("L2", "b"): 2}


def test_levels_and_merging(spark):
    assert [r[0] for r in spark.createDataFrame([("0",), ("L3",), ("9",), ("x",)], "v string").select(R.parsed_level(F.col("v"))).collect()] == ["L1", "L3", "L4", None]
    a, b = spark.createDataFrame([("m", 1)], "model string, x int"), spark.createDataFrame([("m", 2)], "model string, y int")
    assert tuple(R.merged([a, b]).first()) == ("m", 1, 2)
    with pytest.raises(Exception, match="no row for"):
        R.merged([a, b.withColumn("model", F.lit("n"))]).collect()


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in U.components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and got[101] == 100


def test_perturbations_keep_what_they_must(spark):
    leaves = spark.createDataFrame([(p, f"f{i}", f"v{i}") for p in ("a", "b") for i in range(9)], "page string, path string, value string")
    out = P.swapped_pairs(leaves, "page", "path", "value", 0.6, 3)
    before, after = ({k: sorted(r.value for r in d.collect() if r.page == k) for k in "ab"} for d in (leaves, out))
    assert before == after and out.exceptAll(leaves).count() > 0
    b = lambda *v: B.box(*[F.lit(float(x)) for x in v])
    moved = spark.range(1).select(P.shifted_region(b(0, 0, 1, 1), F.array(b(0.5, 0, 1.5, 1), b(0, 0.5, 1, 1.5))).alias("m")).first().m
    overlap = lambda p, q: max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
    for o in ((0, 0, 1, 1), (0.5, 0, 1.5, 1), (0, 0.5, 1, 1.5)):
        i = overlap(tuple(moved), o)
        assert i / (2 - i) < 0.5
    r = spark.range(1).select(P.wrong_relation(F.lit("s"), F.lit("t"), F.lit("x"), ["x", "y"], F.lit(False)).alias("a"), P.wrong_relation(F.lit("s"), F.lit("t"), F.lit("x"), ["x", "y"], F.lit(True)).alias("b")).first()
    assert tuple(r.a) == ("s", "t", "y") and tuple(r.b) == ("t", "s", "x")


def test_bootstrap_of_one_cluster(spark):
    from quillmark.operators import summaries

    df = spark.createDataFrame([("m", "t", 1.2, 2), ("n", "a", 0.0, 1), ("n", "b", 3.0, 3)], "model string, t string, total double, weight int")
    got = {r.model: r for r in summaries.resampled(df, ["model"], "t", "total", "weight", 200).collect()}
    assert got["m"].low == got["m"].high == pytest.approx(0.6) and got["n"].estimate == 0.75 and got["n"].low == 0.0 and got["n"].high == 1.0


def test_streaming_ingestion(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    line = lambda m, s, t, when: json.dumps({"model": m, "sample_id": s, "raw_text": t, "written_at": when})
    (source / "1.json").write_text(line("m", "a", "old", "2024-01-01T00:00:00Z") + "\n" + line("m", "b", "x", "2024-01-01T00:00:00Z") + "\n")
    for k in (2, 3):
        q = ingest.run(ingest.stream(spark, str(source)), table, str(tmp_path / "check"))
        q.awaitTermination(60)
        (source / f"{k}.json").write_text(line("m", "a", "new", "2024-01-02T00:00:00Z") + "\n")
    assert {r.sample_id: r.raw_text for r in ingest.latest(spark, table).collect()} == {"a": "new", "b": "x"}
    assert spark.read.parquet(table).count() == 3  # each batch wrote its own lines only
    (source / "4.json").write_text(line("m", "c", "more", "2024-01-03T00:00:00Z") + "\n")
    ingest.run(ingest.stream(spark, str(source)), table, str(tmp_path / "another")).awaitTermination(60)  # reads all again
    assert {r.sample_id: r.raw_text for r in ingest.latest(spark, table).collect()} == {"a": "new", "b": "x", "c": "more"}
    ingest.compacted(spark, table, str(tmp_path / "small"))
    assert ingest.latest(spark, str(tmp_path / "small")).count() == 3


def test_vector_search_in_blocks(spark, monkeypatch):
    import numpy as np

    from quillmark.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 5)
    x = np.random.default_rng(5).normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0]), (302, [None] * 8), (303, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in vectors.cosine_top(df, F.col("id") % 20 == 0, 3, "vec_id", "embedding").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    y = np.concatenate([x, np.zeros((1, 8))])
    ids = np.array([*range(200), 303])
    unit = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    for q in range(0, 200, 20):
        s = (unit[q] @ unit.T).round(6)
        assert got[q] == [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:3]
    near = {r.query_id: (r.n_within, r.nearest) for r in vectors.hamming_neighbours(df, F.col("id") % 20 == 0, 2, "vec_id", "embedding").collect()}
    bits = y > 0
    for q in range(0, 200, 20):
        d = (bits[q] != bits).sum(axis=1)[ids != q]
        assert near[q] == ((d <= 2).sum(), d.min())


def test_reduced_pages_score_like_whole_ones(spark, tmp_path):
    """Pages of odd texts: the classes of ``damaged_units`` are few, stand for every page, and give what the SQL finds page by page."""
    from oracle import rows_of_spark, rows_of_sql

    from quillmark.plans import summaries as M

    copy = tmp_path / "sf"
    for name in ("nation", "region", "customer", "orders", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "customer":  # names and segments that damage turns into each other, or leaves as they are
            df = df.withColumns({"c_name": F.when(F.col("c_custkey") % 3 == 0, "O").when(F.col("c_custkey") % 3 == 1, "x 1").otherwise(F.col("c_name")), "c_mktsegment": F.when(F.col("c_custkey") % 2 == 0, "B").otherwise("K 6")})
        df.write.parquet(str(copy / f"{name}.parquet"))
    pages = spark.read.parquet(str(copy / "lineitem.parquet")).select("l_orderkey").distinct().count()
    units = M.damaged_units(spark, str(copy)).groupBy("error").agg(F.sum("n").alias("pages"), F.count("*").alias("classes")).collect()
    assert {r.error: r.pages for r in units} == dict.fromkeys(("value", "widget", "region", "grid", "relation"), 2 * pages)
    sql = M.SQL["perturbation_response"]
    for name in ("nation", "region", "customer", "orders", "lineitem"):
        sql = sql.replace(f"FROM {name} ", f"FROM read_parquet('{copy}/{name}.parquet/*.parquet') {name} ").replace(f"JOIN {name} ", f"JOIN read_parquet('{copy}/{name}.parquet/*.parquet') {name} ")
        sql = sql.replace(f"FROM {name})", f"FROM read_parquet('{copy}/{name}.parquet/*.parquet') {name})")
    assert rows_of_spark(M.perturbation_response(spark, str(copy))) == rows_of_sql(sql, str(copy / "none"))


def test_sources_of_a_run_are_derived_once(spark, monkeypatch):
    from quillmark.plans import summaries as M

    asked = []
    real = M.page_metrics
    monkeypatch.setattr(M, "page_metrics", lambda spark, d, only=None: asked.append(only) or real(spark, d, only))
    plan = M.run_sources(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert asked == [("m1",)] and "MapInArrow" not in plan


def test_interval_derives_its_pages_once(spark, monkeypatch):
    from quillmark.plans import summaries as M

    asked = []
    real = M.page_metrics
    monkeypatch.setattr(M, "page_metrics", lambda spark, d, only=None: asked.append(only) or real(spark, d, only))
    plan = M.wasserstein_interval(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert asked == [("m1", "m2")] and "MapInArrow" not in plan


def test_selectivity_scores_every_metric_before_and_after(spark, monkeypatch):
    """A metric that is not 1 on clean pages is seen under every error, on every page, before and after; it once was taken to be 1 wherever it wasn't the target."""
    from quillmark.plans import summaries as M

    seen, real, score = [], M.Y.selectivity, M.G.set_f1
    monkeypatch.setattr(M.G, "set_f1", lambda a, b: score(a, b) / 2)
    monkeypatch.setattr(M.Y, "selectivity", lambda rows, *a: seen.append(rows) or real(rows, *a))
    M.selectivity(spark, "/root/testdata/sf0.001")
    pages = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    got = {(r.error, r.metric): r for r in seen[0].groupBy("error", "metric").agg(F.sum("n").alias("n"), F.min("clean").alias("low"), F.max("clean").alias("high"), F.min("corrupted").alias("least"), F.max("corrupted").alias("most")).collect()}
    assert set(got) == {(e, m) for e in M.TARGETS for m in M.METRICS} and {r.n for r in got.values()} == {2 * pages}
    for (error, metric), r in got.items():
        clean = 0.5 if metric == "rel_f1" else 1.0
        assert (r.low, r.high, r.most) == (clean, clean, clean)
        assert (r.least < clean) == (metric in M.TARGETS[error] + M.EXPECTED.get(error, []))
