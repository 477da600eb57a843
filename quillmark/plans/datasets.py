"""Queries: profiles, duplicates, distributions, classification and release of datasets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.hashing import chosen
from quillmark.operators import distributions as Q
from quillmark.operators import duplicates as U
from quillmark.operators import vectors as V
from quillmark.operators.semantic import leaf_rows
from quillmark.plans.rollups import FEATURE_SQL, difficulty, template_features
from quillmark.sources import derived as X
from quillmark.sources.derived import _u

docs = lambda spark, d: X.table(spark, d, "documents")

# --- profiles --------------------------------------------------------------------------------------


def answer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = X.answers(spark, sf_dir)
    leaves = leaf_rows(index, "sample_id", "answer_json").withColumn("template_name", F.substring_index("sample_id", "__", 1))
    text = F.when(F.col("kind") == "string", F.length("value"))
    return leaves.groupBy("template_name").agg(
        F.count("*").alias("n_leaves"), F.count_distinct("sample_id").alias("n_answers"), F.round(F.avg((F.col("kind") == "number").cast("int")), 6).alias("numeric_share"),
        F.max(F.size("path")).cast("long").alias("max_depth"), F.count_distinct(F.array_join("path", "/")).alias("n_paths"), F.round(F.avg(text), 6).alias("mean_chars"),
    )


ANSWER_SQL = f"""WITH {X.INDEX_SQL} SELECT template_name, count(*) AS n_leaves, count(DISTINCT sample_id) AS n_answers, round(avg((v IS NOT NULL)::INT), 6) AS numeric_share,
max(len(string_split(path, '/'))) AS max_depth, count(DISTINCT path) AS n_paths, round(avg(length(s)), 6) AS mean_chars FROM leaf GROUP BY 1"""


def template_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pages(spark, sf_dir)
    counts = p.groupBy("template_name", "o_orderpriority").agg(F.count("*").alias("n"))
    spread = p.groupBy("template_name").agg(F.count("*").alias("n_pages"), F.count_distinct("o_orderpriority").alias("n_values"), F.round(F.stddev_pop("o_totalprice") / F.abs(F.avg("o_totalprice")), 6).alias("variation"))
    modes = U.first_seen_mode(p, ["template_name"], "o_orderpriority", "o_orderkey")
    return spread.join(Q.entropy(counts, ["template_name"]), "template_name").join(modes, "template_name").withColumns({"entropy": F.round("entropy", 6), "modal_share": F.round("modal_share", 6)})


DIVERSITY_SQL = f"""WITH {X.INDEX_SQL}, c AS (SELECT template_name, o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS seen FROM pg GROUP BY ALL),
e AS (SELECT template_name, -sum(p * log2(p)) AS entropy FROM (SELECT template_name, n / sum(n) OVER (PARTITION BY template_name) AS p FROM c) GROUP BY 1),
m AS (SELECT template_name, v AS mode, n / sum(n) OVER (PARTITION BY template_name) AS modal_share FROM c QUALIFY row_number() OVER (PARTITION BY template_name ORDER BY n DESC, seen) = 1)
SELECT template_name, count(*) AS n_pages, count(DISTINCT o_orderpriority) AS n_values, round(stddev_pop(o_totalprice) / abs(avg(o_totalprice)), 6) AS variation, round(any_value(entropy), 6) AS entropy, any_value(mode) AS mode, round(any_value(modal_share), 6) AS modal_share
FROM pg JOIN e USING (template_name) JOIN m USING (template_name) GROUP BY template_name"""


def modal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents in another language than the commonest, and much longer or shorter than the median."""
    d = docs(spark, sf_dir).select("doc_id", "source", "lang", "n_chars")
    mode = U.first_seen_mode(d, ["source"], "lang", "doc_id")
    mid = d.groupBy("source").agg(F.percentile("n_chars", 0.5).alias("median"))
    t = d.join(mode.select("source", "mode"), "source").join(mid, "source")
    return t.groupBy("source", "mode").agg(F.count("*").alias("n"), F.count_if(F.col("lang") != F.col("mode")).alias("n_other_lang"), F.count_if(F.col("n_chars") > 1.5 * F.col("median")).alias("n_long"), F.count_if(F.col("n_chars") < 0.5 * F.col("median")).alias("n_short"))


MODAL_SQL = """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY ALL), m AS (SELECT source, lang AS mode FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) = 1),
h AS (SELECT source, quantile_cont(n_chars, 0.5) AS median FROM documents GROUP BY 1)
SELECT source, mode, count(*) AS n, count(*) FILTER (lang <> mode) AS n_other_lang, count(*) FILTER (n_chars > 1.5 * median) AS n_long, count(*) FILTER (n_chars < 0.5 * median) AS n_short FROM documents JOIN m USING (source) JOIN h USING (source) GROUP BY ALL"""


def value_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with a seeded share altered at equal length: letters by 13, digits by 5."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    turn = letters[13:] + letters[:13]
    c = X.table(spark, sf_dir, "customer")
    hit = chosen(0.3, "7", "value", F.col("c_custkey").cast("string"))
    changed = F.translate("c_name", letters + letters.upper() + "0123456789", turn + turn.upper() + "5678901234")
    return c.select("c_custkey", hit.alias("chosen"), F.when(hit, changed).otherwise(F.col("c_name")).alias("c_name"))


CORRUPT_SQL = f"""WITH h AS (SELECT *, {_u("'7|value|' || c_custkey")} < {int(0.3 * 2**64)}::HUGEINT AS chosen FROM customer)
SELECT c_custkey, chosen, CASE WHEN chosen THEN translate(c_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM5678901234') ELSE c_name END AS c_name FROM h"""

# --- duplicates and neighbours ---------------------------------------------------------------------


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.exact_clusters(docs(spark, sf_dir), "doc_id", "text")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of five-word shingle similarity 0.8 within its source, and its text's links."""
    return U.classes(docs(spark, sf_dir), "doc_id", "source", "text")


_SETS = """w AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT source, text, min(doc_id) AS id, any_value(w) AS w FROM w GROUP BY source, text),
s AS (SELECT source, text, id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
x AS (SELECT source, id, unnest(s) AS g FROM s),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS nb FROM x a JOIN x b ON a.source = b.source AND a.g = b.g AND a.id < b.id GROUP BY ALL),
e AS (SELECT o.a, o.b FROM o JOIN s sa ON sa.id = o.a JOIN s sb ON sb.id = o.b WHERE nb / (len(sa.s) + len(sb.s) - nb) >= 0.8)"""
NEAR_SQL = f"""WITH RECURSIVE {_SETS},
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, root) AS (SELECT id, id FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY id), d AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT w.doc_id, c.class_id, coalesce(d.n, 0)::BIGINT AS n_links FROM w JOIN t ON w.source = t.source AND w.text = t.text JOIN c ON c.id = t.id LEFT JOIN d ON d.id = t.id"""


def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies with over one member: size, distinct sources are one by construction, first and last id."""
    return near_duplicates(spark, sf_dir).groupBy("class_id").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"), F.max("n_links").alias("most_links")).where("n > 1")


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign codes of every twentieth vector against all rows."""
    return V.hamming_neighbours(X.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 16, "vec_id", "embedding")


HAMMING_SQL = """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
p AS (SELECT a.vec_id AS query_id, len(list_filter(list_zip(a.s, b.s), lambda z: z[1] <> z[2])) AS d FROM s a JOIN s b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, count(*) FILTER (d <= 16) AS n_within, min(d) AS nearest FROM p GROUP BY 1"""


def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cosine_top(X.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 5, "vec_id", "embedding")


COSINE_SQL = """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS rank, vec_id, cosine FROM p QUALIFY rank <= 5"""


def overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item's eight-word runs."""
    return U.overlap_pairs(docs(spark, sf_dir), X.table(spark, sf_dir, "benchmark"), "doc_id", "item_id").withColumn("share", F.round("share", 6))


_GRAMS = "list_distinct(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
OVERLAP_SQL = f"""WITH d AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)),
i AS (SELECT item_id, {_GRAMS} AS gs FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark)),
u AS (SELECT item_id, unnest(gs) AS g FROM i), c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN u USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, round(n_shared / len(gs), 6) AS share FROM c JOIN i USING (item_id) WHERE n_shared / len(gs) >= 0.5"""

# --- distributions ---------------------------------------------------------------------------------


def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.jensen_shannon(docs(spark, sf_dir).select("source", "lang"), "source", "lang").withColumn("js", F.round("js", 6))


JS_SQL = """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), a AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1),
g AS (SELECT s.source, a.lang, coalesce(c.n, 0) AS n, a.total FROM (SELECT DISTINCT source FROM c) s CROSS JOIN a LEFT JOIN c ON c.source = s.source AND c.lang = a.lang),
p AS (SELECT source, n / sum(n) OVER w + 1e-12 AS p, total / sum(total) OVER w + 1e-12 AS q FROM g WINDOW w AS (PARTITION BY source)),
z AS (SELECT source, p / sum(p) OVER (PARTITION BY source) AS p, q / sum(q) OVER (PARTITION BY source) AS q FROM p)
SELECT source, round(greatest(0, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2), 6) AS js FROM z GROUP BY 1"""


def wasserstein_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of good against other labelled documents, by language."""
    labels = X.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = docs(spark, sf_dir).select("doc_id", "lang", "n_chars").join(labels, "doc_id")
    return Q.wasserstein(d, ["lang"], "n_chars", F.col("quality") == 1).select("lang", F.round("distance", 4).alias("distance"), F.round("normalised", 6).alias("normalised"))


WASSERSTEIN_SQL = """WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1), d AS (SELECT lang, n_chars::DOUBLE AS x, quality = 1 AS good FROM documents JOIN l USING (doc_id)),
c AS (SELECT lang, x, count(*) FILTER (good) AS a, count(*) FILTER (NOT good) AS b FROM d GROUP BY ALL),
s AS (SELECT lang, lead(x) OVER o - x AS gap, sum(a) OVER o / nullif(sum(a) OVER p, 0) AS fa, sum(b) OVER o / nullif(sum(b) OVER p, 0) AS fb FROM c WINDOW p AS (PARTITION BY lang), o AS (PARTITION BY lang ORDER BY x)),
q AS (SELECT lang, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS span FROM d WHERE good GROUP BY 1)
SELECT lang, round(sum(abs(fa - fb) * gap), 4) AS distance, round(sum(abs(fa - fb) * gap) / (any_value(span) + 1e-12), 6) AS normalised FROM s JOIN q USING (lang) GROUP BY lang"""
GOWER = ["n_pages", "n_items", "n_parts", "n_open"]


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = template_features(spark, sf_dir).select(F.col("template_name").alias("id"), *GOWER)
    ranges = f.agg(*[(F.max(c) - F.min(c)).alias(f"{c}_range") for c in GOWER])
    return Q.gower(f, f, GOWER, ranges)


def gower_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each template's nearest other one."""
    return _distances(spark, sf_dir).groupBy(F.col("l").alias("template_name")).agg(F.min_by("r", F.struct(F.round("distance", 9), "r")).alias("nearest"), F.round(F.min("distance"), 6).alias("distance"))


def coverage_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference: templates of even number; how many others are as near to one as 95 % of the reference are to each other."""
    even = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int") % 2 == 0
    near = _distances(spark, sf_dir).where(even("r")).groupBy("l", even("l").alias("reference")).agg(F.min("distance").alias("d"))
    tau = near.where("reference").agg(F.percentile("d", 0.95).alias("tau"))
    return near.where("not reference").crossJoin(F.broadcast(tau)).groupBy(F.round("tau", 6).alias("tau")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("d") <= F.col("tau")).cast("int")), 6).alias("coverage"))


_GOWER_SQL = f"""{FEATURE_SQL}, rg AS (SELECT {", ".join(f"max({c}) - min({c}) AS {c}_r" for c in GOWER)} FROM fx),
gd AS (SELECT a.template_name AS l, b.template_name AS r, ({" + ".join(f"least(1.0, abs(a.{c} - b.{c}) / {c}_r)" for c in GOWER)}) / {len(GOWER)} AS d FROM fx a CROSS JOIN fx b CROSS JOIN rg WHERE a.template_name <> b.template_name)"""


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.kappa(X.table(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


KAPPA_SQL = """WITH c AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels)
SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM c"""
#: Classes of documents by their keywords.
RULES = [("licence", ["license", "all rights reserved"]), ("contact", ["@", "example.com", "+1 ("]), ("secret", ["token =", "password", "key ="]), ("table", [" | "]), ("noise", ["%%%", "###", "&&&"])]


def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source", Q.keyword_class(F.col("text"), RULES).alias("domain")).agg(F.count("*").alias("n"))


def _rule_sql(words: list[str]) -> str:
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


DOMAIN_SQL = f"""WITH h AS (SELECT source, lower(coalesce(text, '')) AS t FROM documents), k AS (SELECT source, {", ".join(f"{_rule_sql(w)} AS h{i}" for i, (_, w) in enumerate(RULES))} FROM h),
b AS (SELECT *, greatest({", ".join(f"h{i}" for i in range(len(RULES)))}) AS best FROM k)
SELECT source, CASE WHEN best = 0 THEN 'other' {" ".join(f"WHEN h{i} = best THEN '{n}'" for i, (n, _) in enumerate(RULES))} END AS domain, count(*) AS n FROM b GROUP BY ALL"""
SPLITS = {"train": 0.7, "validation": 0.15, "test": 0.15}


def split_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates dealt to splits by level: quotas keep both margins; within a level, by hash of the name."""
    leveled = difficulty(spark, sf_dir).select("template_name", "level")
    sizes = {r["level"]: r["count"] for r in leveled.groupBy("level").count().orderBy("level").collect()}
    total = sum(sizes.values())
    train, validation = int(np.floor(total * SPLITS["train"])), int(np.floor(total * SPLITS["validation"]))
    cells = Q.quotas(sizes, SPLITS, {"train": train, "validation": validation, "test": total - train - validation})
    order = Window.partitionBy("level").orderBy(F.sha2(F.concat(F.lit("42|"), "template_name"), 256))
    bounds, rows = {}, []
    for (level, split), n in cells.items():
        rows.append((level, split, bounds.get(level, 0), bounds.get(level, 0) + n))
        bounds[level] = bounds.get(level, 0) + n
    table = spark.createDataFrame(rows, "level string, split string, low int, high int")
    dealt = leveled.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(table), "level").where("place >= low and place < high")
    return dealt.groupBy("split", "level").agg(F.count("*").alias("n"), F.min("template_name").alias("first_template"))


#: DuckDB: quotas as a list, level by level, to which one is added at a time where row and column have room.
SPLIT_SQL = f"""{FEATURE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, ns AS (SELECT list(level ORDER BY level) AS ls, list(n ORDER BY level) AS ns, sum(n) AS t FROM (SELECT level, count(*) AS n FROM df GROUP BY level)),
st AS (SELECT ls, ns, [floor(t * 0.7::DOUBLE), floor(t * 0.15::DOUBLE), t - floor(t * 0.7::DOUBLE) - floor(t * 0.15::DOUBLE)] AS cs, list_transform(range(1, 3 * len(ns) + 1), lambda k: ns[(k - 1) // 3 + 1] * ([0.7, 0.15, 0.15]::DOUBLE[])[(k - 1) % 3 + 1]) AS raw FROM ns),
qs AS (SELECT ls, ns, cs, raw, list_transform(raw, lambda x: floor(x)::INT) AS q, 0 AS step FROM st
  UNION ALL SELECT ls, ns, cs, raw, list_transform(range(1, len(q) + 1), lambda k: q[k] + (k = pick)::INT), step + 1 FROM (
    SELECT *, CASE WHEN list_max(sc) > -99 THEN list_position(sc, list_max(sc)) END AS pick FROM (
      SELECT *, list_transform(range(1, len(q) + 1), lambda k: CASE WHEN ns[(k - 1) // 3 + 1] > list_sum(q[(k - 1) // 3 * 3 + 1:(k - 1) // 3 * 3 + 3])
        AND cs[(k - 1) % 3 + 1] > list_sum(list_transform(range(0, len(ns)), lambda l: q[l * 3 + (k - 1) % 3 + 1])) THEN raw[k] - q[k] ELSE -99 END) AS sc FROM qs)) WHERE pick IS NOT NULL),
fq AS (SELECT * FROM qs ORDER BY step DESC LIMIT 1),
bd AS (SELECT ls[(k - 1) // 3 + 1] AS level, ['train', 'validation', 'test'][(k - 1) % 3 + 1] AS split, coalesce(list_sum(q[(k - 1) // 3 * 3 + 1:k - 1]), 0) AS low, list_sum(q[(k - 1) // 3 * 3 + 1:k]) AS high FROM (SELECT *, unnest(range(1, len(q) + 1)) AS k FROM fq)),
pl AS (SELECT template_name, level, row_number() OVER (PARTITION BY level ORDER BY sha256('42|' || template_name)) - 1 AS place FROM df)
SELECT split, pl.level, count(*) AS n, min(template_name) AS first_template FROM pl JOIN bd ON pl.level = bd.level AND place >= low AND place < high GROUP BY ALL"""


def region_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share and cumulative share of parts by size, with a row for every size from 1 to the largest."""
    n = X.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    every = n.agg(F.max("size").alias("m")).select(F.explode(F.sequence(F.lit(1), "m")).alias("size"))
    whole, upto = Window.partitionBy(), Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    full = every.join(n, "size", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.select("size", "n", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("probability"), F.round(F.sum("n").over(upto) / F.sum("n").over(whole), 6).alias("cumulative"))


CDF_SQL = """WITH n AS (SELECT p_size AS size, count(*) AS n FROM part GROUP BY 1), e AS (SELECT unnest(range(1, (SELECT max(size) FROM n) + 1))::INT AS size), f AS (SELECT e.size, coalesce(n.n, 0) AS n FROM e LEFT JOIN n USING (size))
SELECT size, n, round(n / sum(n) OVER (), 6) AS probability, round(sum(n) OVER (ORDER BY size) / sum(n) OVER (), 6) AS cumulative FROM f"""


def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one record: its turns in order, their number and length, and a digest of the record."""
    c = X.table(spark, sf_dir, "conversations")
    rec = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    line = F.array_join(F.transform("m", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return rec.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda t: t["role"]), ",").alias("roles"), F.length(line).cast("long").alias("n_chars"), F.md5(line).alias("digest"))


SFT_SQL = """WITH r AS (SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn, role, text) AS roles, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS line FROM conversations GROUP BY 1)
SELECT conv_id, n_messages, roles, length(line) AS n_chars, md5(line) AS digest FROM r"""

QUERIES = {f.__name__: f for f in (answer_profile, template_diversity, modal_tags, value_corruption, exact_duplicates, near_duplicates, dup_components, hamming_pairs, embedding_cosine_topk, overlap_candidates, js_divergence, wasserstein_norm, gower_nn, coverage_tau, cohen_kappa, domain_classify, split_composition, region_cdf, sft_messages)}
SQL = {
    "split_composition": SPLIT_SQL,
    "answer_profile": ANSWER_SQL,
    "template_diversity": DIVERSITY_SQL,
    "modal_tags": MODAL_SQL,
    "value_corruption": CORRUPT_SQL,
    "exact_duplicates": "SELECT sha256(coalesce(text, '')) AS hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "near_duplicates": NEAR_SQL,
    "dup_components": f"SELECT class_id, count(*) AS n, max(doc_id) AS last_id, max(n_links) AS most_links FROM ({NEAR_SQL}) GROUP BY 1 HAVING count(*) > 1",
    "hamming_pairs": HAMMING_SQL,
    "embedding_cosine_topk": COSINE_SQL,
    "overlap_candidates": OVERLAP_SQL,
    "js_divergence": JS_SQL,
    "wasserstein_norm": WASSERSTEIN_SQL,
    "gower_nn": f"{_GOWER_SQL} SELECT l AS template_name, arg_min(r, (round(d, 9), r)) AS nearest, round(min(d), 6) AS distance FROM gd GROUP BY 1",
    "coverage_tau": f"""{_GOWER_SQL}, nr AS (SELECT l, regexp_extract(l, '(\\d+)$', 1)::INT % 2 = 0 AS ref, min(d) AS d FROM gd WHERE regexp_extract(r, '(\\d+)$', 1)::INT % 2 = 0 GROUP BY ALL), ta AS (SELECT quantile_cont(d, 0.95) AS tau FROM nr WHERE ref)
        SELECT round(tau, 6) AS tau, count(*) AS n, round(avg((d <= tau)::INT), 6) AS coverage FROM nr CROSS JOIN ta WHERE NOT ref GROUP BY tau""",
    "cohen_kappa": KAPPA_SQL,
    "domain_classify": DOMAIN_SQL,
    "region_cdf": CDF_SQL,
    "sft_messages": SFT_SQL,
}
