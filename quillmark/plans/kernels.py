"""Queries: per-page kernels and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.hashing import chosen, code
from quillmark.operators import pages as P
from quillmark.operators import perturb as T
from quillmark.plans.predictions import values
from quillmark.sources import derived as X
from quillmark.sources.derived import _u


def _with_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_items(spark, sf_dir).crossJoin(F.broadcast(X.models(spark)))


def value_ned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the answers, each behind a hash of its path, so that a value is nearest to its own damaged form; a hit one has a letter more."""
    held = _with_models(spark, sf_dir)
    leaf = lambda path, v: F.struct(path.alias("path"), F.concat(F.substring(F.sha2(path, 256), 1, 16), F.lit(":"), v).alias("v"))
    one = [leaf(F.lit(p), F.col(c)) for p, c in (("order/status", "o_orderstatus"), ("order/priority", "o_orderpriority"), ("customer/name", "c_name"), ("customer/segment", "c_mktsegment"))]
    leaves = F.concat(F.array(*one), F.transform("items", lambda x, i: leaf(F.concat(F.lit("items/"), i.cast("string"), F.lit("/flag")), x["l_returnflag"])))
    each = held.select("model", "sample_id", "severity", code("page", F.col("model"), F.col("sample_id")).alias("fate"), "missing", "bad", leaves.alias("leaves"))
    hit = lambda path: chosen(F.col("severity"), F.col("model"), F.col("sample_id"), path)
    said = F.to_json(F.map_from_entries(F.transform("leaves", lambda x: F.struct(x["path"], F.when(hit(x["path"]), F.concat(x["v"], F.lit("~"))).otherwise(x["v"])))))
    raw = F.when(F.col("fate") < F.col("missing"), None).when(F.col("fate") < F.col("bad"), "{").otherwise(said)
    pages = each.select("model", "sample_id", F.to_json(F.map_from_entries("leaves")).alias("t"), raw.alias("r"))
    return P.value_similarity(pages, "t", "r").groupBy("model").agg(F.count("*").alias("n_pages"), F.round(F.avg("value_ned"), 6).alias("value_ned"))


VALUE_SQL = f"""{X.PAGE_METRICS_SQL}, s AS (SELECT model, sample_id, avg(CASE WHEN s = ps THEN 1 ELSE 1 - 1 / (18.0::DOUBLE + length(s)) END) AS x FROM both_leaves WHERE s IS NOT NULL GROUP BY ALL)
SELECT f.model, count(*) AS n_pages, round(avg(CASE WHEN status = 'ok' THEN x ELSE 0 END), 6) AS value_ned FROM fate f JOIN s ON f.model = s.model AND f.sample_id = s.sample_id GROUP BY f.model"""


def schema_nted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of answers whose last item is lost by hash."""
    held = _with_models(spark, sf_dir)
    lost = chosen(F.col("severity"), "shape", F.col("model"), F.col("sample_id")) & (F.size("items") > 0)
    both = held.select("model", "sample_id", F.to_json(X.answer()).alias("t"), lost.alias("lost"), "items", *[c for c in held.columns if c.startswith(("o_", "c_"))])
    cut = both.withColumn("items", F.when(F.col("lost"), F.slice("items", F.lit(1), F.greatest(F.size("items") - 1, F.lit(0)))).otherwise(F.col("items"))).withColumn("r", F.to_json(X.answer()))
    return P.shape_similarity(cut.select("model", "sample_id", "t", "r"), "t", "r").groupBy("model").agg(F.count("*").alias("n_pages"), F.round(F.avg("schema_nted"), 6).alias("schema_nted"))


SHAPE_SQL = f"""WITH {X.INDEX_SQL}, {X.MODELS_SQL}, n AS (SELECT sample_id, count(l_orderkey) AS n FROM pg LEFT JOIN it ON l_orderkey = o_orderkey GROUP BY 1),
s AS (SELECT model, CASE WHEN n > 0 AND {_u("'shape|' || model || '|' || sample_id")} < severity THEN 1 - 4 / (2.0 * (10 + 4 * n) - 4) ELSE 1.0 END AS s FROM n CROSS JOIN mo)
SELECT model, count(*) AS n_pages, round(avg(s), 6) AS schema_nted FROM s GROUP BY model"""


def grits_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of an item a row and three columns; a damaged row is predicted as one wide cell."""
    cell = lambda r, c, w: F.struct(r.cast("int").alias("r"), F.lit(c).alias("c"), F.lit(1).alias("h"), F.lit(w).alias("w"))
    row = lambda i: F.array(*[cell(i, c, 1) for c in range(3)])
    bad = lambda i: chosen(F.col("severity"), "grid", F.col("model"), F.col("sample_id"), i.cast("string"))
    g = _with_models(spark, sf_dir).select("model", "sample_id", F.flatten(F.transform("items", lambda x, i: row(i))).alias("t"), F.flatten(F.transform("items", lambda x, i: F.when(bad(i), F.array(cell(i, 0, 3))).otherwise(row(i)))).alias("p"))
    return P.grid_similarity(g, "t", "p").groupBy("model").agg(F.count("grits_top").alias("n_pages"), F.round(F.avg("grits_top"), 6).alias("grits_top"))


GRID_SQL = f"""WITH {X.INDEX_SQL}, {X.MODELS_SQL}, c AS (SELECT model, sample_id, count(*) AS n, count(*) FILTER ({_u("'grid|' || model || '|' || sample_id || '|' || k")} < severity) AS bad FROM it JOIN pg ON l_orderkey = o_orderkey CROSS JOIN mo GROUP BY ALL)
SELECT model, count(*) AS n_pages, round(avg(1 - 2.0 * bad / (3 * n)), 6) AS grits_top FROM c GROUP BY model"""


def widget_group_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group of boxes a page, one an item; a hit box has the opposite state."""
    on = lambda x: F.when(x["l_returnflag"] == "A", "selected").otherwise("unselected")
    at = lambda i: F.array(F.lit(10.0), i * 20.0, F.lit(20.0), i * 20.0 + 10)
    member = lambda i, s: F.struct(F.lit("checkbox").alias("type"), s.alias("state"), at(i).alias("bbox"))
    off = lambda i: chosen(F.col("severity"), "widget", F.col("model"), F.col("sample_id"), i.cast("string"))
    group = lambda m: F.when(F.size("items") > 0, F.array(F.struct(F.lit("choice").alias("type"), m.alias("members"))))
    w = _with_models(spark, sf_dir).select("model", "sample_id", group(F.transform("items", lambda x, i: member(i, on(x)))).alias("t"), group(F.transform("items", lambda x, i: member(i, F.when(off(i), T.flipped_state(on(x))).otherwise(on(x))))).alias("p"))
    f = F.when(F.col("wg_truth") + F.col("wg_predicted") > 0, 2 * F.col("wg_total") / (F.col("wg_truth") + F.col("wg_predicted")))
    return P.widget_group_similarity(w, "t", "p").groupBy("model").agg(F.count(f).alias("n_pages"), F.round(F.avg(f), 6).alias("wg_f1"))


WIDGET_SQL = f"""WITH {X.INDEX_SQL}, {X.MODELS_SQL}, c AS (SELECT model, sample_id, avg(({_u("'widget|' || model || '|' || sample_id || '|' || k")} >= severity)::INT) AS f FROM it JOIN pg ON l_orderkey = o_orderkey CROSS JOIN mo GROUP BY ALL)
SELECT model, count(*) AS n_pages, round(avg(f), 6) AS wg_f1 FROM c GROUP BY model"""


def greedy_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four labelled values a page against four fields; a hit label is unrecognisable."""
    fields = [("order/status", "Order Status", "o_orderstatus"), ("order/priority", "Order: Priority", "o_orderpriority"), ("customer/name", "Customer_Name", "c_name"), ("customer/segment", "Customer Segment", "c_mktsegment")]
    held = X.pages(spark, sf_dir).crossJoin(F.broadcast(X.models(spark)))
    bad = lambda p: chosen(F.col("severity"), "label", F.col("model"), F.col("sample_id"), p)
    none = F.lit(None).cast("array<double>")
    c = F.array(*[F.struct(F.when(bad(p), "qqqq").otherwise(F.lower(F.lit(n))).alias("label"), F.col(v).alias("value"), none.alias("bbox")) for p, n, v in fields])
    f = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(n).alias("label"), none.alias("bbox")) for p, n, _ in fields])
    a = P.greedy_alignment(held.select("model", "sample_id", c.alias("c"), f.alias("f"), "o_orderstatus"), "c", "f")
    return a.groupBy("model").agg(F.count("*").alias("n_pages"), F.sum(F.size("aligned")).alias("n_aligned"), F.sum(F.size("unaligned")).alias("n_unaligned"), F.count_if(F.col("aligned")["order/status"] == F.col("o_orderstatus")).alias("n_status"))


ALIGN_SQL = f"""WITH {X.INDEX_SQL}, {X.MODELS_SQL}, f(p) AS (VALUES ('order/status'), ('order/priority'), ('customer/name'), ('customer/segment')),
h AS (SELECT model, sample_id, p, {_u("'label|' || model || '|' || sample_id || '|' || p")} >= severity AS ok FROM pg CROSS JOIN mo CROSS JOIN f)
SELECT model, count(DISTINCT sample_id) AS n_pages, count(*) FILTER (ok) AS n_aligned, count(*) FILTER (NOT ok) AS n_unaligned, count(*) FILTER (ok AND p = 'order/status') AS n_status FROM h GROUP BY model"""
RESPONSES = [
    ('{"a": 1}', True, None, '{"a":1}'),
    ('<think>{"no": 0}</think>```json\n{"a": [1, 2,], }\n```', True, None, '{"a":[1,2]}'),
    ('Here: {"a": "}{", "b": {"c": null}} and more', True, None, '{"a":"}{","b":{"c":null}}'),
    ('[{"a": 1}]', False, "not_an_object", None),
    ('{"a": 1', False, "invalid_json", None),
    ("nothing", False, "no_json", None),
    ("", False, "no_json", None),
    ('<THINK>x</THINK>a <think> {"a": {"b": "\\\\\\"}"}} ]', True, None, '{"a":{"b":"\\\\\\"}"}}'),
    ('[1, {"a": ]} , 2] {}', False, "invalid_json", None),
]


def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed responses, and all conversation texts as one line of counts."""
    own = P.responses(spark.createDataFrame([(str(i), r[0]) for i, r in enumerate(RESPONSES)], "id string, text string"), "text").select("id", "ok", "error", "json", F.lit(1).cast("long").alias("n"))
    rest = P.responses(X.table(spark, sf_dir, "conversations").select("text"), "text").groupBy("ok", "error").agg(F.count("*").alias("n"))
    return own.unionByName(rest.select(F.lit("conversations").alias("id"), "ok", "error", F.lit(None).cast("string").alias("json"), "n"))


TABLES = ["<table><tr><th>A</th><th>B &amp; C</th><th> </th></tr><tr><td>1<br>2</td><td> x  y </td></tr><tr><td></td></tr></table>", "<table><tr><td>open<td>- cell</table><p>in</p>", "<p>none</p>", "<td># free</td></tr><tr><td>next</td>"]
#: Empty cells and rows are left out, a break is a line, marks of headings and lists go, an unclosed cell goes on to the end.
TABLE_CELLS = [(0, 0, 0, "A"), (0, 0, 1, "B & C"), (0, 1, 0, "1\n2"), (0, 1, 1, "x y"), (1, 0, 0, "open"), (1, 0, 1, "cellin"), (3, 0, 0, "free"), (3, 1, 0, "next")]


def html_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of fixed tables, and of all pages (which hold none)."""
    own = P.table_cells(spark.createDataFrame(list(enumerate(TABLES)), "id int, html string"), "html")
    return own.unionByName(P.table_cells(X.table(spark, sf_dir, "pages").select(F.col("page_id").cast("int").alias("id"), "html"), "html"))


OCR = "\n".join(["title[[10, 20, 300, 60]]", "# Order  &amp; form", "", "text[[10,80,200,110]]", "", "Name: x", "plain", "text[[1,2,3,4]]", "table[[5,6,7,8]]", "after", "sub_title[[1,2,x,4]]", "- list", "text[[1,2,3,9]]", "list", "<|det|>image [1, 2, 3, 4]<|/det|> in line", "text[[9,9,9,9]]"])
#: A mark takes the next line that isn't empty, even if it is a mark; a mark without four numbers gives no region; equal lines are listed once.
OCR_ROWS = [("title", 10.0, 20.0, 300.0, 60.0, "Order  & form"), ("field", 10.0, 80.0, 200.0, 110.0, "Name: x"), ("text", 1.0, 2.0, 3.0, 9.0, "list"), ("text", 1.0, 2.0, 3.0, 4.0, "in line")]


def ocr_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ocr_regions(spark.createDataFrame([(OCR,)], "text string"), "text")


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of OCR output in order; what is left of grounded texts."""
    lines = P.ocr_pages(spark.createDataFrame([(OCR,)], "t string"), "t").select(F.array_join("lines", "|").alias("text"))
    return lines.union(P.ungrounded(spark.createDataFrame([(t,) for t in GROUNDED], "t string"), "t").select("plain"))


GROUNDED = ["a<|ref|> # One <|/ref|><|det|>[[1,2,3,4]]<|/det|><|ref|>Two<|/ref|>", "x <|det|>1\n2<|/det|>y<|ref|> ", None]
LINE_TEXTS = ["Order  & form|Name: x|plain|after|list|in line", "One\nTwo", "x y", ""]

PIPELINE = """{"pages": [{"res": {"parsing_res_list": [
  {"block_content": "# Title", "block_label": "doc_title", "block_bbox": [0, 0, 10, 2], "block_id": 7},
  {"content": "<table><tr><td>a</td><td>b</td></tr></table>", "label": "table", "bbox": [0, 10, 10, 2]},
  {"content": "Sum: 3\\nSum: 3", "poly": [0, 20, 10, 20, 10, 30, 0, 30]}, "odd", {"content": "lost"}],
  "layout_det_res": {"boxes": [{"coordinate": [0, 0, 10, 2], "label": "DOC_TITLE"}, {"coordinate": [[1, 1], [2, 5]], "label": "seal"}, {"coordinate": [1]}]}}}, 5]}"""


def pipeline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, lines and table rows of a layout pipeline's pages; a text that isn't JSON has none."""
    p = P.pipeline_pages(spark.createDataFrame([("page", PIPELINE), ("broken", "{"), ("null", None)], "page string, t string"), "t")
    regions = F.array_join(F.transform("regions", lambda r: F.concat_ws(" ", r["id"], r["kind"], r["label"], F.array_join(F.transform(r["box"], lambda v: v.cast("int").cast("string")), ","))), "|")
    return p.select("page", regions.alias("regions"), F.array_join("lines", "|").alias("lines"), F.array_join("cells", "|").alias("cells"), F.array_join("rows", "/").alias("rows"))


PIPELINE_ROWS = [("page", "7 title doc_title 0,0,10,2|r2 table table 0,2,10,10|r3 field text 0,20,10,30|det1_2 seal seal 1,1,2,5", "Title|a | b|Sum: 3|lost", "a|b", "a | b"), ("broken", "", "", "", ""), ("null", "", "", "", "")]


QUERIES = {f.__name__: f for f in (value_ned, schema_nted, grits_top, widget_group_f1, greedy_align, response_parse, html_table_text, ocr_markdown, ocr_lines, pipeline_pages)}
SQL = {
    "value_ned": VALUE_SQL,
    "schema_nted": SHAPE_SQL,
    "grits_top": GRID_SQL,
    "widget_group_f1": WIDGET_SQL,
    "greedy_align": ALIGN_SQL,
    "response_parse": values([(str(i), ok, e, j, 1) for i, (_, ok, e, j) in enumerate(RESPONSES)], "id, ok, error, json, n") + " UNION ALL SELECT 'conversations', false, 'no_json', NULL, count(*) FROM conversations",
    "html_table_text": values(TABLE_CELLS, 'id, "row", "col", "text"'),
    "ocr_lines": values([(t,) for t in LINE_TEXTS], "text"),
    "pipeline_pages": values(PIPELINE_ROWS, "page, regions, lines, cells, rows"),
    "ocr_markdown": values(OCR_ROWS, "kind, x1, y1, x2, y2, content"),
}
