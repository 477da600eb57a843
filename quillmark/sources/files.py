"""Sources and sinks: page folders, JSON lines, CSV reports, configuration and rendered tables."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators.lineage import cut

INDEX = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "template_name", "instance_id", "image_path", "label_path")])
#: Order of degradation levels.
LEVEL_ORDER = {"low": 0, "medium": 1, "high": 2}


def sample_id(template: Column, instance: Column) -> Column:
    return F.concat_ws("__", template, instance)


def scan_pages(spark: SparkSession, root: str, templates: list[str] | None = None) -> DataFrame:
    """Index of ``root/template/instance/*``: a row for each folder with one JSON label; an image only if it is the only one. Lists files, reads none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path"))
    parts = F.split("path", "/")
    f = files.select("path", F.element_at(parts, -3).alias("template_name"), F.element_at(parts, -2).alias("instance_id"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("kind"))
    if templates:
        f = f.where(F.col("template_name").isin(templates))
    one = lambda kind: F.when(F.count_if(kind) == 1, F.max(F.when(kind, F.col("path"))))
    pages = f.groupBy("template_name", "instance_id").agg(one(F.col("kind").isin("png", "jpg", "jpeg")).alias("image_path"), one(F.col("kind") == "json").alias("label_path"))
    return pages.where("label_path is not null").select(sample_id(F.col("template_name"), F.col("instance_id")).alias("sample_id"), "template_name", "instance_id", "image_path", "label_path")


def select_pages(index: DataFrame, templates: list[str] | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """Pages of these templates; with a limit, those whose seeded hash is smallest."""
    kept = index.where(F.col("template_name").isin(templates)) if templates else index
    return kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), "sample_id"), 256)).limit(limit) if limit is not None else kept


def shard(index: DataFrame, shards: int, number: int, key: str = "sample_id") -> DataFrame:
    """One of ``shards`` disjoint parts, the same whatever else is in the index."""
    return index.where(F.pmod(F.xxhash64(key), F.lit(shards)) == number)


def degraded_index(paths: DataFrame, clean: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(index, reasons): ``split/variant/level/template/instance`` paths paired with their clean page, and counts of those left out by reason."""
    p = F.split(path, "/")
    at = lambda i: F.element_at(p, i)
    parsed = paths.select(F.col(path), F.size(p).alias("depth"), *[F.when(F.size(p) >= 5, at(i)).alias(n) for i, n in zip(range(-5, 0), ("split", "degradation_variant", "degradation_level", "template_name", "instance_id"), strict=True)])
    parsed = parsed.withColumn("clean_sample_id", sample_id(F.col("template_name"), F.col("instance_id")))
    known = clean.select(F.col("sample_id").alias("clean_sample_id"), F.lit(True).alias("known"))
    joined = parsed.join(known, "clean_sample_id", "left")
    reason = F.when(F.col("depth") < 5, "short_path").when(~F.col("degradation_level").isin(*LEVEL_ORDER), "unknown_level").when(F.col("known").isNull(), "no_clean_page")
    marked = joined.withColumn("reason", reason)
    order = reduce(lambda c, kv: c.when(F.col("degradation_level") == kv[0], kv[1]), list(LEVEL_ORDER.items())[1:], F.when(F.col("degradation_level") == "low", 0))
    index = marked.where("reason is null").select(F.concat_ws("__", "clean_sample_id", F.lit("deg"), "degradation_variant", "degradation_level").alias("sample_id"), "clean_sample_id", "split", "degradation_variant", "degradation_level", order.alias("level_no"))
    return index, marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def summary_of(meta: Column, keys: list[str]) -> Column:
    """The listed keys of a JSON object, as a map."""
    return F.map_filter(F.from_json(meta, "map<string,string>"), lambda k, v: k.isin(keys))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a line that isn't an object of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole JSON files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_report(spark: SparkSession, path: str, key: str = "model") -> DataFrame:
    """A CSV report by key; of rows with one key the last in the file stays."""
    rows = spark.read.option("header", "true").csv(path).withColumn("__n", F.monotonically_increasing_id())
    last = Window.partitionBy(key).orderBy(F.desc("__n"))
    return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__n", "__r")


def report_columns(df: DataFrame, columns: list[str], digits: int = 4, missing: str = "NA") -> DataFrame:
    """Fixed columns as text: numbers with ``digits`` decimals, NA for null."""
    real = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))) if c in real else F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns])


def write_report(df: DataFrame, path: str, columns: list[str], digits: int = 4) -> None:
    report_columns(df, columns, digits).write.mode("overwrite").option("header", "true").csv(path)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a few collected rows."""
    cell = lambda v: "NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", r"\|")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line([cell(r.get(c)) for c in columns]) for r in rows)])


def latex(rows: list[dict], columns: list[str]) -> str:
    special = {c: "\\" + c for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    text = lambda v: "".join(special.get(c, c) for c in ("--" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)))
    body = [" & ".join(text(r.get(c)) for c in columns) + r" \\" for r in rows]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", " & ".join(map(text, columns)) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])


def load_config(path: str) -> dict:
    """A YAML or JSON file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if os.path.splitext(path)[1] == ".json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def chosen_models(config: list[dict], asked: list[str] | None = None) -> list[dict]:
    """Enabled models, or those asked for by name or alias; an unknown one raises."""
    by_name = {n: m for m in config for n in (m["name"], *m.get("aliases", ()))}
    if asked:
        if unknown := [a for a in asked if a not in by_name]:
            raise KeyError(f"unknown models: {', '.join(unknown)}")
        return list({by_name[a]["name"]: by_name[a] for a in asked}.values())
    return [m for m in config if m.get("enabled", True)]


def resolved_spaces(manifest: DataFrame) -> DataFrame:
    """(run, source_space): runs without a space of their own take that of the run they inherit from; a cycle or an open end gives null.

    Pointers are doubled, so as many rounds as the count of runs has bits reach the end of any chain.
    """
    now = manifest.select("run", "source_space", F.col("inherits").alias("next"))
    for _ in range(manifest.count().bit_length()):
        above = now.select(F.col("run").alias("next"), F.col("source_space").alias("s2"), F.col("next").alias("n2"))
        open_end = F.col("source_space").isNull() & F.col("s2").isNull()
        now = cut(now.join(above, "next", "left").select("run", F.coalesce("source_space", "s2").alias("source_space"), F.when(open_end, F.col("n2")).alias("next")))
    return now.select("run", "source_space")


def layouts(spark: SparkSession, folder: str) -> DataFrame:
    """(template_name, layout): the JSON texts of a folder with one file a template."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("template_name"), F.col("value").alias("layout"))


def attempted(*parts: DataFrame, key: str = "sample_id") -> DataFrame:
    """Distinct ids over several sources of attempts."""
    return reduce(DataFrame.union, [p.select(key) for p in parts]).where(F.col(key).isNotNull()).distinct()


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def merged_results(old: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """New rows, and old ones of keys that have none."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def chat_records(pages: DataFrame, prompt: Column, answer: Column, key: str = "sample_id") -> DataFrame:
    """(value): one JSON text for each page, with a user and an assistant message."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return pages.select(F.to_json(F.struct(F.col(key).alias("id"), F.array(say("user", prompt), say("assistant", answer)).alias("messages"))).alias("value"))
