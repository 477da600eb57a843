"""Scores of predicted answers against true ones, page by page.

The states of a metric: a number; null where the truth has nothing to score (not applicable, left out of
means); 0 for a missing or invalid prediction on a page where it applies. A page and its prediction meet
in one join; everything per page is computed inside the row, so no leaf is ever shuffled.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import documents as D

COUNTS = ("n_gt", "n_equal", "v_hits", "v_total", "w_equal", "w_total")


def paired(index: DataFrame, models: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every page of every model, with its prediction or null.

    A page's predictions are put together first (one a model), so its truth is shuffled once and its models stay neighbours.
    """
    said = predictions.groupBy("sample_id").agg(F.collect_list(F.struct("model", "raw_text")).alias("__said"))
    every = index.join(said, "sample_id", "left").crossJoin(F.broadcast(models.select("model")))
    own = F.filter("__said", lambda s: s["model"] == F.col("model"))
    return every.withColumn("raw_text", F.get(own, F.lit(0))["raw_text"]).drop("__said")


@lru_cache(256)
def _gold(truth: str | None, widgets: frozenset) -> tuple:
    """A page's truth, read once for the models that follow one another."""
    try:
        whole = D.tidy(D.unwrapped(json.loads(truth)))
    except (TypeError, ValueError):  # a truth that is missing or no JSON has nothing to score
        whole = {}
    gold = D.leaves(whole)
    tokens = Counter(t for t in map(D.token, gold.values()) if t)
    chosen = [p for p in gold if p in widgets]
    return whole, gold, tokens, chosen, (len(gold), 0, 0, sum(tokens.values()), 0, len(chosen))


def page_counts(truth: str | None, raw: str | None, widgets: frozenset = frozenset()) -> tuple:
    """(status, exact, *COUNTS) of one page."""
    whole, gold, tokens, chosen, base = _gold(truth, widgets)
    if raw is None:
        return "missing_prediction", False, *base
    try:
        value = json.loads(raw)
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return "invalid_json", False, *base
    answer = D.tidy(D.unwrapped(value))
    said = D.leaves(answer)
    # A missing path counts as null, so a null in the truth matches it; 1, 1.0 and true are equal.
    equal = sum(said.get(p) == v for p, v in gold.items())
    mine = Counter(map(D.token, said.values()))
    hits = sum(min(n, mine[t]) for t, n in tokens.items() if t in mine)
    exact = equal == len(gold) == len(said) and D.canonical(answer) == D.canonical(whole)
    return "ok", exact, len(gold), equal, hits, base[3], sum(said.get(p) == gold[p] for p in chosen), len(chosen)


def score(pages: DataFrame, truth: str = "answer_json", raw: str = "raw_text", keys: tuple[str, ...] = ("model", "sample_id", "template_name"), widgets: frozenset = frozenset()) -> DataFrame:
    """keys, status, exact and COUNTS of each page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", status string, exact boolean, " + ", ".join(f"{c} long" for c in COUNTS)
    names, n = [*keys, "status", "exact", *COUNTS], len(keys)

    def run(batches):
        for b in batches:
            rows = [page_counts(t, r, widgets) for t, r in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (2 + len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=names)

    return pages.select(*keys, truth, raw).mapInArrow(run, schema)


def ratio(hits: str, total: str) -> Column:
    """Share of what there is; null if there is nothing."""
    return F.when(F.col(total) > 0, F.col(hits) / F.col(total))


def with_metrics(scored: DataFrame) -> DataFrame:
    """tsr_path, vacc, wacc, page_em and valid from the counts."""
    return scored.withColumns({"valid": F.col("status") == "ok", "tsr_path": ratio("n_equal", "n_gt"), "vacc": ratio("v_hits", "v_total"), "wacc": ratio("w_equal", "w_total"), "page_em": F.col("exact").cast("double")})


def weighted(weights: dict[str, float]) -> Column:
    """Mean of the metrics that apply, by weight; null if none does."""
    total = sum((F.when(F.col(m).isNotNull(), F.lit(w)).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in weights.items()), F.lit(0.0)) / total)


def leaf_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path array<string>, kind, value, token): one row for each leaf of the JSON texts; texts that aren't JSON have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, text in zip(ids, b.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    continue
                for path, v in D.leaves(D.tidy(value)).items():
                    name = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
                    out.append((i, list(path), name, None if v is None else v if isinstance(v, str) else json.dumps(v), D.token(v)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.list_(pa.string())), *(pa.array(c, pa.string()) for c in cols[2:])], names=["key", "path", "kind", "value", "token"])

    return df.select(key, column).mapInArrow(run, f"key {kind}, path array<string>, kind string, value string, token string").withColumnRenamed("key", key)
