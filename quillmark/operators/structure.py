"""Scores of predicted layout: regions, line-item groups, cell topology and typed relations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import kernels as K
from quillmark.functions.boxes import f1, iou
from quillmark.functions.structures import COMPATIBLE
from quillmark.functions.text import let


def overlaps(truth: str, predicted: str, least: float, typed: bool = True) -> Column:
    """array<struct<i, j, s>>: predicted region i and true region j whose categories fit and whose boxes overlap by s, at least ``least``."""
    fits = lambda p, g: reduce(lambda a, b: a | b, [(p["kind"] == k) & g["kind"].isin(*kinds) for k, kinds in COMPATIBLE.items() if kinds]) if typed else F.lit(True)
    edge = lambda p, i, g, j: F.when(fits(p, g), let(iou(p["box"], g["box"]), lambda s: F.when(s >= least, F.struct(i.alias("i"), j.alias("j"), s.alias("s")))))
    each = F.transform(predicted, lambda p, i: F.transform(truth, lambda g, j: edge(p, i, g, j)))
    return F.coalesce(F.filter(F.flatten(each), lambda e: e.isNotNull()), F.array().cast("array<struct<i:int,j:int,s:double>>"))


def region_matches(df: DataFrame, truth: str, predicted: str, thresholds: tuple[float, ...] = (0.5, 0.75), keys: tuple[str, ...] = ("model", "sample_id"), typed: bool = True) -> DataFrame:
    """keys, n_pred, n_gt and tp_<threshold in hundredths>: largest matchings of compatible regions whose boxes overlap enough.

    Both columns hold array<struct<kind, box struct<x1, y1, x2, y2>>>; a predicted region without a box still counts as predicted.
    Overlaps are computed in the plan and only their numbers go to Python, where pages without a choice are counted and the others matched.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*keys, "n_pred", "n_gt", *[f"tp_{round(100 * t)}" for t in thresholds]]
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ", ".join(f"{c} long" for c in names[len(keys) :])
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")

    def matched(rows: int, row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Size of the largest matching of each row's edges."""
        out = np.bincount(row, minlength=rows)
        for side in (i, j):
            pair = row.astype(np.int64) << 32 | side
            _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
            for r in np.unique(row[times[back] > 1]).tolist():
                at = np.flatnonzero(row == r)
                own: dict[int, list[int]] = {}
                for x, y in zip(i[at].tolist(), j[at].tolist(), strict=True):
                    own.setdefault(x, []).append(y)
                out[r] = K.matching_size(list(own.values()))
        return out

    def run(batches):
        n = len(keys)
        for b in batches:
            edges = b.column(n + 2)
            row = np.repeat(np.arange(len(edges)), np.diff(edges.offsets.to_numpy()))
            flat = edges.flatten()
            i, j, s = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            found = [matched(len(edges), row[s >= t], i[s >= t], j[s >= t]) for t in thresholds]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n + 2)), *(pa.array(f, pa.int64()) for f in found)], names=names)

    return df.select(*keys, size(predicted).alias("n_pred"), size(truth).alias("n_gt"), overlaps(truth, predicted, min(thresholds), typed).alias("edges")).mapInArrow(run, schema)


def deduplicated(regions: Column, kind: str = "region", other: str = "section", least: float = 0.9) -> Column:
    """Regions of one kind go where they nearly coincide with one of the other kind."""
    return F.filter(regions, lambda r: ~((r["kind"] == kind) & F.exists(regions, lambda s: (s["kind"] == other) & (iou(r["box"], s["box"]) >= least))))


def union_box(boxes: Column) -> Column:
    """Smallest box around all; null if there is none."""
    side = lambda n, pick: pick(F.transform(boxes, lambda b: b[n]))
    around = F.struct(side("x1", F.array_min).alias("x1"), side("y1", F.array_min).alias("y1"), side("x2", F.array_max).alias("x2"), side("y2", F.array_max).alias("y2"))
    return F.when(F.size(boxes) > 0, around)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets; null if both are empty."""
    return f1(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), None)


def typed_edges(truth: DataFrame, predicted: DataFrame, endpoints: DataFrame, symmetric: tuple[str, ...] = ()) -> DataFrame:
    """(type, tp, pred, gt) of edges (source, target, type): predicted endpoints are mapped by ``endpoints`` (predicted, truth).

    Predicted edges count before mapping, so an unmapped one is wrong; edges of a symmetric type have no direction.
    """
    turn = lambda e: e.select(
        F.when(F.col("type").isin(*symmetric) & (F.col("target") < F.col("source")), F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("type").isin(*symmetric) & (F.col("target") < F.col("source")), F.col("source")).otherwise(F.col("target")).alias("target"),
        "type",
    )
    gold, said = turn(truth).distinct(), turn(predicted).distinct()
    left, right = endpoints.select(F.col("predicted").alias("source"), F.col("truth").alias("s")), endpoints.select(F.col("predicted").alias("target"), F.col("truth").alias("t"))
    mapped = turn(said.join(left, "source").join(right, "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "type")).distinct()
    hit = mapped.join(gold, ["source", "target", "type"], "left_semi")
    tagged = [e.groupBy("type").agg(*[(F.count("*") if k == n else F.lit(0).cast("long")).alias(k) for k in ("tp", "pred", "gt")]) for n, e in (("tp", hit), ("pred", said), ("gt", gold))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("type").agg(*[F.sum(k).alias(k) for k in ("tp", "pred", "gt")])


def smallest_parent(children: DataFrame, parents: DataFrame, page: str = "sample_id") -> DataFrame:
    """(page, child, parent): for each child the smallest region of its page that holds its centre. Inputs: page, id, box."""
    c = children.select(page, F.col("id").alias("child"), ((F.col("box.x1") + F.col("box.x2")) / 2).alias("x"), ((F.col("box.y1") + F.col("box.y2")) / 2).alias("y"))
    size = (F.col("box.x2") - F.col("box.x1")) * (F.col("box.y2") - F.col("box.y1"))
    p = parents.select(F.col(page).alias("page"), F.col("id").alias("parent"), "box", size.alias("size"))
    inside = F.col("x").between(F.col("box.x1"), F.col("box.x2")) & F.col("y").between(F.col("box.y1"), F.col("box.y2"))
    return c.join(p, (F.col(page) == F.col("page")) & inside & (F.col("child") != F.col("parent"))).groupBy(page, "child").agg(F.min_by("parent", F.struct("size", "parent")).alias("parent"))
