"""Seeded damage of a known kind and amount, to see which metrics answer to it.

A unit (leaf, widget, row, region, relation) is hit if the hash of (seed, error, page, unit) falls below the
severity, so a larger severity hits a superset. Counts of eligible units are kept beside the injected ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.boxes import box, iou
from quillmark.functions.hashing import chosen
from quillmark.functions.text import let

#: The opposite of a widget's state.
FLIPPED = {"selected": "unselected", "unselected": "selected", "filled": "blank", "blank": "filled"}


def hit(severity: float, seed: int, error: str, page: Column, unit: Column) -> Column:
    return chosen(severity, str(seed), error, page, unit)


LOW = "abcdefghijklmnopqrstuvwxyz"
TURNED = LOW[13:] + LOW[:13]
PLAIN, OTHER = LOW + LOW.upper() + "0123456789", TURNED + TURNED.upper() + "5678901234"
#: The same alteration for Python's ``translate``.
ALTERED = str.maketrans(PLAIN, OTHER)


def altered_text(x: Column) -> Column:
    """Other text of equal length: letters turned by 13, digits by 5, anything else kept."""
    return F.translate(x, PLAIN, OTHER)


def flipped_state(x: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(x == kv[0], kv[1]), list(FLIPPED.items())[1:], F.when(x == list(FLIPPED)[0], list(FLIPPED.values())[0])).otherwise(x)


def shifted_region(own: Column, others: Column, steps: int = 4, least: float = 0.5) -> Column:
    """The box moved by the smallest of (2 * steps + 1)**2 offsets of its own size after which it overlaps no other by ``least``; unmoved if there is none.

    Offsets are tried ring by ring, so the near ones, which mostly do, are all that is looked at.
    """

    def tried(b: Column) -> Column:
        wide, high = b["x2"] - b["x1"], b["y2"] - b["y1"]
        moved = lambda i, j: box(b["x1"] + i * 0.6 * wide, b["y1"] + j * 0.6 * high, b["x2"] + i * 0.6 * wide, b["y2"] + j * 0.6 * high)
        free = lambda m: ~F.exists(others, lambda o: iou(m, o) >= least) & (iou(m, b) < least)
        rings = [[(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if abs(i) + abs(j) == far] for far in range(1, 2 * steps + 1)]
        first = lambda ring: F.get(F.filter(F.array(*[moved(i, j) for i, j in ring]), free), F.lit(0))
        return F.coalesce(*map(first, rings), b)

    return let(own, tried)


def reshaped_grid(cells: Column) -> Column:
    """All cells in one column if the grid is at least as wide as high, in one row else, and the other way round if that is how they stand; null if there is no other shape."""
    extent = lambda at, size: F.array_max(F.transform(cells, lambda c: c[at] + c[size]))
    place = lambda r, c, h, w: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), h.cast("int").alias("h"), w.cast("int").alias("w"))
    now = F.transform(cells, lambda c: place(c["r"], c["c"], c["h"], c["w"]))
    column = F.transform(cells, lambda _, i: place(i, F.lit(0), F.lit(1), F.lit(1)))
    row = F.transform(cells, lambda _, i: place(F.lit(0), i, F.lit(1), F.lit(1)))
    wide = extent("c", "w") >= extent("r", "h")
    first, second = F.when(wide, column).otherwise(row), F.when(wide, row).otherwise(column)
    return F.when(F.size(cells) > 1, F.when(first != now, first).when(second != now, second))


def wrong_relation(source: Column, target: Column, kind: Column, kinds: list[str], reverse: Column) -> Column:
    """struct(source, target, type): turned around, or given the next type."""
    after = reduce(lambda acc, i: acc.when(kind == kinds[i], kinds[(i + 1) % len(kinds)]), range(1, len(kinds)), F.when(kind == kinds[0], kinds[1 % len(kinds)])).otherwise(kinds[0])
    return F.when(reverse, F.struct(target.alias("source"), source.alias("target"), kind.alias("type"))).otherwise(F.struct(source.alias("source"), target.alias("target"), after.alias("type")))


def swapped_pairs(leaves: DataFrame, page: str, path: str, value: str, severity: float, seed: int) -> DataFrame:
    """Leaves with the values of hit ones passed on to the next hit leaf of their page, in hash order, so the page keeps its multiset of values."""
    from pyspark.sql import Window

    marked = leaves.withColumn("__hit", hit(severity, seed, "hierarchy", F.col(page), F.col(path)))
    order = Window.partitionBy(page, "__hit").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), page, path), 256), path)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.coalesce(F.lag(value).over(order), F.last(value).over(whole))
    return marked.withColumn(value, F.when(F.col("__hit"), moved).otherwise(F.col(value))).drop("__hit")


def curves(rows: DataFrame, by: list[str], template: str = "template_name", pages: str | None = None) -> DataFrame:
    """by, drop in percentage points (mean of template means), injected share of eligible units. Rows hold clean, corrupted, eligible, injected, and in ``pages`` how many pages they stand for; pages without units are left out."""
    n = F.col(pages) if pages else F.lit(1)
    apart = (F.col("clean") - F.col("corrupted")) * 100
    some = rows.where("eligible > 0")
    means = some.groupBy(*by, template).agg((F.sum(apart * n) / F.sum(F.when(apart.isNotNull(), n))).alias("d"), F.sum(F.col("injected") * n).alias("i"), F.sum(F.col("eligible") * n).alias("e"), F.sum(n).alias("n"))
    return means.groupBy(*by).agg(F.sum("n").alias("n_pages"), F.avg("d").alias("drop"), (F.sum("i") / F.sum("e")).alias("injected_share"))
