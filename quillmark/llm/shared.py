"""What the training-data operators share: reading, Arrow helpers, and the lineage cuts and components of the core.

All of it works on any number of rows: nothing here collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import let
from quillmark.operators.lineage import components, cut, shared_folder

__all__ = ["before_each", "components", "cut", "documents", "let", "partitions", "portions", "shared_folder", "sums_before", "tidy"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy() -> None:
    """Gives freed memory of this Python worker back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return


def portions(batches, rows: int = 512):
    """The batches in slices of bounded length; memory goes back after each batch."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))
        tidy()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def before_each(numbers: Column, combine) -> Column:
    """For each element of an int array what ``combine`` makes of 0 and all before it: their sum, or their largest.

    A fold that appends to an array copies it at every step. Here elements are combined in blocks of the cube root of their
    number, blocks before a block and elements before an element each by a short fold: n ** (4 / 3) steps in all.
    """
    total = lambda a: F.aggregate(a, F.lit(0), combine)
    block = lambda i, w: F.floor(i / w).cast("int")

    def blocked(xs: Column, w: Column) -> Column:
        count = F.ceil(F.size(xs) / w).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), count), lambda b: total(F.slice(xs, (b - 1) * w + 1, w)))
        before = lambda blocks: F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        each = lambda firsts: F.transform(xs, lambda _, i: combine(F.get(firsts, block(i, w)), total(F.slice(xs, block(i, w) * w + 1, i % w))))
        return let(let(blocks, before), each)

    some = let(numbers, lambda xs: let(F.ceil(F.cbrt(F.size(xs))).cast("int"), lambda w: F.when(F.size(xs) > 0, blocked(xs, w))))
    return F.coalesce(some, F.array().cast("array<int>"))


def sums_before(numbers: Column) -> Column:
    return before_each(numbers, lambda a, b: a + b)
