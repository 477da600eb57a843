"""Seeded, engine-independent selection: the same text is chosen wherever SHA-256 is available."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = 1 << 64


def code(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, joined by '|'. As text it sorts like the number."""
    return F.substring(F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256), 1, 16)


def unit(*parts: Column | str) -> Column:
    """The same as DECIMAL(20,0)."""
    return F.conv(code(*parts), 16, 10).cast("decimal(20,0)")


def bound(severity: float) -> int:
    return int(severity * WHOLE)


def mark(number: int) -> str:
    """A bound as text to compare codes with; past the last one it is above all of them."""
    return f"{number:016x}" if number < WHOLE else "g"


def chosen(severity: float | Column, *parts: Column | str) -> Column:
    """Whether the uniform number of the parts is below ``severity``, a share or a column of marks. Texts are compared, which spares a conversion for each."""
    return code(*parts) < (severity if isinstance(severity, Column) else F.lit(mark(bound(severity))))
