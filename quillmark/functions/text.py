"""Text normalisation as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(x: Column) -> Column:
    """Trimmed, with every run of white space (Unicode) made one blank."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")


def value_token(x: Column) -> Column:
    """Comparison form of a value's text: lower case, collapsed, no blanks or commas between digits. Compatibility forms are folded before, in ``leaves``."""
    return F.regexp_replace(collapse(F.lower(x)), r"(?U)(?<=\d)[\s,]+(?=\d)", "")


def strip_fences(x: Column) -> Column:
    """Without think blocks; the inside of the first fenced block, if there is one."""
    bare = F.regexp_replace(x, r"(?is)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?s)```[A-Za-z0-9_-]*\s*\n?(.*?)```", 1)
    return F.regexp_replace(F.when(F.length(fenced) > 0, fenced).otherwise(bare), r"^\s+|\s+$", "")


def without_trailing_commas(x: Column) -> Column:
    return F.regexp_replace(x, r",\s*([}\]])", "$1")


def let(value: Column, then) -> Column:
    """then(value), with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def char_shingles(x: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; the text itself if it is shorter, none if it is empty."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: t.substr(i, F.lit(n)))
    return F.when(F.length(x) >= n, F.array_distinct(let(x, runs))).when(F.length(x) > 0, F.array(x)).otherwise(F.array().cast("array<string>"))


def words(x: Column) -> Column:
    """What lies between ASCII white space."""
    return F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_shingles(x: Column, n: int = 5) -> Column:
    """Distinct runs of n words, joined by one blank; all words if there are fewer."""

    def runs(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(some)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(words(x), runs)


def signature(parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of an array's texts, one a line."""
    return F.substring(F.sha2(F.array_join(parts, "\n"), 256), 1, 16)


def dedup_form(x: Column) -> Column:
    """Lower case with digits as #, letters and # only, collapsed: what near copies of a form have in common."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(x), r"[0-9]", "#"), r"(?U)[^\p{L}#]+", " "))


def holds_all(text: Column, values: Column) -> Column:
    """Whether a sidecar text has every value, as it is or with its HTML characters escaped."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.forall(values, lambda v: text.contains(v) | text.contains(escaped(v)))
