"""Preference formatting of chat pairs (operator 8), in DataFrame functions only.

A chosen and a rejected conversation share their longest common prefix of turns (same role and text).
That prefix is rendered once as the prompt, and what follows on each side is a completion with a mask:
the code-point ranges of the completion on which loss is taken, which are the assistant's words and
the end marker after them. Prompts are masked as a whole.

A turn is rendered ``<|im_start|>role\\ntext<|im_end|>\\n``; a marker inside a text is defused by a
space after ``<|``. Null roles count as ``user``, null texts as empty; turns sort by number (null
first), role and text, so ties and repeated rows have one order. A pair with one side missing keeps
its row with the other side whole as completion, an empty prompt and null for the missing side. Equal
sides give two empty completions; if one side is a prefix of the other, its completion is empty.
Further columns of the input are ignored, whatever they are called. One shuffle; a row of the result is one pair, so what a
task gathers is bounded by one pair's own length; very long conversations cost little more than their length. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.shared import let, sums_before

BEGIN, END = "<|im_start|>", "<|im_end|>"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def loss_ranges(turns: Column) -> Column:
    """start:end of each assistant text with its end marker, in code points of the rendered turns, comma-joined."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + (len(BEGIN) + 1 + len(END) + 1)

    def written(own: Column) -> Column:
        first = lambda t, at: at + len(BEGIN) + F.length(t["role"]) + 1
        each = F.zip_with(own, sums_before(F.transform(own, size)), lambda t, at: F.when(t["role"] == "assistant", F.concat_ws(":", first(t, at).cast("string"), (first(t, at) + F.length(t["text"]) + len(END)).cast("string"))))
        return F.array_join(F.filter(each, lambda x: x.isNotNull()), ",")

    return let(turns, written)


def in_order(turn: str, role: str, text: str) -> Column:
    """A turn as it is compared and sorted: null roles are the user's, markers in texts are defused."""
    safe = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("<| "))
    return F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"), safe.alias("text"))


def format_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, chosen_loss, rejected, rejected_loss).

    ``side`` says ``chosen`` or ``rejected``; other rows are no part of any pair.
    """
    one = turns.where(F.col(side).isin("chosen", "rejected")).select(F.col(pair).alias("pair_id"), F.col(side).alias("side"), F.col(conv).alias("conv"), in_order(turn, role, text).alias("t"))
    of = lambda s: F.col("side") == s
    both = one.groupBy("pair_id").agg(
        F.min(F.when(of("chosen"), F.col("conv"))).alias("chosen_id"),
        F.min(F.when(of("rejected"), F.col("conv"))).alias("rejected_id"),
        F.sort_array(F.collect_list(F.when(of("chosen"), F.col("t")))).alias("c"),
        F.sort_array(F.collect_list(F.when(of("rejected"), F.col("t")))).alias("r"),
    )
    return format_sides(both)


def format_sides(both: DataFrame) -> DataFrame:
    """The same from (pair_id, chosen_id, rejected_id, c, r), the sides' turns in order as arrays."""
    equal = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    at = F.array_position(equal, F.lit(False)).cast("int")
    known = both.withColumn("n", F.when(at > 0, at - 1).otherwise(F.size("c")))
    tail = lambda c: F.when(F.size(c) > F.col("n"), F.slice(F.col(c), F.col("n") + 1, F.size(c) - F.col("n"))).otherwise(F.slice(F.col(c), 1, 0))
    parts = known.select("pair_id", "chosen_id", "rejected_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), tail("c").alias("c"), tail("r").alias("r"))
    text_of = lambda c: F.array_join(F.transform(c, rendered), "")
    there = lambda k, x: F.when(F.col(k).isNotNull(), x)
    return parts.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), text_of("p").alias("prompt"),
        there("chosen_id", text_of("c")).alias("chosen"), there("chosen_id", loss_ranges(F.col("c"))).alias("chosen_loss"),
        there("rejected_id", text_of("r")).alias("rejected"), there("rejected_id", loss_ranges(F.col("r"))).alias("rejected_loss"),
    )


def with_answers_swapped(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, chosen_id, rejected_id, c, r): each conversation as chosen, and as rejected the same with its last answer
    replaced by the last answer of its neighbour (2k and 2k + 1 are neighbours).

    Conversations without an answer have no row; where the neighbour has none, the rejected side is missing.
    """
    one = turns.where(F.col(conv).isNotNull()).select(F.floor(F.col(conv) / 2).cast("long").alias("both"), F.pmod(F.col(conv), F.lit(2)).alias("odd"), F.col(conv).alias("conv"), in_order(turn, role, text).alias("t"))
    side = lambda k: (F.min(F.when(F.col("odd") == k, F.col("conv"))).alias(f"id{k}"), F.sort_array(F.collect_list(F.when(F.col("odd") == k, F.col("t")))).alias(f"t{k}"))
    met = one.groupBy("both").agg(*side(0), *side(1))
    last = lambda k: F.array_max(F.transform(f"t{k}", lambda t, i: F.when(t["role"] == "assistant", i)))
    known = met.withColumns({"l0": last(0), "l1": last(1)})

    def pair(a: int, b: int) -> Column:
        """Side a as it is and with b's last answer."""
        own, at = F.col(f"t{a}"), F.col(f"l{a}")
        other = F.when(F.col(f"l{b}").isNotNull(), F.get(F.col(f"t{b}"), F.col(f"l{b}"))["text"])
        swapped = F.transform(own, lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == at, other).otherwise(t["text"]).alias("text")))
        rejected = F.when(other.isNotNull(), swapped).otherwise(F.slice(own, 1, 0))
        return F.when(at.isNotNull(), F.struct(F.col(f"id{a}").alias("pair_id"), F.col(f"id{a}").alias("chosen_id"), F.when(other.isNotNull(), F.col(f"id{b}")).alias("rejected_id"), own.alias("c"), rejected.alias("r")))

    return known.select(F.explode(F.array(pair(0, 1), pair(1, 0))).alias("p")).where("p is not null").select("p.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preference pairs: each conversation is chosen, and rejected with its neighbour's last answer in place of its own."""
    return format_sides(with_answers_swapped(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = r"""
WITH t AS (
  SELECT conv_id, CAST(floor(conv_id / 2) AS BIGINT) AS duo, turn, coalesce(role, 'user') AS role, replace(coalesce(text, ''), '<|', '<| ') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
a AS (SELECT conv_id, duo, max(k) AS last, arg_max(text, k) AS answer FROM u WHERE role = 'assistant' GROUP BY ALL),
i AS (SELECT a.conv_id AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.last, b.answer FROM a LEFT JOIN a AS b ON a.duo = b.duo AND a.conv_id <> b.conv_id),
n AS (
  SELECT pair_id, 0 AS side, k, role, text FROM i JOIN u ON chosen_id = conv_id
  UNION ALL SELECT pair_id, 1, k, role, CASE WHEN k = last THEN answer ELSE text END FROM i JOIN u ON chosen_id = conv_id WHERE rejected_id IS NOT NULL),
x AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (SELECT * FROM n WHERE side = 0) c FULL JOIN (SELECT * FROM n WHERE side = 1) r ON c.pair_id = r.pair_id AND c.k = r.k),
p AS (SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS n FROM x GROUP BY pair_id),
m AS (
  SELECT n.*, p.n AS cut, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM n JOIN p USING (pair_id)),
o AS (
  SELECT *, CAST(coalesce(sum(length(s)) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM m WHERE k > cut),
l AS (
  SELECT *, CAST(before + 12 + length(role) + 1 AS VARCHAR) || ':' || CAST(before + 12 + length(role) + 1 + length(text) + 10 AS VARCHAR) AS range FROM o)
SELECT p.pair_id, i.chosen_id, i.rejected_id, CAST(p.n AS BIGINT) AS n_prompt_turns,
  coalesce((SELECT string_agg(s, '' ORDER BY k) FROM m WHERE m.pair_id = p.pair_id AND side = 0 AND k <= p.n), '') AS prompt,
  CASE WHEN i.chosen_id IS NOT NULL THEN coalesce((SELECT string_agg(s, '' ORDER BY k) FROM l WHERE l.pair_id = p.pair_id AND side = 0), '') END AS chosen,
  CASE WHEN i.chosen_id IS NOT NULL THEN coalesce((SELECT string_agg(range, ',' ORDER BY k) FROM l WHERE l.pair_id = p.pair_id AND side = 0 AND role = 'assistant'), '') END AS chosen_loss,
  CASE WHEN i.rejected_id IS NOT NULL THEN coalesce((SELECT string_agg(s, '' ORDER BY k) FROM l WHERE l.pair_id = p.pair_id AND side = 1), '') END AS rejected,
  CASE WHEN i.rejected_id IS NOT NULL THEN coalesce((SELECT string_agg(range, ',' ORDER BY k) FROM l WHERE l.pair_id = p.pair_id AND side = 1 AND role = 'assistant'), '') END AS rejected_loss
FROM p JOIN i USING (pair_id)
"""
