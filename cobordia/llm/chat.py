"""Preference formatting: pairs of a chosen and a rejected conversation as one prompt and two masked completions.

Native: DataFrame functions only. The longest common prefix of turns (same role and text; null and empty are the same) is rendered once
as the prompt; what follows in either conversation is its completion. A turn is rendered as
``<|role|>\\ntext<|end|>\\n``. The mask of a completion lists the stretches to train on, ``first-end`` in characters,
one for each assistant turn: its text and end mark.

Turns are matched by an equi-join on pair and position, and the prefix is a minimum over mismatches, so nothing but the
turns of one conversation ever comes together in a row.

Defined cases: turns of a conversation are ordered by (turn, role, text), which settles ties and repeated rows; a null
role or text is rendered as empty; a pair of which one conversation is missing has no common turn, and the missing
side is empty; equal conversations leave two empty completions; rows without a conv_id are ignored; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobordia.session import table


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def preference_format(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``turns``: (conv_id, turn, role, text); ``pairs``: (pair_id, chosen_id, rejected_id), each conversation once.

    One row per pair: pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask,
    rejected_mask.
    """
    turns = turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sides = pairs.select("pair_id", F.col("chosen_id").alias("conv_id"), F.lit(0).alias("side"))
    sides = sides.unionByName(pairs.select("pair_id", F.col("rejected_id").alias("conv_id"), F.lit(1).alias("side")))
    x = turns.withColumn("at", F.row_number().over(order)).join(sides, "conv_id").select("pair_id", "side", "at", "role", "text")
    # both sides' turns at one position meet in one group of at most two rows
    spot = x.groupBy("pair_id", "at").agg(F.count("*").alias("n"), F.countDistinct(F.struct(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).alias("kinds"))
    split = spot.groupBy("pair_id").agg((F.coalesce(F.min(F.when((F.col("n") < 2) | (F.col("kinds") > 1), F.col("at"))), F.max("at") + 1) - 1).cast("long").alias("shared"))
    x = x.join(split, "pair_id").withColumn("shown", render(F.col("role"), F.col("text")))
    own = Window.partitionBy("pair_id", "side").orderBy("at")
    rest = F.when(F.col("at") > F.col("shared"), F.length("shown")).otherwise(0)
    x = x.withColumn("end", F.sum(rest).over(own))
    first = F.col("end") - F.length(F.coalesce("text", F.lit(""))) - F.length(F.lit("<|end|>\n"))
    span = F.when(F.col("role") == "assistant", F.concat(first, F.lit("-"), F.col("end") - 1))

    def gathered(value: Column, keep: Column, sep: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep & value.isNotNull(), F.struct("at", value.alias("v")))))
        return F.array_join(F.transform(rows, lambda r: r["v"]), sep)

    late = F.col("at") > F.col("shared")
    out = x.groupBy("pair_id", "shared").agg(
        gathered(F.col("shown"), ~late & (F.col("side") == 0), "").alias("prompt"),
        gathered(F.col("shown"), late & (F.col("side") == 0), "").alias("chosen"),
        gathered(F.col("shown"), late & (F.col("side") == 1), "").alias("rejected"),
        gathered(span, late & (F.col("side") == 0), ",").alias("chosen_mask"),
        gathered(span, late & (F.col("side") == 1), ",").alias("rejected_mask"),
    )
    return pairs.join(out, "pair_id").select("pair_id", "chosen_id", "rejected_id", F.col("shared").alias("n_prompt_turns"), "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k are the chosen and 2k + 1 the rejected ones of pair k."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.filter("conv_id is not null").select(F.floor(F.col("conv_id") / 2).alias("pair_id"), "conv_id").distinct()
    pairs = pairs.groupBy("pair_id").agg(F.max(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.col("conv_id") % 2 != 0, F.col("conv_id"))).alias("rejected_id"))
    return preference_format(turns, pairs)


OP5_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT floor(conv_id / 2)::BIGINT AS pair_id, conv_id, conv_id % 2 AS side, pos, role, text,
        '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown FROM t),
spot AS (SELECT pair_id, pos, count(*) AS n, count(DISTINCT shown) AS kinds FROM x GROUP BY ALL),
split AS (SELECT pair_id, coalesce(min(CASE WHEN n < 2 OR kinds > 1 THEN pos END), max(pos) + 1) - 1 AS shared FROM spot GROUP BY pair_id),
y AS (SELECT x.*, shared, sum(CASE WHEN pos > shared THEN length(shown) ELSE 0 END) OVER (PARTITION BY x.pair_id, side ORDER BY pos) AS stop FROM x JOIN split USING (pair_id))
SELECT pair_id, max(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN side <> 0 THEN conv_id END) AS rejected_id, shared::BIGINT AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos <= shared AND side = 0), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos > shared AND side = 0), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos > shared AND side <> 0), '') AS rejected,
  coalesce(string_agg((stop - length(coalesce(text, '')) - 8)::VARCHAR || '-' || (stop - 1)::VARCHAR, ',' ORDER BY pos) FILTER (pos > shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((stop - length(coalesce(text, '')) - 8)::VARCHAR || '-' || (stop - 1)::VARCHAR, ',' ORDER BY pos) FILTER (pos > shared AND side <> 0 AND role = 'assistant'), '') AS rejected_mask
FROM y GROUP BY pair_id, shared
"""

QUERIES = {"op5_chat": op5_chat}
SQL = {"op5_chat": OP5_SQL}
