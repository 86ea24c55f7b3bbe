"""Chat formatting: logged snapshots of one conversation collapse to the longest, then chats are rendered.

Every turn gets a rolling hash of all turns up to it (exclusive or of the hashes of
(position, role, text), 128 bits). The hash of a whole conversation that is also a
prefix hash of a longer one names a snapshot; anti-joins drop those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, saved


def rendered(turns: Column) -> Column:
    """Chat markup of an array of (role, text)."""
    return F.array_join(
        F.transform(
            turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))
        ),
        "",
    )


def format_chats(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, copies (equal conversations, itself included), chat.

    Turns are ordered by turn number (null first), then role and text; each row is a
    turn, repeated rows too. A null role is ``unknown``, a null text empty. A
    conversation whose turns (role and text) begin a longer one is dropped; of equal
    ones the smallest id stays. Rows without an id belong to no conversation and are
    left out. Other columns are not read.
    """
    ready(turns.sparkSession)
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = (
        rows.withColumn("position", F.row_number().over(order))
        .withColumn("h1", F.bit_xor(F.xxhash64("position", "role", "text")).over(up_to))
        .withColumn("h2", F.bit_xor(F.xxhash64("role", F.lit("|"), "text", "position")).over(up_to))
    )
    logged = saved(
        hashed.groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.struct("position", "h1", "h2", "role", "text"))).alias("turns")
        ),
        "conversations",
    )
    last = F.element_at("turns", -1)
    whole = logged.select(
        "conv_id", last["position"].alias("position"), last["h1"].alias("h1"), last["h2"].alias("h2")
    )
    key = ["position", "h1", "h2"]
    # Many conversations share prefixes: both aggregates combine before they shuffle.
    groups = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    prefixes = (
        logged.select(F.explode(F.slice("turns", F.lit(1), F.size("turns") - 1)).alias("t"))
        .select("t.position", "t.h1", "t.h2")
        .distinct()
    )
    maximal = saved(groups.join(prefixes, key, "left_anti").select("conv_id", "copies"), "maximal")
    return logged.join(maximal, "conv_id").select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), "copies", rendered(F.col("turns")).alias("chat")
    )
