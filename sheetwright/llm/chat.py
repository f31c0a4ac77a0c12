"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again, each time with more turns. Every turn gets three hashes of its
place and content; their running sums are rolling hashes of all prefixes. A conversation whose full hashes are
those of a proper prefix of another one is dropped by an anti-join, equal conversations keep the smallest id,
and what remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.llm.common import saved

#: Bits of a turn's hash that are summed: sums of 2**23 turns stay within a long.
_BITS = 40
_SUMS = ("h1", "h2", "h3")


def _hash(salt: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), "place", "role", "text"), 64 - _BITS)


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn, places counted from 1: conv_id, place, role, text, and the hashes of the prefix that ends there."""
    kept = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    rolling = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    for name in _SUMS:
        placed = placed.withColumn(name, F.sum(_hash(name)).over(rolling))
    return placed.drop("turn")


def maximal(turns: DataFrame, **columns: str) -> DataFrame:
    """Turns of the conversations that are neither a proper prefix of another one nor equal to one of smaller id."""
    rows = prefixes(turns, **columns)
    narrow = saved(rows.select("conv_id", "place", *_SUMS), "prefixes")
    ends = narrow.groupBy("conv_id").agg(F.max("place").alias("turns"))
    marked = narrow.join(ends, "conv_id")
    whole = marked.where("place = turns").groupBy("turns", *_SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = marked.where("place < turns").select(F.col("place").alias("turns"), *_SUMS).distinct()
    kept = whole.join(inner, ["turns", *_SUMS], "left_anti").select("conv_id", "turns", "copies")
    return rows.select("conv_id", "place", "role", "text").join(kept, "conv_id")


def render(turns: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>", **columns: str) -> DataFrame:
    """A row for each maximal conversation: conv_id, turns, copies (equal conversations), rendered, sha256.

    Turns are ordered by turn, ties by role and text. Null roles and texts are empty, turns without a
    conversation are left out, repeated turns are turns. Other columns are ignored; an empty table gives an
    empty result. A rendered conversation is one value, so it is as long as its turns together.
    """
    kept = maximal(turns, **columns)
    line = F.concat(F.lit(begin), F.col("role"), F.lit("\n"), F.col("text"), F.lit(end), F.lit("\n"))
    parts = kept.select("conv_id", "turns", "copies", "place", line.alias("line"))
    out = parts.groupBy("conv_id", "turns", "copies").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    out = out.withColumn("rendered", F.array_join(F.transform("lines", lambda x: x["line"]), ""))
    return out.select("conv_id", "turns", "copies", "rendered", F.sha2("rendered", 256).alias("sha256"))
