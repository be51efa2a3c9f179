"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns (equal role and text) of a pair is rendered once, as the prompt; what follows in each conversation is its completion. Completions are masked:
only the text of assistant turns, with its closing mark, is learnt from; other turns and all headers are not. Masks are spans of code points, end exclusive.

A turn is rendered as header, text, close. A null role counts as "user", a null text as empty. Turns are in order of turn, then role, then text; repeated rows are turns of their own. Rows
without a conversation id are left out. If one conversation begins with the whole of the other, the shorter one's completion is empty. Each
conversation is one row of the result, and no pair ever meets more than its own two conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a turn is rendered.
HEADER = ("<|", "|>\n")
CLOSE = "<|end|>\n"
LEARNT_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEADER[0]), role, F.lit(HEADER[1]), text, F.lit(CLOSE))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. pairs: pair_id, chosen, rejected, conversation ids.

    A row for each pair: pair_id, chosen_conv, rejected_conv, n_common (turns), prompt, chosen, rejected (completions), chosen_mask, rejected_mask (arrays of [from, to))."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(True).alias("is_chosen"), F.col("chosen").alias("conv_id")), F.struct(F.lit(False).alias("is_chosen"), F.col("rejected").alias("conv_id")))).alias("side")).select("pair_id", "side.*")
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).join(sides, "conv_id")
    return formatted(own)


def formatted(own: DataFrame) -> DataFrame:
    """preference_pairs of sides given as turns: pair_id, is_chosen, conv_id, turn, role, text, without null roles and texts."""
    in_order = Window.partitionBy("pair_id", "is_chosen").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = own.withColumn("place", F.row_number().over(in_order))
    # a place is common if both sides have it with the same turn; the prefix ends at the first that isn't
    at_place = Window.partitionBy("pair_id", "place")
    placed = placed.withColumn("differs", (F.count(F.lit(1)).over(at_place) < 2) | (F.min(F.struct("role", "text")).over(at_place) != F.max(F.struct("role", "text")).over(at_place)))
    whole_pair = Window.partitionBy("pair_id")
    placed = placed.withColumn("n_common", F.coalesce(F.min(F.when(F.col("differs"), F.col("place"))).over(whole_pair) - 1, F.max("place").over(whole_pair)))
    placed = placed.withColumn("line", rendered(F.col("role"), F.col("text"))).withColumn("common", F.col("place") <= F.col("n_common"))
    completion = Window.partitionBy("pair_id", "is_chosen", "common").orderBy("place")
    placed = placed.withColumn("end", F.sum(F.length("line")).over(completion)).withColumn("start", F.col("end") - F.length("text") - len(CLOSE))

    def joined(what: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(what, F.struct("place", "line")))), lambda x: x["line"]), "")

    def mask(is_chosen: bool) -> Column:
        learnt = (F.col("is_chosen") == is_chosen) & ~F.col("common") & (F.col("role") == LEARNT_ROLE)
        return F.transform(F.array_sort(F.collect_list(F.when(learnt, F.struct("start", "end")))), lambda x: F.array(x["start"], x["end"]))

    texts = placed.groupBy("pair_id").agg(
        F.max(F.when(F.col("is_chosen"), F.col("conv_id"))).alias("chosen_conv"),
        F.max(F.when(~F.col("is_chosen"), F.col("conv_id"))).alias("rejected_conv"),
        F.first("n_common").cast("long").alias("n_common"),
        joined(F.col("is_chosen") & F.col("common")).alias("prompt"),
        joined(F.col("is_chosen") & ~F.col("common")).alias("chosen"),
        joined(~F.col("is_chosen") & ~F.col("common")).alias("rejected"),
        mask(True).alias("chosen_mask"),
        mask(False).alias("rejected_mask"),
    )
    return texts.filter("chosen_conv is not null and rejected_conv is not null")


def neighbouring_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of every two conversations that follow each other: ids 2 i and 2 i + 1, the one with more assistant text chosen, the smaller id of equals. An id without its neighbour is in no pair."""
    said = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("role") == LEARNT_ROLE, F.length("text"))), F.lit(0)).alias("said"))
    better = F.struct((-F.col("said")).alias("less"), F.col("conv_id").alias("id"))
    both = said.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).agg(F.min(better)["id"].alias("chosen"), F.max(better)["id"].alias("rejected"), F.count(F.lit(1)).alias("n"))
    return both.filter("n = 2").select("pair_id", "chosen", "rejected")


def branches(turns: DataFrame) -> DataFrame:
    """Sides of a pair for each conversation with two assistant turns or more, which share all turns before the last one of these: chosen goes on with it, rejected with the conversation's first assistant turn, an answer to something else."""
    own = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    whole, said = Window.partitionBy("conv_id"), F.when(F.col("role") == LEARNT_ROLE, F.col("place"))
    own = own.withColumns({"first": F.min(said).over(whole), "last": F.max(said).over(whole)}).filter("last > first and place <= last")
    sides = F.array(
        F.struct(F.lit(True).alias("is_chosen"), F.col("place").alias("turn")),
        F.when(F.col("place") < F.col("last"), F.struct(F.lit(False).alias("is_chosen"), F.col("place").alias("turn"))),
        F.when(F.col("place") == F.col("first"), F.struct(F.lit(False).alias("is_chosen"), F.col("last").alias("turn"))),
    )
    return own.select(F.col("conv_id").alias("pair_id"), "conv_id", "role", "text", F.inline(F.filter(sides, lambda x: x.isNotNull())))


def branch_preferences(turns: DataFrame) -> DataFrame:
    """Formatted pairs of each conversation's own branches; masks as text, from:to joined by commas. An empty table gives an empty result."""
    return _with_listed_masks(formatted(branches(turns)))


def preferences(turns: DataFrame) -> DataFrame:
    """preference_pairs of neighbouring conversations; masks as text, from:to joined by commas."""
    return _with_listed_masks(preference_pairs(turns, neighbouring_pairs(turns)))


def _with_listed_masks(found: DataFrame) -> DataFrame:
    def listed(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))), ",")

    return found.withColumns({c: listed(c) for c in ("chosen_mask", "rejected_mask")})
