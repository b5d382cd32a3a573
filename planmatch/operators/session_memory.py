"""Which columns matter in a conversation, carried from turn to turn.

State after a turn: labels with weights, ascending, and the number of turns. A
follow-up adds its own weights, and labels below the memory point are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planmatch.operators.ranking import value_positions
from planmatch.sources.storage import scratch_path

# Fixed value: average weight per turn from which a label is worth remembering.
MEMORY_SHARE = 0.2
# Turns of one conversation handled in one go.
TURNS_PER_BLOCK = 10_000

ITEMS = "array<struct<weight:double,label:string>>"
STATE = f"struct<chat_length:int,items:{ITEMS}>"


# What the single steps are done for: one turn of each conversation, or, with
# ("conv_id", "turn_no"), every turn.
CONVERSATION = ("conv_id",)


def merge_weights(
    current: DataFrame, stored: DataFrame, by: Sequence[str] = CONVERSATION
) -> DataFrame:
    """(by, label, weight): sum over both sides, missing counts 0.

    Both sides hold a label once per `by`.
    """
    columns = [*by, "label", "weight"]
    both = current.select(*columns).unionByName(stored.select(*columns))
    return both.groupBy(*by, "label").agg(F.sum("weight").alias("weight"))


def order_weights(merged: DataFrame, by: Sequence[str] = CONVERSATION) -> DataFrame:
    """`rk` 1 is the lightest label, ties by label."""
    order = Window.partitionBy(*by).orderBy("weight", "label")
    return merged.withColumn("rk", F.row_number().over(order))


def memory_point(
    ordered: DataFrame, turns: DataFrame, by: Sequence[str] = CONVERSATION
) -> DataFrame:
    """(by, memory): first rank heavy enough among those the relaxation reached; null when
    there is none, and at a first turn. turns(by, chat_length, level), where chat_length
    counts the turns before."""
    heavy = F.col("weight") / (F.col("chat_length") + 1) >= MEMORY_SHARE
    reached = (F.col("rk") - 1 <= F.col("level")) & (F.col("chat_length") > 0)
    return (
        ordered.join(turns, list(by))
        .groupBy(*by)
        .agg(F.min(F.when(heavy & reached, F.col("rk"))).alias("memory"))
    )


def truncate_memory(
    ordered: DataFrame, memory: DataFrame, turns: DataFrame, by: Sequence[str] = CONVERSATION
) -> DataFrame:
    """Labels from the memory point on (all without one), and the next chat_length."""
    return (
        ordered.join(memory, list(by))
        .join(turns.select(*by, "chat_length"), list(by))
        .where(F.col("rk") >= F.coalesce("memory", F.lit(1)))
        .select(*by, "label", "weight", "rk", (F.col("chat_length") + 1).alias("chat_length"))
    )


def remembered_conditions(
    constraints: DataFrame,
    ordered: DataFrame,
    memory: DataFrame,
    by: Sequence[str] = CONVERSATION,
) -> DataFrame:
    """The query to carry on: conditions on labels before the memory point are gone.

    constraints(by, col, ...).
    """
    forgotten = (
        ordered.join(memory, list(by))
        .where(F.col("rk") < F.col("memory"))
        .select(*by, F.col("label").alias("col"))
    )
    return constraints.join(forgotten, [*by, "col"], "left_anti")


def number_turns(turns: DataFrame) -> DataFrame:
    """Renumber the turns of each conversation from 0 in `turn` order.

    Positions come from range-split counts, so one endless conversation is still
    spread over many tasks.
    """
    places = value_positions(turns, "turn", by=["conv_id"]).select(
        "conv_id", "turn", F.col("distinct_before").cast("int").alias("turn_no")
    )
    return turns.join(places, ["conv_id", "turn"])


def _weight_of(items: Column, label: Column) -> Column:
    """Weight at the first place of the label, 0 when absent."""
    hits = F.filter(items, lambda x: x["label"] == label)
    return F.coalesce(F.get(hits, F.lit(0))["weight"], F.lit(0.0))


def _next_state(state: Column, turn: Column) -> Column:
    stored, current = state["items"], turn["items"]
    labels = F.array_union(
        F.transform(stored, lambda x: x["label"]), F.transform(current, lambda x: x["label"])
    )
    merged = F.array_sort(
        F.transform(
            labels,
            lambda label: F.struct(
                (_weight_of(stored, label) + _weight_of(current, label)).alias("weight"),
                label.alias("label"),
            ),
        )
    )
    chat = state["chat_length"]
    follow_up = chat > 0
    # Rank of the first label that is heavy enough and was reached, 0 for none.
    memory = F.aggregate(
        F.transform(merged, lambda x, i: F.struct(x["weight"].alias("w"), i.alias("i"))),
        F.lit(0),
        lambda found, x: F.when(
            (found == 0) & (x["w"] / (chat + 1) >= MEMORY_SHARE) & (x["i"] <= turn["level"]),
            x["i"] + 1,
        ).otherwise(found),
    )
    start = F.when(follow_up, F.greatest(memory, F.lit(1))).otherwise(F.lit(1))
    return F.struct(
        (chat + 1).cast("int").alias("chat_length"),
        F.slice(merged, start, F.size(merged)).cast(ITEMS).alias("items"),
    )


def _last_state(start: Column) -> list[Column]:
    state = F.aggregate("turns", start, _next_state)
    return [F.array(state).cast(f"array<{STATE}>").alias("states")]


def _every_state(start: Column) -> list[Column]:
    """The state before the block, then one after each turn; and the turns' numbers."""
    kind = f"array<{STATE}>"
    states = F.aggregate(
        "turns",
        F.array(start).cast(kind),
        lambda past, turn: F.concat(
            past, F.array(_next_state(F.element_at(past, -1), turn)).cast(kind)
        ),
    )
    return [states.alias("states"), F.transform("turns", lambda t: t["turn_no"]).alias("turn_nos")]


def _fold(
    weights: DataFrame,
    levels: DataFrame,
    turns_per_block: int,
    states_of: Callable[[Column], list[Column]],
) -> tuple[DataFrame, int]:
    """(conv_id, block, states, ...) for every block of a conversation, newest state last;
    and the number of blocks.

    Each turn depends on the one before, so a conversation is folded in order. A
    group never holds more than `turns_per_block` turns: longer conversations go
    on in further rounds from their newest written state, however many turn numbers
    are missing in between, so the size of a block changes no result. Ordinary data
    needs one round.
    """
    spark = weights.sparkSession
    items = weights.groupBy("conv_id", "turn_no").agg(
        F.array_sort(F.collect_list(F.struct("weight", "label"))).cast(ITEMS).alias("items")
    )
    turns = levels.join(items, ["conv_id", "turn_no"], "left").select(
        "conv_id",
        "turn_no",
        F.floor(F.col("turn_no") / turns_per_block).cast("int").alias("block"),
        F.col("level").cast("int").alias("level"),
        F.coalesce("items", F.array().cast(ITEMS)).alias("items"),
    )
    # One number per block that occurs.
    block_of = F.floor(F.col("turn_no") / turns_per_block).cast("int")
    blocks = sorted(r[0] for r in levels.select(block_of).distinct().collect()) or [0]
    if len(blocks) > 1:
        path = scratch_path(spark, "turns")
        turns.write.partitionBy("block").parquet(path)
        turns = spark.read.schema(turns.schema).parquet(path)

    fresh = F.struct(
        F.lit(0).alias("chat_length"), F.array().cast(ITEMS).alias("items")
    ).cast(STATE)
    ordered = F.array_sort(F.collect_list(F.struct("turn_no", "level", "items"))).alias("turns")
    newest = F.element_at("states", -1)
    paths: list[str] = []
    for block in blocks:
        mine = turns.where(F.col("block") == block) if len(blocks) > 1 else turns
        grouped = mine.groupBy("conv_id").agg(ordered)
        start = fresh
        if paths:
            written = spark.read.schema(folded.schema).parquet(*paths)
            before = written.groupBy("conv_id").agg(F.max_by(newest, "block").alias("state"))
            grouped = grouped.join(before, "conv_id", "left")
            start = F.coalesce("state", fresh)
        folded = grouped.select("conv_id", F.lit(block).alias("block"), *states_of(start))
        if len(blocks) == 1:
            return folded, 1
        paths.append(scratch_path(spark, "state"))
        folded.write.parquet(paths[-1])
    return spark.read.schema(folded.schema).parquet(*paths), len(blocks)


def session_fold(
    weights: DataFrame, levels: DataFrame, turns_per_block: int = TURNS_PER_BLOCK
) -> DataFrame:
    """(conv_id, chat_length, items) after the last turn of every conversation.

    weights(conv_id, turn_no, label, weight); levels(conv_id, turn_no, level) has
    one row per turn, also for turns without weights. The first turn is stored as
    it is; pruning starts with the first follow-up.
    """
    folded, blocks = _fold(weights, levels, turns_per_block, _last_state)
    newest = F.element_at("states", -1)
    if blocks > 1:
        final = folded.groupBy("conv_id").agg(F.max_by(newest, "block").alias("state"))
    else:
        final = folded.select("conv_id", newest.alias("state"))
    return final.select("conv_id", "state.*")


def session_history(
    weights: DataFrame, levels: DataFrame, turns_per_block: int = TURNS_PER_BLOCK
) -> DataFrame:
    """(conv_id, turn_no, chat_length, items) after every turn, from tables as in
    `session_fold`."""
    folded, _ = _fold(weights, levels, turns_per_block, _every_state)
    after = F.zip_with(
        F.slice("states", F.lit(2), F.size("turn_nos")),
        F.col("turn_nos"),
        lambda state, turn_no: F.struct(
            turn_no.alias("turn_no"),
            state["chat_length"].alias("chat_length"),
            state["items"].alias("items"),
        ),
    )
    return folded.select("conv_id", F.inline(after))


def stored_weights(history: DataFrame) -> DataFrame:
    """(conv_id, turn_no, label, weight): what is stored when a turn comes, which is the
    state after the turn before."""
    return history.select(
        "conv_id", (F.col("turn_no") + 1).alias("turn_no"), F.explode("items").alias("item")
    ).select("conv_id", "turn_no", "item.label", "item.weight")


def state_rows(states: DataFrame) -> DataFrame:
    """One row per remembered label, `rk` ascending by weight."""
    return states.select(
        "conv_id", "chat_length", F.posexplode("items").alias("pos", "item")
    ).select("conv_id", "chat_length", (F.col("pos") + 1).alias("rk"), "item.label", "item.weight")
