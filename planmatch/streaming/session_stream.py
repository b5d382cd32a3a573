"""Session memory over a stream of turns.

The only operator with Python state. Per conversation it keeps the current labels
with weights and, until their turn comes, turns that arrived early; both are small.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from planmatch.operators.session_memory import MEMORY_SHARE

# The processor travels with the query, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "conv_id long, turn_no int, chat_length int, labels array<string>, weights array<double>"
STATE = "chat_length int, upcoming int, labels array<string>, weights array<double>"
# Fixed value: the provider that keeps several states per key.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EARLY = "level int, labels array<string>, weights array<double>, due long"


def next_memory(
    chat: int, stored: dict[str, float], current: dict[str, float], level: int
) -> dict[str, float]:
    """Labels kept after one turn, ascending by weight."""
    merged = sorted(
        (stored.get(label, 0.0) + current.get(label, 0.0), label)
        for label in stored.keys() | current.keys()
    )
    if chat > 0:
        for place, (weight, _) in enumerate(merged[: level + 1]):
            if weight / (chat + 1) >= MEMORY_SHARE:
                merged = merged[place:]
                break
    return {label: weight for weight, label in merged}


class SessionProcessor(StatefulProcessor):
    def __init__(self, wait_ms: int | None = None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", STATE)
        self.early = handle.getMapState("early", "turn_no int", EARLY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        upcoming = self.memory.get()[1] if self.memory.exists() else 0
        now = timerValues.getCurrentProcessingTimeInMs() if self.wait_ms else 0
        due = now + (self.wait_ms or 0)
        for batch in rows:
            for row in batch.itertuples(index=False):
                number = (int(row.turn_no),)
                # A turn that was already folded in, or waits, came twice; or it came too late.
                if row.turn_no >= upcoming and not self.early.containsKey(number):
                    weights = [float(w) for w in row.weights]
                    self.early.updateValue(number, (int(row.level), list(row.labels), weights, due))
        yield from self.fold_waiting(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.fold_waiting(key, expiredTimerInfo.getExpiryTimeInMs())

    def fold_waiting(self, key, now: int) -> Iterator[pd.DataFrame]:
        """Fold in turns without a gap before them, and up to the last one that is overdue."""
        chat, upcoming, stored = 0, 0, {}
        if self.memory.exists():
            chat, upcoming, labels, weights = self.memory.get()
            stored = dict(zip(labels, weights))
        waiting = {number[0]: turn for number, turn in self.early.iterator()}
        overdue = -1
        if self.wait_ms:
            overdue = max((number for number, turn in waiting.items() if turn[3] <= now), default=-1)
        done = []
        for number in sorted(waiting):
            if number > max(upcoming, overdue):
                break
            level, labels, weights, _ = waiting.pop(number)
            self.early.removeKey((number,))
            stored = next_memory(chat, stored, dict(zip(labels, weights)), level)
            chat, upcoming = chat + 1, number + 1
            done.append((key[0], number, chat, list(stored), list(stored.values())))
        if waiting and self.wait_ms:
            self.handle.registerTimer(min(turn[3] for turn in waiting.values()))
        if done:
            self.memory.update((chat, upcoming, list(stored), list(stored.values())))
            columns = ["conv_id", "turn_no", "chat_length", "labels", "weights"]
            yield pd.DataFrame(done, columns=columns)

    def close(self) -> None:
        pass


def turn_records(weights: DataFrame, levels: DataFrame) -> DataFrame:
    """One record per turn, as the stream expects them."""
    items = weights.groupBy("conv_id", "turn_no").agg(
        F.array_sort(F.collect_list(F.struct("weight", "label"))).alias("items")
    )
    joined = levels.join(items, ["conv_id", "turn_no"], "left")
    return joined.select(
        "conv_id",
        F.col("turn_no").cast("int").alias("turn_no"),
        F.col("level").cast("int").alias("level"),
        F.coalesce(F.transform("items", lambda x: x["label"]), F.array().cast("array<string>")).alias(
            "labels"
        ),
        F.coalesce(F.transform("items", lambda x: x["weight"]), F.array().cast("array<double>")).alias(
            "weights"
        ),
    )


def session_stream(turns: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """The state after every turn. `turns` is a stream of turn records, in any order;
    needs the RocksDB state store provider.

    A turn waits for the turns before it. With `wait_ms` it does so for that many milliseconds:
    then it is folded in over the gap, as the batch fold does with numbers that are missing,
    and a turn of the gap that comes later is left out. Without, it waits for ever. Timers
    go by the clock, so with `wait_ms` the query needs a trigger that keeps running.
    """
    return turns.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(wait_ms),
        outputStructType=OUTPUT,
        outputMode="Update",
        timeMode="ProcessingTime" if wait_ms else "None",
    )


def run_to_end(turns: DataFrame, checkpoint: str, sink: str) -> DataFrame:
    """Drain a finite stream into parquet and return the last state per conversation
    as (conv_id, chat_length, items)."""
    spark = turns.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # One folder per batch, so that a repeated batch replaces itself.
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        running = (
            session_stream(turns)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        running.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    states = spark.read.schema(OUTPUT).parquet(sink)
    last = states.groupBy("conv_id").agg(
        F.max_by(F.struct("chat_length", "labels", "weights"), "turn_no").alias("s")
    )
    items = F.arrays_zip(F.col("s.weights").alias("weight"), F.col("s.labels").alias("label"))
    return last.select("conv_id", "s.chat_length", items.alias("items"))
