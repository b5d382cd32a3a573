"""Session memory: the fold against plain Python, in blocks, and as a stream."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from planmatch.operators import session_memory as memory
from planmatch.plans import queries
from planmatch.sources.storage import scratch_path
from planmatch.streaming import session_stream as session_stream_module
from planmatch.streaming.session_stream import session_stream, turn_records

LABELS = ["a", "b", "c", "d", "e"]


def sequential(turns):
    """turns: list of (level, {label: weight})."""
    chat, stored = 0, {}
    for level, current in turns:
        merged = sorted(
            (stored.get(x, 0.0) + current.get(x, 0.0), x) for x in set(stored) | set(current)
        )
        if chat > 0:
            for i, (w, _) in enumerate(merged):
                if w / (chat + 1) >= 0.2:
                    merged = merged[i:]
                    break
                if i >= level:
                    break
        stored = {x: w for w, x in merged}
        chat += 1
    return chat, [(x, round(w, 9)) for x, w in stored.items()]


@pytest.fixture(scope="module")
def sessions():
    rng = random.Random(5)
    out = {}
    for conv in range(60):
        turns = []
        for _ in range(1 if conv == 0 else rng.randint(1, 9)):
            current = {x: rng.choice([0.05, 0.1, 0.25, 0.4]) for x in LABELS if rng.random() < 0.6}
            turns.append((rng.randint(0, 5), current))
        out[conv] = turns
    return out


def frames(spark, sessions):
    weights = [
        (c, t, x, w) for c, turns in sessions.items() for t, (_, cur) in enumerate(turns) for x, w in cur.items()
    ]
    levels = [(c, t, lv) for c, turns in sessions.items() for t, (lv, _) in enumerate(turns)]
    return (
        spark.createDataFrame(weights, "conv_id long, turn_no int, label string, weight double"),
        spark.createDataFrame(levels, "conv_id long, turn_no int, level int"),
    )


@pytest.mark.parametrize("block", [10_000, 3, 1])
def test_fold_equals_sequential(spark, sessions, block):
    states = memory.session_fold(*frames(spark, sessions), turns_per_block=block)
    got = {
        r["conv_id"]: (r["chat_length"], [(x["label"], round(x["weight"], 9)) for x in r["items"]])
        for r in states.collect()
    }
    assert got == {c: sequential(turns) for c, turns in sessions.items()}


@pytest.mark.parametrize("block", [1, 2, 10_000])
def test_gaps_between_turns_change_nothing(spark, block):
    weights = [(1, 0, "a", 0.5), (1, 5, "b", 0.66), (2, 3, "c", 0.1), (1, 900, "a", 0.2)]
    w = spark.createDataFrame(weights, "conv_id long, turn_no int, label string, weight double")
    levels = spark.createDataFrame([(c, t, 9) for c, t, _, _ in weights], "conv_id long, turn_no int, level int")
    got = {r["conv_id"]: (r["chat_length"], [x["label"] for x in r["items"]]) for r in memory.session_fold(w, levels, block).collect()}
    assert got == {1: (3, ["b", "a"]), 2: (1, ["c"])}


@pytest.mark.parametrize("block", [10_000, 2])
def test_history_is_the_fold_of_every_prefix(spark, sessions, block):
    rows = memory.session_history(*frames(spark, sessions), turns_per_block=block).collect()
    got = {
        (r["conv_id"], r["turn_no"]): (r["chat_length"], [(x["label"], round(x["weight"], 9)) for x in r["items"]])
        for r in rows
    }
    assert len(rows) == len(got)
    assert got == {(c, t): sequential(turns[: t + 1]) for c, turns in sessions.items() for t in range(len(turns))}


def test_turn_numbers(spark):
    rows = [(1, 4), (1, 2), (1, 9), (2, 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long")
    got = {(r[0], r[1]): r[2] for r in memory.number_turns(turns).select("conv_id", "turn", "turn_no").collect()}
    assert got == {(1, 2): 0, (1, 4): 1, (1, 9): 2, (2, 0): 0}


def test_remembered_conditions(spark):
    conditions = spark.createDataFrame(
        [(1, "a"), (1, "b"), (1, "b"), (1, "z"), (2, "a")], "conv_id long, col string"
    )
    ordered = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (2, "a", 1)], "conv_id long, label string, rk int"
    )
    points = spark.createDataFrame([(1, 2), (2, None)], "conv_id long, memory int")
    got = memory.remembered_conditions(conditions, ordered, points)
    assert sorted(map(tuple, got.collect())) == [(1, "b"), (1, "b"), (1, "z"), (2, "a")]


def test_stream_equals_fold(spark, sf_dir):
    weights, levels = queries._session(spark, sf_dir)
    records = turn_records(weights, levels)
    path = scratch_path(spark, "turns")
    # Later turns first: the stream has to put them in order.
    late = F.col("turn_no") >= 2
    records.where(late).coalesce(1).write.parquet(path)
    records.where(~late).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    source = (
        spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(path)
    )
    running = (
        session_stream(source)
        .writeStream.format("memory")
        .queryName("session_states")
        .outputMode("update")
        .option("checkpointLocation", scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    assert running.awaitTermination(240)
    final = (
        spark.table("session_states")
        .groupBy("conv_id")
        .agg(F.max_by(F.struct("chat_length", "labels", "weights"), "turn_no").alias("s"))
    )
    got = {
        r["conv_id"]: (r["s"]["chat_length"], [(x, round(w, 9)) for x, w in zip(r["s"]["labels"], r["s"]["weights"])])
        for r in final.collect()
    }
    folded = {
        r["conv_id"]: (r["chat_length"], [(x["label"], round(x["weight"], 9)) for x in r["items"]])
        for r in memory.session_fold(weights, levels).collect()
    }
    assert got == folded


def test_stream_goes_on_over_a_gap(spark):
    turns = [(c, n, 1, ["a", f"x{n % 3}"], [0.5, 0.1 * n]) for c in (1, 2, 3) for n in (0, 1, 4, 5, 7)]
    # Conversation 2 gets its missing turns in time, 3 never has a first turn.
    turns = [t for t in turns if t[:2] != (3, 0)]
    filled = [(2, n, 1, ["a", f"x{n % 3}"], [0.5, 0.1 * n]) for n in (2, 3, 6)]
    schema = "conv_id long, turn_no int, level int, labels array<string>, weights array<double>"
    path, checkpoint = scratch_path(spark, "turns"), scratch_path(spark, "stream")
    spark.createDataFrame(turns, schema).coalesce(1).write.parquet(path)
    spark.createDataFrame(filled, schema).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", session_stream_module.ROCKSDB)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    running = (
        session_stream(source, wait_ms=2_000)
        .writeStream.format("memory")
        .queryName("gap_states")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime="1 second")
        .start()
    )
    end = time.time() + 120
    while time.time() < end and running.isActive and spark.table("gap_states").count() < len(turns + filled):
        time.sleep(0.5)
    running.stop()
    got = {(r["conv_id"], r["turn_no"]): (r["chat_length"], dict(zip(r["labels"], r["weights"])))
           for r in spark.table("gap_states").collect()}

    every = spark.createDataFrame(turns + filled, schema)
    levels = every.select("conv_id", "turn_no", "level")
    weights = every.select("conv_id", "turn_no", F.inline(F.arrays_zip(F.col("labels").alias("label"), F.col("weights").alias("weight"))))
    expected = {(r["conv_id"], r["turn_no"]): (r["chat_length"], {x["label"]: x["weight"] for x in r["items"]})
                for r in memory.session_history(weights, levels).collect()}
    assert got.keys() == expected.keys() and len(got) == len(turns + filled)
    for turn, (chat, items) in expected.items():
        assert got[turn][0] == chat and got[turn][1] == pytest.approx(items)
    waiting = (
        spark.read.format("statestore").option("path", checkpoint)
        .option("stateVarName", "early").load()
    )
    assert waiting.count() == 0
