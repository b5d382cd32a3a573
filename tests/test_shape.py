"""Projection, order, JSON answers, sources, ranking, joins, retrieval."""

from __future__ import annotations

import json
import math
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planmatch.operators import retrieval, shaping
from planmatch.operators.joins import join_back
from planmatch.operators.ranking import exact_quantiles, rank_all, value_positions
from planmatch.plans import queries
from planmatch.sources import catalog, documents, storage


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "a", 3.0), (2, "b", None), (3, "c", 1.0), (4, "d", 1.0), (5, "e", 2.0)]
    return spark.createDataFrame(data, "id long, name string, price double")


def test_projection_and_fallback(rows):
    assert shaping.project_requested(rows, ["name"], ["id", "name"]).columns == ["name", "id"]
    assert shaping.project_requested(rows, ["name"], ["missing"]).columns == rows.columns


def test_top_rows(rows):
    assert [r["id"] for r in shaping.top_rows(rows, 3, key="id").collect()] == [3, 4, 5]
    assert [r["id"] for r in shaping.sort_by_price(rows, key="id").collect()] == [3, 4, 5, 1, 2]
    without = rows.select("id")
    assert shaping.sort_by_price(without) is without
    plan = shaping.top_rows(rows, 3, key="id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_column_map_keeps_order(spark, rows):
    best = shaping.top_rows_by(rows.withColumn("g", F.lit(1)), ["g"], 3, "price", "id")
    maps = shaping.rows_to_column_map(best, ["g"], "id", ["name", "price"])
    entries = maps.select(F.map_entries("name").alias("e"), "price").first()
    assert [tuple(e) for e in entries["e"]] == [(3, "c"), (4, "d"), (5, "e")]
    assert entries["price"] == {3: 1.0, 4: 1.0, 5: 2.0}


def test_envelope_json(spark):
    answers = spark.createDataFrame(
        [(1, "q", "a = 1", ["x"], [0.5], "", {3: "c"}, None), (2, "q", "", [], [], "", None, "unknown column: z")],
        "request_id long, query string, sql string, labels array<string>, stored_weights array<double>,"
        "final_query string, m map<long,string>, error string",
    ).withColumn("plans", F.when(F.col("m").isNotNull(), F.struct(F.col("m").alias("name")))).drop("m")
    got = {r["request_id"]: (r["status"], json.loads(r["body"])) for r in shaping.result_envelope(answers).collect()}
    assert got[2] == (500, {"error": "unknown column: z"})
    assert got[1] == (
        200,
        {
            "User query": "q",
            "SQL queries": "a = 1",
            "labels": ["x"],
            "stored_weights": [0.5],
            "Final Queries": [""],
            "plans": [{"name": {"3": "c"}}],
            "benefits": None,
        },
    )


def test_envelopes_written_as_json(spark, sf_dir):
    path = tempfile.mkdtemp(prefix="planmatch-out-") + "/answers"
    envelopes = queries.answer_envelopes(spark, sf_dir)
    shaping.write_envelopes(envelopes, path)
    back = spark.read.json(path)
    assert back.count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    body = json.loads(back.where("request_id = 1").first()["body"])
    assert set(body) == {
        "User query", "SQL queries", "labels", "stored_weights", "Final Queries", "plans", "benefits",
    }


def test_documents_one_per_file_and_missing_folder(spark):
    root = tempfile.mkdtemp(prefix="planmatch-docs-")
    os.makedirs(f"{root}/a/b")
    for name, text in {"x.txt": "line 1\nline 2", "a/b/y.txt": "deep"}.items():
        with open(f"{root}/{name}", "w") as file:
            file.write(text)
    got = documents.read_documents(spark, root)
    assert sorted(r["text"] for r in got.collect()) == ["deep", "line 1\nline 2"]
    missing = documents.read_documents(spark, f"{root}/nowhere").first()
    assert missing["error"] == f"Not a valid directory: {root}/nowhere" and missing["text"] is None


def test_catalog_schema_inferred_only_on_request(spark, rows):
    path = tempfile.mkdtemp(prefix="planmatch-csv-") + "/c"
    catalog.write_catalog(rows, path)
    assert catalog.read_catalog(spark, path, rows.schema).schema == rows.schema
    assert sorted(map(str, catalog.read_catalog(spark, path).collect())) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("values_per_range", [200_000, 7])
def test_positions_in_ranges(spark, values_per_range):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else rng.choice("ab"), rng.randint(0, 60)) for _ in range(500)]
    df = spark.createDataFrame(data, "g string, v int")
    got = value_positions(df, "v", ["g"], values_per_range=values_per_range).collect()
    assert len(got) == len(set(data))
    for r in got:
        mine = [v for g, v in data if g == r["g"]]
        assert r["n"] == mine.count(r["v"])
        assert r["before"] == sum(v < r["v"] for v in mine)
        assert r["distinct_before"] == len({v for v in mine if v < r["v"]})


def test_ranges_hold_many_small_groups_and_split_large_ones(spark, monkeypatch):
    from planmatch.operators import ranking

    made = []
    original = ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, name: made.append((name, original(df, name))) or made[-1][1])
    limit = 2_000
    small = spark.range(160_000).select((F.col("id") % 40_000).alias("g"), F.floor(F.col("id") / 40_000).alias("v"))
    large = spark.range(9_000).select(F.lit(-1).cast("long").alias("g"), F.col("id").alias("v"))
    got = ranking.value_positions(small.unionByName(large), "v", ["g"], values_per_range=limit)
    assert got.where("g >= 0 AND before <> v").count() == 0 and got.where("g = -1 AND before <> v").count() == 0
    assert got.count() == 169_000
    ranges = [df for name, df in made if name == "ranges"]
    assert ranges[0].groupBy("_range").count().agg(F.max("count")).first()[0] <= 2 * limit
    assert ranges[0].count() == 9_000


def test_rank_with_nulls(spark, rows):
    got = {r["id"]: (r["rank"], r["dense_rank"]) for r in rank_all(rows, "price", ["id"]).collect()}
    assert got == {3: (1, 1), 4: (1, 1), 5: (3, 2), 1: (4, 3), 2: (None, None)}


def test_quantiles_by_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0)], "g string, v double")
    got = {r["g"]: (r["q"], r["m"]) for r in exact_quantiles(df, "v", {"q": 0.95, "m": 0.5}, ["g"]).collect()}
    assert math.isclose(got["a"][0], 8.55) and got["a"][1] == 4.5 and got["b"] == (5.0, 5.0)


def test_join_back_splits_hot_keys(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"))
    keyed = big.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    small = join_back(big, keyed, ["k"], ["id"])
    split = join_back(big, keyed, ["k"], ["id"], broadcast_rows=0, slices=8)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, split.select(small.columns).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = join_back(big, keyed, ["k"], ["id"], broadcast_rows=0, slices=8)
        hot = parts.where("k = -1").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in hot) == 1000 and len(hot) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("questions,question_bytes", [(300, 16_000_000), (1000, 40_000), (3, 1)])
def test_any_number_of_questions(spark, questions, question_bytes):
    rng = np.random.default_rng(questions)
    base, asked = rng.normal(size=(60, 5)), rng.normal(size=(questions, 5))
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, v array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, w array<double>")
    got = retrieval.cosine_topk(b, q, 2, "id", "v", "q", "w", question_bytes=question_bytes).collect()
    cosines = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (base / np.linalg.norm(base, axis=1)[:, None]).T
    want = {(j, r + 1): int(i) for j, row in enumerate(cosines) for r, i in enumerate(np.argsort(-row)[:2])}
    assert {(r["q"], r["rank"]): r["id"] for r in got} == want


def test_vectors_that_do_not_fit(spark):
    b = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [1.0, 0.0, 5.0]), (2, [3.0]), (3, None), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [0.0, 2.0])],
        "id long, v array<double>",
    )
    q = spark.createDataFrame([(0, [2.0, 0.0]), (1, None), (2, [1.0, None]), (3, [0.0, 0.0, 1.0])], "q long, w array<double>")
    got = {(r["q"], r["id"]): r["score"] for r in retrieval.score_all(b, q, "id", "v", "q", "w").collect()}
    assert {k: round(v, 6) for k, v in got.items() if v is not None} == {(0, 0): 1.0, (0, 6): 0.0, (3, 1): round(5 / 26**0.5, 6)}
    assert {k[0] for k in got} == {0, 3}
    assert retrieval.cosine_topk(b, q.limit(0), 2, "id", "v", "q", "w").count() == 0
    assert retrieval.cosine_topk(b, q.where("w IS NULL"), 2, "id", "v", "q", "w").count() == 0


def test_hits_without_text_stay(spark):
    near = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "q long, id long, rank int")
    texts = spark.createDataFrame([(1, "one"), (3, "three")], "id long, text string")
    asked = spark.createDataFrame([(7, "what?")], "q long, question string")
    hits = retrieval.attach_texts(near, texts, "id")
    assert sorted((r["rank"], r["text"]) for r in hits.collect() if r["text"]) == [(1, "one"), (3, "three")]
    assert hits.count() == 3
    found = retrieval.assemble_context(hits, asked, "q", "question", "text").first()["prompt"]
    assert found.endswith("one\n\n\n\nthree")


@pytest.mark.parametrize("values_per_range", [200_000, 7])
def test_positions_of_texts_and_odd_numbers(spark, values_per_range):
    numbers = [float(i % 23) for i in range(80)] + [float("nan"), float("inf"), float("-inf"), float("inf"), None]
    frame = spark.createDataFrame([(v, None if v is None else f"t{v}") for v in numbers], "v double, t string")
    for name, key in (("v", lambda x: (x != x, x)), ("t", lambda x: x)):
        kept = sorted((r[0] for r in frame.select(name).collect() if r[0] is not None), key=key)
        want = {}
        for i, x in enumerate(kept):
            want.setdefault(str(x), i)
        got = value_positions(frame, name, values_per_range=values_per_range).collect()
        assert {str(r[name]): r["before"] for r in got} == want


def test_quantiles_of_the_group_without_key(spark):
    frame = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g long, v double")
    got = {r["g"]: r["half"] for r in exact_quantiles(frame, "v", {"half": 0.5}, ["g"]).collect()}
    assert got == {None: 2.0, 1: 5.0}


def test_catalog_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    (tmp_path / "c.csv").write_text('name,n\n"a ""b"", c",1\nd,two\n')
    schema = "name string, n int"
    read = catalog.read_catalog(spark, str(tmp_path / "c.csv"), T.StructType.fromDDL(schema), bad="_bad").collect()
    assert [(r["name"], r["n"]) for r in read if r["_bad"] is None] == [('a "b", c', 1)]
    assert [r["_bad"] for r in read if r["_bad"] is not None] == ["d,two"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://somewhere", "a"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        storage.scratch_root(Session())


def test_approximate_recall(spark, sf_dir):
    exact = {(r["label"], r["vec_id"]) for r in queries._nearest(spark, sf_dir, 5).collect()}
    approx = {(r["label"], r["vec_id"]) for r in queries.ann_topk(spark, sf_dir).collect()}
    assert len(exact & approx) / len(exact) >= 0.9


def test_topk_plan_has_one_small_exchange(spark, sf_dir):
    plan = queries.cosine_topk(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1
    assert "Join" not in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_topk_ties_and_zero_vectors(spark):
    base = spark.createDataFrame(
        [(i, [1.0, 0.0]) for i in range(9, 0, -1)] + [(10, [0.0, 0.0]), (11, None)],
        "id long, v array<double>",
    )
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "name string, v array<double>")
    got = retrieval.cosine_topk(base, asked, 3, "id", "v", "name", "v").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    every = retrieval.cosine_topk(base, asked, 20, "id", "v", "name", "v").orderBy("rank").collect()
    assert len(every) == 10 and (every[-1]["id"], every[-1]["score"]) == (10, None)
