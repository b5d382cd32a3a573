"""The inverted file against exact search over all rows."""

from __future__ import annotations

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from planmatch.operators import retrieval, vector_index

SCHEMA = "id long, v array<double>"
ASKED = "name string, v array<double>"


def vectors(n, groups=6, size=5, seed=3):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    return [(i, [m + rng.gauss(0, 0.2) for m in middles[rng.randrange(groups)]]) for i in range(n)]


def pairs(found):
    return {(r["name"], r["id"], r["rank"]) for r in found.collect()}


def test_finds_nine_tenths_in_few_files_and_is_kept(spark, tmp_path):
    rows = vectors(600)
    base = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in rows[::20]], ASKED)
    path = str(tmp_path / "index")
    index = vector_index.build_index(base, "id", "v", k=5, path=path, sample=200)
    assert len(index.centroids) == 24 and index.held.sum() == 600
    kept = vector_index.load_index(spark, path)
    assert (kept.visits, kept.key, kept.held.tolist()) == (index.visits, "id", index.held.tolist())
    exact = {(q, i) for q, i, _ in pairs(retrieval.cosine_topk(base, asked, 5, "id", "v", "name", "v"))}
    found = vector_index.search_index(kept, asked, 5, "name", "v")
    near = {(q, i) for q, i, _ in pairs(found)}
    assert len(near) == len(exact) == 150 and 10 * len(near & exact) >= 9 * len(exact)
    # Few bytes of questions at a time give the same rows.
    assert {(q, i) for q, i, _ in pairs(vector_index.search_index(kept, asked, 5, "name", "v", 400))} == near
    one = vector_index.search_index(kept, asked.limit(1), 5, "name", "v")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_all_cells_visited_is_exact(spark):
    base = spark.createDataFrame(vectors(80), SCHEMA)
    asked = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 0.0]), ("b", [0.0, -1.0, 0.5, 0.0, 2.0])], ASKED)
    index = vector_index.build_index(base, "id", "v", k=5, recall=1.0)
    index.visits = len(index.centroids)
    got = vector_index.search_index(index, asked, 7, "name", "v")
    assert {r["exact"] for r in got.collect()} == {False}
    assert pairs(got) == pairs(retrieval.cosine_topk(base, asked, 7, "id", "v", "name", "v"))


def test_odd_vectors_and_questions_are_answered_by_all_rows(spark):
    rows = [(i, [1.0, float(i)]) for i in range(30)]
    rows += [(100, [0.0, 0.0]), (101, None), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [1.0])]
    rows += [(5, [1.0, 5.0])] * 40  # repeated rows
    base = spark.createDataFrame(rows, SCHEMA)
    index = vector_index.build_index(base, "id", "v", k=3)
    stored = {r["key"] for r in index.rows(spark).where("cell = -1").collect()}
    assert stored == {100, 102, 103, 104} and index.held.sum() == 70
    asked = spark.createDataFrame(
        [("long", [1.0, 2.0, 3.0]), ("none", None), ("hole", [None, 1.0]), ("zero", [0.0, 0.0]), ("fit", [1.0, 5.0])], ASKED
    )
    got = vector_index.search_index(index, asked, 3, "name", "v").collect()
    by = {q: [(r["id"], r["score"] and round(r["score"], 9), r["exact"]) for r in got if r["name"] == q] for q in ("long", "none", "hole", "zero", "fit")}
    assert by["none"] == by["hole"] == []
    assert len(by["long"]) == len(by["zero"]) == 3
    assert all(score is None and exact for _, score, exact in by["long"] + by["zero"])
    assert by["fit"] == [(5, 1.0, False)] * 3
    more = vector_index.search_index(index, asked.where("name = 'fit'"), 75, "name", "v").collect()
    assert {r["exact"] for r in more} == {True} and len(more) == 74


def test_empty_base_and_no_questions(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([("a", [1.0, 0.0])], ASKED)
    index = vector_index.build_index(none, "id", "v")
    assert index.centroids.shape[0] == 0
    assert vector_index.search_index(index, asked, 3, "name", "v").collect() == []
    full = vector_index.build_index(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA), "id", "v")
    assert vector_index.search_index(full, asked.limit(0), 3, "name", "v").collect() == []
    assert [r["id"] for r in vector_index.search_index(full, asked, 1, "name", "v").collect()] == [1]


def test_tasks_hold_a_tile_of_cosines_not_rows_times_questions(spark, monkeypatch):
    """8000 rows of a batch times 4000 questions would be 256 MB, and several times that."""
    rng = np.random.default_rng(5)
    base = spark.createDataFrame(vectors(300), SCHEMA)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 5)))], ASKED)
    index = vector_index.build_index(base, "id", "v", k=5)
    index.visits = len(index.centroids)
    tasks, run = [], type(base).mapInArrow
    monkeypatch.setattr(type(base), "mapInArrow", lambda df, f, schema: (tasks.append(f), run(df, f, schema))[1])
    retrieval.cosine_topk(base, asked, 5, "id", "v", "name", "v")
    vector_index.search_index(index, asked, 5, "name", "v")
    retrieval.score_all(base, asked, "id", "v", "name", "v")
    assert len(tasks) == 3
    own = rng.normal(size=(8000, 5)).tolist()
    # Equal rows tie with the k-th; they may not be held either.
    own[:4000] = [own[0]] * 4000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(8000)), pa.array(own), pa.array(np.arange(8000, dtype="int32") % len(index.centroids))],
        names=["key", "vector", "cell"],
    )
    for task, rows in zip(tasks, (20_000, 20_000, None)):
        tracemalloc.start()
        made = sum(b.num_rows for b in (task(iter([batch])) if rows else itertools.islice(task(iter([batch])), 1)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 150e6 and (rows is None or made == rows)


def test_nearest_rows_of_tiles_and_batches_are_those_of_all_at_once(monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 40)
    rng = np.random.default_rng(9)
    asked = rng.integers(-1, 2, size=(13, 3)).astype("float64")
    asked[0] = np.nan
    asked[1:] += 0.5
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(300), rng.integers(-1, 2, size=(300, 3)).astype("float64"))]
    rows += [(None, [1.0, 0.0, 0.0]), (300, [1.0]), (301, [1.0, None, 0.0]), (302, [float("nan"), 1.0, 0.0])]
    best = retrieval.NearestRows(asked, 4, pa.int64())
    for at in range(0, len(rows), 37):
        part = rows[at : at + 37]
        best.meet(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.list_(pa.float64())))], names=["key", "vector"]))
    schema = pa.schema([("key", pa.int64()), ("q", pa.int64()), ("score", pa.float64())])
    got = best.found(list(range(13)), schema).to_pylist()

    def cosine(q, v):
        own = np.array(v, "float64")
        length = np.linalg.norm(own) if len(own) == 3 else 0
        return None if not length > 0 or np.isnan(q).any() else round(float(own @ q / length), 9)

    for q in range(13):
        scored = [(cosine(asked[q], v), key) for key, v in rows]
        wanted = sorted(scored, key=lambda s: (s[0] is None, -(s[0] or 0), s[1] is not None, s[1] or 0))[:4]
        mine = [(None if r["score"] is None else round(r["score"], 9), r["key"]) for r in got if r["q"] == q]
        assert [k for _, k in mine] == [k for _, k in wanted]
        assert all(a == b or abs(a - b) < 2e-9 for (a, _), (b, _) in zip(mine, wanted))
