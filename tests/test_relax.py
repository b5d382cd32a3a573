"""Relaxation against the literal loop: drop, filter again, until something is left."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest

from planmatch.functions.predicates import Condition, conjunction
from planmatch.operators import relax_batch as rb
from planmatch.operators.cell_index import CellIndex, Wish
from planmatch.operators.close_match import close_values
from planmatch.operators.relax import drop_conditions_on, label_ranks, relax_single

COLUMNS = ["brand", "kind", "size", "price"]
SCHEMA = "key long, brand string, kind string, size int, price double"


def make_catalog(rng, n):
    def maybe(x):
        return None if rng.random() < 0.15 else x

    return [
        (
            i,
            maybe(rng.choice(["xenon", "Yard ", "z"])),
            maybe(rng.choice(["p", "quiet"])),
            maybe(rng.randint(0, 12)),
            maybe(rng.choice([1.5, 2.0, 2.5, 7.0, -3.0, 0.0])),
        )
        for i in range(n)
    ]


def make_request(rng):
    conds = []
    for _ in range(rng.randint(0, 6)):
        col = rng.choice(COLUMNS)
        if col in ("brand", "kind"):
            op = rng.choice(["=", "in", "~"])
            names = ["xenon", "yard", "z", "p", "quiet", "none"]
            if op == "~":
                value = rng.choice([" Xenom", "yar", "quite", "y", "", "en", "absent", "Z"])
            else:
                value = rng.choice(names) if op == "=" else tuple(rng.sample(names, rng.randint(0, 3)))
        else:
            op = rng.choice(["=", "<=", ">=", "<", ">", "between", "in"])
            low = rng.choice([-4, -3, 0, 1.5, 2, 2.5, 5, 9, 13, 1e9])
            if op == "between":
                value = (low, low + rng.choice([-1, 0, 3, 8]))
            elif op == "in":
                value = tuple(rng.choice([0, 2, 2.5, 7, 99]) for _ in range(rng.randint(0, 3)))
            else:
                value = low
        conds.append(Condition(col, op, value))
    labels = rng.sample([*COLUMNS, "other"], rng.randint(0, 5))
    return conds, labels


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(have, wanted):
    have, wanted = have.strip(" ").lower(), wanted.strip(" ").lower()
    return wanted in have or edits(have, wanted) <= max(1, len(wanted) // 4)


def holds(row, cond):
    have = dict(zip(["key", *COLUMNS], row))[cond.column]
    if have is None:
        return False
    value = cond.value
    return {
        "=": lambda: have == value,
        "<=": lambda: have <= value,
        ">=": lambda: have >= value,
        "<": lambda: have < value,
        ">": lambda: have > value,
        "between": lambda: value[0] <= have <= value[1],
        "in": lambda: have in value,
        "~": lambda: close(have, value),
    }[cond.op]()


def literal_loop(rows, conds, labels):
    """(steps, qualifying rows)."""
    left = list(conds)
    found = [r for r in rows if all(holds(r, c) for c in left)]
    steps = 0
    for label in labels:
        if found:
            break
        left = [c for c in left if c.column != label]
        found = [r for r in rows if all(holds(r, c) for c in left)]
        steps += 1
    return steps, found


def best(found, n):
    order = sorted(found, key=lambda r: (r[4] is None, r[4] if r[4] is not None else 0, r[0]))
    return [r[0] for r in order[:n]]


@pytest.fixture(scope="module")
def world():
    rng = random.Random(11)
    rows = make_catalog(rng, 40)
    return rows, [make_request(rng) for _ in range(150)]


def test_single_equals_loop(spark, world):
    rows, requests = world
    catalog = spark.createDataFrame(rows, SCHEMA).cache()
    for conds, labels in requests[:25]:
        steps, found = literal_loop(rows, conds, labels)
        got = relax_single(catalog, conds, labels)
        assert got.level == steps
        assert {r["key"] for r in got.rows.collect()} == {r[0] for r in found}
        assert got.is_empty == (not found)


def batch_frames(spark, requests):
    constraints, relevance = [], []
    for i, (conds, labels) in enumerate(requests):
        for ord_, c in enumerate(conds):
            values = list(c.value) if isinstance(c.value, tuple) else [c.value]
            constraints.append((i, ord_, c.column, c.op, [str(v) for v in values]))
        relevance += [(i, label, place / 10) for place, label in enumerate(labels)]
    return (
        spark.createDataFrame([(i,) for i in range(len(requests))], "request_id long"),
        spark.createDataFrame(
            constraints, "request_id long, ord int, col string, op string, values array<string>"
        ),
        spark.createDataFrame(relevance, "request_id long, col string, score double"),
    )


@pytest.mark.parametrize("options", [{}, {"inline_constants": 2, "broadcast_rows": 0}])
def test_batch_equals_loop(spark, world, options):
    rows, requests = world
    frames = batch_frames(spark, requests)
    answers = rb.relax_batch(
        spark.createDataFrame(rows, SCHEMA), *frames, key="key", price="price", **options
    )
    got = {
        r["request_id"]: (r["level"], [x["key"] for x in r["rows"] or []])
        for r in answers.collect()
    }
    wanted = {}
    for i, (conds, labels) in enumerate(requests):
        steps, found = literal_loop(rows, conds, labels)
        wanted[i] = (steps, best(found, 3))
    assert got == wanted
    # Every outcome is met: kept as it is, given up partly, nothing left.
    assert {0, 1, 2} <= {lv for lv, _ in wanted.values()}
    assert any(not keys for _, keys in wanted.values())


def one_sided(request):
    """Only bounds from one side, another one for each of the two numeric columns."""
    conds, labels = request
    sided = {"size": "<=", "price": ">"}
    return [
        Condition(c.column, sided[c.column], c.value[0] if isinstance(c.value, tuple) else c.value)
        if c.column in sided and c.value != ()
        else c
        for c in conds
        if c.column not in sided or c.value != ()
    ], labels


LEVELS_BY = {
    "listed": {},
    "ranked": {"inline_constants": 2, "broadcast_rows": 0},
    "walked": {"probe_bytes": 3000},
    "one-sided": {},
}


@pytest.mark.parametrize("how", LEVELS_BY)
def test_levels_without_rows_equal_loop(spark, world, monkeypatch, how):
    if how == "walked":
        monkeypatch.setattr(rb, "LISTED_AXES", 0)
    rows, requests = world
    if how == "one-sided":
        requests = [one_sided(r) for r in requests]
    # A hot row many times over, and neither key nor price among the columns.
    catalog = spark.createDataFrame(rows + rows[:1] * 500, SCHEMA).drop("key")
    got = rb.relax_levels(catalog, *batch_frames(spark, requests), **LEVELS_BY[how])
    wanted = {}
    for i, (conds, labels) in enumerate(requests):
        steps, found = literal_loop(rows, conds, labels)
        wanted[i] = (steps, not found)
    assert {r["request_id"]: (r["level"], r["is_empty"]) for r in got.collect()} == wanted


def test_levels_without_catalog_conditions_or_requests(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "b", None, None, 2.0)], SCHEMA)
    free = batch_frames(spark, [([], ["brand"])])
    asked = batch_frames(spark, [([Condition("brand", "=", "b")], ["brand"])])

    def levels(catalog, frames):
        return [(r["level"], r["is_empty"]) for r in rb.relax_levels(catalog, *frames).orderBy("request_id").collect()]

    assert levels(none, free) == [(1, True)] and levels(some, free) == [(0, False)]
    assert levels(none, asked) == [(1, True)] and levels(some, asked) == [(0, False)]
    assert levels(some, [f.limit(0) for f in asked]) == []
    # One column, bounded from one side, whose conditions are given up.
    bounded = batch_frames(spark, [([Condition("size", "<=", 3)], ["size"]), ([Condition("price", ">", 2)], [])])
    assert levels(none, bounded) == [(1, True), (0, True)] and levels(some, bounded) == [(1, False), (0, True)]
    sided = batch_frames(spark, [([Condition("price", ">=", 2)], []), ([Condition("price", ">", 2)], ["price"])])
    assert levels(some, sided) == [(0, False), (1, False)] and levels(none, sided) == [(0, True), (1, True)]


@pytest.mark.parametrize("probe_bytes", [300, 2_000_000])
def test_comparing_cells_with_probes_equals_loop(spark, world, monkeypatch, probe_bytes):
    monkeypatch.setattr(rb, "LISTED_AXES", 0)
    monkeypatch.setattr(rb, "_search", None)  # not called
    rows, requests = world
    frames = batch_frames(spark, requests[:40])
    answers = rb.relax_batch(
        spark.createDataFrame(rows, SCHEMA), *frames, key="key", price="price", probe_bytes=probe_bytes * 10
    )
    for r in answers.collect():
        steps, found = literal_loop(rows, *requests[r["request_id"]])
        assert (r["level"], [x["key"] for x in r["rows"] or []]) == (steps, best(found, 3))


def test_index_finds_what_a_scan_finds_and_compares_few_cells():
    rng = np.random.default_rng(7)
    size = 20_000
    columns = {
        0: rng.integers(-1, 5000, size),
        1: rng.integers(-1, 40, size),
        2: rng.integers(0, 900, size),
        3: np.array([None, "a", "b", "c"], object)[rng.integers(0, 4, size)],
    }
    index, probes = CellIndex(size, columns), 0
    for _ in range(300):
        probe = []
        for axis in range(3):
            low = int(rng.integers(-10, 5000) if axis == 0 else rng.integers(-2, 900))
            points = tuple(rng.integers(0, 60, 3).tolist()) if axis == 1 and rng.random() < 0.5 else None
            if rng.random() < 0.8:
                probe.append(Wish(axis, low, low + int(rng.integers(-3, 800)), points))
        if rng.random() < 0.3:
            probe.append(Wish(3, None, None, ("a", "z") if rng.random() < 0.5 else ()))
        hits = np.ones(size, bool)
        for w in probe:
            have = columns[w.axis]
            if w.low is None:
                hits &= np.isin(have.astype(str), w.points) & (have != None)  # noqa: E711
            else:
                hits &= (have >= w.low) & (have <= w.high) & (have >= 0)
                hits &= np.isin(have, w.points) if w.points is not None else True
        assert index.first(probe, 3) == np.flatnonzero(hits)[:3].tolist()
        probes += 1
    assert index.compared * 10 < size * probes
    assert CellIndex(0, {0: np.array([], np.int64)}).first([Wish(0, 0, 9, None)], 3) == []


RANGE_SCHEMA = "key long, big long, exact decimal(30,4), day date, at timestamp, word string, price double"


@pytest.mark.parametrize("options", [{}, {"inline_constants": 2, "broadcast_rows": 0}])
def test_ranges_of_every_type_equal_one_request_each(spark, options):
    rng = random.Random(21)
    bigs = [9007199254740991 + i for i in range(5)] + [-(2**63), 2**63 - 1, 7, None]
    exacts = [Decimal("12345678901234567890.1234"), Decimal("12345678901234567890.1235"), Decimal("0.5"), None]
    days = [date(2020, 1, d) for d in range(1, 9)] + [None]
    times = [datetime(2020, 1, 1, 0, 0, 0, i) for i in range(4)] + [None]
    words = ["", "a", "ab", "B", "é", "zz", None]
    pools = {"big": bigs, "exact": exacts, "day": days, "at": times, "word": words}
    rows = [(i, *[rng.choice(p) for p in pools.values()], float(rng.randint(0, 9))) for i in range(60)]
    catalog = spark.createDataFrame(rows, RANGE_SCHEMA).cache()
    requests = []
    for _ in range(24):
        conds = []
        for name in rng.sample(list(pools), rng.randint(1, 4)):
            op = rng.choice(["=", "<=", ">=", "<", ">", "between", "in"])
            pick = lambda: rng.choice([v for v in pools[name] if v is not None])  # noqa: E731, B023
            value = (pick(), pick()) if op in ("between", "in") else pick()
            conds.append(Condition(name, op, value))
        requests.append((conds, rng.sample(list(pools), rng.randint(0, 5))))
    answers = rb.relax_batch(catalog, *batch_frames(spark, requests), key="key", price="price", n=100, **options)
    got = {r["request_id"]: (r["level"], {x["key"] for x in r["rows"] or []}) for r in answers.collect()}
    for i, (conds, labels) in enumerate(requests):
        single = relax_single(catalog, conds, labels)
        assert got[i] == (single.level, {r["key"] for r in single.rows.select("key").collect()})


def test_numbers_beyond_the_column(spark):
    catalog = spark.createDataFrame([(1, 2**63 - 1, 1.0), (2, -5, 2.0)], "key long, big long, price double")
    asked = [([Condition("big", op, v)], []) for op, v in (("<=", "1e300"), (">", "-1e300"), ("=", "9007199254740993.5"))]
    got = rb.relax_batch(catalog, *batch_frames(spark, asked), key="key", price="price").orderBy("request_id").collect()
    assert [[x["key"] for x in r["rows"] or []] for r in got] == [[1, 2], [1, 2], []]


def test_folded_texts(spark):
    rows = [(1, "Yes", 1.0), (2, " yes", 2.0), (3, "ADD  on\tdata ", 3.0), (4, "No", 4.0), (5, None, 5.0)]
    catalog = spark.createDataFrame(rows, "key long, t string, price double")
    asked = {("=", "YES "): [1, 2], ("in", ("yes", "add on  data")): [1, 2, 3], ("~", " Add on  dat"): [3], ("=", "Ye s"): []}
    requests = [([Condition("t", op, v, folded=True)], []) for op, v in asked]
    answers = rb.relax_batch(catalog, *batch_frames(spark, requests), key="key", price="price", payload=["t"], folded=["t"])
    got = {r["request_id"]: [(x["key"], x["t"]) for x in r["rows"] or []] for r in answers.collect()}
    shown = {k: t for k, t, _ in rows}
    for i, ((conds, _), keys) in enumerate(zip(requests, asked.values())):
        assert got[i] == [(k, shown[k]) for k in keys]
        assert sorted(r["key"] for r in catalog.where(conjunction(conds)).collect()) == keys
    plain = rb.relax_batch(catalog, *batch_frames(spark, requests[:1]), key="key", price="price").first()
    assert plain["rows"] is None


def test_unreadable_values_become_errors(spark):
    schema = spark.createDataFrame([], "key long, big long, day date, t string").schema
    constraints = spark.createDataFrame(
        [(1, 0, "big", "=", ["abc"]), (2, 0, "big", "between", ["1"]), (3, 0, "day", ">=", ["soon"]),
         (4, 0, "day", "<", ["2020-01-01"]), (5, 0, "t", ">=", ["a"]), (6, 0, "big", "between", None), (7, 0, "big", "in", [])],
        "request_id long, ord int, col string, op string, values array<string>",
    )
    valid, errors = rb.split_requests(constraints, schema.names, schema)
    assert sorted(r["request_id"] for r in valid.collect()) == [4, 7]
    assert {r["request_id"]: r["error"].split(":")[0] for r in errors.collect()} == {
        1: "unreadable value for column", 2: "between needs two values", 3: "unreadable value for column",
        5: ">= does not suit column", 6: "between needs two values",
    }
    valid, _ = rb.split_requests(constraints, schema.names, schema, text_ranges=True)
    assert sorted(r["request_id"] for r in valid.collect()) == [4, 5, 7]


def test_cells_are_listed_for_asked_columns_only(spark, world, monkeypatch):
    rows, _ = world
    made = []
    original = rb._node_rows
    monkeypatch.setattr(rb, "_node_rows", lambda *args: made.append(original(*args)) or made[-1])
    asked = [([Condition("size", "<=", 5)], []), ([Condition("price", "=", 2.0)], [])]
    rb.relax_batch(spark.createDataFrame(rows, SCHEMA), *batch_frames(spark, asked), key="key", price="price")
    nodes = [r["node"] for r in made[0].collect()]
    assert nodes and all(node.count("*") == 1 for node in nodes)


def test_batch_levels_name_dropped_labels(spark, world):
    rows, requests = world
    frames = batch_frames(spark, requests)
    answers = rb.relax_batch(
        spark.createDataFrame(rows, SCHEMA), *frames, key="key", price="price"
    )
    for r in rb.batch_levels(answers, frames[2]).collect():
        conds, labels = requests[r["request_id"]]
        steps, found = literal_loop(rows, conds, labels)
        assert (r["level"], r["dropped"], r["is_empty"]) == (
            steps,
            ",".join(labels[:steps]),
            not found,
        )


def test_no_conditions_at_all(spark, world):
    rows, _ = world
    frames = batch_frames(spark, [([], ["brand"]), ([], [])])
    answers = rb.relax_batch(
        spark.createDataFrame(rows, SCHEMA), *frames, key="key", price="price"
    )
    for r in answers.collect():
        assert (r["level"], [x["key"] for x in r["rows"]]) == (0, best(rows, 3))


def test_repeated_label_uses_a_step():
    assert label_ranks(["a", "b", "a", "c"]) == {"a": 1, "b": 2, "c": 4}
    conds = (Condition("a", "=", 1), Condition("b", "=", 2), Condition("a", ">", 0))
    assert drop_conditions_on(conds, ["a"]) == (conds[1],)


def test_bad_requests_become_errors(spark):
    constraints = spark.createDataFrame(
        [(1, 0, "brand", "=", ["x"]), (2, 0, "colour", "=", ["x"]), (3, 0, "size", "like", ["1"])],
        "request_id long, ord int, col string, op string, values array<string>",
    )
    valid, errors = rb.split_requests(constraints, ["key", *COLUMNS])
    assert [r["request_id"] for r in valid.collect()] == [1]
    assert {r["request_id"]: r["error"] for r in errors.collect()} == {
        2: "unknown column: colour",
        3: "unknown operator: like",
    }


def test_operators_that_do_not_suit_a_column_become_errors(spark):
    catalog = spark.createDataFrame([(1, "Yes", 2.0)], "key long, combined string, price double")
    constraints = spark.createDataFrame(
        [(1, 0, "combined", ">=", ["20"]), (2, 0, "price", ">=", ["1"]), (3, 0, "price", "~", ["1"])],
        "request_id long, ord int, col string, op string, values array<string>",
    )
    valid, errors = rb.split_requests(constraints, catalog.columns, catalog.schema)
    assert [r["request_id"] for r in valid.collect()] == [2]
    assert {r["request_id"]: r["error"] for r in errors.collect()} == {
        1: ">= does not suit column: combined",
        3: "~ does not suit column: price",
    }


def test_text_compared_with_a_number(spark):
    catalog = spark.createDataFrame([(1, "Yes", 5), (2, "30", 5), (3, None, 9007199254740993)], "key long, combined string, n long")
    kept = catalog.where(conjunction([Condition("combined", ">=", 20)]))
    assert [r["key"] for r in kept.collect()] == [2]
    assert [r["key"] for r in catalog.where(conjunction([Condition("n", "=", 9007199254740993)])).collect()] == [3]
    assert catalog.where(conjunction([Condition("n", "=", 9007199254740992)])).count() == 0


def test_rendered_query_keeps_order(spark):
    constraints = spark.createDataFrame(
        [
            (1, 2, "size", "between", ["1", "5"]),
            (1, 1, "brand", "in", ["x", "y"]),
            (1, 3, "price", "<=", ["9"]),
        ],
        "request_id long, ord int, col string, op string, values array<string>",
    )
    text = rb.render_queries(constraints).first()["query"]
    assert text == "brand in (x, y) AND size between 1 and 5 AND price <= 9"


def test_batch_plan_trims_before_the_exchange(spark, world):
    rows, requests = world
    frames = batch_frames(spark, requests)
    seen = []
    original = rb._search
    rb._search = lambda nodes, *rest: seen.append(nodes) or original(nodes, *rest)
    try:
        rb.relax_batch(spark.createDataFrame(rows, SCHEMA), *frames, key="key", price="price")
    finally:
        rb._search = original
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert word not in plan


def test_single_plan_pushes_surviving_conditions(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    found = relax_single(
        part, [Condition("p_type", "=", "TINY"), Condition("p_size", "<=", 9)], ["p_type", "p_size"]
    )
    plan = found.rows.select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(p_size,9)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_close_values_equal_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 13))) for _ in range(120)]
    values, wanted = sorted(set(words[:60])), sorted(set(words[60:]) | {"", "a", "abcabc"})
    got = close_values(
        spark.createDataFrame([(v,) for v in values], "value string"),
        spark.createDataFrame([(w,) for w in wanted], "text string"),
    )
    assert {(r["text"], r["value"]) for r in got.collect()} == {
        (w, v) for w in wanted for v in values if close(v, w)
    }
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
