"""Reply parsing, predicates and chunking edges."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from planmatch.functions.covers import ancestors, depth_for, interval_cover
from planmatch.functions.predicates import (
    Condition,
    close_to,
    conjunction,
    limited,
    normalise_category,
    predicate,
    violated,
)
from planmatch.functions.text import SENTENCE, last_bracket_slice, parse_name_list
from planmatch.operators import chunking
from planmatch.sources.replies import classifier_relevance, column_lists


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Cols: ['a', 'b']", "['a', 'b']"),
        ("see [1] then ['x','y'] ok", "['x','y']"),
        ("[['n','m']]", "['n','m']]"),
        ("none", None),
        ("] then [", ""),
    ],
)
def test_slices(spark, text, expected):
    assert one(spark, last_bracket_slice(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("['a', 'b']", ["a", "b"]),
        ('["it\'s", \'GCC & Local\',]', ["it's", "GCC & Local"]),
        (r"['it\'s']", ["it's"]),
        ("[]", []),
        ("['n','m']]", None),
        ("", None),
        ("[1]", None),
        ("['a' 'b'", None),
        ("['a' 'b']", None),
        ("['', '', ]", ["", ""]),
        ("[,'a']", None),
        ("['a',,'b']", None),
        ("['a',,]", None),
        ("[ ]", []),
        (" ['a']", None),
        ("['a\", 'b']", None),
        ("[\"a'b\", '\"']", ["a'b", '"']),
    ],
)
def test_name_lists(spark, text, expected):
    assert one(spark, parse_name_list(F.col("t")), t=text) == expected


def test_bad_replies_are_set_aside(spark):
    replies = spark.createDataFrame(
        [(1, "use ['a']"), (2, "no list"), (3, None)], "request_id long, reply string"
    )
    got = {r["request_id"]: (r["names"], r["bad"]) for r in column_lists(replies, "reply").collect()}
    assert got == {1: (["a"], False), 2: (None, True), 3: (None, True)}


def test_classifier_reply_first_element(spark):
    text = '[{"labels":["a","b"],"scores":[0.9,0.1]},{"labels":["z"],"scores":[1.0]}]'
    replies = spark.createDataFrame([(1, text), (2, "[]"), (3, "oops")], "request_id long, reply string")
    got = sorted(map(tuple, classifier_relevance(replies, "reply").collect()))
    assert got == [(1, "a", 0.9), (1, "b", 0.1)]


def test_very_long_names(spark):
    names = ["x" * 100_000, "it" + "y" * 50_000]
    assert one(spark, parse_name_list(F.col("t")), t=str(names)) == names
    assert one(spark, parse_name_list(F.col("t")), t=str(names)[:-2]) is None


def test_very_many_names(spark):
    names = [f"column {i}" for i in range(200_000)]
    assert one(spark, parse_name_list(F.col("t")), t=str(names)) == names
    assert one(spark, parse_name_list(F.col("t")), t=str(names)[:-2]) is None


def test_names_with_blanks_and_brackets(spark):
    df = spark.createDataFrame([(24,), (8,), (None,)], "`Local Data(GB)` long")
    cond = Condition("Local Data(GB)", ">=", 20)
    assert [r[0] for r in df.where(conjunction([cond])).collect()] == [24]
    assert df.where(violated(cond)).count() == 2
    assert df.where(conjunction([])).count() == 3


def test_every_operator(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "v int")
    cases = {("=", 2): [2], ("<", 2): [0, 1], (">", 3): [4, 5], ("between", (1, 2)): [1, 2], ("in", (0, 5)): [0, 5]}
    for (op, value), wanted in cases.items():
        assert [r[0] for r in df.where(predicate(Condition("v", op, value))).collect()] == wanted
    with pytest.raises(ValueError):
        Condition("v", "like", "x")


def test_categories(spark):
    assert one(spark, normalise_category(F.col("c")), c=" Add On  Data ") == "add on data"
    assert one(spark, close_to(F.col("c"), "Regular"), c="regulat ")
    assert one(spark, close_to(F.col("c"), "Data"), c="Data Top up")
    assert not one(spark, close_to(F.col("c"), "Regular"), c="Top up")
    df = spark.createDataFrame([(99999999,), (20,)], "v long")
    assert df.select(F.avg(limited(F.col("v")))).first()[0] == 20


def test_cover_is_exact_and_disjoint(spark):
    cells = 21
    depth = depth_for(cells)
    pairs = spark.createDataFrame(
        [(a, b) for a in range(cells) for b in range(-1, cells)], "low int, high int"
    )
    nodes = pairs.select("low", "high", interval_cover(F.col("low"), F.col("high"), depth).alias("n"))
    up = spark.range(cells).select(
        F.col("id").cast("int").alias("c"), ancestors(F.col("id").cast("int"), depth).alias("u")
    )
    above = {r["c"]: r["u"] for r in up.collect()}
    for r in nodes.collect():
        assert len(r["n"]) <= 2 * depth
        for c in range(cells):
            hits = len(set(above[c]) & set(r["n"]))
            assert hits == (1 if r["low"] <= c <= r["high"] else 0)


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_static_windows_cover_everything(spark):
    words = [f"w{i}" for i in range(25)]
    got = chunking.chunk_static(documents(spark, " ".join(words), "", "one"), 10, 3).collect()
    mine = [r["chunk_text"].split(" ") for r in sorted(got, key=lambda r: r["chunk_no"]) if r["doc_id"] == 0]
    assert [len(c) for c in mine] == [10, 10, 10, 4]
    assert all(a[-3:] == b[:3] for a, b in zip(mine, mine[1:]))
    assert mine[-1][-1] == "w24"
    assert {(r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"]} == {(1, 0), (2, 1)}
    with pytest.raises(ValueError):
        chunking.chunk_static(documents(spark, "x"), 3, 3)


def expected_sentences(text, size, overlap):
    pieces = []
    for words in (p.split() for p in re.findall(SENTENCE, text)):
        pieces += [words[i : i + size] for i in range(0, len(words), size)]
    chunks, held = [], []
    for piece in pieces:
        if sum(map(len, held)) + len(piece) > size:
            chunks.append(held)
            room = min(overlap, size - len(piece))
            while held and sum(map(len, held)) > room:
                held = held[1:]
        held = held + [piece]
    return [" ".join(w for p in c for w in p) for c in [*chunks, held]]


def test_sentences_fill_chunks(spark, monkeypatch):
    random.seed(11)
    texts = ["", " ... ", "one", "a b. " * 40, "word " * 57]
    for _ in range(40):
        lengths = [random.choice([0, 1, 2, 3, 5, 8, 25]) for _ in range(random.randint(1, 60))]
        texts.append(" ".join(" ".join(f"w{random.randint(0, 99)}" for _ in range(n)) + "." for n in lengths))
    for at_once, size, overlap in ((1_000, 10, 4), (3, 10, 0), (7, 12, 11)):
        monkeypatch.setattr(chunking, "PIECES_AT_ONCE", at_once)
        rows = chunking.chunk_sentences(documents(spark, *texts), size, overlap).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_no"])):
            assert r["n_tokens"] == len(r["chunk_text"].split()) <= size
            got.setdefault(r["doc_id"], []).append(r["chunk_text"])
        assert got == {i: expected_sentences(t, size, overlap) for i, t in enumerate(texts)}
    assert chunking.chunk_sentences(documents(spark, "x").where("false")).count() == 0
    assert chunking.chunk_sentences(documents(spark, "x", None)).count() == 1
    with pytest.raises(ValueError):
        chunking.chunk_sentences(documents(spark, "x"), 3, 3)


def test_sentences_of_a_very_long_document(spark):
    text = "".join(f"Sentence {i} about item{i % 97} here. " for i in range(60_000))
    start = time.time()
    got = chunking.chunk_sentences(documents(spark, text), 20, 5).agg(F.count("*"), F.max("n_tokens")).first()
    # Four sentences of five words, the last of which comes again.
    assert tuple(got) == (20_000, 20)
    assert time.time() - start < 60


def expected_semantic(text, percentile, buffer):
    parts = re.findall(SENTENCE, text)
    words = [set(p.lower().split()) for p in parts]
    groups = [set().union(*words[max(0, i - buffer) : i + buffer + 1]) for i in range(len(parts))]
    dist = [1 - len(a & b) / len(a | b) if a | b else 0.0 for a, b in zip(groups, groups[1:])]
    if not parts:
        return [""]
    if not dist:
        return [text]
    place = percentile / 100 * (len(dist) - 1)
    low, high = sorted(dist)[int(place)], sorted(dist)[-int(-place // 1)]
    cut = low + (high - low) * (place - int(place))
    chunks, current = [], parts[0]
    for d, p in zip(dist, parts[1:]):
        if d > cut:
            chunks.append(current)
            current = ""
        current += p
    return [*chunks, current]


@pytest.mark.parametrize("buffer", [0, 1, 2])
def test_semantic_equals_definition(spark, sf_dir, buffer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in chunking.chunk_semantic(docs, 80.0, buffer).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk_text"])
    assert got == {d: expected_semantic(t, 80.0, buffer) for d, t in texts.items()}
    assert all("".join(c) == texts[d] for d, c in got.items())


def test_semantic_edges(spark):
    got = chunking.chunk_semantic(documents(spark, "One sentence only.", "", "no end mark")).collect()
    assert sorted((r["doc_id"], r["chunk_text"]) for r in got) == [
        (0, "One sentence only."),
        (1, ""),
        (2, "no end mark"),
    ]


def test_semantic_on_vectors(spark):
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]]
    docs = spark.createDataFrame(
        [(1, "A. B. C. D.", vectors)], "doc_id long, text string, v array<array<double>>"
    )
    got = [r["chunk_text"] for r in chunking.chunk_semantic(docs, 60.0, vectors="v").collect()]
    assert got == ["A. B. ", "C. D."]


def test_guard_scopes(spark):
    long = " ".join(["word"] * 30) + "."
    docs = spark.createDataFrame(
        [(1, "b1", long), (2, "b1", "Short one. Other two."), (3, "b2", "Short one. Other two."), (4, None, "Alone.")],
        "doc_id long, batch string, text string",
    )

    def texts(batch):
        out = {}
        for r in chunking.chunk_guarded(docs, 10, overlap=2, batch=batch).collect():
            out.setdefault(r["doc_id"], []).append(r["chunk_text"])
        return out

    by_doc, by_batch = texts(None), texts("batch")
    assert len(by_doc[1]) == len(by_batch[1]) == 4
    assert by_doc[2] == by_doc[3] == by_batch[3]
    # The oversized neighbour re-chunks the whole batch from the original text.
    assert by_batch[2] == ["Short one. Other two."]
    assert by_doc[4] == by_batch[4] == ["Alone."]


def test_one_very_long_document_stays_linear(spark):
    text = "".join(f"Sentence {i} about item{i % 97} here. " for i in range(60_000))
    docs = documents(spark, text)
    start = time.time()
    got = chunking.chunk_semantic(docs).agg(F.count("*"), F.sum(F.length("chunk_text"))).first()
    assert got[1] == len(text)
    assert time.time() - start < 60


def test_chunking_never_moves_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (chunking.chunk_semantic(docs), chunking.chunk_static(docs), chunking.chunk_sentences(docs), chunking.chunk_guarded(docs, 200)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
