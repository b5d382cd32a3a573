"""The registered queries: SQL twins, archives, held-out accuracy and the pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import pytest
from compare import connect, differences

import corpus_pipeline
from planmatch.llm import queries as llm
from planmatch.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from planmatch.llm.warc import make_archive, read_archive, read_archives, write_archives, write_record


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_same_result(spark, sf_dir, name):
    assert differences(llm.QUERIES[name](spark, sf_dir), connect(sf_dir), llm.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLE)))
def test_a_row_for_every_document(spark, sf_dir, name):
    key, table = ("vec_id", "embeddings") if name == "op11_whitening" else ("doc_id", "documents")
    found = llm.QUERIES[name](spark, sf_dir).select(key).distinct().count()
    assert found == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


# -- archives -----------------------------------------------------------------------


def test_archives_hold_every_page(rows_of, spark, tmp_path):
    body = "<p>payload</p>" * 20
    pages = [(i, f"http://h/{i}", body if i % 3 == 0 else f"{body}{i}", "x") for i in range(200)]
    pages += [(300, None, None, "x"), (301, "http://a\r\nb/é", "", "x"), (302, "u", "short", "x"), (303, "u", "short", "x"),
              (304, "u", "y" * 300_000, "x"), (None, "u", body, "x"), (0, "again", body, "x")]
    folder = f"file://{tmp_path}/warc"
    (tmp_path / "warc").mkdir()
    source = rows_of("page_id long, url string, html string, digest string", pages)
    assert sum(r["records"] for r in write_archives(source, folder, archive_bytes=20_000).collect()) == len(pages)
    found = read_archives(spark, folder).collect()
    assert {r["error"] for r in found} == {None}
    want = Counter()
    for page, _, html, _ in pages:
        raw = (html or "").encode()
        revisit = html == body and page != 0
        want[(f"<urn:x-page:{page}>", len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
              "<urn:x-page:0>" if revisit else None, None if revisit else raw)] += 1
    assert want == Counter((r["name"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                            None if r["payload"] is None else bytes(r["payload"])) for r in found)


def test_damaged_archives_are_told():
    record = write_record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
    good = make_archive([record] * 3)
    assert [r[7] for r in read_archive(good)] == [None] * 3
    assert [r[7] is None for r in read_archive(good[:-5])] == [True, True, False]
    wrong = [record.replace(b"Content-Length: ", b"Content-Length: 1", 1), record.replace(b"WARC/1.1", b"WARC/9.9"),
             record.replace(b"xx\r\n\r\n", b"xy\r\n\r\n"), record.replace(b"WARC-Date", b"WARC-Dote"), record]
    assert [r[7] is None for r in read_archive(make_archive(wrong))] == [False] * 4 + [True]
    assert [r[7] is None for r in read_archive(b"rubbish rubbish")] == [False]
    assert list(read_archive(b"")) == []


def test_archives_of_other_writers():
    import base64

    import zstandard

    def record(kind, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Length: {len(block)}", *more]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npayload"
    sha1 = "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    records = [record("warcinfo", b"software: x"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("metadata", b""),
               record("response", http, "Content-Type: application/http; msgtype=response"), record("response", http, sha1),
               record("response", http[:-1] + b"!", sha1), record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", sha1)]
    shared = b"".join(records)
    packed = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    words = packed.compress(shared) + packed.flush()
    found = []
    for lead, extra in ((b"", {}), ((0x184D2A5D).to_bytes(4, "little") + len(words).to_bytes(4, "little") + words, {"dict_data": zstandard.ZstdCompressionDict(shared)})):
        frames = b""
        for r in records:
            stream = zstandard.ZstdCompressor(write_content_size=False, **extra).compressobj()
            frames += stream.compress(r) + stream.flush()
        found.append(list(read_archive(lead + frames)))
    assert found[0] == found[1]
    assert [r[0] for r in found[0]] == ["warcinfo", "request", "metadata", "response", "response", None, "revisit"]
    assert [r[6] for r in found[0]] == [b"software: x", b"GET / HTTP/1.1\r\n\r\n", b"", b"payload", b"payload", None, None]
    assert [r[7] is None for r in found[0]] == [True] * 5 + [False, True]
    assert found[0][0][8].startswith("WARC/1.0\r\nWARC-Type: warcinfo")


# -- toxicity -----------------------------------------------------------------------


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    llm.op4_toxicity(spark, sf).createOrReplaceTempView("scored")
    labels = {r[0]: r[1] for r in duckdb.execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()}
    rows = [(labels[r["doc_id"]], r["predicted"]) for r in spark.table("scored").where("held_out").collect() if r["doc_id"] in labels]
    hit = sum(1 for y, p in rows if y and p)
    assert hit / sum(y for y, _ in rows) > 0.75
    assert hit / max(1, sum(p for _, p in rows)) > 0.75


def test_toxicity_of_odd_tables(rows_of, spark):
    docs = rows_of("doc_id long, text string, score string", [(i, t, "x") for i, t in enumerate([None, "", "a", "é" * 3000, "vile " * 50] * 4)])
    labels = rows_of("doc_id long, toxic int, lang string", [(i, int(i % 5 == 4), "x") for i in range(20)] + [(None, 1, "x"), (3, None, "x"), (2, 0, "y")])
    model = fit_toxicity(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert len(scores) == 20 and all(0 <= s <= 1 for s in scores.values())
    assert scores[4] > 0.5 > scores[3]
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["score"] < 0.01 for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()} == {True}
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_of_a_small_balanced_table(rows_of):
    clean = [f"a calm walk by the river number {i} in the morning" for i in range(12)]
    toxic = [f"you vile filthy scum number {i} get lost" for i in range(12)]
    docs = rows_of("doc_id long, text string", list(enumerate(clean + toxic + ["the calm river in the morning", "vile filthy scum"])))
    labels = rows_of("doc_id long, toxic int", [(i, int(i >= 12)) for i in range(24)])
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    assert all((scores[i] >= THRESHOLD) == (12 <= i < 24 or i == 25) for i in range(26))


# -- pipeline -----------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        now = {r["doc_id"]: r for r in docs.collect()}
        assert set(now) <= set(before) and len(now) > len(before) // 2
        if name != "passage_dedup":
            assert all(now[k] == before[k] for k in now)
        else:
            assert all(len(now[k]["text"] or "") <= len(before[k]["text"] or "") for k in now)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(before)
