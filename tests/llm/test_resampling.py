"""Resampling against a plain recomputation."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np

from planmatch.llm import resampling as R

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = WORD.findall(raw)
    return words, words + [a + b" " + b for a, b in zip(words, words[1:])]


def plain(docs, target, percent=25, least=20):
    s, t = [0] * 10000, [0] * 10000
    for text in (x for _, x in docs):
        for f in features(text)[1]:
            s[zlib.crc32(f) % 10000] += 1
    for text in target:
        for f in features(text)[1]:
            t[zlib.crc32(f) % 10000] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, met = features(text)
        weight = sum(gain[zlib.crc32(f) % 10000] for f in met) // len(met) if met else 0
        shown = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"7:{shown}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words), len(met), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2], r[3]))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = place
    return rows


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, v or 0) for v in r))


def test_against_plain(rows_of):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "über", "x1", "0", "日本"] + [f"w{i}" for i in range(200)]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(n))

    docs = [(i, prose(rng.randrange(60))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (None, prose(30)), (None, prose(30)), (5, docs[5][1]), (203, "same " * 70000)]
    docs += [(300 + i, docs[7][1]) for i in range(40)]
    target = [prose(50) for _ in range(4)] + [None, ""]
    asked = rows_of("doc_id long, text string, score string, place int", [(i, t, "x", 1) for i, t in docs], 5)
    got = R.resample(asked, rows_of("item_id long, text string", list(enumerate(target))))
    assert order(got.collect()) == order(plain(docs, target))


def test_empty_tables(rows_of):
    none = rows_of("doc_id long, text string", [])
    some = rows_of("doc_id long, text string", [(1, "a " * 30), (2, "b " * 30), (3, "c"), (4, "d " * 25), (5, "e " * 21)])
    assert R.resample(none, some).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in some.collect()]
    assert order(R.resample(some, none).collect()) == order(plain(docs, []))


def test_bit_slices_add_up():
    rng = np.random.default_rng(2)
    gains = rng.integers(-9000, 9000, 10000)
    for counts in (rng.integers(0, 5, 10000), np.zeros(10000, np.int64), rng.integers(0, 1 << 40, 10000)):
        want = sum(int(g) * int(c) for g, c in zip(gains, counts))
        assert R.GainPlanes(gains).dot(counts) == want
