"""Near copies by MinHash against sets compared pair by pair."""

from __future__ import annotations

import random

import numpy as np

from planmatch.llm import minhash as M


def shingles(text, width=4):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = folded.encode().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain(docs, width=4, share=(4, 5)):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both * share[1] >= (len(a) + len(sets[j]) - both) * share[0]:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    rows = []
    for i, (doc_id, _) in enumerate(docs):
        c = least.get(find(i)) if sets[i] else doc_id
        rows.append((doc_id, len(sets[i]), c, doc_id == c))
    return rows


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, v or 0) for v in r))


def corpus(rng):
    words = [f"w{i}" for i in range(900)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    docs, passage = [], prose(60)
    for base in range(12):  # copies with a few words changed, chains of them
        text = prose(rng.randrange(30, 200))
        for _ in range(rng.randrange(2, 12)):
            docs.append(list(text))
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
    docs += [prose(rng.randrange(1, 60)) for _ in range(40)]
    docs += [passage + prose(15) for _ in range(30)]  # alike, not similar enough
    texts = [" ".join(d) for d in docs]
    texts += [texts[0]] * 20 + [texts[3].upper(), texts[4].replace(" ", " \n"), None, "", "  ", None, "one", "One", "a b c", "a b d"]
    return texts


def test_against_all_pairs(rows_of):
    texts = corpus(random.Random(4))
    docs = list(enumerate(texts)) + [(None, texts[1]), (None, "nobody else says this at all"), (7, texts[30]), (None, None)]
    asked = rows_of("doc_id long, text string, node string, n long, root string", [(i, t, "x", 1, "y") for i, t in docs], 5)
    got = M.near_sets(asked).select("doc_id", "n_shingles", "component_id", "kept")
    assert order(got.collect()) == order(plain(docs))


def test_empty_table_and_long_text(rows_of):
    none = rows_of("doc_id long, text string", [])
    assert M.near_sets(none).count() == 0
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000))
    docs = [(1, long), (2, long + " end"), (3, "same " * 200_000), (4, "same " * 10)]
    got = M.near_sets(rows_of("doc_id long, text string", docs))
    assert order(got.collect()) == order(plain(docs))


def test_estimate_follows_similarity():
    rng = np.random.default_rng(8)
    multipliers = M._multipliers(M.WIDE)
    for share in (0.0, 0.5, 0.8, 0.95):
        pool = rng.integers(0, 1 << 64, 2000, np.uint64)
        cut = int(round(2000 * (1 - share) / 2))  # the ends that one of two lacks
        a, b = pool[: 2000 - cut], pool[cut:]
        x = M.packed(M.minima(a, multipliers)) ^ M.packed(M.minima(b, multipliers))
        differ = sum(((int(v) | int(v) >> 1) & M._EVEN_BITS).bit_count() for v in x)
        assert abs(M.similarity(M.WIDE - differ, M.WIDE) - (2000 - 2 * cut) / 2000) < 0.05


def pairs_met(spark, rows_of, n):
    """Pairs that reach whole sets, for n texts alike only in a passage."""
    rng = random.Random(n)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(25))) for i in range(n)]
    table = rows_of("doc_id long, text string", docs)
    nodes = M.materialise(
        M.signatures(table, "doc_id", "text", 4).select("node", "size", "keys", "bits"), "nodes"
    )
    members = M._members(nodes)
    star = M._with_hub(members, M.SHARE).distinct().count()
    roots = spark.createDataFrame([], "node binary, root binary")
    return star + M._across(table, members, nodes, roots, "text", 4, M.SHARE).count()


def test_shared_passages_make_no_pairs(spark, rows_of):
    met = [pairs_met(spark, rows_of, n) for n in (100, 200, 400)]
    assert all(m <= n // 10 for m, n in zip(met, (100, 200, 400))), met
