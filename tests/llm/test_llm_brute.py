"""Every operator against a plain re-computation on small, awkward tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from planmatch.llm.decontaminate import benchmark_passages, without_benchmark
from planmatch.llm.packing import best_fit_plan, pack
from planmatch.llm.quality import RULES, plan_cascade, quality_cascade, repeated_words
from planmatch.llm.queries import TOKENIZER, URL_RULES
from planmatch.llm.sharding import byte_shards
from planmatch.llm.simhash import components, links, near_copies, one_of_each
from planmatch.llm.suffix_dedup import repeated_passages
from planmatch.llm.token_cache import count_tokens
from planmatch.llm.tokens import PieceEncoder
from planmatch.llm.url_filter import GlobSet, filter_urls

DOCS = "doc_id long, text string, lang string, fp string, spans string, `k0` int"


def awkward(seed: int, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(k))

    shared = [prose(40) for _ in range(3)]
    texts: list[str | None] = [None, "", " \n\t ", "One", "two  WORDS", "x" * 500, "ab " * 400]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2 and len(texts) > 10:
            texts.append(rng.choice(texts[7:]))
        elif kind < 0.4 and len(texts) > 10:
            words = (rng.choice(texts[7:]) or "x").split(" ")
            words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
        elif kind < 0.6:
            texts.append(prose(rng.randint(1, 60)) + " " + rng.choice(shared) + " " + prose(20))
        else:
            texts.append(prose(rng.randint(1, 200)))
    rng.shuffle(texts)
    rows = [(i, t, "en", "clash", "clash", 7) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[-1]]


def by_row(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- suffix-array dedup -------------------------------------------------------------


def brute_repeats(rows, least):
    """rows of (doc, text): the same order as the operator's, ids first, none last."""
    seen: dict[bytes, tuple] = {}
    spots = []
    for doc, text in rows:
        raw = (text or "").encode()
        key = 2**63 - 1 if doc is None else doc
        for s in range(len(raw) - least + 1):
            piece = raw[s : s + least]
            spots.append((piece, key, s))
            seen[piece] = min(seen.get(piece, (key, s)), (key, s))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        key = 2**63 - 1 if doc is None else doc
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            if seen[raw[s : s + least]] < (key, s):
                gone[s : s + least] = True
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((doc, len(raw), int(gone.sum()), int((edges == 1).sum()), rest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,crowded", [(100, 2000), (30, 2), (300, 2000)])
def test_repeated_passages(rows_of, least, crowded):
    rows = awkward(least + crowded)
    rows += [(None, rows[20][1], "", "", "", 0), (None, rows[21][1], "", "", "", 0), (5, rows[30][1], "", "", "", 0)]
    found = repeated_passages(rows_of(DOCS, rows), least, crowded=crowded)
    got = sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["rest"])) for r in found.collect()), key=repr
    )
    assert got == brute_repeats([r[:2] for r in rows], least)


def test_repeated_passages_of_nothing(spark):
    assert repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_of_many_rows_without_id(rows_of):
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh ", k=140))
    rows = [(1, passage), (2, "x" + passage)] + [(None, f"{i} " + "".join(rng.choices("ijklmnop ", k=30))) for i in range(6000)]
    rows += [(None, "held " + passage), (None, "z" * 150), (None, "z" * 150)]
    found = repeated_passages(rows_of("doc_id long, text string", rows), keep=("text",)).collect()
    cut = {r["text"]: r["n_removed"] for r in found if r["n_removed"]}
    # Rows without id are one document: equal places in it are not earlier ones.
    assert cut == {"x" + passage: 140, "held " + passage: 140, "z" * 150: 149}
    assert len(found) == len(rows)


# -- SimHash ------------------------------------------------------------------------


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(prints):
    """prints: (doc, fp) -> smallest doc reachable, by row."""
    nodes = sorted({p for _, p in prints})
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least: dict = {}
    for doc, p in prints:
        if doc is not None:
            least[find(p)] = min(least.get(find(p), doc), doc)
    return sorted(((doc, least.get(find(p))) for doc, p in prints), key=repr)


@pytest.mark.parametrize("crowded", [2])
def test_near_copies(rows_of, crowded):
    rows = awkward(5)
    rows += [(None, rows[20][1], "", "", "", 0), (None, "alone and nameless " * 9, "", "", "", 0)]
    prints = [(r[0], brute_print(r[1])) for r in rows]
    found = near_copies(rows_of(DOCS, rows), crowded=crowded).collect()
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64)) for r in found), key=repr) == sorted(prints, key=repr)
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=repr) == brute_components(prints)
    kept = one_of_each(rows_of(DOCS, rows), ["doc_id", "text"]).collect()
    wanted = sorted({c for _, c in brute_components(prints) if c is not None})
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == wanted
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["alone and nameless " * 9]


def test_unlike_texts_under_one_id_both_stay(rows_of):
    a, b = "first text of its own " * 8, "another and quite different one " * 8
    rows = [(3, a), (5, a), (5, b), (5, b + "x"), (7, b), (9, "short")]
    kept = one_of_each(rows_of("doc_id long, text string", rows), ["doc_id", "text"]).collect()
    prints = [brute_print(t) for _, t in rows]
    near = (prints[2] ^ prints[3]).bit_count() <= 3
    assert Counter(map(tuple, kept)) == Counter([(3, a), (5, b), (9, "short")] + ([] if near else [(5, b + "x")]))


def test_one_of_each_with_other_columns_and_of_nothing(rows_of):
    schema = "doc_id long, text string, node_ string, id int, row string, fp long, n int, root int"
    rows = [(i, f"text number {i % 3} " * 9, "x", 1, "y", 2, 3, 4) for i in range(9)] + [(0, "text number 0 " * 9, "z", 1, "y", 2, 3, 4)]
    kept = one_of_each(rows_of(schema, rows), ["doc_id", "text", "node_", "fp"]).collect()
    assert sorted(map(tuple, kept)) == [(i, rows[i][1], "x", 2) for i in range(3)]
    assert one_of_each(rows_of(schema, []), ["doc_id", "node_"]).count() == 0


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("crowded", [1024, 2])
def test_links(spark, crowded):
    rng = random.Random(crowded)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = set(base)
    while len(prints) < 250:  # chains of flips around a few values
        p = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in links(nodes, crowded).collect()]
    p = sorted(signed(x) for x in prints)
    want = [(a, b) for i, a in enumerate(p) for b in p[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    assert sorted(got) == sorted(want)


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 120)
    edges = [(a, b) for a, b in zip(names[:60], names[1:60])] + [(names[70], n) for n in names[71:]]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in found}
    for group in (names[:60], names[70:]):
        assert {roots.get(n, n) for n in group} == {min(group)}


# -- decontamination ----------------------------------------------------------------


def brute_hits(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for doc, text in docs:
        w, hit, owners = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            if not p or item is None:
                continue
            for win in [p[i : i + window] for i in range(max(1, len(p) - window + 1))]:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        owners.add(str(item))
        out.append((doc, len(w), len(hit), ",".join(sorted(owners))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [2_000_000, 400])
def test_benchmark_passages(rows_of, block_bytes):
    rows = awkward(11)
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    items = [(i, " ".join(t.split()[3:20])) for i, t in enumerate(texts[:6])]
    items += [(10, "One"), (11, None), (12, ""), (None, texts[0]), (2, texts[7]), (13, items[0][1].upper()), (9, "ab ab")]
    bench = rows_of("item_id long, text string, extra string", [(*i, "x") for i in items])
    found = benchmark_passages(rows_of(DOCS, rows), bench, block_bytes=block_bytes)
    got = sorted(
        ((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), ",".join(r["items"])) for r in found.collect()),
        key=repr,
    )
    want = brute_hits([r[:2] for r in rows], items)
    assert got == want
    clean = without_benchmark(rows_of(DOCS, rows), bench, ["doc_id", "text", "lang"])
    assert by_row(clean, "doc_id") == sorted(((d,) for d, _, n, _ in want if not n), key=repr)


def test_no_benchmark_and_no_documents(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in benchmark_passages(docs, bench).collect()] == [(1, 2, [], [])]
    assert benchmark_passages(docs.limit(0), bench).count() == 0


# -- shards -------------------------------------------------------------------------


def test_byte_shards(rows_of):
    rows = [*awkward(21), (None, "nameless", "", "", "", 0), *[(7, "hot", "", "", "", 0)] * 40]
    found = byte_shards(rows_of(DOCS, rows), 8).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted(
        (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    found.sort(key=lambda r: r["position"])
    assert [r["position"] for r in found] == list(range(len(rows)))
    key = [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found]
    assert key == sorted(key)
    total, before, slots = sum(r["size"] for r in found), 0, Counter()
    for r in found:
        assert r["shard"] == (2 * before + r["size"]) * 8 // (2 * total)
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        before += r["size"]
    assert byte_shards(rows_of(DOCS, rows).limit(0), 8).count() == 0


# -- quality ------------------------------------------------------------------------


def test_quality(rows_of):
    rows = [*awkward(31), (900, "a #b " * 40 + "\nx\nx\n \n \nx", "", "", "", 0), (901, "word " * 300, "", "", "", 0)]
    docs = rows_of(DOCS, rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    cascade = plan_cascade(docs)
    assert sorted(r.name for r in cascade) == sorted(r.name for r in RULES)
    got = by_row(quality_cascade(docs, cascade, measures=names), "doc_id", *names, "rejected_by")
    want = []
    for doc, text, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {i + j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(8)}
        m = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep))
        assert repeated_words([x.encode() for x in w]) == len(rep)
        want.append((doc, *m))
    assert [g[:-1] for g in got] == sorted(want, key=repr)
    # Any order gives the same verdicts.
    other = by_row(quality_cascade(docs, cascade[::-1]), "doc_id", "rejected_by")
    assert Counter((d, v is None) for d, v in other) == Counter((g[0], g[-1] is None) for g in got)
    assert quality_cascade(docs.limit(0), plan_cascade(docs.limit(0))).count() == 0


# -- tokens -------------------------------------------------------------------------


ODD = [
    "Don't we're I'LL <|endoftext|> x<|ENDOFTEXT|>y <|startoftext|>", "a\u0301 A\u030a \u212b İstanbul ΣΑΣ ﬁ ²³ ½ ١٢ 你好，世界 🙂🙂",
    "tab\there\u00a0nbsp\u2028ls\x00nul\x1c\x7f", "12345 a1b2 __x__ %%% ##$$", "ÀÉÎ õ÷× ªº «q» ñandú Straße", "'s 's' ''s !'s <| <|endoftext|",
]


def test_ids_are_the_library_s(sf_dir):
    import duckdb
    from tokenizers import Tokenizer

    texts = [t or "" for (t,) in duckdb.execute(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()] + ODD
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), PieceEncoder.of(TOKENIZER)
    for text in texts:
        assert np.frombuffer(encoder.encode(text.encode()), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_tables_are_bounded_in_bytes(monkeypatch):
    from planmatch.llm import tokens

    monkeypatch.setattr(tokens, "TABLE_BYTES", 100_000)
    monkeypatch.setattr(tokens, "SLICE", 1000)
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), PieceEncoder(TOKENIZER)
    rng = random.Random(6)
    for size in (10, 500, 9000):
        text = "".join(rng.choices("abcdeABCé.,'7 \n", k=size)) + " don't <b>日本</b> " + "y" * 200
        assert np.frombuffer(encoder.encode(text.encode()), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        kept = {**encoder.old, **encoder.young}
        assert sum(len(k) + len(v) + tokens.ENTRY for k, v in kept.items()) <= 1.5 * tokens.TABLE_BYTES
        assert max(map(len, kept), default=0) <= tokens.LONGEST


def test_a_text_of_one_long_word(rows_of):
    rows = [(1, "x" * 1_000_000), (2, "word " * 400_000), (3, "y")]
    table = rows_of("doc_id long, text string", rows)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [(i, len(t), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    assert by_row(count_tokens(table, TOKENIZER), "doc_id", "n_bytes", "n_tokens") == want
    pieces = pack(table, TOKENIZER).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert sorted(map(tuple, pieces)) == [(i, n + 1) for i, _, n in want]


def test_count_tokens_and_its_cache(rows_of, spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = [*awkward(41), *[(2000 + i, t, "", "", "", 0) for i, t in enumerate(ODD)], (None, "  two\t\twords ", "", "", "", 0)]
    want = sorted(((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    cache = str(tmp_path / "counts")
    ids = Counter(r[0] for r in rows[:30])
    got = by_row(count_tokens(rows_of(DOCS, rows[:30]), TOKENIZER, cache), "doc_id", "n_bytes", "n_tokens")
    assert got == sorted((w for w in set(want) for _ in range(ids[w[0]])), key=repr)
    first = spark.read.parquet(cache).count()
    assert first == len({" ".join((r[1] or "").split()) for r in rows[:30]})
    assert by_row(count_tokens(rows_of(DOCS, rows), TOKENIZER, cache), "doc_id", "n_bytes", "n_tokens") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() > first
    again = stored.count()
    assert by_row(count_tokens(rows_of(DOCS, rows), TOKENIZER, cache), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == again
    assert count_tokens(rows_of(DOCS, rows).limit(0), TOKENIZER).count() == 0


# -- packing ------------------------------------------------------------------------


def brute_best_fit(lengths, size):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 50, 128])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 600))] + [7] * rng.randint(0, 300)
    plan = best_fit_plan(dict(Counter(lengths)), size)
    filled: dict[int, list] = defaultdict(list)
    rank: Counter = Counter()
    for n in lengths:
        sequence, offset = plan.place(np.array([n]), np.array([rank[n]]))
        rank[n] += 1
        filled[int(sequence[0])].append((int(offset[0]), n))
    for pieces in filled.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    assert sorted(filled) == list(range(plan.sequences))
    assert sorted(size - sum(n for _, n in p) for p in filled.values()) == brute_best_fit(lengths, size)


def test_pack(rows_of):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = [*awkward(51), (None, "nameless", "", "", "", 0)]
    size = 128
    found = pack(rows_of(DOCS, rows), TOKENIZER, size).collect()
    ids = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]
    want = Counter()
    for r, own in zip(rows, ids):
        for s in range(0, len(own), size):
            piece = own[s : s + size]
            want[(r[0], s, len(piece), zlib.crc32(piece.tobytes()), len(own))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    assert sorted(sequences) == list(range(len(sequences)))
    rest = [len(o) % size for o in ids if len(o) % size]
    assert len(sequences) == sum(len(o) // size for o in ids) + len(brute_best_fit(rest, size))
    assert pack(rows_of(DOCS, rows).limit(0), TOKENIZER).count() == 0


# -- urls ---------------------------------------------------------------------------


def test_globs_like_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts = ["".join(rng.choices("ab/é", k=rng.randint(0, 12))) for _ in range(300)]
    hit = GlobSet(globs).match([t.encode() for t in texts])
    for j, g in enumerate(globs):
        parts = re.findall(r"\*\*|.", g)
        pattern = re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts))
        for i, t in enumerate(texts):
            assert hit[i, j] == bool(pattern.fullmatch(t)), (g, t)


def test_filter_urls(rows_of):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.NET/x?y", "https://example.net/en/", "https://m.example.net/en",
            "http://badexample.com/de/", "http://x.example.com/de/1#f", "http://b.org/fr/2", "http://b.org/de/net/", "http://a.com/x.net/",
            "u://h?net/#/", "x http://y.net/ http://z", "http://ex.org/fr/" + "y" * 5000, "http://a.net:80/"]
    found = filter_urls(rows_of("page_id long, url string, host string, html string", [(i, u, "h", "x") for i, u in enumerate(urls)]), URL_RULES)
    for r in found.collect():
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.name, best.verdict if best else "allow")
