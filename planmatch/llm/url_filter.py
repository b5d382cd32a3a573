"""Rules with wildcards over URLs, all tried at once by a bit-parallel automaton.

Every glob becomes a row of states: bit j is set when its first j pieces have been read.
The states of all globs are packed side by side into 64-bit words. Reading a byte is one
shift (with a carry between words), one mask of the states that this byte may enter, and
one mask of the states in which a wildcard waits. A whole batch of URLs is read in step, as
numpy arrays of words, so neither rules nor URLs are looped over one by one.

Globs are matched against `.host/path`: `*` is any run without `/`, `**` any run, `?` one
character that is not `/`; everything else stands for itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.llm.batches import utf8

ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """`host` with all its subdomains, paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z folded; else empty."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


class GlobSet:
    """Masks of a list of globs."""

    def __init__(self, globs: Sequence[str]):
        enter: list[tuple[int, int | None]] = []  # (state, byte or None for `?`)
        loops: list[tuple[int, bool]] = []  # (state, crosses `/`)
        starts, finals, state = [], [], 0
        follow: list[int] = []  # states after `?`: the rest of its character
        for glob in globs:
            starts.append(state)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops.append((state, True))
                    i += 2
                elif raw[i : i + 1] == b"*":
                    loops.append((state, False))
                    i += 1
                else:
                    state += 1
                    if raw[i : i + 1] == b"?":
                        enter.append((state, None))
                        follow.append(state)
                    else:
                        enter.append((state, raw[i]))
                    i += 1
            finals.append(state)
            state += 1
        self.words = max(1, -(-state // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for at, byte in enter:
            of = [byte] if byte is not None else [b for b in range(256) if b != 47 and not 128 <= b < 192]
            self.enter[of, at // 64] |= ONE << np.uint64(at % 64)
        for at, crosses in loops:
            of = [b for b in range(256) if crosses or b != 47]
            self.stay[of, at // 64] |= ONE << np.uint64(at % 64)
        for at in follow:
            self.stay[128:192, at // 64] |= ONE << np.uint64(at % 64)
        self.start = np.zeros(self.words, np.uint64)
        for at in starts:
            self.start[at // 64] |= ONE << np.uint64(at % 64)
        self.finals = np.array(finals, np.int64)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Rows x globs: does the whole text fit."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        states = np.tile(self.start, (len(texts), 1))
        live = len(texts)
        for step in range(int(sizes[0]) if len(texts) else 0):
            while live and sizes[live - 1] <= step:  # longest first: the tail has ended
                live -= 1
            now = states[:live]
            byte = flat[begins[:live] + step]
            moved = now << ONE
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:live] = (moved & self.enter[byte]) | (now & self.stay[byte])
        hit = np.zeros((len(texts), len(self.finals)), bool)
        shift = (self.finals % 64).astype(np.uint64)
        hit[order] = (states[:, self.finals // 64] >> shift) & ONE != 0
        return hit


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row, repeats included.

    Of the rules that fit the longest wins, the earlier one of equally long ones; without
    one `rule` is null and the verdict is `default`. Null urls and urls without `://` have
    an empty host and path, which no rule fits.
    """
    names = [r.name for r in rules]
    verdicts = [r.verdict for r in rules]
    rank = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))
    globs = GlobSet([rules[i].glob for i in rank])

    def judge(batches):
        for batch in batches:
            hosts, paths = utf8(batch.column(1)), utf8(batch.column(2))
            hit = globs.match([b"." + h + p for h, p in zip(hosts, paths)])
            if rules:
                best = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
            else:
                best = np.full(batch.num_rows, -1)
            rule = [None if b < 0 else names[rank[b]] for b in best]
            verdict = [default if b < 0 else verdicts[rank[b]] for b in best]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    address = named(url)
    source = pages.select(
        named(page_id).alias("page_id"),
        F.coalesce(host_of(address), F.lit("")).alias("host"),
        F.coalesce(path_of(address), F.lit("")).alias("path"),
    )
    kind = pages.schema[page_id].dataType.simpleString()
    return source.mapInArrow(
        judge, f"page_id {kind}, host string, path string, rule string, verdict string"
    )
