"""Quality rules as a short-circuit cascade.

Each rule's cost and the share of rows that it rejects are measured on a sample; the rules
then run in falling order of rejections per cost, every one only on the rows that all
before it let through. The order changes how much work is done, never the verdict: a row
is kept when no rule rejects it. The sample sets the order alone.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planmatch.functions.predicates import named
from planmatch.llm.batches import arrow_map, kept_fields, utf8

WINDOW = 8
# Rows on which costs and rejections are measured.
SAMPLE_ROWS = 1_000
# Fixed value: the symbols that count.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


class Measures:
    """Numbers of one text, each worked out when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._got: dict[str, int] = {}
        self._words: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    def __getitem__(self, name: str) -> int:
        if name not in self._got:
            self._got[name] = getattr(self, f"_{name}")()
        return self._got[name]

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.raw.translate(None, BLANKS).decode("utf-8", "replace"))

    def _n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    def _n_dup_lines(self) -> int:
        lines = [line for line in self.raw.split(b"\n") if line.strip(BLANKS)]
        return len(lines) - len(set(lines))

    def _n_repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more in the text."""
    size = len(words) - window + 1
    if size < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    # Windows are numbered by doubling: equal numbers, equal words.
    width, step = 1, ids
    while width < window:
        shift = min(width, window - width)
        joined = step[: len(step) - shift] * (int(step.max()) + 1) + step[shift:]
        distinct, step, counts = np.unique(joined, return_inverse=True, return_counts=True)
        width += shift
        if len(distinct) == len(joined):
            return 0
    begins = np.flatnonzero(counts[step] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[begins] += 1
    edges[begins + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


@dataclass(frozen=True)
class QualityRule:
    name: str
    rejects: Callable[[Measures], bool]


#: Thresholds in whole numbers, so that they can be stated exactly elsewhere.
RULES = (
    QualityRule("few_words", lambda m: m["n_words"] < 20),
    QualityRule("repeats", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    QualityRule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    QualityRule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    QualityRule("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    QualityRule(
        "same_lines",
        lambda m: 10 * m["n_dup_lines"] > 3 * (m.raw.count(b"\n") + 1),
    ),
)


def plan_cascade(
    docs: DataFrame, rules: Sequence[QualityRule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[QualityRule]:
    """Rules by falling rejections per second on the first rows of the scan. Rules that
    reject nothing there come last, cheapest first; the given order breaks ties."""
    sample = docs.select(named(text).alias("text")).limit(sample_rows)

    def weigh(batches):
        spent: Counter = Counter()
        rejected: Counter = Counter()
        for batch in batches:
            for raw in utf8(batch.column(0)):
                for rule in rules:
                    began = time.perf_counter()
                    # A fresh look at the text: what another rule has worked out is not free.
                    rejected[rule.name] += bool(rule.rejects(Measures(raw)))
                    spent[rule.name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r.name for r in rules], pa.string()),
                pa.array([spent[r.name] for r in rules], pa.float64()),
                pa.array([float(rejected[r.name]) for r in rules], pa.float64()),
            ],
            names=["rule", "seconds", "rejected"],
        )

    weighed = sample.mapInArrow(weigh, "rule string, seconds double, rejected double")
    found = {
        r["rule"]: (r["s"], r["r"])
        for r in weighed.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    }  # one row per rule

    def rank(rule: QualityRule):
        seconds, rejected = found.get(rule.name, (0.0, 0.0))
        return (-rejected / max(seconds, 1e-9), seconds)

    return sorted(rules, key=rank)


def quality_cascade(
    docs: DataFrame,
    cascade: Sequence[QualityRule],
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    measures: Sequence[str] = (),
) -> DataFrame:
    """The kept columns of every row, the asked `measures` (long), and `rejected_by`: the
    first rule of the cascade that rejects the text, null for a text that is kept.

    A rule runs only on the rows that the rules before it let through. Null texts count as
    empty. Repeated rows are judged each for itself.
    """
    fields = kept_fields(docs, keep)
    width = len(fields)
    out = T.StructType(
        [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)]
        + [T.StructField(m, T.LongType()) for m in measures]
        + [T.StructField("rejected_by", T.StringType())]
    )
    source = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], named(text).alias("text"))

    def judge(batch):
        texts = [Measures(t) for t in utf8(batch.column(width))]
        verdict: list[str | None] = [None] * len(texts)
        left = list(range(len(texts)))
        for rule in cascade:
            out_now = [i for i in left if rule.rejects(texts[i])]
            for i in out_now:
                verdict[i] = rule.name
            gone = set(out_now)
            left = [i for i in left if i not in gone]
        return [*batch.columns[:width], *[[m[name] for m in texts] for name in measures], verdict]

    judged = arrow_map(source, judge, out)
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *measures, "rejected_by")
