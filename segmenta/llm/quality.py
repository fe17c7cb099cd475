"""Quality rules as a short-circuit cascade.

A bounded sample tells what each rule costs and how many texts it rejects.  Both are taken where the cascade would meet
them: on texts that pass the base, a rule's cost is what it adds to the base counts, and its rejections count among the
texts that the rules before it let through.  So the rule with the most rejections per cost comes first, then the best of the
others on what is left.  A text leaves at the first rule that it fails.  The order changes the work, never the verdict: a
text is kept if no rule rejects it.  The base counts are computed for every text and rules share what has been computed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents

SYMBOLS = list(b"#*$%&|<>")
BLANKS = [9, 10, 11, 12, 13, 32]
#: Seconds that a rule costs at least.
LEAST = 2e-6


class Text:
    """A text with the counts that rules ask for, each computed once when first needed."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "replace")

    @cached_property
    def bytes_seen(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.raw, np.uint8), minlength=256)

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at exactly the six blanks

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        seen = self.bytes_seen
        return len(self.raw) - int(seen[128:192].sum()) - int(seen[BLANKS].sum())

    @cached_property
    def n_symbols(self) -> int:
        return int(self.bytes_seen[SYMBOLS].sum())

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = len(self.words) - 2
        if n < 2:
            return 0
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], np.int64)
        m = len(number)
        pairs = ids[:-1] * m + ids[1:]
        if m > 2_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        key = pairs[:-1] * m + ids[2:]
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        found = np.isin(key, twice)
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : k + n] |= found
        return int(covered.sum())

    @cached_property
    def capitals(self) -> float:
        upper, lower = int(self.bytes_seen[65:91].sum()), int(self.bytes_seen[97:123].sum())
        return upper / max(1, upper + lower)

    @cached_property
    def lettered_words(self) -> float:
        return sum(any(c >= 128 or chr(c).isalpha() for c in w) for w in self.words) / max(1, self.n_words)

    @cached_property
    def distinct_words(self) -> float:
        return len(set(self.words)) / max(1, self.n_words)


#: Rules by name: true if the text is rejected.
RULES: dict[str, Callable[[Text], bool]] = {
    "short_or_long_words": lambda t: not 2 <= t.word_chars / max(1, t.n_words) <= 15,
    "symbols": lambda t: t.n_symbols > 0.1 * t.n_words,
    "repeated_lines": lambda t: t.n_dup_lines > 0.6 * len(t.lines),
    "capitals": lambda t: t.capitals > 0.3,
    "unlettered": lambda t: t.lettered_words < 0.7,
    "one_phrase": lambda t: t.distinct_words < 0.08,
}


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def trial(text: str | None) -> list[tuple[bool, float]]:
    """Whether each rule rejects a text, and the seconds it adds to the base counts; none if the text fails the base."""
    found = []
    for rule in RULES.values():
        t = Text(text)
        if base_failed(t):
            return []
        for count in COUNTS:
            getattr(t, count)
        began = time.perf_counter()
        rejected = bool(rule(t))
        found.append((rejected, time.perf_counter() - began))
    return found


def ordered(trials: Sequence[Sequence[tuple[bool, float]]]) -> list[str]:
    """Rule names by rejections per second among the texts that the rules before let through.

    A rule costs LEAST at least, so those that only compare base counts go by their rejections alone; ties by name.
    """
    left, order, rest = [t for t in trials if t], [], sorted(RULES)
    at = {name: k for k, name in enumerate(RULES)}
    while rest:
        cost = {name: max(LEAST, sum(t[at[name]][1] for t in left) / max(1, len(left))) for name in rest}
        best = min(rest, key=lambda name: (-sum(t[at[name]][0] for t in left) / cost[name], cost[name], name))
        order.append(best)
        rest.remove(best)
        left = [t for t in left if not t[at[best]][0]]
    return order


def plan(docs: DataFrame, *, sample_rows: int = 400) -> list[str]:
    """The order of the rules, from about ``sample_rows`` whole texts chosen by a hash of the id.

    The texts are tried where they lie; two numbers a rule come back.
    """
    n = docs.select("doc_id").count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample_rows / max(1, n))) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trials = [trial(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([pa.array([[r for r, _ in t] for t in trials], pa.list_(pa.bool_())), pa.array([[s for _, s in t] for t in trials], pa.list_(pa.float64()))], ["rejected", "seconds"])

    rows = docs.where(part).select("text").limit(2 * sample_rows).mapInArrow(run, "rejected array<boolean>, seconds array<double>").collect()
    return ordered([list(zip(r["rejected"], r["seconds"], strict=True)) for r in rows])


def judged(docs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Base counts and verdict of every row.

    Null texts count as empty: all counts 0, base_failed, not kept.  Very long texts count whole, with their list of words
    in memory.  Equal texts agree; null and repeated ids are kept; an
    empty table gives no rows; other columns are not read.
    """
    shape = docs.select("doc_id").schema
    for name in COUNTS:
        shape = shape.add(name, T.LongType())
    shape = shape.add("base_failed", T.BooleanType()).add("kept", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                t = Text(value.as_py())
                failed = base_failed(t)
                rows.append((*(getattr(t, c) for c in COUNTS), failed, not failed and not any(RULES[r](t) for r in order)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], shape.names)

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    docs = documents(spark, sf_dir)
    return judged(docs, plan(docs))
