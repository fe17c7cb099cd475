"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled rows gives a lexicon (words, and stems of 4 to 6 letters, far more frequent in toxic texts),
trees fitted to the log-loss on binned features, and a monotone map from their margin to a chance, fitted on rows that
the trees didn't see.  The executors read the sampled texts; four hashes, counts of entries and twelve numbers a row come
to the driver, never a text.  The model is a few kilobytes; every text is then scored where it lies, in one pass over its
bytes: the text alone goes to Python and a number comes back, other columns stay with Spark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fold, written

TOKEN = re.compile(r"[^\W\d_]+")
# Second-person pronouns of four languages, and the letters that digits and signs stand for.
SECOND_PERSON = re.compile(r"\b(?:you|your|yours|yourself|du|dich|dir|dein|deine|ihr|euch|tu|te|toi|ton|ta|tes|vous|votre|tú|ti|tus|usted|ustedes|vos)\b")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "-": None, ".": None, "_": None})
STEMS = (4, 5, 6)
FEATURES = ("lexicon", "hits", "kinds", "near_you", "capitals", "shouts", "punctuation", "symbols", "digits", "hidden", "uncovered", "words")
#: Byte classes: 1 letter (ASCII or part of a longer code point), 2 digit, 3 other sign, 0 white space and controls.
CLASSES = np.zeros(256, np.uint8)
CLASSES[33:127] = 3
CLASSES[48:58] = 2
CLASSES[65:91] = CLASSES[97:123] = 1
CLASSES[128:] = 1
#: Signs and digits that stand for a letter next to one; hyphens, stops and exclamation marks only between two.
INSTEAD = np.isin(np.arange(256), list(b"@$*013457"))
STARRED = re.compile(r"[^\W\d_]+\*[^\W\d_*]*(?:\*[^\W\d_*]*)*")
#: Texts whose features are held at once.
SLICE = 512


class Lexicon:
    """Finds entries at the start of words; an entry ending in ``*`` is a stem, others are whole words."""

    def __init__(self, entries: Sequence[str]):
        self.entries, self.find = tuple(entries), None
        if entries:
            self.find = ahocorasick.Automaton()
            for e in entries:
                self.find.add_word(e.rstrip("*"), (e.rstrip("*"), e.endswith("*")))
            self.find.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.entries,)

    def hits(self, text: str) -> list[tuple[int, str]]:
        """(place, entry) of one hit a word at most."""
        found: dict[int, str] = {}
        if self.find is not None:
            for end, (entry, stem) in self.find.iter(text):
                start = end - len(entry) + 1
                if start not in found and (not start or not text[start - 1].isalpha()) and (stem or end + 1 >= len(text) or not text[end + 1].isalpha()):
                    found[start] = entry
        return list(found.items())

    def masked(self, lower: str) -> int:
        """Words with letters starred out that an entry fits, a star for each letter."""
        n = 0
        for word in set(STARRED.findall(lower)):
            fits = lambda start, entry: re.fullmatch(start.replace("*", r"[^\W\d_]"), entry)
            n += len(word) < 40 and any(fits(word[: len(e) - 1], e[:-1]) if e.endswith("*") else fits(word, e) for e in self.entries)
        return n


def least_keys(text: str, keys: int = 4) -> list[int]:
    """The ``keys`` smallest hashes of a text's five-word shingles."""
    words = text.encode("utf-8", "replace").split()
    return sorted({crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))})[:keys]


def copies(keys: Sequence[Sequence[int]]) -> list[bool]:
    """Whether a text shares one of its ``least_keys`` with an earlier one: likely a copy."""
    seen: set[int] = set()
    found = []
    for own in keys:
        found.append(not seen.isdisjoint(own))
        seen.update(own)
    return found


def entries_of(text: str) -> set[str]:
    """The words of a text that may enter the lexicon, and their stems."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) < 40}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def odds(toxic: int, other: int, sizes: Sequence[int]) -> float:
    """How much more often an entry is in toxic texts than in others; sizes: the texts that are not toxic, and those that are."""
    return (toxic + 0.5) / (other + 0.5) * (sizes[0] + 1) / (sizes[1] + 1)


def chosen_entries(counts: dict[str, tuple[int, int]]) -> Lexicon:
    """The lexicon of entries far more frequent in toxic texts, with their counts (in others, in toxic texts)."""
    kept = set(counts)

    def covers(stem: str, entry: str) -> bool:
        return stem != entry and stem.endswith("*") and entry.startswith(stem[:-1])

    # a stem gives way to a longer entry that nearly always completes it, and covers the other longer ones
    exact = {e for e in kept if not any(covers(e, f) and counts[f][1] >= 0.9 * counts[e][1] for f in kept)}
    return Lexicon(sorted(e for e in exact if not any(covers(s, e) for s in exact)))


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return [0.0] * len(FEATURES)
    n, seen, kind = len(raw), np.bincount(raw, minlength=256), CLASSES[raw]
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    words = int(np.count_nonzero((kind[1:] != 0) & (kind[:-1] == 0))) + int(kind[0] != 0)
    inner = int(np.count_nonzero((kind[1:-1] >= 2) & (kind[:-2] == 1) & (kind[2:] == 1)))
    lower = text.lower()
    hits = lexicon.hits(lower)
    near = sum(bool(SECOND_PERSON.search(lower[max(0, at - 30) : at + 40])) for at, _ in hits)
    beside = inner or bool((INSTEAD[raw[1:]] & (kind[:-1] == 1)).any() or (INSTEAD[raw[:-1]] & (kind[1:] == 1)).any())
    uncovered = len(lexicon.hits(lower.translate(LEET))) - len(hits) + (lexicon.masked(lower) if seen[42] else 0) if beside else 0
    per = 1.0 / max(1, words)
    signs = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    return [
        len(hits) * per,
        math.log1p(len(hits)),
        float(len({e for _, e in hits})),
        near * per,
        int(seen[65:91].sum()) / letters,
        int(seen[33] + seen[63]) * per,
        signs / n,
        int(seen[[35, 36, 37, 38, 42, 64, 124]].sum()) / n,
        int(seen[48:58].sum()) / n,
        inner * per,
        max(0, uncovered) * per,
        math.log1p(words),
    ]


@dataclass
class Boosted:
    """Trees of a fixed depth as flat arrays: a split feature and threshold by inner node, a value by leaf."""

    depth: int
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, split[node]] > at[node])
            out += value[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the log-loss; splits at quantiles, found from sums of gradients by bin."""
    chance = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Boosted(depth, math.log(chance / (1 - chance)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    margin = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        split, at, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place, best = node - first, np.zeros(width)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                key, shape = place * (bins + 1) + binned[:, f], (width, bins + 1)
                gs = np.bincount(key, g, width * (bins + 1)).reshape(shape).cumsum(1)
                hs = np.bincount(key, h, width * (bins + 1)).reshape(shape).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(cut)]
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), top] > best + 1e-9):
                    best[k], split[first + k], at[first + k] = gain[k, top[k]], f, cut[top[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), split[node]] > at[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.trees.append((split, at, value))
        margin += value[leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, chance) of the best rising map, with one row of either label added."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([float(label), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    knots = np.array([b[2] / b[1] for b in blocks])
    return knots, np.array([(b[0] + 0.5 * y.mean()) / (b[1] + 0.5) for b in blocks]).clip(0, 1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Chances of texts, 0 to 1; some hundred texts are held at once."""
        out, texts = [np.zeros(0)], iter(texts)
        while some := list(islice(texts, SLICE)):
            if self.trees is None:
                out.append(np.full(len(some), self.knots[1][0]))
            else:
                x = np.array([features(t or "", self.lexicon) for t in some]).reshape(len(some), len(FEATURES))
                out.append(np.interp(self.trees.margin(x), *self.knots))
        return np.concatenate(out).clip(0, 1)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, lexicon: Lexicon) -> Model:
    """Trees from the rows that are not held back, calibration from those that are."""
    trees = boost(x[~held], y[~held])
    return Model(lexicon, trees, isotonic(trees.margin(x[held]), y[held]))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic 0 or 1) of about ``max_rows`` labelled ids, chosen by a hash, one text an id (the least)."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, max_rows / max(1, n))) + 1)
    rows = docs.select("doc_id", "text").join(F.broadcast(known.where(part).limit(2 * max_rows)), "doc_id")
    return rows.groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), (F.max("toxic") > 0).cast("long").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000, ratio: float = 15.0, part: float = 0.012) -> Model:
    """A model from at most about ``max_rows`` labelled ids, chosen by a hash of the id, with their whole texts.

    Rows whose crc32 of the id modulo 5 is 0 are never learned from; neither are null labels and null ids.  Of repeated
    labels the larger counts, of repeated ids the least text.  The chosen ids (bounded by ``max_rows``) are broadcast; a
    few numbers a row come back.  A quarter of the rows (by crc32 of the text) is held back for calibration.  The lexicon
    has words and stems that are in at least ``part`` of the toxic texts (four at least) and ``ratio`` times as often as
    in others; likely copies of an earlier text count once, else the rare words of a much-copied one would enter.  With
    fewer than 20 rows, or one label, every chance is the mean of the labels, 0.49 at most (0 without any): none is rejected.
    """
    rows = written(sample(docs, labels, max_rows), "sample")

    @F.arrow_udf("struct<fold:bigint,keys:array<bigint>>")
    def marks(text: pa.Array) -> pa.Array:
        texts = [t.as_py() for t in text]
        return pa.StructArray.from_arrays([pa.array([crc32(t.encode("utf-8", "replace")) % 4 for t in texts], pa.int64()), pa.array([least_keys(t) for t in texts], pa.list_(pa.int64()))], ["fold", "keys"])

    found = rows.select("doc_id", "toxic", marks("text").alias("m")).select("doc_id", "toxic", "m.fold", "m.keys").orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in found], float)
    if len(y) < 20 or y.min() == y.max():
        return Model(Lexicon(()), None, (np.zeros(1), np.array([min(0.49, y.mean()) if len(y) else 0.0])))
    held = np.array([r["fold"] == 3 for r in found])
    if held.all() or not held.any() or y[~held].min() == y[~held].max():
        held = np.arange(len(y)) % 4 == 3
    own = [r for r, h in zip(found, held, strict=True) if not h]
    counted = {r["doc_id"] for r, copy in zip(own, copies([r["keys"] for r in own]), strict=True) if not copy}
    sizes = [sum(r["doc_id"] in counted and r["toxic"] == k for r in own) for k in (0, 1)]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for doc_id, text, toxic in zip(*batch.columns, strict=True):
                if doc_id.as_py() in counted:
                    counts[toxic.as_py()].update(entries_of(text.as_py()))
        every = list(counts[0] | counts[1])
        yield pa.record_batch([pa.array(every, pa.string()), *(pa.array([c[e] for e in every], pa.int64()) for c in counts)], ["entry", "other", "toxic"])

    most = rows.mapInArrow(entries, "entry string, other long, toxic long").groupBy("entry").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    frequent = most.where((F.col("toxic") >= max(4, part * sizes[1])) & (odds(F.col("toxic"), F.col("other"), sizes) >= ratio))
    lexicon = chosen_entries({r[0]: (r[1], r[2]) for r in frequent.collect()})
    described = F.arrow_udf(lambda text: pa.array([features(t.as_py(), lexicon) for t in text], pa.list_(pa.float64())), "array<double>")
    x = np.array([r[1] for r in rows.select("doc_id", described("text")).orderBy("doc_id").collect()])
    return fit(x, y, held, lexicon)


def chance(text: Column, model: Model) -> Column:
    """The score of a text."""
    return F.arrow_udf(lambda x: pa.array(model.scores(t.as_py() for t in x)), "double")(text)


def scored(docs: DataFrame, model: Model, *, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with score (0 to 1, higher is more toxic) and predicted (1 if score >= 0.5).

    Null texts count as empty; very long texts are scored whole; equal texts have equal scores; repeated and null ids are
    kept; an empty table gives no rows.  Columns outside ``keep`` (and text) are not read; ``keep`` has neither score nor
    predicted.
    """
    found = docs.select(*keep, chance(F.col("text"), model).alias("score"))
    return found.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a model learned from them and ``labels`` does not call toxic.

    Null and empty texts are judged like any other; very long ones whole; equal texts, so repeated rows too, share their
    fate.  Null and repeated ids are kept.  Extra columns may have any name.  An empty table gives no rows; without
    labels all rows stay.
    """
    return docs.where(chance(F.col("text"), learn(docs, labels)) < 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted."""
    docs = documents(spark, sf_dir)
    found = scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
