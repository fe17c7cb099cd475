"""Language identification by error-correcting output codes.

Each language has a codeword of bits that differ from the other words in many places.  One linear classifier over hashed
byte n-grams predicts each bit; a text's bits are decoded to the codeword of least total log-loss, so confident bits weigh
more than doubtful ones, and a small lead over the second codeword marks the answer as ambiguous.  The classifiers are
fitted on a bounded sample of labelled rows and are some hundred kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, fold

SIZE = 4096
#: Bytes of a text that are counted at once; the counts of the pieces add up.
PIECE = 1 << 20
ROWS = 256


def profile(text: bytes) -> np.ndarray:
    """Square roots of the frequencies of hashed runs of one to three bytes: a vector of length one."""
    raw = np.frombuffer(text, np.uint8)
    counts = np.zeros(SIZE, np.int64)
    for at in range(0, len(raw), PIECE):
        a = raw[at : at + PIECE + 2].astype(np.uint32)
        two = (a[:-1] << 8) | a[1:]
        three = (two[:-1] << 8) | a[2:]
        n = min(PIECE, len(raw) - at)
        counts += np.bincount(((a[:n] + 1) * np.uint32(2654435761)) >> 20, minlength=SIZE)
        counts += np.bincount((two[:n] * np.uint32(2246822519) + np.uint32(77)) >> 20, minlength=SIZE)
        counts += np.bincount((three[:n] * np.uint32(3266489917) + np.uint32(1234567)) >> 20, minlength=SIZE)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """``n`` different words of -1 and 1.  Up to seven languages: all ways to split them in two; more: the best of some
    random codes by the least distance between two words."""
    if n <= 7:
        columns = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, max(2, 2 ** (n - 1)))]
        return np.array(columns, np.float32).T
    bits, best, rng = 4 * int(np.ceil(np.log2(n))) + 7, None, np.random.default_rng(seed)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the weight exp(-loss) over all codewords, and whether it is ambiguous."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        wrong = (np.sign(margin) != self.code[best]).sum(1)
        apart = min((self.code[i] != self.code[j]).sum() for i in range(len(self.code)) for j in range(i)) if len(self.code) > 1 else 1
        return best, share[np.arange(len(x)), best], (share[np.arange(len(x)), best] < 0.75) | (wrong > (apart - 1) // 2)


def fit(x: np.ndarray, languages: Sequence[str], *, steps: int = 100, ridge: float = 1e-5, rate: float = 40.0) -> Codes:
    """One logistic classifier a bit, all by one accelerated gradient descent on the mean loss; each language weighs the same."""
    names = sorted(set(languages))
    code = codewords(len(names))
    at = np.searchsorted(names, list(languages))
    y = code[at]
    weigh = (1.0 / (len(names) * np.bincount(at)))[at].astype(np.float32)[:, None]
    w, bias = np.zeros((SIZE, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead, last, xt = w, w, np.ascontiguousarray(x.T)
    for k in range(steps):
        pull = y * weigh / (1 + np.exp((x @ ahead + bias) * y))
        w = ahead + rate * (xt @ pull - ridge * ahead)
        bias = bias + pull.sum(0)
        ahead, last = w + k / (k + 3) * (w - last), w
    return Codes(names, code, w, bias)


def learn(docs: DataFrame, *, max_rows: int = 2000) -> Codes | None:
    """Classifiers from about ``max_rows`` rows at most, chosen by a hash of the id, as many of each language as there are.

    Rows whose crc32 of the id modulo 4 is 2, null languages and null texts are left out.  A language is learned if it is
    one of the ``max_rows`` most frequent ones (ties by name).  Null if nothing is left.  Profiles of a fixed size come to
    the driver, not texts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).select("doc_id", "text", F.col("lang").alias("l"))
    counts = {r[0]: r[1] for r in known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_rows).collect()}
    if not counts:
        return None
    part = F.lit(0)
    for lang, n in counts.items():
        part = F.when(F.col("l") == lang, int((1 << 20) * min(1.0, max_rows / len(counts) / n)) + 1).otherwise(part)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part).limit(2 * max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([profile(t.as_py().encode("utf-8", "replace")).astype(np.float16).tobytes() for t in b.column(1)], pa.binary())], ["l", "x"])

    rows = chosen.select("l", "text").mapInArrow(run, "l string, x binary").orderBy("l", "x").collect()
    return fit(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), [r["l"] for r in rows]) if rows else None


def identify(docs: DataFrame, codes: Codes | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous for every row, from its whole text.

    Null texts and texts without a letter are ``und`` with score 0 and ambiguous; so is everything if nothing was
    learned.  Very long texts are counted piece by piece.  Of languages at equal distance the first by name counts.  Equal
    texts agree; repeated and null ids are kept; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, unsure = ["und"] * n, np.zeros(n), np.ones(n, bool)
            lettered = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)) if codes else []
            for at in range(0, len(lettered), ROWS):
                rows = lettered[at : at + ROWS]
                best, share, vague = codes.decode(np.stack([profile(batch.column(1)[int(i)].as_py().encode("utf-8", "replace")) for i in rows]))
                score[rows], unsure[rows] = share, vague
                for i, k in zip(rows, best, strict=True):
                    lang[i] = codes.languages[k]
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    shape = docs.select("doc_id").schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("ambiguous", T.BooleanType())
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, shape)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents: doc_id, held_out, lang_pred, score, ambiguous."""
    docs = documents(spark, sf_dir)
    found = identify(docs, learn(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
