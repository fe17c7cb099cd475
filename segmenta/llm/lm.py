"""LM scoring with an Elias-Fano n-gram trie of three levels.

Level one, the vocabulary: 64-bit hashes of the training words in order, and monotone pointers into the stream of all
training tokens sorted by word, so a word's count is the difference of two pointers.  A word's place in that order is its
id.  Level two has the successors of each word, level three those of each pair.  Both are stored alike: a monotone pointer
for each context into the level's successors, and the ids of the successors as one rising sequence, where those of a
context start above the last value of the context before.  So a successor is searched relative to its context: two
pointers bracket it, the value before the bracket is its zero, and the search stays inside.

By each pair stand its smoothed probability and what its contexts leave to shorter ones, by each triple its share, each
quantised to one of 256 values:

    P(w)       = (n(w) + 1) / (N + V + 1)                                   the add-one base
    P(w | b)   = (n(b w) + MU P(w)) / (n(b) + MU)                           level two; not seen: MU P(w) / (n(b) + MU)
    P(w | a b) = n(a b w) / (n(a b) + NU) + NU / (n(a b) + NU) P(w | b)     level three; a b not seen: P(w | b)

A text's first word follows the end of a text and has no pair before it.

Files in the shared folder hold the levels, cut by ranges of hashes (WORD_PARTS files, whatever the corpus) and of the sorted
token stream (PART tokens each; a frequent context is cut inside its successors).  They are mapped, not loaded or broadcast,
and found by number, so a task is sent some sums and a bit by file.  Tasks count what they have read before anything is
shuffled, and send sorted differences, packed; parts merge them batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .elias_fano import EliasFano, load, save
from .shared import documents, fold, fresh_path

#: The end of a text, which is also the context of its first word: no word is empty.
END = xxhash.xxh64_intdigest(b"")
#: Bytes of text that a task counts together.
TOGETHER = 12 << 20
#: Ranges of word hashes, a power of two; training tokens by part of levels two and three.
WORD_PARTS, PART = 256, 4_000_000
#: Counts that a part holds before it merges them.
HELD = 4_000_000
MU, NU = 100.0, 4.0


@dataclass
class Tokens:
    """Texts as places in ``hashes`` (rising): words, A-Z lower-cased, cut at ASCII white space, and the end after each text."""

    hashes: np.ndarray
    words: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = split.flatten()
        some = pc.greater(pc.binary_length(words), 0)  # blanks at either end of a text leave an empty word there
        coded = words.filter(some).dictionary_encode()
        own = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
        hashes, place = np.unique(np.append(own, np.uint64(END)), return_inverse=True)
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        sizes = np.diff(np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[edges]) + 1
        out, ends = np.full(int(sizes.sum()), place[-1]), np.cumsum(sizes) - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = place[coded.indices.to_numpy(zero_copy_only=False)]
        return cls(hashes, out, sizes)

    @property
    def end(self) -> int:
        return int(np.searchsorted(self.hashes, np.uint64(END)))

    def before(self) -> np.ndarray:
        """The word before each; the end before a text's first."""
        return np.concatenate([[self.end], self.words[:-1]])

    def first(self) -> np.ndarray:
        """Which words are the first of a text."""
        return np.concatenate([[True], self.words[:-1] == self.end])


def groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Slices of about TOGETHER bytes of text, with their tokens."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + TOGETHER, side="right")))
            part = batch.slice(start, stop - start)
            yield part, Tokens.of(part.column(column))
            start = stop


def summed(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Different keys in order, by the first array and then the next, with their summed counts."""
    if not len(counts):
        return keys, counts
    one = keys[0]
    for more in keys[1:]:  # places of the first keys and the next key in one number, which sorts faster
        one = np.unique(one, return_inverse=True)[1].astype(np.uint64) * (more.max() + np.uint64(1)) + more
    order = np.argsort(one)
    keys, counts = tuple(k[order] for k in keys), counts[order]
    first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return tuple(k[first] for k in keys), np.add.reduceat(counts, first)


def planes(values: np.ndarray, kind: str) -> bytes:
    """An array byte plane by byte plane, so that equal high bytes stand together."""
    return values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(raw: np.ndarray, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw[: n * np.dtype(kind).itemsize].reshape(-1, n).T).view(kind)[:, 0] if n else np.zeros(0, kind)


def packed(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> bytes:
    """Sorted keys and counts, compressed: the first keys as differences, the others as they are."""
    steps = np.diff(keys[0], prepend=keys[0].dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([planes(steps, "<u8"), *(planes(k, "<u8") for k in keys[1:]), planes(counts, "<u4")]))


def unpacked(blob: bytes, width: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // (8 * width + 4)
    keys = tuple(unplanes(raw[8 * n * k :], n, "<u8") for k in range(width))
    return (np.cumsum(keys[0], dtype=np.uint64), *keys[1:]), unplanes(raw[8 * n * width :], n, "<u4").astype(np.int64)


def by_part(part: np.ndarray, keys: tuple[np.ndarray, ...], counts: np.ndarray) -> pa.RecordBatch:
    """Rows (part, blob) of keys in order of part."""
    numbers, first = np.unique(part, return_index=True)
    blobs = [packed(tuple(k[a:b] for k in keys), counts[a:b]) for a, b in zip(first, np.append(first[1:], len(part)), strict=True)]
    return pa.record_batch([pa.array(numbers.astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "blob"])


def merged(batches: Iterator[pa.RecordBatch], width: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The different keys of all blobs with their summed counts, merged whenever HELD of them wait."""
    none = np.zeros(0, np.uint64)
    keys, counts, waiting, held = (none,) * width, np.zeros(0, np.int64), [], 0

    def all_of() -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        every = [(keys, counts), *waiting]
        return summed(tuple(np.concatenate([e[0][k] for e in every]) for k in range(width)), np.concatenate([e[1] for e in every]))

    for batch in batches:
        for blob in batch.column(batch.schema.get_field_index("blob")):
            waiting.append(unpacked(blob.as_py(), width))
            held += len(waiting[-1][1])
            if held >= HELD:
                keys, counts = all_of()
                waiting, held = [], 0
    return all_of()


def coded(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and their 256 values: the means of what falls into equal steps between the least and the largest."""
    if not len(logs):
        return np.zeros(0, np.uint8), np.zeros(256)
    codes = np.searchsorted(np.linspace(logs.min(), logs.max(), 257)[1:-1], logs, side="right")
    return codes.astype(np.uint8), np.bincount(codes, logs, 256) / np.maximum(1, np.bincount(codes, minlength=256))


def level(context_of: np.ndarray, successors: np.ndarray, contexts: int, universe: int) -> dict[str, EliasFano]:
    """Pointers and successors of a level from (context, successor) in order; successors are below ``universe``."""
    pointer = np.searchsorted(context_of, np.arange(contexts + 1))
    last = successors[np.maximum(pointer[1:] - 1, 0)].astype(np.int64)
    zero = np.concatenate([[0], np.cumsum(np.where(pointer[1:] > pointer[:-1], last + 1, 0))])  # above the contexts before
    values = (successors.astype(np.int64) + zero[context_of]).astype(np.uint64)
    return {"pointer": EliasFano.build(pointer.astype(np.uint64), len(successors) + 1), "successor": EliasFano.build(values, int(zero[-1]) + universe + 1)}


def search(sequences: dict[str, EliasFano], at: str, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Where the successors of contexts (in order) stand in a level, -1 if they don't: inside what the pointers bracket."""
    pointer, found = sequences[f"{at}pointer"], sequences[f"{at}successor"]
    out = np.full(len(context), -1, np.int64)
    if not len(context) or not found.n:
        return out
    new = np.concatenate([[True], context[1:] != context[:-1]])
    start, stop = (edge.astype(np.int64) for edge in pointer.get_two(context[new]))
    size, rank = stop - start, np.cumsum(new) - 1
    some = np.flatnonzero(size > 0)
    # the value before the bracket and the first one inside stand side by side
    before, first = (v.astype(np.int64) for v in found.get_two(np.maximum(start[some] - 1, 0)))
    leads = start[some] == 0
    zero, only = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    zero[some], only[some] = np.where(leads, 0, before + 1), np.where(leads, before, first)
    asked, of = successor + zero[rank], size[rank]
    one = np.flatnonzero((of == 1) & (only[rank] == asked))
    out[one] = start[rank[one]]
    more = np.flatnonzero(of > 1)
    out[more] = found.find(asked[more].astype(np.uint64), start[rank[more]], stop[rank[more]])
    return out


@dataclass
class Trie:
    """Where the parts of a model are.  words/tokens: before each part of level one, and in all; pairs: a bit by part."""

    folder: str
    words: np.ndarray
    tokens: np.ndarray
    pairs: np.ndarray

    @property
    def V(self) -> int:  # noqa: N802
        return int(self.words[-1])

    @property
    def N(self) -> int:  # noqa: N802
        return int(self.tokens[-1])

    def vocabulary(self, k: int) -> str:
        return f"{self.folder}/words-{k:04d}"

    def part_name(self, k: int) -> str:
        return f"{self.folder}/pairs-{k % 1000:03d}/{k:09d}"

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id (-1: unknown), count, and tokens of words before it, for sorted different hashes."""
        ids, counts, before = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        numbers, first = np.unique(word_part(h), return_index=True)
        for k, a, b in zip(numbers.tolist(), first.tolist(), np.append(first[1:], len(h)).tolist(), strict=True):
            if self.words[k] == self.words[k + 1]:
                continue
            found = load(self.vocabulary(k))[0]
            place = found["hash"].find(h[a:b] % np.uint64(WORD_RANGE))
            known = np.flatnonzero(place >= 0)
            at, after = found["pointer"].get_two(place[known])
            counts[a + known] = (after - at).astype(np.int64)
            ids[a + known], before[a + known] = place[known] + self.words[k], at.astype(np.int64) + self.tokens[k]
        return ids, counts, before

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id, in any order."""
        out = np.zeros(len(ids), np.int64)
        part = np.searchsorted(self.words, ids, side="right") - 1
        for k in np.unique(part).tolist():
            at = np.flatnonzero(part == k)
            different, back = np.unique(ids[at] - self.words[k], return_inverse=True)
            first, after = load(self.vocabulary(k))[0]["pointer"].get_two(different)
            out[at] = (after - first).astype(np.int64)[back]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.N + self.V + 1.0)

    def part(self, before: np.ndarray, counts: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The part where a pair and its triples belong: its context's tokens are cut by the successor's id.

        Rises with (context, successor).
        """
        place = before + np.floor(counts * (successor / max(1, self.V))).astype(np.int64)
        return np.minimum(place // PART, self.N // PART)

    def look_up(self, c: np.ndarray, w: np.ndarray, part: np.ndarray, owner: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted pairs of known ids: P(w | c) (nan if not seen) and what they leave to it (1 if not seen); and of
        triples (``owner``, the place of a pair, in order, and x): their shares, 0 if not seen."""
        prob, rest, share = np.full(len(c), np.nan), np.ones(len(c)), np.zeros(len(x))
        numbers, first = np.unique(part, return_index=True)
        stops = np.append(first[1:], len(part))
        for k, a, b, t, u in zip(numbers.tolist(), first.tolist(), stops.tolist(), np.searchsorted(owner, first).tolist(), np.searchsorted(owner, stops).tolist(), strict=True):
            if not self.pairs[k // 8] >> (k % 8) & 1:
                continue
            levels, more, _ = load(self.part_name(k))
            new = np.concatenate([[True], c[a + 1 : b] != c[a : b - 1]])
            rank = levels["context"].find(c[a:b][new].astype(np.uint64))[np.cumsum(new) - 1]
            inside = np.flatnonzero(rank >= 0)
            place = np.full(b - a, -1, np.int64)
            place[inside] = search(levels, "2.", rank[inside], w[a:b][inside])
            seen = np.flatnonzero(place >= 0)
            prob[a + seen], rest[a + seen] = more["probs"][more["prob"][place[seen]]], more["rests"][more["rest"][place[seen]]]
            of = place[owner[t:u] - a]
            inside = np.flatnonzero(of >= 0)
            at = search(levels, "3.", of[inside], x[t:u][inside])
            share[t + inside[at >= 0]] = more["shares"][more["share"][at[at >= 0]]]
        return prob, rest, share


WORD_RANGE = (1 << 64) // WORD_PARTS


def word_part(h: np.ndarray) -> np.ndarray:
    return (h // np.uint64(WORD_RANGE)).astype(np.int64)


def train(docs: DataFrame, folder: str) -> Trie:
    """Counts all words, pairs and triples of ``docs`` and writes the levels of the trie to ``folder``."""
    texts = docs.select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, 0):
            yield by_part(word_part(t.hashes), (t.hashes,), np.bincount(t.words, minlength=len(t.hashes)))

    def of_part(make: Callable[[int, Iterator[pa.RecordBatch]], list[int]]) -> Callable:
        """Rows (part, numbers) of what ``make`` returns for each part."""

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([make(key[0].as_py(), batches)], pa.list_(pa.int64()))], ["part", "numbers"])

        return run

    trie = Trie(folder, np.zeros(1), np.zeros(1), np.zeros(0, np.uint8))

    def vocabulary(k: int, batches: Iterator[pa.RecordBatch]) -> list[int]:
        (keys,), counts = merged(batches, 1)
        # a text has its end even if all its words are others, so an end that was only looked for has no count
        keys, counts = keys[counts > 0], counts[counts > 0]
        pointers = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        save(trie.vocabulary(k), {"hash": EliasFano.build(keys % np.uint64(WORD_RANGE), WORD_RANGE), "pointer": EliasFano.build(pointers, int(pointers[-1]) + 1)}, {}, {})
        return [len(keys), int(pointers[-1])]

    blobs = texts.mapInArrow(words, "part long, blob binary")
    found = dict(tuple(r) for r in blobs.groupBy("part").applyInArrow(of_part(vocabulary), "part long, numbers array<long>").collect())
    sums = np.concatenate([[[0, 0]], np.cumsum([found.get(k, [0, 0]) for k in range(WORD_PARTS)], axis=0)])
    trie.words, trie.tokens = sums[:, 0], sums[:, 1]

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pair, next word) with V for no next word after a text's end: pairs are counted by what follows them."""
        for _, t in groups(batches, 0):
            ids, counts, before = trie.lookup(t.hashes)
            n = len(t.hashes)
            pairs, of = np.unique(t.before() * n + t.words, return_inverse=True)
            after = np.append(t.words[1:], 0)
            after[t.words == t.end] = n
            key, times = np.unique(of * (n + 1) + after, return_counts=True)
            c, w = pairs // n, pairs % n
            part, of, after = trie.part(before[c], counts[c], ids[w]), key // (n + 1), key % (n + 1)
            pair = ids[c].astype(np.uint64) * np.uint64(trie.V) + ids[w].astype(np.uint64)
            yield by_part(part[of], (pair[of], np.append(ids, trie.V)[after].astype(np.uint64)), times)

    def successors(k: int, batches: Iterator[pa.RecordBatch]) -> list[int]:
        (pair_of, after), n = merged(batches, 2)
        after = after.astype(np.int64)
        pairs, first, rank = np.unique(pair_of, return_index=True, return_inverse=True)
        c, w = (pairs // np.uint64(trie.V)).astype(np.int64), (pairs % np.uint64(trie.V)).astype(np.int64)
        times = np.add.reduceat(n, first)
        contexts, context_of = np.unique(c, return_inverse=True)
        prob, probs = coded(np.log10((times + MU * trie.base(trie.counts_of(w))) / (trie.counts_of(contexts)[context_of] + MU)))
        rest, rests = coded(np.log10(NU / (times + NU)))
        inner = after < trie.V
        share, shares = coded(np.log10(n[inner] / (times[rank[inner]] + NU)))
        levels = {"context": EliasFano.build(contexts.astype(np.uint64), trie.V)}
        for name, made in (("2.", level(context_of, w, len(contexts), trie.V)), ("3.", level(rank[inner], after[inner], len(pairs), trie.V))):
            levels |= {name + key: sequence for key, sequence in made.items()}
        arrays = {"prob": prob, "probs": 10.0**probs, "rest": rest, "rests": 10.0**rests, "share": share, "shares": 10.0**shares}
        save(trie.part_name(k), levels, arrays, {})
        return []

    blobs = texts.mapInArrow(triples, "part long, blob binary")
    there = np.zeros(-(-(trie.N // PART + 1) // 8) * 8, np.uint8)
    there[[r[0] for r in blobs.groupBy("part").applyInArrow(of_part(successors), "part long, numbers array<long>").select("part").collect()]] = 1
    trie.pairs = np.packbits(there, bitorder="little")
    return trie


def scored(docs: DataFrame, trie: Trie) -> DataFrame:
    """Scores of every row's whole text: doc_id, n_tokens, n_known, train_tokens, base_score, score (sums of log10).

    Null texts count as empty and have the end alone.  A very long text is one piece: its tokens are held together.
    Without training text every probability is one.  Equal texts agree; null and repeated ids are kept; an empty table
    gives no rows; other columns are not read.
    """
    names = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    shape = docs.select("doc_id").schema
    for name, kind in names:
        shape = shape.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in groups(batches, 1):
            n, begins = len(t.hashes), np.cumsum(t.sizes) - t.sizes
            ids, counts, before = trie.lookup(t.hashes)
            base = trie.base(counts)
            pairs, of = np.unique(t.before() * n + t.words, return_inverse=True)
            c, w = pairs // n, pairs % n
            prob = base[w] * (MU / (counts[c] + MU))  # what holds for pairs not seen; an unknown context leaves all to the base
            rest, share = np.ones(len(pairs)), np.zeros(len(of))
            known = np.flatnonzero((ids[c] >= 0) & (ids[w] >= 0))
            if len(known):
                place = np.full(len(pairs), -1, np.int64)
                place[known] = np.arange(len(known))
                owner = np.append(-1, place[of[:-1]])  # the pair before each token
                third = np.flatnonzero((owner >= 0) & ~t.first() & (ids[t.words] >= 0))
                triple, back = np.unique(owner[third] * n + t.words[third], return_inverse=True)
                kc, kw = c[known], w[known]
                seen, left, shares = trie.look_up(ids[kc], ids[kw], trie.part(before[kc], counts[kc], ids[kw]), triple // n, ids[triple % n])
                prob[known] = np.where(np.isnan(seen), prob[known], seen)
                rest[known], share[third] = left, shares[back]
            first = t.first()
            score = np.log10(share + np.where(first, 1.0, np.append(1.0, rest[of[:-1]])) * prob[of])
            add = lambda x: pa.array(np.add.reduceat(x, begins))
            columns = [pa.array(t.sizes.astype(np.int64)), add((counts > 0)[t.words].astype(np.int64)), pa.array(np.full(len(begins), trie.N)), add(np.log10(base)[t.words]), add(score)]
            yield pa.record_batch([batch.column(0), *columns], shape.names)

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those whose crc32 of the id modulo 7 is not 2."""
    docs = documents(spark, sf_dir)
    trie = train(docs.where(fold(F.col("doc_id"), 7) != 2), fresh_path(spark, "lm"))
    found = scored(docs, trie)
    return found.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
