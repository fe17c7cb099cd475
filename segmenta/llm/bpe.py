"""Byte-level BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

Merges never cross a pre-token.  Inside one, how far to the left a change at the right end can reach is bounded by the
merge list alone: a merge that happens or not because of what follows can only disturb merges of a later rank to its
left, each of which must take, as its right part, a symbol that starts with the disturbed left part.  The longest such
chain plus the longest token is the sufficient lookahead (``sufficient_lookahead``).  Tokens that end at least that far
before the end of the bytes read so far are final: ``Transducer`` emits them and forgets their bytes, so its memory does
not grow with the text.

Texts stream too: the last pre-tokens of what has been read wait for more, all others are final (``Encoder.stream``).  Most
pre-tokens are far shorter than the lookahead and end before it does, so they are final at once; all those of a batch of
texts are merged together in numpy (``merge_rows``), behind a table of recent pre-tokens of fixed size.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import documents

VOCABULARY = "byte_bpe_50k.json"
LETTER, NUMBER, OTHER, SPACE, CUT = range(5)
#: Characters of a text, or of several short ones, that are cut into pre-tokens at once.
CHUNK = 1 << 19
#: Pre-tokens up to so many bytes are kept in the table of recent ones.
SHORT = 15
#: Pre-tokens up to so many bytes are merged in rows; longer ones stream through the transducer.
ROW = 64
NONE = np.iinfo(np.int32).max


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: letter (L*), number (N*), white space, other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    found = np.full(0x110000, OTHER, np.uint8)
    for klass, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"[\p{White_Space}]+")):
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = klass
    return found


def pretoken_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens start.  points: code points; kind: their classes, CUT for a separator between texts.

    The rule is that of the usual pattern: runs of one class, with one leading space; English contractions; white space
    before a word leaves its last character to stand alone or, if it is a space, to lead the word.
    """
    start = np.ones(len(points), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == CUT)
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero(points[:-1] == 39)
    quote = quote[start[quote] & (kind[quote + 1] == LETTER) & (kind[quote] == OTHER)]
    if len(quote):
        padded = np.append(points, [0, 0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        letter = np.append(kind, [CUT] * 3)[quote + 2] == LETTER
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = letter & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for chosen, width in ((single, 2), (double & ~single, 3)):
            at = quote[chosen]
            start[at + 1] = False
            at = at + width
            start[at[at < len(start)]] = True
    return start


class Vocabulary:
    """Merges and tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        byte_of = self._bytes_by_character()
        self.tokens: list[bytes] = [b""] * (1 + max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])]))
        for token, i in held["model"]["vocab"].items():
            self.tokens[i] = bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        ids = {t: i for i, t in enumerate(self.tokens) if t and i not in self.special.values()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        sides = [(bytes(byte_of[c] for c in a), bytes(byte_of[c] for c in b)) for a, b in pairs]
        self.left = np.array([ids[a] for a, _ in sides], np.int64)
        self.right = np.array([ids[b] for _, b in sides], np.int64)
        self.merged = np.array([ids[a + b] for a, b in sides], np.int32)
        self.size = len(self.tokens)
        self.longest = max(len(self.tokens[i]) for i in self.merged)
        self.ranks = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self._table()

    @staticmethod
    def _bytes_by_character() -> dict[str, int]:
        """Printable Latin-1 characters stand for themselves, the other bytes for code points from 256 in order."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def _table(self) -> None:
        """Open-addressing hash table from a pair of symbols to the rank of its merge."""
        self.bits = 19
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.probes, mask = 1, (1 << self.bits) - 1
        for key, rank in zip(self.left * self.size + self.right, range(len(self.left)), strict=True):
            slot, k = self._slot(int(key)), 1
            while self.keys[slot] != -1:
                slot, k = (slot + 1) & mask, k + 1
            self.keys[slot], self.values[slot], self.probes = key, rank, max(self.probes, k)

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 13) & ((1 << self.bits) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of a with b, NONE where there is none."""
        key = a.astype(np.int64) * self.size + b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_rows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of many sequences of equal length: (token rows padded with 0, tokens in each).

        Each round makes in every row the merge of lowest rank, leftmost first, so rows that go on all have equal length.
        """
        m, w = symbols.shape
        out, sizes = np.zeros((m, w), np.int32), np.full(m, w)
        row, ids = np.arange(m), symbols.astype(np.int32)
        rank = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, w - 1)
        while w > 1 and len(row):
            at = rank.argmin(1)
            every = np.arange(len(row))
            best = rank[every, at]
            ended = best == NONE
            if ended.any():
                out[row[ended], :w], sizes[row[ended]] = ids[ended], w
                going = ~ended
                row, ids, rank, at, best = row[going], ids[going], rank[going], at[going], best[going]
                every = np.arange(len(row))
            if not len(row):
                break
            column = np.arange(w - 1)
            ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[every, at] = self.merged[best]
            w -= 1
            rank = np.where(column[: w - 1] < at[:, None], rank[:, :-1], rank[:, 1:])
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < w - 1)
            rank[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
            rank[after, at[after]] = self.rank(ids[after, at[after]], ids[after, at[after] + 1])
        if len(row):
            out[row, :w], sizes[row] = ids, w
        return out, sizes

    def merge_one(self, piece: bytes) -> list[int]:
        """BPE of one sequence of any length, by a heap of merges."""
        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := self.ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    @property
    def sufficient_lookahead(self) -> int:
        """Bytes behind a token's end after which nothing that follows can change it.

        reach[t]: the longest chain of disturbed merges, all of ranks above the one looked at, that starts at a symbol
        beginning with t.  Ranks are visited from the last to the first, so each merge extends the chains of later ones.
        """
        if not hasattr(self, "_lookahead"):
            reach, split = np.zeros(self.size, np.int64), {int(m): int(a) for m, a in zip(self.merged, self.left, strict=True)}
            most = 0
            for r in range(len(self.left) - 1, -1, -1):
                u, y = int(self.left[r]), int(self.right[r])
                length = len(self.tokens[u]) + int(reach[u])
                most = max(most, length)
                while True:
                    reach[y] = max(reach[y], length)
                    if y not in split:
                        break
                    y = split[y]
            self._lookahead = most + self.longest
        return self._lookahead


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """Encodes one pre-token that comes in pieces; holds at most some lookaheads of bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held = vocab, b""
        self.window = 4 * vocab.sufficient_lookahead

    def feed(self, piece: bytes) -> list[int]:
        """Tokens that have become final."""
        out: list[int] = []
        for at in range(0, len(piece), self.window):
            self.held += piece[at : at + self.window]
            if len(self.held) >= self.window:
                done, stable = 0, len(self.held) - self.vocab.sufficient_lookahead
                for token in self.vocab.merge_one(self.held):
                    if done + len(self.vocab.tokens[token]) > stable:
                        break
                    out.append(token)
                    done += len(self.vocab.tokens[token])
                self.held = self.held[done:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.vocab.merge_one(self.held), b""
        return out


class Encoder:
    """Encodes texts to token ids.  ``misses``: how short pre-tokens outside the table of recent ones are encoded."""

    def __init__(self, path: str, bits: int = 19, misses: Callable[[list[bytes]], list[list[int]]] | None = None):
        self.vocab, self.misses, self.bits = vocabulary(path), misses, bits
        self.k0, self.k1 = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.n, self.ids = np.zeros(1 << bits, np.uint8), np.zeros((1 << bits, 8), np.int32)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, whole."""
        for parts in self.emitted(texts):
            held = list(parts)
            yield held[0] if len(held) == 1 else np.concatenate([np.zeros(0, np.int32), *held])

    def emitted(self, texts: Iterable[str | None]) -> Iterator[Iterable[np.ndarray]]:
        """Of each text its ids, as they become final.  Short texts are cut together; a long one goes chunk by chunk, and
        what it has emitted is not held."""
        group: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > CHUNK:
                yield from ([ids] for ids in self._group(group))
                group, size = [], 0
                yield self.stream(text[i : i + CHUNK] for i in range(0, len(text), CHUNK))
                continue
            group.append(text)
            size += len(text)
            if size > CHUNK:
                yield from ([ids] for ids in self._group(group))
                group, size = [], 0
        yield from ([ids] for ids in self._group(group))

    def _parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special tokens, each with the id of the special token after it; the leftmost one counts, and the
        longest of those that begin there."""
        special = self.vocab.special
        if not any(content in text for content in special):
            return [(text, None)]
        found = re.split("(" + "|".join(re.escape(c) for c in sorted(special, key=len, reverse=True)) + ")", text)
        return [(found[k], special[found[k + 1]] if k + 1 < len(found) else None) for k in range(0, len(found), 2)]

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        parts = [(p, i, k) for k, t in enumerate(texts) for p, i in self._parts(t)]
        ids, ends = self._pieces([p for p, _, _ in parts])
        found: list[list[np.ndarray]] = [[] for _ in texts]
        at = 0
        for (_, special, k), end in zip(parts, ends, strict=True):
            found[k].append(ids[at:end])
            if special is not None:
                found[k].append(np.array([special], np.int32))
            at = end
        for own in found:
            yield own[0] if len(own) == 1 else np.concatenate(own)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all pieces in one array, and where each piece ends."""
        text = "\0".join(pieces) + "\0"
        raw = text.encode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        cuts = np.cumsum([len(p) + 1 for p in pieces]) - 1
        kind = classes()[points]
        kind[cuts] = CUT
        starts = np.flatnonzero(pretoken_starts(points, kind))
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        begin = place[starts]
        length = np.diff(np.append(begin, place[-1]))
        cut = kind[starts] == CUT
        ids, sizes = self._words(raw, begin[~cut], length[~cut])
        # tokens before each cut
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, upto[np.flatnonzero(cut) - np.arange(int(cut.sum()))].tolist()

    def _words(self, raw: bytes, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens, in order, in one array, and how many each has."""
        buffer = np.frombuffer(raw + bytes(16), np.uint8)
        eight = np.ndarray((len(raw) + 8,), "<u8", buffer=buffer, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        sizes, group = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.uint8)
        short = length <= SHORT
        near = np.flatnonzero(short)
        size = length[near]
        k0 = eight[begin[near]] & mask[np.minimum(size, 8)]
        k1 = eight[begin[near] + 8 * (size > 8)] & mask[np.where(size > 8, size - 8, 0)] | (size.astype(np.uint64) << np.uint64(56))
        mixed = (k0 ^ (k1 * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        slot = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = (self.k0[slot] == k0) & (self.k1[slot] == k1)
        hits = slot[hit]
        count = self.n[hits]
        sizes[near[hit]] = count
        flat_hits = self.ids[hits][np.arange(8) < count[:, None]]
        # short ones outside the table: encode each different one once
        missed = np.flatnonzero(~hit)
        _, first, back = np.unique(mixed[missed], return_index=True, return_inverse=True)
        if not (np.array_equal(k0[missed][first][back], k0[missed]) and np.array_equal(k1[missed][first][back], k1[missed])):
            first, back = np.arange(len(missed)), np.arange(len(missed))  # two pre-tokens share all 64 bits
        own = near[missed[first]]
        rows, counts = self._short(raw, buffer, begin[own], length[own])
        keep = np.flatnonzero(counts <= 8)
        into = slot[missed[first[keep]]]
        self.k0[into], self.k1[into] = k0[missed[first[keep]]], k1[missed[first[keep]]]
        self.n[into], self.ids[into] = counts[keep], rows[keep, :8]
        sizes[near[missed]], group[near[missed]] = counts[back], 1
        flat_missed = rows[back][np.arange(rows.shape[1]) < counts[back][:, None]]
        # long ones
        far = np.flatnonzero(~short)
        group[far] = 2
        long_ids = self._long(raw, buffer, begin[far], length[far])
        sizes[far] = [len(x) for x in long_ids]
        of = np.repeat(group, sizes)
        out = np.zeros(len(of), np.int32)
        out[of == 0], out[of == 1] = flat_hits, flat_missed
        if long_ids:
            out[of == 2] = np.concatenate(long_ids)
        return out, sizes

    def _short(self, raw: bytes, buffer: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = np.zeros((len(begin), SHORT + 1), np.int32), np.zeros(len(begin), np.int64)
        if self.misses is not None:
            for k, ids in enumerate(self.misses([raw[a : a + n] for a, n in zip(begin.tolist(), length.tolist(), strict=True)])):
                rows[k, : len(ids)], counts[k] = ids, len(ids)
            return rows, counts
        for w in np.unique(length).tolist():
            at = np.flatnonzero(length == w)
            rows[at, :w], counts[at] = self.vocab.merge_rows(self.vocab.byte_ids[buffer[begin[at, None] + np.arange(w)]])
        return rows, counts

    def _long(self, raw: bytes, buffer: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(begin)
        if self.misses is not None:
            return [np.array(ids, np.int32) for ids in self.misses([raw[a : a + n] for a, n in zip(begin.tolist(), length.tolist(), strict=True)])]
        for w in np.unique(length).tolist():
            at = np.flatnonzero(length == w)
            if w <= ROW:
                rows, counts = self.vocab.merge_rows(self.vocab.byte_ids[buffer[begin[at, None] + np.arange(w)]])
                for k, row, n in zip(at.tolist(), rows, counts.tolist(), strict=True):
                    out[k] = row[:n]
                continue
            for k in at.tolist():
                machine = Transducer(self.vocab)
                out[k] = np.array([*machine.feed(raw[begin[k] : begin[k] + w]), *machine.finish()], np.int32)
        return out

    def stream(self, chunks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of a text that comes in chunks, as they become final.

        The last two pre-tokens of what has been read wait for more text; a run of one class that outgrows a chunk is
        passed on to a transducer instead, whose memory is bounded.
        """
        held, machine, klass = "", None, CUT
        guard = max(map(len, self.vocab.special), default=1)
        for chunk in chunks:
            held += chunk
            if machine is not None:
                ended, stop = self._run_end(held, klass)
                if ended and stop > len(held) - guard and stop != self._special_at(held):
                    ended, stop = False, len(held)  # a special token may have begun before the end
                yield np.array(machine.feed(held[: (stop := stop if ended else max(0, stop - guard))].encode("utf-8", "replace")), np.int32)
                held = held[stop:]
                if not ended:
                    continue
                yield np.array(machine.finish(), np.int32)
                machine = None
            if len(held) <= 2 * guard:
                continue
            *whole, (held, _) = self._parts(held)
            for part, i in whole:
                yield from self._group([part])
                yield np.array([i], np.int32)
            points = np.frombuffer(held.encode("utf-32-le", "replace"), "<u4")
            kind = classes()[points]
            starts = np.flatnonzero(pretoken_starts(points, kind)) if len(points) else np.zeros(0, int)
            starts = starts[starts < len(held) - guard]
            if len(starts) > 2:
                yield self._pieces([held[: starts[-2]]])[0] if kind[starts[-2] - 1] != SPACE else self._before_more(held, int(starts[-2]))
                held = held[starts[-2] :]
            elif len(held) > CHUNK and len(starts):
                first = int(starts[-1])
                if first:
                    yield self._before_more(held, first)
                machine, klass = Transducer(self.vocab), int(kind[min(first + 1, len(kind) - 1)])
                stop = len(held) - guard
                yield np.array(machine.feed(held[first:stop].encode("utf-8", "replace")), np.int32)
                held = held[stop:]
        if machine is not None:
            _, stop = self._run_end(held, klass)
            yield np.array([*machine.feed(held[:stop].encode("utf-8", "replace")), *machine.finish()], np.int32)
            held = held[stop:]
        yield from self._group([held])

    def _special_at(self, held: str) -> int:
        """Where the first special token starts, or the length."""
        return min((at for content in self.vocab.special if (at := held.find(content)) >= 0), default=len(held))

    def _run_end(self, held: str, klass: int) -> tuple[bool, int]:
        """Whether and where a run of one class ends; the last of white space belongs to a word that follows."""
        at = self._special_at(held)
        other = np.flatnonzero(classes()[np.frombuffer(held[:at].encode("utf-32-le", "replace"), "<u4")] != klass)
        if len(other):
            return True, max(0, int(other[0]) - (klass == SPACE))
        return at < len(held), at

    def _before_more(self, held: str, end: int) -> np.ndarray:
        """Ids of the pre-tokens of ``held`` that end by ``end``, cut with the text that follows in view."""
        points = np.frombuffer(held.encode("utf-32-le", "replace"), "<u4")
        starts = np.flatnonzero(pretoken_starts(points, classes()[points]))
        starts = starts[starts <= end]
        words = [held[a:b].encode("utf-8", "replace") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        length = np.array([len(w) for w in words], np.int64)
        return self._words(b"".join(words), np.cumsum(length) - length, length)[0] if words else np.zeros(0, np.int32)


class Decoder:
    """Text of ids that come in parts.  The state is the unfinished code point at the end; invalid bytes become U+FFFD."""

    def __init__(self, vocab: Vocabulary):
        self.token, self.machine = vocab.tokens.__getitem__, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, step: int = 4096) -> Iterator[str]:
        for at in range(0, len(ids), step):
            yield self.machine.decode(b"".join(map(self.token, ids[at : at + step].tolist())))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decode(vocab: Vocabulary, ids: np.ndarray, step: int = 4096) -> Iterator[str]:
    """Text of the ids in pieces."""
    machine = Decoder(vocab)
    yield from machine.feed(ids, step)
    yield machine.finish()


@lru_cache(2)
def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each number below ``size`` in decimal with a comma behind, as bytes in rows, and how long it is."""
    texts = [f"{i},".encode() for i in range(size)]
    width = max(map(len, texts))
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(size, width), np.array([len(t) for t in texts])


def listed(ids: np.ndarray, size: int) -> bytes:
    """The ids in decimal, each with a comma behind."""
    rows, width = decimals(size)
    return rows[ids][np.arange(rows.shape[1]) < width[ids][:, None]].tobytes()


def digests(machine: Encoder, parts: Iterable[np.ndarray]) -> tuple[int, str, str]:
    """How many ids there are, and the digests of their decimal list and of the text they decode to, from ids that come in
    parts: each part is digested and decoded as it is emitted, and then forgotten."""
    n, ids_of, text_of, decoder, comma = 0, sha256(), sha256(), Decoder(machine.vocab), b""
    for ids in parts:
        n += len(ids)
        for at in range(0, len(ids), CHUNK):
            list_ = comma + listed(ids[at : at + CHUNK], machine.vocab.size)
            ids_of.update(list_[:-1])
            comma = b","
        for piece in decoder.feed(ids):
            text_of.update(piece.encode())
    text_of.update(decoder.finish().encode())
    return n, ids_of.hexdigest(), text_of.hexdigest()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """The id of each row and ``ids``, its tokens (array of int).

    Null texts count as empty and have none; the tokens of a very long text are one array.  Equal texts agree; null and
    repeated ids are kept; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(encoder(path).encode([t.as_py() for t in batch.column(1)]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))], [id_column, "ids"])

    return docs.select(id_column, "text").mapInArrow(run, docs.select(id_column).schema.add("ids", "array<int>"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: its tokens and the text that they decode to.

    Null texts count as empty: no tokens, digests of the empty text.  A very long text goes chunk by chunk and its tokens
    are digested as they become final.  Equal texts agree; null and repeated ids are kept; an empty table gives no rows;
    other columns are not read.
    """
    shape = docs.select("doc_id").schema.add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path)
        for batch in batches:
            rows = [digests(machine, parts) for parts in machine.emitted(t.as_py() for t in batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], shape.names)

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents and what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
