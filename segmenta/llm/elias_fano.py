"""Elias-Fano sequences in numpy, kept in files that are mapped into memory."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

#: Of the upper bits, ones from one whose place is noted to the next, and zeros: between these may stand many ones.
STEP, ZERO_STEP = 32, 4
ALL, ONES, HIGHS = (np.uint64(x) for x in (0xFFFFFFFFFFFFFFFF, 0x0101010101010101, 0x8080808080808080))


def _places() -> np.ndarray:
    """Where the k-th one of a byte stands, at 8 * byte + k."""
    out = np.zeros(2048, np.uint8)
    for byte in range(256):
        ones = [i for i in range(8) if byte >> i & 1]
        out[8 * byte : 8 * byte + len(ones)] = ones
    return out


PLACES = _places()


def in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the k-th one (uint64) of each word stands: counts by byte side by side, then a table for the byte."""
    s = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * ONES  # ones up to each byte
    place = np.bitwise_count(((k * ONES | HIGHS) - s) & HIGHS).astype(np.uint64) << np.uint64(3)
    rank = k - (((s << np.uint64(8)) >> place) & np.uint64(255))
    return place.astype(np.int64) + PLACES[(((words >> place) & np.uint64(255)) << np.uint64(3)) + rank]


def select(words: np.ndarray, noted: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """Where the k-th (from 0) one or zero of a bit string stands; noted: where each STEP-th or ZERO_STEP-th does."""
    flip, step = (np.uint64(0), STEP) if ones else (ALL, ZERO_STEP)
    start = noted[k // step].astype(np.int64)
    at, left = start >> 6, k % step
    chosen = (words[at] ^ flip) & (ALL << (start & 63).astype(np.uint64))
    n = np.bitwise_count(chosen).astype(np.int64)
    open_ = np.flatnonzero(left >= n)
    while len(open_):
        left[open_] -= n[open_]
        at[open_] += 1
        chosen[open_] = words[at[open_]] ^ flip
        n[open_] = np.bitwise_count(chosen[open_])
        open_ = open_[left[open_] >= n[open_]]
    return (at << 6) + in_word(chosen, left.astype(np.uint64))


def run_after(words: np.ndarray, at: np.ndarray, ones: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many ones (or zeros) follow a place without a break, and for which places the word does not tell."""
    shift = (at & 63).astype(np.uint64)
    rest = ((words[at >> 6] ^ (np.uint64(0) if not ones else ALL)) >> shift) >> np.uint64(1)  # what breaks the run is one
    return np.bitwise_count((rest & -rest) - np.uint64(1)).astype(np.int64), np.flatnonzero(rest == 0)


class EliasFano:
    """A rising sequence below ``universe``: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, parts: dict[str, np.ndarray]):
        self.n, self.l = n, low_bits
        self.low, self.high, self.ones, self.zeros = (parts[k] for k in ("low", "high", "ones", "zeros"))

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values`` (uint64) must rise, equal ones allowed."""
        n = len(values)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (universe >> low_bits) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones, zeros = high[::STEP] + np.arange(n)[::STEP], np.flatnonzero(bits == 0)[::ZERO_STEP]
        noted = np.uint32 if len(bits) < 1 << 32 else np.uint64
        low = np.zeros(-(-n * low_bits // 64) + 2, np.uint64)
        if low_bits:
            rest, at = values & np.uint64((1 << low_bits) - 1), np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, rest << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return cls(n, low_bits, {"low": low, "high": words, "ones": ones.astype(noted), "zeros": zeros.astype(noted)})

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        high = (select(self.high, self.ones, i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self.lows(i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places ``i`` and at the places after them; after the last place any value."""
        at = select(self.high, self.ones, i, True)
        gap, unknown = run_after(self.high, at, False)
        after = at + gap + 1
        unknown = unknown[i[unknown] + 1 < self.n]  # after the last one there is none: what is given for it means nothing
        after[unknown] = select(self.high, self.ones, i[unknown] + 1, True)
        join = lambda at, i: ((at - i).astype(np.uint64) << np.uint64(self.l)) | self.lows(i)
        return join(at, i), join(after, i + 1)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """The place of each ``x`` in the sequence, or between places ``first`` and ``stop`` of it, -1 where it isn't: by
        halves among those of its high bits, which may be many where the sequence is dense."""
        high, low = (x >> np.uint64(self.l)).astype(np.int64), x & np.uint64((1 << self.l) - 1)
        before = np.full(len(x), -1, np.int64)  # the zero before those of the same high bits
        later = np.flatnonzero(high > 0)
        before[later] = select(self.high, self.zeros, high[later] - 1, False)
        start = before - high + 1
        run, unknown = run_after(self.high, np.maximum(before, 0), True)
        unknown = np.union1d(unknown, np.flatnonzero(before < 0))
        end = start + run
        end[unknown] = select(self.high, self.zeros, high[unknown], False) - high[unknown]
        if first is not None:
            start, end = np.maximum(start, first), np.minimum(end, stop)
        last, open_ = end.copy(), np.flatnonzero(start < end)
        while len(open_):
            middle = (start[open_] + last[open_]) >> 1
            less = self.lows(middle) < low[open_]
            start[open_[less]] = middle[less] + 1
            last[open_[~less]] = middle[~less]
            open_ = open_[start[open_] < last[open_]]
        out, inside = np.full(len(x), -1, np.int64), np.flatnonzero(start < end)
        hit = inside[self.lows(start[inside]) == low[inside]]
        out[hit] = start[hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones, "zeros": self.zeros}


def save(uri: str, sequences: dict[str, EliasFano], more: dict[str, np.ndarray], about: dict) -> None:
    """One file: a line of JSON, then arrays on multiples of eight bytes.  It appears under its name when it is whole."""
    held = {f"{name}.{k}": a for name, s in sequences.items() for k, a in s.arrays().items()} | more
    head = {"about": about, "sequences": {k: [s.n, s.l] for k, s in sequences.items()}, "arrays": []}
    at = 0
    for k, a in held.items():
        head["arrays"].append([k, str(a.dtype), len(a), at])
        at += -(-a.nbytes // 8) * 8
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(line)
        for a in held.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
    try:
        system.move(own, path)
    except OSError:  # some stores don't replace; another attempt of the task has written the same
        if system.get_file_info(path).type != fs.FileType.File:
            raise
        system.delete_file(own)


class Opened:
    """The files used last: mapped ones by number, those of a store that can't be mapped by their bytes in memory."""

    def __init__(self, files: int = 4096, size: int = 256 << 20):
        self.files, self.size, self.held, self.used = files, size, OrderedDict(), 0

    def __call__(self, uri: str) -> tuple[dict[str, EliasFano], dict[str, np.ndarray], dict]:
        if uri in self.held:
            self.held.move_to_end(uri)
            return self.held[uri][0]
        system, path = fs.FileSystem.from_uri(uri)
        if isinstance(system, fs.LocalFileSystem):
            whole, cost = np.memmap(path, np.uint8, "r").view(np.ndarray), 0
        else:
            with system.open_input_file(path) as f:
                whole = np.frombuffer(f.read(), np.uint8)
            cost = len(whole)
        while self.held and (len(self.held) >= self.files or self.used + cost > self.size):
            self.used -= self.held.popitem(last=False)[1][1]
        start = bytes(whole[: 1 << 16])
        line = start[: start.index(b"\n") + 1]
        head = json.loads(line)
        arrays = {k: whole[len(line) + at : len(line) + at + n * np.dtype(kind).itemsize].view(kind) for k, kind, n, at in head["arrays"]}
        sequences = {k: EliasFano(n, low, {p: arrays.pop(f"{k}.{p}") for p in ("low", "high", "ones", "zeros")}) for k, (n, low) in head["sequences"].items()}
        self.held[uri] = ((sequences, arrays, head["about"]), cost)
        self.used += cost
        return self.held[uri][0]


#: Opens a file of ``save``: its sequences, other arrays, and what else it says.
load = Opened()
