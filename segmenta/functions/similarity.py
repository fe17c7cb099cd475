"""Similarity of strings and alignment of words.

The scalar measures follow their public definitions: ratio is 200 LCS / (lengths), and the token measures apply it to sorted
or intersected words.  The longest common subsequence is computed bit-parallel on Python integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


DIVERGENCE = T.ArrayType(
    T.StructType(
        [
            T.StructField("asr_token", T.StringType()),
            T.StructField("retrieval_token", T.StringType()),
            T.StructField("position", T.IntegerType()),
            T.StructField("asr_word_confidence", T.DoubleType()),
            T.StructField("is_divergent", T.BooleanType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
)


def common(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        u = state & places.get(x, 0)
        state = (state + u | state - u) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 if a == b else 200.0 * common(a, b) / total if total else 100.0


#: Characters of a string that one machine word holds; longer pairs are compared one by one.
LANES = 64
#: Cells of a table, and pairs, that are laid out at once.
CELLS, SIDE = 1 << 19, 1 << 16


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of some texts one after the other, and where each text starts (and the last one ends)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def places_of(patterns: Sequence[str], alphabet: np.ndarray) -> np.ndarray:
    """For each pattern of up to LANES characters and letter of the alphabet, the bits of its places; a last column has none."""
    letters, at = code_points(patterns)
    letters, sizes = coded(letters, alphabet), np.diff(at)
    table = np.zeros((len(patterns), len(alphabet) + 1), np.uint64)
    for i in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > i)
        table[some, letters[at[some] + i]] |= np.uint64(1 << i)
    table[:, -1] = 0
    return table


def coded(letters: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Places in the alphabet; what is not in it stands one after."""
    at = np.searchsorted(alphabet, letters)
    return np.where(alphabet[np.minimum(at, len(alphabet) - 1)] == letters, at, len(alphabet)) if len(alphabet) else np.zeros(len(letters), np.int64)


def common_of(table: np.ndarray, of: np.ndarray, sizes: np.ndarray, letters: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """``common`` of a pattern (row ``of`` of a table of places, with ``sizes`` characters) and a stretch of coded letters, for many
    at once: a step for each character of the stretches."""
    out = np.zeros(len(of), np.int64)
    flat, width = table.ravel(), table.shape[1]
    longest = np.argsort(starts - stops, kind="stable")
    for at in range(0, len(of), SIDE):
        some = longest[at : at + SIDE]
        n, base, start = (stops - starts)[some], of[some] * width, starts[some]
        state = np.full(len(some), np.uint64(2**64 - 1))
        # those that have ended stand last
        going = len(some) - np.searchsorted(n[::-1], np.arange(int(n[0])), side="right")
        for j, k in enumerate(going.tolist()):
            now = state[:k]
            used = now & flat[base[:k] + letters[start[:k] + j]]
            state[:k] = now + used | now - used
        own = sizes[of[some]]
        full = np.where(own < LANES, (np.uint64(1) << (own % LANES).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
        out[some] = own - np.bitwise_count(state & full)
    return out


def commons(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """``common`` of many pairs."""
    out = np.zeros(len(pairs), np.int64)
    short = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    fit = [i for i, (a, _) in enumerate(short) if 0 < len(a) <= LANES]
    for at in range(0, len(fit), 4096):
        part = fit[at : at + 4096]
        alphabet = np.unique(code_points([short[i][0] for i in part])[0])
        step = max(1, CELLS // (len(alphabet) + 1))
        for k in range(0, len(part), step):
            some = part[k : k + step]
            letters, ends = code_points([short[i][1] for i in some])
            table = places_of([short[i][0] for i in some], alphabet)
            out[some] = common_of(table, np.arange(len(some)), np.array([len(short[i][0]) for i in some]), coded(letters, alphabet), ends[:-1], ends[1:])
    for i, (a, b) in enumerate(short):
        if len(a) > LANES:
            out[i] = common(a, b)
    return out


def ratios(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """``ratio`` of many pairs."""
    total = np.array([len(a) + len(b) for a, b in pairs])
    same = np.array([a == b for a, b in pairs], bool)
    return np.where(same | (total == 0), 100.0, 200.0 * commons(pairs) / np.maximum(total, 1))


def partials(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """``partial_ratio`` of many pairs: all windows of all pairs side by side."""
    out = np.zeros(len(pairs))
    asked = []
    for i, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not short or short in long:
            out[i] = 100.0 if short or not long else 0.0
        elif len(short) > LANES:
            out[i] = partial_ratio(a, b)
        else:
            asked.append((i, short, long))
            if len(a) == len(b):
                asked.append((i, long, short))
    weights = np.concatenate([[0], np.cumsum([len(s) + len(t) for _, s, t in asked])])
    start = 0
    while start < len(asked):
        stop = min(max(int(np.searchsorted(weights, weights[start] + SIDE, side="right")) - 1, start + 1), start + 4096)
        some, start = asked[start:stop], stop
        alphabet = np.unique(code_points([s for _, s, _ in some])[0])
        for k in range(0, len(some), step := max(1, CELLS // (len(alphabet) + 1))):
            _windows(some[k : k + step], alphabet, out)
    return out


def _windows(asked: Sequence[tuple[int, str, str]], alphabet: np.ndarray, out: np.ndarray) -> None:
    letters, at = code_points([t for _, _, t in asked])
    m, n = np.array([len(s) for _, s, _ in asked]), np.diff(at)
    counts = n + m - 1
    of = np.repeat(np.arange(len(asked)), counts)
    end = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    start, stop = np.maximum(end - m[of], 0), np.minimum(end, n[of])
    letters, first = coded(letters, alphabet), at[of]
    # the last character of a window, or the first where it sticks out at the end, is one of the pattern's
    table = places_of([s for _, s, _ in asked], alphabet)
    some = table[of, letters[first + np.where(end <= n[of], stop - 1, start)]] > 0
    of, start, stop, first = of[some], start[some], stop[some], first[some]
    found = 200.0 * common_of(table, of, m, letters, first + start, first + stop) / (m[of] + stop - start)
    new = np.flatnonzero(np.diff(of, prepend=-1))
    if len(new):
        np.maximum.at(out, np.array([i for i, _, _ in asked])[of[new]], np.maximum.reduceat(found, new))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one; windows may stick out at either end."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    return max(_partial(a, b), _partial(b, a)) if len(a) == len(b) else _partial(*sorted((a, b), key=len))


def _partial(short: str, long: str) -> float:
    if short in long:
        return 100.0
    m, letters, best = len(short), set(short), 0.0
    have = Counter(short)
    for end in range(1, len(long) + m):
        start, stop = max(0, end - m), min(end, len(long))
        if start >= len(long) or not (long[stop - 1] in letters if end <= len(long) else long[start] in letters):
            continue
        window = long[start:stop]
        bound = 200.0 * sum(min(n, have[c]) for c, n in Counter(window).items()) / (m + len(window))
        if bound > best:
            best = max(best, ratio(short, window))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_sets(a: str, b: str) -> tuple[float, int, int, str, str]:
    """What ``token_set_ratio`` comes to but for one comparison: (least, add, total, left, right), and it is the greater of
    least and, where there is a left, 200 (add + common(left, right)) / total.

    The shared words begin both joined texts, so they count whole, and a joined text has just them in common with them.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0, 0, 1, "", ""
    both, left, right = x & y, x - y, y - x
    if both and not (left and right):
        return 100.0, 0, 1, "", ""
    one, two = " ".join(sorted(left)), " ".join(sorted(right))
    if not both:
        return 0.0, 0, len(one) + len(two), one, two
    s = sum(map(len, both)) + len(both) - 1
    return 200.0 * s / (2 * s + 1 + min(len(one), len(two))), s + 1, 2 * s + 2 + len(one) + len(two), one, two


def token_set_ratio(a: str, b: str) -> float:
    least, add, total, left, right = token_sets(a, b)
    return max(least, 200.0 * (add + common(left, right)) / total) if left else least


def token_set_ratios(pairs: Sequence[tuple[str, str]], least: float = 0.0) -> np.ndarray:
    """``token_set_ratio`` of many pairs; where it cannot reach ``least``, 0."""
    found = [token_sets(a, b) for a, b in pairs]
    out = np.array([f[0] for f in found])
    open_ = [i for i, (_, add, total, left, right) in enumerate(found) if left and 200.0 * (add + min(len(left), len(right))) / total >= least]
    if open_:
        shared = commons([found[i][3:] for i in open_])
        out[open_] = np.maximum(out[open_], [200.0 * (found[i][1] + int(k)) / found[i][2] for i, k in zip(open_, shared, strict=True)])
    return np.where(out >= least, out, 0.0)


def token_sort_ratios(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """``token_sort_ratio`` of many pairs."""
    return ratios([(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs])


def jaccard(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x or y else 0.0


def word_errors(reference: Sequence, hypothesis: Sequence) -> int:
    """Levenshtein distance of two sequences."""
    row = list(range(len(hypothesis) + 1))
    for i, r in enumerate(reference, 1):
        last, row[0] = row[0], i
        for j, h in enumerate(hypothesis, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (r != h))
    return row[-1]


def divergence(heard: str, source: str, confidences: Sequence[float] | None = None) -> list[tuple]:
    """(word heard, source words, position, confidence, divergent, similarity) for each heard word, from an alignment.

    Both are canonical texts.  Blocks of equal length are compared word by word; a word against a block of another length
    carries the whole block; words only in the source are left out; missing confidences are 0.
    """
    a, b, out = heard.split(), source.split(), []
    if not a or not b:
        return out
    sure = [*(confidences or []), *[0.0] * len(a)]
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, a, b).get_opcodes():
        for k in range(i1, i2):
            if kind == "equal":
                out.append((a[k], b[j1 + k - i1], k, sure[k], False, 1.0))
            elif kind == "replace" and i2 - i1 == j2 - j1:
                like = ratio(a[k], b[j1 + k - i1]) / 100
                out.append((a[k], b[j1 + k - i1], k, sure[k], like < 1, like))
            else:
                out.append((a[k], " ".join(b[j1:j2]), k, sure[k], True, 0.0))
    return sorted(out, key=lambda t: t[2])


def retrieval_score(heard: str, source: str) -> tuple[float, float, float]:
    """(word overlap, fuzzy similarity, combined) of canonical texts, each rounded to four places."""
    if not heard or not source:
        return 0.0, 0.0, 0.0
    fuzzy = (0.35 * partial_ratio(heard, source) + 0.40 * token_set_ratio(heard, source) + 0.25 * token_sort_ratio(heard, source)) / 100
    even = min(len(heard), len(source)) / max(len(heard), len(source))
    return round(jaccard(heard, source), 4), round(fuzzy, 4), round(min(1.0, max(0.0, fuzzy * (0.70 + 0.30 * even))), 4)


def jaccards(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    return np.array([jaccard(a, b) for a, b in pairs])


MEASURES = {"ratio": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "jaccard": jaccard}
#: The same for many pairs at once.
BATCHED = {"ratio": ratios, "partial": partials, "token_sort": token_sort_ratios, "token_set": token_set_ratios, "jaccard": jaccards}


def scored(*names: str):
    """A vectorised function (a, b) to a struct of the named measures; null counts as empty."""

    @F.pandas_udf(doubles(*names))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = [(x or "", y or "") for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({n: BATCHED[n](pairs) for n in names}, dtype="float64")

    return run


@F.pandas_udf(DIVERGENCE)
def token_divergence(heard: pd.Series, source: pd.Series, confidences: pd.Series) -> pd.Series:
    names = ("asr_token", "retrieval_token", "position", "asr_word_confidence", "is_divergent", "similarity")
    rows = (divergence(a or "", b or "", None if c is None else list(c)) for a, b, c in zip(heard, source, confidences, strict=True))
    return pd.Series([[dict(zip(names, t, strict=True)) for t in r] for r in rows])


@F.pandas_udf(doubles("token_overlap", "fuzzy_similarity", "combined"))
def retrieval_scores(heard: pd.Series, source: pd.Series) -> pd.DataFrame:
    rows = [retrieval_score(a or "", b or "") for a, b in zip(heard, source, strict=True)]
    return pd.DataFrame(rows, columns=["token_overlap", "fuzzy_similarity", "combined"], dtype="float64")


@F.pandas_udf(T.DoubleType())
def word_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([word_errors(r.split(), (h or "").split()) / len(r.split()) if r and r.split() else 0.0 for r, h in zip(reference, hypothesis, strict=True)], dtype="float64")


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance by the reference's length; 0 without a reference."""
    return F.when(F.length(reference) > 0, F.levenshtein(reference, hypothesis) / F.length(reference)).otherwise(0.0)
