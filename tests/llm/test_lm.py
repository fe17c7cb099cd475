import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from segmenta.llm import lm
from segmenta.llm.elias_fano import EliasFano, Opened, save
from segmenta.llm.shared import fold, fresh_path


def test_elias_fano_finds_and_gets():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (1, 1 << 63), (500, 600), (3000, 1 << 40), (3000, 1 << 64), (2000, 5000)):
        values = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True)) if n else np.zeros(0, np.uint64)
        ef = EliasFano.build(values, universe)
        assert np.array_equal(ef.get(np.arange(n)), values)
        some = np.concatenate([values, rng.integers(0, universe - 1, 200, dtype=np.uint64, endpoint=True)])
        place = ef.find(some)
        assert np.array_equal(place >= 0, np.isin(some, values))
        assert np.array_equal(values[place[place >= 0]], some[place >= 0])


def brute(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    crc = lambda i: __import__("zlib").crc32(b"" if i is None else str(i).encode()) % 7
    train = [tokens(r[1]) for r in rows if crc(r[0]) != 2]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b"", *t], t, strict=False))
    tri = Counter(p for t in train for p in zip([b"", *t], t, t[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    base = lambda w: (uni[w] + 1) / (n + v + 1)
    two = lambda c, w: (bi[c, w] + lm.MU * base(w)) / (uni[c] + lm.MU)
    three = lambda b, c, w: (tri[b, c, w] + lm.NU * two(c, w)) / (bi[b, c] + lm.NU)
    for r in rows:
        t = tokens(r[1])
        logs = [math.log10(two(b"", t[0])), *(math.log10(three(b, c, w)) for b, c, w in zip([b"", *t], t, t[1:], strict=False))]
        yield r[0], crc(r[0]) == 2, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), sum(logs)


def test_scores_equal_brute_force(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(lm, "PART", 5000)
    monkeypatch.setattr(lm, "TOGETHER", 20_000)
    monkeypatch.setattr(lm, "HELD", 2000)
    trie = lm.train(docs.where(fold(F.col("doc_id"), 7) != 2), fresh_path(spark, "test-lm"))
    found = lm.scored(docs, trie).withColumn("held_out", fold(F.col("doc_id"), 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for got, want in zip(sorted(map(tuple, found.collect()), key=key), sorted(brute(rows), key=key), strict=True):
        assert got[:5] == want[:5]
        assert math.isclose(got[5], want[5], rel_tol=1e-9)
        assert abs(got[6] - want[6]) < 0.02 * want[2] + 0.05  # quantised
    assert lm.scored(empty, trie).count() == 0
    nothing = lm.train(empty, fresh_path(spark, "test-lm"))
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in lm.scored(docs.limit(3), nothing).collect())


def test_tokens_are_words_and_ends():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "\t", " ", "\x0b", "\r\n", "\x1c", "\x85", "\xa0", "é", "🙂", "\x00"]) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, ""]
    t = lm.Tokens.of(pa.array(texts))
    want = [xxhash.xxh64_intdigest(w) for x in texts for w in [*(x or "").encode().lower().split(), b""]]
    assert t.hashes[t.words].tolist() == want
    assert t.sizes.tolist() == [len((x or "").encode().split()) + 1 for x in texts]


def test_levels_find_successors_inside_their_context():
    rng = np.random.default_rng(4)
    for contexts, universe, n in ((1, 1, 1), (5, 10, 20), (300, 1000, 2000), (50, 100_000, 400)):
        keys = np.unique(rng.integers(0, contexts * universe, n))
        made = {f"2.{k}": s for k, s in lm.level(keys // universe, keys % universe, contexts, universe).items()}
        asked = np.unique(np.concatenate([keys, rng.integers(0, contexts * universe, n)]))
        place = lm.search(made, "2.", asked // universe, asked % universe)
        assert np.array_equal(place >= 0, np.isin(asked, keys))
        assert np.array_equal(keys[place[place >= 0]], asked[place >= 0])


def test_opened_files_are_bounded(tmp_path):
    for k in range(6):
        save(f"file://{tmp_path}/{k}", {"s": EliasFano.build(np.arange(k, dtype=np.uint64), k + 1)}, {"x": np.arange(3)}, {"k": k})
    some = Opened(files=2)
    for k in (0, 1, 2, 3, 4, 5, 0):
        sequences, arrays, about = some(f"file://{tmp_path}/{k}")
        assert about == {"k": k} and arrays["x"].tolist() == [0, 1, 2] and sequences["s"].get(np.arange(k)).tolist() == list(range(k))
        assert len(some.held) <= 2


def test_other_kinds_of_ids(spark):
    df = spark.createDataFrame([("a", "x y z"), (None, None)], "doc_id string, text string")
    trie = lm.train(df, fresh_path(spark, "test-lm"))
    assert {r["doc_id"] for r in lm.scored(df, trie).collect()} == {"a", None}
