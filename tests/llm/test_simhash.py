import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from segmenta.llm import components, simhash
from segmenta.llm.components import connected_components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fp); the smallest id that each reaches."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(prints))]


def test_rows_equal_brute_force(docs, rows, empty):
    want = [(r[0], brute_print(r[1])) for r in rows]
    want = Counter((k, f"{fp:016x}", c) for (k, fp), c in zip(want, brute_components(want), strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_pieces_of_a_long_text_do_not_show(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "É", "x\ty", "word\n"]) for _ in range(n)) for n in (1, 2, 3, 4, 50, 400)] + ["", "  ", "z" * 100]
    want = [brute_print(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("bucket", [64, 3])
def test_crowded_segments_lose_no_link(spark, bucket):
    rng = random.Random(bucket)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 2, 3, 5, 7)))))
    for _ in range(4):  # one half in common
        centre = rng.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(32), rng.choice((2, 3, 4, 6)))))
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket)
    assert all((np.uint64(a & (1 << 64) - 1) ^ np.uint64(b & (1 << 64) - 1)).item().bit_count() <= 3 for a, b in edges.distinct().collect())
    roots = dict(tuple(r) for r in connected_components(edges).collect())
    want = brute_components([(s, p) for s, p in zip(signed, prints, strict=True)])
    assert [roots.get(s, s) for s in signed] == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (7, 7), (200, 100)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_components_write_no_table_that_changes_nothing(spark, monkeypatch):
    names, written = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or written(df, name))
    for edges, tables in (([], 1), ([(1, 2), (3, 1), (1, 3), (8, 9)], 1), ([(1, 2), (2, 3)], 2)):
        names.clear()
        got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
        assert got == {n: 8 if n > 7 else 1 for e in edges for n in e}
        assert len(names) == tables
