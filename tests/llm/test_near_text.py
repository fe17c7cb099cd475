import random
from collections import Counter

import corpus_pipeline
import pytest

from segmenta.llm import near_text

from .conftest import SCHEMA


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The smallest id (null last) of each group that pairs at 0.8 connect."""
    sets, parent = [brute_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (r[0] is None, r[0] or 0))
    return Counter(None if none else k for none, k in least.values())


def edited(rng, base, edits):
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies(seed=4):
    """Texts about the bound, a chain of copies of copies, and a crowd of copies of one text."""
    rng, texts = random.Random(seed), []
    for n in (30, 80, 200, 400):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts += [" ".join(base), *(edited(rng, base, max(1, round(n * part))) for part in (0.005, 0.015, 0.02, 0.023, 0.03, 0.06))]
    base = [f"c{k}" for k in range(200)]
    texts += [edited(rng, base, k % 7) for k in range(60)]
    chain = base = [f"d{k}" for k in range(100)]
    for _ in range(12):
        chain = edited(rng, chain, 1).split()
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return [(i, t, "en", "a", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_one_of_each_group_stays(spark, rounds):
    rows = near_copies()
    kept = near_text.drop_near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds=rounds)
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == brute_kept(rows)


def test_the_stage_drops_what_simhash_misses(spark):
    rows = near_copies(9)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == brute_kept(rows)


def test_odd_rows(docs, rows, empty):
    kept = near_text.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.where("fp != 'extra' or row != 'extra'").count() == 0
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == brute_kept(rows)
    assert near_text.drop_near_copies(empty).count() == 0


def test_pieces_of_a_long_text_do_not_show(monkeypatch):
    from segmenta.llm import simhash

    text = " ".join(f"w{k % 37}" for k in range(3000))
    want = near_text.shingles(text).tolist()
    assert len(want) == len(brute_set(text))
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert near_text.shingles(text).tolist() == want


def test_rounds_that_find_nothing_connect_nothing(spark, monkeypatch):
    calls, connected = [], near_text.connected_components
    monkeypatch.setattr(near_text, "connected_components", lambda edges: calls.append(1) or connected(edges))
    rng = random.Random(1)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, edited(rng, base, 20), "en", "a", 0) for i in range(12)]
    kept = near_text.drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == brute_kept(rows)
    assert kept.count() == len(rows) and not calls
