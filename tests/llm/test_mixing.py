import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from segmenta.llm import mixing


def plain_apportion(targets, blocks):
    """Sainte-Lague: one by one to the highest quotient, ties to the first."""
    quotas = [0] * len(targets)
    for _ in range(blocks):
        quotas[-max((t / (2 * q + 1), -i) for i, (t, q) in enumerate(zip(targets, quotas, strict=True)))[1]] += 1
    return quotas


def test_quotas_of_shards_equal_one_by_one(spark):
    rng = random.Random(1)
    cases = [(full, rng.randint(0, full)) for full in [0, 1, 9, 10, 11, *(rng.randint(1, 200) for _ in range(300))]]
    rows = mixing.shard_quotas(spark.createDataFrame(cases, "blocks long, quota long"), 10).collect()
    assert len(rows) == len(cases)
    for r in rows:
        votes = [10] * (r["shards"] - 1) + [r["last"]]
        assert sum(votes) == r["blocks"]
        want = plain_apportion([max(v, 1e-9) for v in votes], r["quota"])
        assert (want[-1], sorted(want[:-1])) == (r["last_quota"], sorted([r["each"] + (k < r["more"]) for k in range(r["shards"] - 1)]))


def test_quotas_of_sources_equal_one_by_one(spark):
    """The highest quotient first, while it is half a block or more."""
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 64, 70, rng.randint(1, 5000)]) for _ in range(200)]
    rests = [rng.random() * n for n in sizes]
    df = spark.createDataFrame(list(zip(sizes, rests, strict=True)), "source_size long, rest double")
    found = df.select("*", *(c.alias(k) for k, c in zip(("quota", "tail"), mixing.rest_quotas(F.col("rest"), F.col("source_size"), 64), strict=True))).collect()
    left, quotas = [r["rest"] - r["source_size"] % 64 * r["tail"] for r in found], [0] * len(found)
    while (best := max((w / (2 * q + 1), -i) for i, (w, q, r) in enumerate(zip(left, quotas, found, strict=True)) if q < r["source_size"] // 64))[0] >= 32:
        quotas[-best[1]] += 1
    assert quotas == [r["quota"] for r in found]
    for r in found:
        assert abs(r["quota"] * 64 + r["tail"] * (r["source_size"] % 64) - r["rest"]) <= 32


def brute_targets(sizes):
    """sizes by source, in order: weights 5, 2, 1; what is above three times the size goes to the others."""
    total, weight = sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    stopped = set()
    while True:
        left = total - sum(3 * sizes[i] for i in stopped)
        own = sum(w for i, w in enumerate(weight) if i not in stopped)
        more = {i for i in range(len(sizes)) if i not in stopped and left * weight[i] / own > 3 * sizes[i]} if own else set()
        if not more:
            return [3.0 * sizes[i] if i in stopped else left * weight[i] / own if own else 0.0 for i in range(len(sizes))]
        stopped |= more


def test_plan(docs, rows, empty):
    plan = mixing.mix_plan(docs, block_words=8).select("doc_id", "size", "source_size", "target", "taken").collect()
    words = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in plan) == Counter((r[0], words(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, brute_targets([sizes[s] for s in order]), strict=True))
    by_target = defaultdict(int)
    for r in plan:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target[round(r["target"], 6), r["source_size"]] += r["taken"]
    assert set(by_target) == {(round(targets[s], 6), sizes[s]) for s in order}
    for (target, _), taken in by_target.items():
        assert abs(taken - target) <= 4
    again = mixing.mix_plan(docs.repartition(7), block_words=8).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, plan))
    assert mixing.mix_plan(empty).count() == 0


def test_the_mix_has_the_words_of_the_plan(docs):
    plan, mixed = mixing.mix_plan(docs, block_words=8), mixing.mix(docs, block_words=8)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in plan.collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixed.select("doc_id", "text", "n_chars").collect():
        got[r["doc_id"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert got == +want


def test_thin_sources_over_many_shards(spark):
    """Production blocks: what sources with a document or two a shard are due must not be lost to rounding."""
    rng, rows = random.Random(5), []
    for source, n, low, high in (("a", 400, 1500, 2500), ("b", 30, 3, 10), ("c", 60, 10, 90), ("d", 400, 1500, 2500), ("e", 120, 20, 60), ("f", 40, 60, 70), ("g", 1, 30, 30)):
        rows += [(len(rows) + k, " ".join(["w"] * rng.randint(low, high)), source) for k in range(n)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=20_000).collect()
    taken, target, size = defaultdict(int), {}, {}
    source = {r[0]: r[2] for r in rows}
    for r in plan:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
    assert sum(target[s] == 3 * size[s] for s in target) >= 4
    for s in target:
        assert abs(taken[s] - target[s]) <= 32, s


def by_source(spark, groups, **options):
    """groups: (source, documents, words of each); (taken, target) by source."""
    rows = [(s, k, " ".join(["w"] * n)) for s, count, n in groups for k in range(count)]
    rows = [(i, t, s) for i, (s, _, t) in enumerate(rows)]
    source, found = {r[0]: r[2] for r in rows}, defaultdict(lambda: [0, 0.0])
    for r in mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), **options).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        found[source[r["doc_id"]]][0] += r["taken"]
        found[source[r["doc_id"]]][1] = r["target"]
    return found


def test_a_thin_source_beside_a_large_one(spark):
    for n in (30, 60, 300):
        found = by_source(spark, [("a", 300, 1000), ("b", n, 5)])
        assert found["b"] == [15 * n, 15.0 * n]
        assert abs(found["a"][0] - found["a"][1]) <= 32


def test_many_shards_and_as_many_sources_as_rows(spark):
    found = by_source(spark, [("a", 200, 1500), ("b", 1500, 3), ("c", 40, 200)], shard_words=640)
    for taken, target in found.values():
        assert abs(taken - target) <= 32
    found = by_source(spark, [(f"s{k:04d}", 1, 20 + 7 * (k % 90)) for k in range(500)], shard_words=6400)
    for taken, target in found.values():
        assert abs(taken - target) <= 32


def test_a_crowd_of_equal_rows(spark):
    rows = [(None, "one two three", "a")] * 5000 + [(k, "x " * 90, "b") for k in range(50)] + [(7, "x y", None)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.mix_plan(df).collect()
    assert Counter(r["doc_id"] for r in plan) == Counter(r[0] for r in rows) + Counter()
    taken = defaultdict(int)
    for r in plan:
        taken[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(n - target) <= 32 for (target, _), n in taken.items())
    mixed = mixing.mix(df)
    assert mixed.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == sum(taken.values())
    assert Counter(map(tuple, mixing.mix(df.repartition(2)).collect())) == Counter(map(tuple, mixed.collect()))


def test_empty_and_wordless(spark, empty):
    assert mixing.mix(empty).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None), (None, "", None)], "doc_id long, text string, source string")
    assert [tuple(r)[1:] for r in mixing.mix_plan(df).collect()] == [(0, 0, 0.0, 0)] * 3
    assert mixing.mix(df).count() == 0
