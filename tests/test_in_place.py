"""What is answered where the queries lie: the same rows as plain loops and as the joins, at a cost that fits long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from segmenta.operators import in_place, retrieval

WORDS = "the mercy of a lord who made day night earth water light سورة كتاب €uro 😀 x".split()


def lines(n, seed, least=0, most=12):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))) for _ in range(n)]


def frames(spark, corpus, asked):
    return spark.createDataFrame(list(enumerate(asked)), "qid long, query string"), spark.createDataFrame(list(enumerate(corpus)), "idx long, canon string")


@pytest.mark.parametrize("n", [3, 80])
def test_candidates_in_place_equal_the_join(spark, n):
    queries, corpus = frames(spark, lines(50, 1), lines(70, 2, most=30))
    index = retrieval.gram_index(corpus)
    rows = [sorted(map(tuple, retrieval.gram_candidates(queries, index, n=n, sent=sent, overlap=True).collect())) for sent in (0, 10**6)]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_overlap_of_long_texts_is_linear(spark):
    """In the JVM's expressions each trigram is found by counting from the start of the text."""
    rng = random.Random(3)
    long = ["".join(rng.choice("abcdefgh ") for _ in range(60_000)) for _ in range(4)]
    df = spark.createDataFrame([(a, b) for a in long for b in long] + [("", ""), ("abc", "abd")], "a string, b string")
    start = time.monotonic()
    got = [r[0] for r in df.select(retrieval.gram_overlap(F.col("a"), F.col("b"))).collect()]
    assert time.monotonic() - start < 20
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    want = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in long for b in long]
    assert got == [*want, 0.0, 0.0]


def test_an_empty_corpus_and_rows_without_trigrams(spark):
    queries, corpus = frames(spark, ["", "ab"], ["", "abc", None])
    assert retrieval.gram_candidates(queries, retrieval.gram_index(corpus), overlap=True).collect() == []
    assert [len(x) for x in in_place.Grams(["abc"], __import__("numpy").array([5])).near([], 3)] == [0] * 5


def test_modes_search_each_text_once_and_see_signals_across_two(spark):
    from segmenta.functions import scores
    from segmenta.operators import context

    rng = random.Random(4)
    some = [*(s for signals in scores.SIGNALS.values() for s in signals), "بسم", "الله", "قال", "رسول", "", None, "x", "الله قال", " ", "رسول ", None]
    rows = [(f, k, rng.choice(some)) for f in range(5) for k in range(80)]
    df = context.content_modes(spark.createDataFrame(rows, "file_id long, seq long, text string"), ["seq"])
    assert df.columns == ["file_id", "seq", "text", "mode"]
    got = {(r["file_id"], r["seq"]): r["mode"] for r in df.collect()}
    for f in range(5):
        own = [t or "" for g, _, t in rows if g == f]
        for k in range(80):
            recent = " ".join(own[max(0, k - 4) : k + 1])
            counts = {m: sum(s in recent for s in signals) for m, signals in scores.SIGNALS.items()}
            best = max(counts, key=counts.get)
            assert got[f, k] == (best if counts[best] >= 2 else "bayan")
    # no text is shuffled for the window
    slim = df.select("file_id", "seq", "mode")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in slim[slim.index("Window") : slim.index("Exchange")] and "collect_list" not in slim


def test_measures_side_by_side_equal_single_ones():
    from segmenta.functions import similarity as sim

    rng = random.Random(5)
    texts = [*lines(150, 6, most=25), "", " ", "ab" * 32, "ba" * 40, "x" * 70, "x" * 65, "é" * 64, "e" + "é" * 63]

    def changed(t):
        letters = list(t)
        for _ in range(rng.randrange(5) if letters else 0):
            letters[rng.randrange(len(letters))] = rng.choice(["", "q", "th", " "])
        return "".join(letters)

    pairs = [(a, changed(a)) for a in texts] + [(rng.choice(texts), rng.choice(texts)) for _ in range(600)]
    assert sim.ratios(pairs).tolist() == [sim.ratio(*p) for p in pairs]
    assert sim.partials(pairs).tolist() == [sim.partial_ratio(*p) for p in pairs]
    assert sim.token_sort_ratios(pairs).tolist() == [sim.token_sort_ratio(*p) for p in pairs]

    def token_set(a, b):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            return 0.0
        both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if both and not (left and right):
            return 100.0
        joined = [f"{both} {s}".strip() for s in (left, right)]
        return max(sim.ratio(*joined), *(sim.ratio(both, j) for j in joined)) if both else sim.ratio(*joined)

    want = [token_set(*p) for p in pairs]
    assert sim.token_set_ratios(pairs).tolist() == [sim.token_set_ratio(*p) for p in pairs] == want
    assert sim.token_set_ratios(pairs, 70).tolist() == [w if w >= 70 else 0.0 for w in want]
    assert [len(f([])) for f in sim.BATCHED.values()] == [0] * 5


def test_narrations_in_place_equal_the_joins(spark):
    rng = random.Random(7)
    corpus = lines(40, 8, least=3, most=30) + ["", "day day day"]
    some = [" ".join(w for w in rng.choice(corpus).split()[rng.randrange(4) :][: rng.randrange(3, 12)] if rng.random() < 0.95) for _ in range(150)]
    asked = [*some, *some[:20], *lines(60, 9), "", None]
    queries, known = frames(spark, corpus, asked)
    queries = queries.withColumn("span", F.lit("s"))
    rows = [sorted(map(tuple, retrieval.match_narrations(queries, known, sent=sent).collect()), key=repr) for sent in (0, 10**6)]
    assert rows[0] == rows[1] and len(rows[0]) > 50
    rows = [sorted(map(tuple, retrieval.match_remote(queries, known, sent=sent).collect())) for sent in (0, 10**6)]
    assert rows[0] == rows[1] and len(rows[0]) > 50
    rows = [sorted(map(tuple, retrieval.search(queries, known, sent=sent).collect())) for sent in (0, 10**6)]
    assert [r[:2] + r[3:] for r in rows[0]] == [r[:2] + r[3:] for r in rows[1]] and all(abs(a[2] - b[2]) < 2e-9 for a, b in zip(*rows, strict=True))
    # each query is answered where it lies: nothing is shuffled
    assert "Exchange" not in retrieval.match_narrations(queries, known)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("confidence", [0.6, 0.9])
def test_verses_in_place_equal_the_joins(spark, confidence):
    rng = random.Random(11)
    corpus = [*lines(60, 12, least=2, most=14), "", "day day day day day day", lines(1, 13, least=70, most=70)[0]]

    def damaged(t):
        letters = list(t)
        for _ in range(rng.randrange(5) if letters else 0):
            letters[rng.randrange(len(letters))] = rng.choice(["", "q", "e ", "th"])
        return "".join(letters)

    asked = [*map(damaged, corpus), *corpus, *lines(40, 14), *(f"{damaged(a)} {b}" for a, b in zip(corpus, corpus[9:]))]
    asked += ["zz zz zz zz zz zz zz zz", "".join(x + "#" for x in corpus[0]), "day day day day day day day day day day"]
    queries, known = frames(spark, corpus, asked)
    queries = queries.withColumn("word_confidence", F.lit(confidence))
    for match, least in ((retrieval.fuzzy, 60), (retrieval.window_fuzzy, 40)):
        rows = [sorted(map(tuple, match(queries, known, sent=sent).collect()), key=repr) for sent in (0, 10**6)]
        assert rows[0] == rows[1] and len(rows[0]) > least
        assert "Exchange" not in match(queries, known)._jdf.queryExecution().executedPlan().toString()
    empty = known.where("idx < 0")
    assert retrieval.fuzzy(queries, empty).collect() == [] and retrieval.window_fuzzy(queries, empty).collect() == []


def test_narrations_of_several_files_keep_their_order(spark, tmp_path):
    """Tasks take larger files first; the first file's row stays whatever the sizes."""
    from segmenta.sources import corpora

    names = corpora.NARRATIONS
    for k, size in enumerate((20, 2000, 200_000)):
        body = "".join(f'"{k}","{k * 10 + j}","c","1","{j}","h","0","text {k} of\nten letters {"x" * size}","e"\n' for j in range(3 + k))
        (tmp_path / f"part-{k:05d}.csv").write_text(",".join(names) + "\n" + body)
    got = {(r["hadith_no"], r["hadith_id"]) for r in corpora.read_narrations(spark, f"file://{tmp_path}").collect()}
    assert got == {("0", 0), ("1", 1), ("2", 2), ("3", 13), ("4", 24)}


def test_a_table_is_written_as_several_csv_files(spark, tmp_path):
    from segmenta import queries as q

    rows = spark.range(400).selectExpr("id as doc_id", "concat('text ', id, ' of ten') as text", "'s' as source", "cast(id as int) as n_chars")
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    df = q.told_in_csv(spark, f"file://{tmp_path}")
    assert sorted((r["hadith_no"], r["hadith_id"]) for r in df.collect()) == sorted((str(k), k if k % 11 else k + 50) for k in range(50))
    assert len(df.inputFiles()) == spark.sparkContext.defaultParallelism


def test_composition_needs_no_python(spark):
    import unicodedata

    from segmenta import queries as q
    from segmenta.functions import plain, text

    rng = random.Random(15)
    marks = [chr(k) for k in range(0x20000) if unicodedata.combining(chr(k))]
    some = ["".join(rng.choice(["e", "o", "ا", "ہ", "ے", "ᄀ", "ᅡ", "ᆨ", "😀", " ", rng.choice(marks)]) for _ in range(12)) for _ in range(3000)] + ["", None]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    got = df.select(text.compose(F.col("t")), text.normalise_arabic("t"), text.canonical("t")).collect()
    assert [tuple(r) for r in got] == [(unicodedata.normalize("NFC", t or ""), plain.normalise(t), plain.canonical(t)) for t in some]
    for name in ("canon_text", "urdu_vocab", "lang_script", "normalise_text"):
        plan = q.FOUND[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
        # what the rules name many times is computed once
        assert name not in ("urdu_vocab", "lang_script") or plan.count("translate(") <= 3


def test_rules_that_match_nothing_are_one_search(spark):
    from functools import reduce

    from segmenta.functions import lexicon, text

    rules = [(text.edged(p), r) for p, r in lexicon.EXPANSIONS] + list(lexicon.TERMS) + [(text.edged(p), r) for p, r in text.ENGLISH] + [*text.REPAIRS, text.TRIM, (" {2,}", " "), text.TRIM]
    some = [*lines(60, 16), " PBUH SAW insha allah اللah انشاءالله قران ab", "Sahih Bukhari, pbuh; xpbuh Insha Allah", "سلامxy", "a  b", " a", "", None]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    every = reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, F.col("t"))
    rows = df.select(text.replaced(F.col("t"), rules), every).collect()
    assert all(a == b for a, b in rows) and sum(a != t for (a, _), t in zip(rows, some)) > 4
    # the first thing that is asked is whether any rule applies
    assert "CASE WHEN" in str(text.replaced(F.col("t"), rules))[:40]
