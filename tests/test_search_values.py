"""Search, verification and outputs against plain loops over the same rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from segmenta.functions import scores, similarity, text
from segmenta.operators import metrics, retrieval
from segmenta.sinks import reports, transcripts
from segmenta.sources import corpora, segments

WORDS = "the mercy of a lord who made day night earth water light and those that came before them in truth".split()


def sentences(n, seed, least=4, most=14):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))) for _ in range(n)]


def damaged(rng, line):
    letters = list(line)
    for _ in range(rng.randrange(6)):
        at = rng.randrange(len(letters))
        letters[at] = rng.choice(["", "x", letters[at] + "q"])
    return "".join(letters)


@pytest.fixture(scope="module")
def corpus():
    return sentences(60, 1) + ["short", "the mercy of a lord"]


@pytest.fixture(scope="module")
def asked(corpus):
    rng = random.Random(2)
    some = [damaged(rng, line) for line in corpus] + sentences(40, 3) + [f"{a} {b}" for a, b in zip(corpus[:10], corpus[10:20], strict=True)]
    # inserted letters leave no trigram in common
    return [*some, "".join(x + "#" * (k % 2) for k, x in enumerate(corpus[0])), "zz zz zz zz zz zz zz zz", ""]


def frames(spark, corpus, asked, confidence=0.6):
    known = spark.createDataFrame(list(enumerate(corpus)), "idx long, canon string")
    return spark.createDataFrame([(i, q, confidence) for i, q in enumerate(asked)], "qid long, query string, word_confidence double"), known


def grams(line):
    return [line[k : k + 3] for k in range(len(line) - 2)]


def near(query, corpus, n):
    """Places of the verses that share most trigrams: more first, then the earlier first shared one, then the place."""
    own, out = Counter(grams(query)), []
    for i, line in enumerate(corpus):
        both = set(grams(line)) & set(own)
        if both:
            out.append((-sum(own[g] for g in both), min(grams(query).index(g) for g in both), i))
    return [(i, -shared) for shared, _, i in sorted(out)[:n]]


@pytest.mark.parametrize("sent", [retrieval.SENT, 0])
def test_candidates_equal_a_loop(spark, corpus, asked, sent):
    queries, known = frames(spark, corpus, asked)
    got = defaultdict(list)
    for r in retrieval.gram_candidates(queries, retrieval.gram_index(known), n=7, sent=sent).orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["idx"], r["shared"]))
        assert r["rank"] == len(got[r["qid"]])
    assert got == {i: found for i, q in enumerate(asked) if (found := near(q, corpus, 7))}


def test_ratios_equal_the_scalar():
    rng = random.Random(4)
    alphabet = "abcdeé🙂 "
    pairs = [tuple("".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 5, 30, 63, 64, 65, 90)))) for _ in range(2)) for _ in range(400)]
    pairs += [(a, a) for a, _ in pairs[:10]]
    got = similarity.ratios(pairs)
    assert all(abs(x - similarity.ratio(a, b)) < 1e-9 for x, (a, b) in zip(got, pairs, strict=True))
    assert len(similarity.ratios([])) == 0


def plain_fuzzy(query, corpus, bar):
    """The best verse of one query, every measure of every candidate computed."""
    if len(query.split(" ")) < 4 or len(query) < 20:
        return None
    order = [i for i, _ in near(query, corpus, 80)] or [i for i in range(len(corpus))]
    scored = []
    for rank, i in enumerate(order):
        line = corpus[i]
        even = min(len(query), len(line)) / max(len(query), len(line))
        inside = len(query.split(" ")) >= 5 and (query in line or line in query)
        token_set = similarity.token_set_ratio(query, line)
        if even < 0.22 or not (inside or 55 + 90 * even / (1 + even) >= 100 * bar) or token_set < 85 * bar:
            continue
        score = 0.35 * token_set + 0.45 * similarity.ratio(query, line) + 0.2 * similarity.partial_ratio(query, line)
        score = max(score, 90 + 8 * even) if inside else score
        if score >= 100 * bar:
            scored.append((-score, rank, i, even))
    if not scored:
        return None
    scored.sort()
    top = scored[0]
    close = [s for s in scored if -s[0] >= -top[0] - 1.5]
    return top[2], round(min(-top[0] / 100 * (0.75 + 0.25 * top[3]), 0.98), 4), len(close)


@pytest.mark.parametrize("confidence", [0.6, 0.9])
def test_fuzzy_equals_a_loop(spark, corpus, asked, confidence):
    queries, known = frames(spark, corpus, asked, confidence)
    got = {r["qid"]: (r["idx"], r["confidence"], r["close"]) for r in retrieval.fuzzy(queries, known).collect()}
    want = {i: found for i, q in enumerate(asked) if (found := plain_fuzzy(q, corpus, 0.82 if confidence < 0.75 else 0.88))}
    assert set(got) == set(want) and len(got) > 20
    for i in want:
        assert got[i][2] == want[i][2] and abs(got[i][1] - want[i][1]) < 1e-4
        assert got[i][0] == want[i][0] or want[i][2] > 1


def test_bm25_of_an_empty_corpus(spark):
    queries, known = frames(spark, [], ["some words here"])
    assert retrieval.search(queries, known).count() == 0


def test_narration_idx_does_not_move(spark):
    raw = spark.createDataFrame([(str(k), "Sahih Bukhari", str(k % 7), "1", f"text of ten letters {k}", "e") for k in range(40)], "hadith_id string, source string, hadith_no string, chapter string, text_ar string, text_en string")
    kept = corpora.narrations_of(raw.withColumn("row", F.monotonically_increasing_id()), "row")
    first = {(r["idx"], r["hadith_number"]) for r in corpora.numbered(kept).collect()}
    assert first == {(r["idx"], r["hadith_number"]) for r in corpora.numbered(kept.repartition(5)).collect()} and len({i for i, _ in first}) == 7


def test_narrations_are_stored_by_collection(spark, tmp_path):
    df = spark.createDataFrame([("bukhari", "1", "a"), ("bukhari", "2", "b"), ("muslim", "1", "c")], "collection string, hadith_no string, text_ar string")
    assert corpora.write_narrations(df, f"file://{tmp_path}/n") == {"bukhari": 2, "muslim": 1}
    assert corpora.stored_narrations(spark, f"file://{tmp_path}/n").where("collection = 'muslim'").count() == 1


def test_a_remote_search_is_asked_again(spark, tmp_path):
    marks = str(tmp_path)

    def ask(query):
        import os

        place = os.path.join(marks, query.replace(" ", "_"))
        if "never" in query:
            raise OSError
        if "later" in query and not os.path.exists(place):
            open(place, "w").close()
            raise OSError
        return [{"collection": "c", "hadith_number": "1", "text_ar": query, "text_en": ""}]

    search = corpora.remote(ask, spacing=0.0, retries=1, backoff=1.0)
    df = spark.createDataFrame([("found at once here",), ("found a little later",), ("never ever found",), ("short",)], "query string")
    got = {r["query"]: [h["text_ar"] for h in r["hits"]] for r in corpora.cached(df, None, search).collect()}
    assert got == {"found at once here": ["found at once here"], "found a little later": ["found a little later"], "never ever found": []}


def test_audio_is_cleaned_where_it_can_be(spark):
    df = spark.createDataFrame([("a", bytearray(b"ab")), ("b", bytearray(b""))], "path string, content binary")

    def clean(content):
        if not content:
            raise ValueError
        return bytes(content)[::-1]

    assert {(r["path"], bytes(r["content"]), r["cleaned"]) for r in segments.preprocessed(df, clean).collect()} == {("a", b"ba", True), ("b", b"", False)}
    assert not segments.preprocessed(df, None).where("cleaned").count()


def test_a_snapshot_never_changes(spark, tmp_path):
    files = spark.createDataFrame([(1, "x"), (2, "y")], "file_id long, type string")
    texts = spark.createDataFrame([(1, "one two")], "file_id long, text string")
    base = {"is_flagged": True, "quran_match": True, "hadith_match": False, "retry_triggered": False, "detected_lang": "ur", "text_preview": "a", "original_text_preview": "a", "confidence_delta": 0.0, "mixed_script_ratio": 0.0, "avg_logprob": -2.0, "repeated_ngram_score": 0.0}
    rows = spark.createDataFrame([(1, 1)], "file_id long, segment_id long").withColumns({k: F.lit(v) for k, v in base.items()} | {"retry_reason": F.array(F.lit("x"))})
    found = metrics.evaluated_files(files, texts, texts, rows, ["segment_id"])
    assert [(r["wer"], r["total_segments"]) for r in found.orderBy("file_id").collect()] == [(0.0, 1), (0.0, 0)]
    place = reports.evaluation_snapshot(found, rows, f"file://{tmp_path}", "v1")
    assert spark.read.json(f"{place}/summary").first()["total_files"] == 2
    assert spark.read.json(f"{place}/worst_segments").count() == 1
    with pytest.raises(Exception, match="already exists"):
        reports.evaluation_snapshot(found, rows, f"file://{tmp_path}", "v1")


def test_settings_are_options():
    import argparse

    from segmenta import cli

    parser = argparse.ArgumentParser()
    names = cli.add_settings(parser)
    args = parser.parse_args(["--beam-size", "3", "--no-enable-retry-decoding", "--temperature", "0,0.4"])
    assert {n: getattr(args, n) for n in names if getattr(args, n) is not None} == {"beam_size": 3, "enable_retry_decoding": False, "temperature": (0.0, 0.4)}


def test_json_transcripts_hold_every_field(spark):
    import json

    from segmenta import queries as q

    d = "/root/testdata/sf0.001"
    rows = {(r["file_id"], r["start"], r["text"]): r for r in q.enriched(spark, d).collect()}
    seen = 0
    for r in transcripts.json_array(q.enriched(spark, d)).collect():
        for o in json.loads(r["content"]):
            own = rows[r["file_id"], o["start"], o["text"]]
            assert o["end"] == own["end"] and o["detected_language"] == own["detected_lang"] and o["raw_text"] is None and o["hadith_verification"] is None
            assert o["quran_match"] == (own["quran_match"] and own["quran_match"].asDict(True)) and o["formula_match"] == (own["formula_match"] and own["formula_match"].asDict(True))
            assert (o["hadith_match"] is None) == (own["hadith_match"] is None)
            seen += 1
    assert seen == len(rows)


def test_measures_by_row(spark):
    pairs = [(a, b) for a, b in zip(sentences(30, 8), sentences(30, 9), strict=True)] + [("", "x"), ("", ""), (None, "a b")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    names = ("ratio", "partial", "token_sort", "token_set", "jaccard")
    for r in df.select("i", similarity.scored(*names)("a", "b").alias("m")).collect():
        a, b = (x or "" for x in pairs[r["i"]])
        assert tuple(r["m"]) == tuple(similarity.MEASURES[n](a, b) for n in names)
    assert scores.SIGNALS and text.members("ab") == "ab"
