"""Values that the operators must give on small inputs."""

import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from segmenta.functions import language, plain, scores, similarity, text
from segmenta.operators import cleaning, context, folds, metrics, retrieval, verification

SALAWAT = "صلى الله عليه وسلم"


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", make(F.col("t")).alias("v")).collect())]


def test_normalisation(spark):
    cases = {"": "", None: "", "  hello   world  ": "hello world", "مُحَمَّد": "محمد", "ؤئ": "وي", "ةى": "هي", "أإآٱ": "اااا", "a\xa0b،c": "a b c"}
    assert values(spark, list(cases), text.normalise_arabic) == list(cases.values())
    assert values(spark, ["اللہ", "علی", "ملک"], text.canonical) == [plain.normalise(x) for x in ("الله", "علي", "ملك")]
    assert "غ" not in values(spark, ["گھر"], text.canonical)[0]


def test_native_normalisation_equals_python(spark):
    rng = random.Random(1)
    letters = [chr(c) for c in (*range(0x621, 0x64B), *range(0x64B, 0x660), 0x670, *range(0x6D2, 0x6E0), 0x6C1, 0x654, 0x653, 0x6D5)] + list(" .,!?-‌‏abcÉé  …")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(3000)]
    got = values(spark, texts, text.normalise_arabic)
    assert got == [plain.normalise(t) for t in texts]
    assert values(spark, texts, text.canonical) == [plain.canonical(t) for t in texts]
    clean = [t for t in got if unicodedata.is_normalized("NFC", t)]
    assert values(spark, clean, text.normalise_arabic) == clean


def test_script_predicates(spark):
    assert values(spark, [None, "hello world", "بسم"], text.has_arabic) == [False, False, True]
    assert values(spark, ["بسم الله الرحمن الرحيم", "یہ ایک اردو جملہ ہے جس میں کوئی عربی نہیں", "", "123"], text.mainly_arabic) == [True, False, False, False]
    spans = values(spark, ["some text في المسجد الحرام other text", "some text الله other text", "یہ آیت إن الله مع الصابرين ہے", None], text.arabic_spans)
    assert spans == [["في المسجد الحرام"], [], ["إن الله مع الصابرين"], []]


def test_corrections(spark):
    got = values(spark, ["PBUH", "SAW", "saw", "اللah", "فرma", "بسم اللlah", "This is an English sentence", "insha allah", "  ", None, "رض x مُرض"], text.correct)
    assert got[0] == got[1] == SALAWAT and got[2] == "saw"
    assert "الله" in got[3] and "فرما" in got[4] and "بسم الله" in got[5]
    assert got[6:] == ["This is an English sentence", "Insha'Allah", "  ", None, "رضي الله عنه x مرضي الله عنه".replace("مرضي الله عنه", got[10].split("x ")[1])]
    assert values(spark, ["Sahih Bukhari and pbuh", "xpbuh"], text.roman_to_urdu) == ["صحیح بخاری and صلی اللہ علیہ وسلم", "xpbuh"]
    assert values(spark, ["كتاب‌  ي", None], text.normalise_urdu) == ["کتاب ی", None]


def test_small_text_functions(spark):
    assert values(spark, ["abcd", "ab", "aaaa"], text.trigrams) == [["abc", "bcd"], [], ["aaa", "aaa"]]
    one = " ".join(["word%d" % i for i in range(6)])
    assert values(spark, [one, "a b c d"], text.word_windows) == [[one, one.rsplit(" ", 1)[0], one.split(" ", 1)[1]], []]
    assert values(spark, ["a b a b a b a b", "a b c d e f g", "a b"], text.repetitive) == [True, False, False]
    assert values(spark, ["Straße  X ", None], text.same_key) == ["strasse x", ""]
    assert values(spark, ["قال رسول الله صلى الله عليه وسلم"], text.distinctive_words) == [1]
    assert values(spark, ["Arabic", "UR", "fa", None], text.language_code) == ["ar", "ur", "und", "und"]
    df = spark.createDataFrame([(3661.9996,), (0.0,)], "s double")
    assert [tuple(r) for r in df.select(text.timestamp("s"), text.timestamp("s", millis=True, comma=True)).collect()] == [("01:01:01", "01:01:01,999"), ("00:00:00", "00:00:00,000")]


def test_languages(spark):
    got = values(spark, ["یہ پاکستان کی اردو تقریر ہے جس میں حدیث کا ذکر ہے", "إنما الأعمال بالنيات", "hello", "123", " ", None, "بعد مسجد"], lambda t: language.detect(t))
    assert got == ["ur", "ar", "en", "und", "und", "und", "ur"]
    rows = [("f", 0, "a b c d", "nl"), ("f", 1, "oh", "nl"), ("f", 2, "ہے", "fa"), ("f", 3, "...", "id"), ("f", 4, "x", "en"), ("f", 5, "..", "fa")]
    df = language.inherit(spark.createDataFrame(rows, "file_id string, seq int, text string, lang string"), ["seq"])
    assert [r["lang"] for r in df.orderBy("seq").collect()] == ["nl", "en", "ur", "ur", "en", "en"]


def segments(spark, rows):
    """rows: (start, end, text, language, logprob)."""
    laid = [("f", i, float(s), float(e), t, lang, lp) for i, (s, e, t, lang, lp) in enumerate(rows)]
    return spark.createDataFrame(laid, "file_id string, seq long, start double, end double, text string, language string, avg_logprob double")


def test_merges(spark):
    def texts(rows, f=folds.merge_short):
        return [r["text"] for r in f(segments(spark, rows)).orderBy("start").collect()]

    assert texts([(0, 1, "hello", "en", -0.1), (1.2, 2, "world", "en", -0.2), (2.3, 3, "foo", "en", -0.4)]) == ["hello world foo"]
    assert len(texts([(0, 1, "hi", "en", 0.0), (1.2, 2, "بسم", "ar", 0.0)])) == 2
    assert len(texts([(0, 1, "hi", "en", 0.0), (5, 6, "there", "en", 0.0)])) == 2
    assert texts([(0, 2, "this is a longer segment with many words", "en", 0.0), (2.2, 2.5, "yes", "en", 0.0)]) == ["this is a longer segment with many words yes"]
    assert texts([(0, 1, "one", "en", 0.0)]) == ["one"] and texts([]) == []
    row = folds.merge_short(segments(spark, [(0, 1, "a", "en", -1.0), (1, 2, "b", "en", -2.0), (2, 3, "c", "en", -4.0)])).first()
    assert row["avg_logprob"] == -2.75 and row["end"] == 3.0
    assert texts([(0, 1, "یہ بات", "ur", 0.0), (2, 3, "الله", "ur", 0.0), (3.5, 4, "x", "ur", 0.0)], folds.merge_quotes) == ["یہ بات الله", "x"]


def naive_repeats(rows):
    last, out = {}, []
    for i, (s, e, t, *_) in enumerate(rows):
        key = " ".join(t.split()).casefold()
        if key in last and s - last[key] < 8 and e - s < 3:
            continue
        last[key] = s
        out.append(i)
    return out


def test_repeats_equal_a_plain_loop(spark):
    rng = random.Random(3)
    fixed = [(0, 1, "same text", "en", 0.0), (5, 6, "Same  text", "en", 0.0), (9, 10, "same text", "en", 0.0)]
    assert [r["seq"] for r in folds.drop_repeats(segments(spark, fixed)).orderBy("seq").collect()] == [0, 2]
    rows, at = [], 0.0
    for _ in range(200):
        at += rng.random() * 4
        rows.append((at, at + rng.random() * 4, rng.choice(["a b", "A  b", "c", "straße"]), "en", 0.0))
    assert [r["seq"] for r in folds.drop_repeats(segments(spark, rows)).orderBy("seq").collect()] == naive_repeats(rows)
    free = [(0, 1, SALAWAT, "ar", 0.0), (1, 2, SALAWAT, "ar", 0.0)]
    assert folds.drop_repeats(segments(spark, free)).count() == 2


def naive_overlaps(rows):
    out = [list(r) for r in rows]
    removed = 0
    for k in range(1, len(out)):
        a, b = out[k - 1], out[k]
        if b[0] >= a[1] or a[1] - b[0] > 2.5:
            continue
        x, y = a[2].split(), b[2].split()
        for n in range(min(15, len(x), len(y)), 0, -1):
            if [plain.normalise(w) for w in x[-n:]] == [plain.normalise(w) for w in y[:n]]:
                b[2] = " ".join(y[n:])
                removed += n
                break
    return [r[2] for r in out if not removed or r[2].strip()]


def test_overlaps_equal_a_plain_loop(spark):
    rng = random.Random(4)
    for rows in ([(0, 10, "x y z", "en", 0.0), (9, 15, "y z w", "en", 0.0)], [(0, 10, "x", "en", 0.0), (9, 11, "x", "en", 0.0), (10.5, 12, "x", "en", 0.0)]):
        assert [r["text"] for r in folds.trim_overlaps(segments(spark, rows)).orderBy("start").collect()] == naive_overlaps(rows)
    rows, at = [], 0.0
    for _ in range(120):
        at += rng.random() * 2
        rows.append((at, at + rng.random() * 4, " ".join(rng.choice("ab،") for _ in range(rng.randrange(1, 6))), "en", 0.0))
    assert [r["text"] for r in folds.trim_overlaps(segments(spark, rows)).orderBy("start").collect()] == naive_overlaps(rows)


def test_filters(spark):
    df = spark.createDataFrame([(t,) for t in ["Thanks for watching", "...", "♪♪", "real words", " ".join(["الله"] * 9), " ".join(["no"] * 8), "see www.x", "، .", " ".join(["no"] * 7), None]], "text string")
    assert {r[0] for r in cleaning.drop_phrases(df).collect()} == {"real words", " ".join(["الله"] * 9), " ".join(["no"] * 8), "see www.x", " ".join(["no"] * 7)}
    assert {r[0] for r in cleaning.drop_patterns(df).collect()} == {"Thanks for watching", "real words", " ".join(["الله"] * 9), " ".join(["no"] * 7), "، ."}


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_measures():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert similarity.common(a, b) == naive_lcs(a, b)
        want = 100.0 if a == b else 200 * naive_lcs(a, b) / (len(a) + len(b))
        assert similarity.ratio(a, b) == pytest.approx(want)
        s, t = sorted((a, b), key=len)
        if s and t:
            windows = {t[max(0, e - len(s)) : e] for e in range(1, len(t) + len(s))} - {""}
            best = max(similarity.ratio(s, w) for w in windows)
            assert similarity.partial_ratio(a, b) >= best - 1e-9
    assert similarity.token_set_ratio("a b c", "c b a x") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.token_sort_ratio("b a", "a b") == 100
    assert similarity.retrieval_score("", "test") == (0.0, 0.0, 0.0)
    assert similarity.retrieval_score("one two", "one two") == (1.0, 1.0, 1.0)
    assert SequenceMatcher(None, "ab", "ab").ratio() == 1


def test_scores(spark):
    df = spark.range(1)
    lit = F.lit

    def one(x):
        return df.select(x).first()[0]

    assert [one(scores.fuzzy_threshold(lit(x))) for x in (0.80, 0.60, 0.2)] == [0.88, 0.82, 0.88]
    assert one(scores.retry_reasons(lit(-1.2), lit(1.0), lit(0.0), lit(0.2))) == ["low_logprob", "mixed_script"]
    assert [one(scores.paraphrase(*map(lit, x))) for x in ((0.95, 50, 55, 90, 85), (0.75, 30, 80, 85, 70), (0.80, 50, 55, 90, 70))] == [False, True, True]
    assert one(scores.calibrated(lit(90.0), lit(10), lit(0))) == 0.0
    assert one(scores.quality(lit(-0.3), lit(0.8), lit(0.1))) == pytest.approx(0.82)
    assert one(scores.content_mode(lit("سورة قرآن"))) == "quran" and one(scores.content_mode(lit("قرآن"))) == "bayan"
    assert one(scores.marker_categories(scores.markers(lit("عن أبي هريرة قال رسول الله " + SALAWAT)))) == ["prophet_speech", "narrator_chain", "salawat"]
    assert one(scores.marker_categories(scores.markers(lit("abc")))) == []


def test_verification(spark):
    rows = [
        ("إنما الأعمال من بالنيات", "إنما الأعمال بالنيات", 0.3, [0.2, 0.9, 0.2]),
        ("إنما الاعمل بالنيات", "إنما الأعمال وأما بالنيات", 0.3, None),
        ("عن أبي هريرة قال رسول الله إنما الاعمل بالنيات", "عن أبي هريرة قال رسول الله إنما الأعمال بالنيات", 0.3, [0.1] * 8),
        ("same words here", "same words here", 0.3, []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, asr_text string, retrieval_text string, asr_word_confidence double, word_confidences array<double>")
    out = verification.verify(df).orderBy("i").collect()
    assert [r["rejection_reason"].split(" ")[0] for r in out[:2]] == ["structural_mismatch"] * 2
    assert [(d["asr_token"], d["retrieval_token"]) for d in out[0]["divergent_tokens"] if d["is_divergent"]] == [("من", "")]
    assert [(d["asr_token"], d["retrieval_token"]) for d in out[1]["divergent_tokens"] if d["is_divergent"]] == [("الاعمل", "الاعمال واما")]
    assert out[0]["low_confidence_word_count"] == 2
    assert (out[2]["correction_type"], out[2]["suggestion_safe"], out[2]["suggested_patch"]) == ("suggestion", True, "الاعمل→الاعمال")
    assert out[3]["correction_type"] == "none" and out[3]["token_overlap"] == 1.0 and not any(r["applied"] for r in out)


def test_gates(spark):
    base = {"asr": 0.3, "ret": 0.9, "over": 0.8, "n": 1, "al": 50, "rl": 50}
    cases = [({}, None), ({"asr": 0.5}, "asr_confidence_high (0.500 >= 0.45)"), ({"ret": 0.5}, "low_retrieval_similarity (0.500 < 0.85)"), ({"over": 0.5}, "low_token_overlap (0.500 < 0.6)"), ({"n": 0}, "no_narration_markers (count=0)"), ({"al": 30}, "length_delta_high (0.400 > 0.3)")]
    none = F.array().cast("array<struct<asr_token:string,retrieval_token:string,position:int,asr_word_confidence:double,is_divergent:boolean,similarity:double>>")
    for change, want in cases:
        v = base | change
        got = spark.range(1).select(scores.suggestion_gate(F.lit(v["asr"]), F.lit(v["ret"]), F.lit(v["over"]), F.lit(v["n"]), none, F.lit(v["al"]), F.lit(v["rl"]))).first()[0]
        assert got == want


def test_quantiles_and_drift(spark):
    rows = [("a", i, lang, c, -c, False, False, False, False, False, 0) for i, (lang, c) in enumerate([("ur", 0.5), ("fa", 0.1), ("ur", 0.9), ("ur", 0.7), ("nl", 0.3)])]
    rows += [("b", 0, "en", 0.4, -0.4, True, True, False, False, True, 2)]
    df = spark.createDataFrame(rows, "file_id string, seq int, detected_lang string, confidence double, avg_logprob double, language_locked boolean, quran_match boolean, hadith_match boolean, was_corrected boolean, is_flagged boolean, overlap_removed_words int")
    out = {r["file_id"]: r for r in metrics.summary(df, ["seq"]).collect()}
    assert (out["a"]["confidence_p25"], out["a"]["confidence_p50"], out["a"]["confidence_p75"], out["a"]["language_drift_events"]) == (0.3, 0.5, 0.7, 3)
    assert (out["b"]["confidence_p25"], out["b"]["n_is_flagged"], out["b"]["overlap_dedup_total_words"]) == (0.4, 1, 2)
    assert {r["file_id"]: r["drift_events"] for r in metrics.drift(df, ["seq"]).collect()} == {"a": 2, "b": 0}


def test_prompts_and_plans(spark):
    rows = [("f", i, f"word{i} trusted text here", -0.1, 0.9, 1.0, 0.0, False, i != 1, "bayan") for i in range(5)]
    df = spark.createDataFrame(rows, "file_id string, seq int, text string, avg_logprob double, avg_word_confidence double, compression_ratio double, mixed_script_ratio double, retry_triggered boolean, prompt_safe boolean, mode string")
    out = context.contextual_prompts(df, ["seq"]).orderBy("seq").collect()
    assert out[0]["prompt"].endswith("Surah, Ayah, Tafsir.")
    assert out[4]["prompt"].endswith(" word0 trusted text here word2 trusted text here word3 trusted text here")
    files = spark.createDataFrame([("a", 100.0), ("b", 250.0), ("c", 240.0)], "file_id string, duration double")
    assert sorted(tuple(r) for r in context.chunk_plan(files).collect()) == [("a", 0, 0.0, 100.0), ("b", 0, 0.0, 120.0), ("b", 1, 118.0, 238.0), ("b", 2, 236.0, 250.0), ("c", 0, 0.0, 120.0), ("c", 1, 118.0, 238.0), ("c", 2, 236.0, 240.0)]


def test_bm25_equals_a_plain_formula(spark):
    import math

    texts = ["alpha beta gamma", "beta beta delta", "gamma alpha alpha alpha", "omega"]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx long, canon string")
    queries = spark.createDataFrame([(0, "alpha delta"), (1, "zeta beta omega")], "qid int, query string")
    got = {(r["qid"], r["idx"]): r["score"] for r in retrieval.search(queries, corpus).collect()}
    docs = [t.split() for t in texts]
    mean = sum(map(len, docs)) / 4
    want = {}
    for q, words in ((0, ["alpha", "delta"]), (1, ["zeta", "beta", "omega"])):
        for i, d in enumerate(docs):
            score = 0.0
            for w in words:
                df = sum(w in x for x in docs)
                if w in d:
                    score += max(math.log((4 - df + 0.5) / (df + 0.5)), 1e-6) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / mean))
            if any(w in d for w in words):
                want[q, i] = round(score, 9)
    assert got == pytest.approx(want)
