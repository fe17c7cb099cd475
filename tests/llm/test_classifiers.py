import random
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from segmenta.llm import language_id, quality, toxicity

SYLLABLES = {"en": ["the", "ing", "tion", "wh", "er"], "de": ["sch", "ung", "ein", "pf", "ü"], "es": ["ción", "ñ", "que", "ll", "ar"]}


def labelled(n=400, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["blockhead", "nitwit", "stinker" + rng.choice("abcdef")])
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_languages_of_held_out_texts(spark, docs, rows, empty):
    own, _ = labelled()
    df = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    codes = language_id.learn(df)
    assert codes.languages == ["de", "en", "es"]
    found = {r["doc_id"]: r for r in language_id.identify(df, codes).collect()}
    held = [r for r in own if crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    out = language_id.identify(docs, codes).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    blank = Counter(r[0] for r in rows if not any(c.isalpha() for c in r[1] or ""))
    assert Counter(r["doc_id"] for r in out if r["lang_pred"] == "und") == blank
    assert language_id.identify(empty, codes).count() == 0
    assert language_id.learn(empty) is None
    assert {r["lang_pred"] for r in language_id.identify(df.limit(3), None).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (1, 2, 4, 7, 12, 40):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n
        if n >= 4:
            assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 3


def test_toxicity_of_held_out_texts(spark, docs, rows, empty):
    own, labels = labelled(800, 2)
    df = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([*labels, (3, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, marks)
    assert model.lexicon.hits("a nitwit, stinkerzz") and not model.lexicon.hits("unitwits")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.scored(df, model).collect()}
    held = [r for r in labels if crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(found[r[0]] == r[2] for r in held) >= 0.97 * len(held)
    out = toxicity.scored(docs, model).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in out)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("score != 'extra'").count() == 0
    assert toxicity.scored(empty, toxicity.learn(empty, marks.limit(0))).count() == 0


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    m = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    knots, chance = toxicity.isotonic(m, y)
    assert (np.diff(knots) > 0).all() and (np.diff(chance) >= -0.02).all()
    assert abs(np.interp(m, knots, chance).mean() - y.mean()) < 0.03


def brute_quality(text):
    text = text or ""
    blanks = "\t\n\x0b\x0c\r "
    for b in blanks:
        text = text if b == "\n" else text.replace(b, " ")
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(covered)


def test_quality_counts_equal_brute_force(docs, rows, empty):
    order = list(quality.RULES)
    got = Counter(tuple(r) for r in quality.judged(docs, order).collect())
    want = Counter()
    for r in rows:
        n, chars, symbols, repeats = brute_quality(r[1])
        seen, dup = set(), 0
        for line in (r[1] or "").split("\n"):
            if line.strip("\t\n\x0b\x0c\r "):
                dup += line in seen
                seen.add(line)
        failed = n < 50 or 100 * repeats > 50 * n
        kept = not failed and not any(rule(quality.Text(r[1])) for rule in quality.RULES.values())
        want[r[0], n, chars, symbols, dup, repeats, failed, kept] += 1
    assert got == want
    again = Counter(tuple(r) for r in quality.judged(docs, order[::-1]).collect())
    assert again == want
    assert quality.judged(empty, quality.plan(empty)).count() == 0


def test_cascade_puts_cheap_rejecting_rules_first(monkeypatch, spark):
    rules = {"never": lambda t: False, "always": lambda t: True, "slow": lambda t: sum(range(20_000)) > 0}
    monkeypatch.setattr(quality, "RULES", rules)
    text = " ".join(f"w{k}" for k in range(60))
    assert quality.ordered([quality.trial(text) for _ in range(5)]) == ["always", "never", "slow"]
    assert quality.trial("too short") == []


def test_order_counts_what_reaches_a_rule(monkeypatch):
    monkeypatch.setattr(quality, "RULES", dict.fromkeys("abcd"))
    c = 1e-3  # b rejects nothing that a lets through, so c comes before it; d rejects least for its cost
    rejects = {"a": {0, 1, 2, 3}, "b": {0, 1, 2}, "c": {4, 5}, "d": {6}}
    trials = [[(k in rejects[r], 5 * c if r == "d" else c) for r in "abcd"] for k in range(8)]
    assert quality.ordered([*trials, []]) == ["a", "c", "d", "b"]
    free = [[(k in rejects[r], 0.0) for r in "abcd"] for k in range(8)]
    assert quality.ordered(free) == ["a", "c", "d", "b"]
    assert quality.ordered([]) == ["a", "b", "c", "d"]


def test_ids_of_other_kinds(spark):
    df = spark.createDataFrame([(1, "one two"), (None, None)], "doc_id int, text string")
    own, _ = labelled(60)
    codes = language_id.learn(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long"))
    for found in (language_id.identify(df, codes), quality.judged(df, list(quality.RULES)), toxicity.scored(df, toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int")))):
        assert found.schema["doc_id"].dataType.simpleString() == "int"
        assert {r["doc_id"] for r in found.collect()} == {1, None}
        texts = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert {r["doc_id"] for r in quality.judged(texts, []).collect()} == {"1", None}


def plain_language(text, codes):
    """Profile by a dictionary of runs, margins and losses by loops."""
    raw, counts = text.encode(), Counter()
    runs = [(raw[i] + 1) * 2654435761 for i in range(len(raw))]
    runs += [((raw[i] << 8) + raw[i + 1]) * 2246822519 + 77 for i in range(len(raw) - 1)]
    runs += [((raw[i] << 16) + (raw[i + 1] << 8) + raw[i + 2]) * 3266489917 + 1234567 for i in range(len(raw) - 2)]
    counts.update((r % 2**32) >> 20 for r in runs)
    x = {k: (n / len(runs)) ** 0.5 for k, n in counts.items()}
    margins = [sum(v * float(codes.weights[k, b]) for k, v in x.items()) + float(codes.bias[b]) for b in range(codes.code.shape[1])]
    loss = [sum(np.logaddexp(0, -m * float(c)) for m, c in zip(margins, word, strict=True)) for word in codes.code]
    share = [np.exp(min(loss) - v) for v in loss]
    return codes.languages[int(np.argmin(loss))], max(share) / sum(share)


def test_languages_equal_a_plain_decoder(spark, docs, rows):
    own, _ = labelled(120)
    codes = language_id.learn(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long"))
    found = language_id.identify(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long"), codes).collect()
    for r, (_, text, *_) in zip(sorted(found, key=lambda r: r["doc_id"]), own, strict=True):
        lang, score = plain_language(text, codes)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_toxicity_equals_a_plain_scorer(spark):
    """Trees walked one by one, the chance by a line between knots, for texts with hidden words too."""
    own, labels = labelled(300, 5)
    df = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def plain(text):
        x, total = toxicity.features(text, model.lexicon), model.trees.base
        for split, at, value in model.trees.trees:
            node = 0
            for _ in range(model.trees.depth):
                node = 2 * node + (2 if x[split[node]] > at[node] else 1)
            total += value[node - len(split)]
        return float(np.interp(total, *model.knots))

    texts = [r[1] for r in own[:80]] + ["", "you n1tw1t", "YOU BLOCKHEAD!!!", "n*tw*t " * 40]
    got = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert abs(r["score"] - min(1, max(0, plain(text)))) < 1e-9
        assert r["predicted"] == (r["score"] >= 0.5)


def test_hidden_words_are_uncovered():
    lexicon = toxicity.Lexicon(["nitwit", "asshole", "blockh*"])
    at = toxicity.FEATURES.index("uncovered")
    for text in ("a$$hole", "@sshole", "n1tw1t", "n*twit", "bl0ckhead", "bl*ckhead", "n.i.t.w.i.t"):
        assert toxicity.features(f"you {text} there", lexicon)[at] > 0, text
    for text in ("plain words, here.", "5 * 3 = 15", "cost: $40!"):
        assert toxicity.features(text, lexicon)[at] == 0


def test_drop_toxic_of_odd_tables(spark, docs, empty):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(empty, marks).count() == 0
    assert toxicity.drop_toxic(docs, marks).count() == docs.count()
    few = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, few).count() == docs.count()


def test_a_query_fold_matches_crc32(docs):
    from segmenta.llm.shared import fold

    for r in docs.select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect():
        assert r["f"] == crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5
