import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from segmenta.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_equal_brute_force(docs, rows):
    found = S.secret_spans(docs, keep=("doc_id", "text")).collect()
    got = Counter((r["doc_id"], r["text"], tuple(tuple(s) for s in r["base_spans"])) for r in found)
    assert got == Counter((r[0], r[1], tuple(brute(r[1]))) for r in rows)
    for r in found:
        assert {tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["all_spans"]}


def test_listed_digest(docs, rows):
    found = S.secret_spans(docs).select("doc_id", F.sha2(S.listed("base_spans"), 256).alias("h"))
    got = Counter(tuple(r) for r in found.collect())
    text = lambda t: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in brute(t))
    assert got == Counter((r[0], hashlib.sha256(text(r[1]).encode()).hexdigest()) for r in rows)


def test_query_counts(spark, rows, tmp_path):
    from .conftest import SCHEMA

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r)[:4] for r in S.op10_secret_scans(spark, str(tmp_path)).collect())
    want = Counter()
    for r in rows:
        kinds = Counter(k for _, k, _ in brute(r[1]))
        want[r[0], kinds[0], kinds[1], kinds[2]] += 1
    assert got == want
    assert any(k[2] and k[3] for k in got)


def test_random_runs_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    chars = S.UPPER + S.LOWER + S.DIGITS
    keys = ["".join(rng.choice(chars) for _ in range(rng.choice((32, 40, 64)))) for _ in range(60)]
    words = ["".join(rng.choice(("tion", "the", "re", "an", "er", "in")) for _ in range(9)) for _ in range(300)]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(1000 + i, f"see {w} here") for i, w in enumerate(words)]
    found = {r["doc_id"]: r["all_spans"] for r in S.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(found[i]) for i in range(60)) >= 50
    assert not any(found[1000 + i] for i in range(300))
    for i in range(60):
        assert all((s["start"], s["end"]) == (4, 4 + len(keys[i])) for s in found[i])


def test_least_evidence_is_benjamini_hochberg():
    counts = [(1, 60, 5), (1, 10, 20), (1, 0, 75), (2, 0, 10)]
    assert S.least_evidence(counts, 0.05) == {1: 60}  # 1e-6 <= .05 * 5 / 100; 0.1 > .05 * 25 / 100


def test_redaction(spark):
    rows = [("é token='zzzzzz' ok " + "0123456789abcdef01234567",), ("token=0123456789abcdef0123456789",), ("clean",)]
    df = spark.createDataFrame(rows, "text string").withColumn("doc_id", F.lit(1))
    out = [r[0] for r in S.secret_spans(df, keep=("text",)).select(S.redacted(F.col("text"), F.col("all_spans"))).collect()]
    assert sorted(out) == sorted(["é [SECRET]' ok [SECRET]", "[SECRET]", "clean"])


def plain_redacted(text, spans):
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_redaction_equals_a_plain_loop(spark, monkeypatch):
    rng, rows = random.Random(7), []
    for i in range(60):
        text = "".join(rng.choice("abc é🙂\n") for _ in range(rng.choice((5, 40, 300))))
        spans = sorted((a, rng.randrange(3), min(len(text), a + rng.randrange(1, 30))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(6))))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"i int, text string, spans {S.SPAN}")
    for piece in (4096, 64, 7):
        monkeypatch.setattr(S, "PIECE", piece)
        got = {r[0]: r[1] for r in df.select("i", S.redacted(F.col("text"), F.col("spans"))).collect()}
        assert got == {i: plain_redacted(t, s) for i, t, s in rows}


def test_runs_that_overlap_no_base_span(spark):
    rng, rows = random.Random(8), []
    for i in range(80):
        edges = sorted(rng.sample(range(200), 2 * rng.randrange(0, 8)))
        runs = [(a, 3, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        base = sorted((a, rng.randrange(3), a + rng.randrange(1, 20)) for a in (rng.randrange(200) for _ in range(rng.randrange(6))))
        rows.append((i, runs, base))
    df = spark.createDataFrame(rows, f"i int, runs {S.SPAN}, base {S.SPAN}")
    got = {r[0]: r[1] for r in df.select("i", S.apart(F.col("runs"), F.col("base"))).collect()}
    assert got == {i: [not any(b[0] < r[2] and r[0] < b[2] for b in base) for r in runs] for i, runs, base in rows}


def plain_evidence(token):
    """Encoding, the three tests and the evidence of one candidate, step by step."""
    name, alphabet = next((name, a) for name, p, a in S.ENCODINGS if re.search(p, token))
    s = token.replace("-", "+").replace("_", "/")
    s = s.lower() if name in ("hex", "base36") else s
    n, a, v = len(s), len(alphabet), [alphabet.index(c) for c in s]
    chi = a / n * sum(k * k for k in Counter(v).values()) - n
    mean, df = sum(v) / n, a - 1
    spread = sum((x - mean) ** 2 for x in v)
    serial = (sum((x - mean) * (y - mean) for x, y in zip(v, v[1:], strict=False)) / spread + 1 / n) * math.sqrt(n) if spread > 0 else 9
    high = sum(x >= a / 2 for x in v)
    runs = 1 + sum((x >= a / 2) != (y >= a / 2) for x, y in zip(v, v[1:], strict=False))
    want = 2 * high * (n - high) / n + 1
    z_runs = (runs - want) / math.sqrt((want - 1) * (want - 2) / (n - 1)) if want > 2 else -9
    z_chi = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    random_ = 3 * math.exp(-0.5 * max(z_chi, 0, abs(z_runs), abs(serial)) ** 2) >= 0.01
    apart = n * (a * max(S.COINCIDENCE, 2 / a) - 1)
    z = (chi - (df + apart)) / math.sqrt(2 * (df + 2 * apart))
    return math.floor(2 * math.log2(n)), random_, math.floor(10 * (0.30103 + 0.5 * z * z / math.log(10))) if z < 0 else 0


def test_added_spans_equal_a_plain_version(spark):
    """The whole method over a table: candidates apart from base spans, tests, and the false-discovery control by class."""
    rng, rows = random.Random(11), []
    for i in range(150):
        words = ["".join(rng.choice(rng.choice((S.LOWER, S.UPPER + S.DIGITS, S.DIGITS + "abcdef", S.LOWER + S.UPPER + S.DIGITS + "+/-_"))) for _ in range(rng.choice((4, 20, 26, 44, 90)))) for _ in range(5)]
        rows.append((i, " token: ".join(words) if i % 9 == 0 else " ".join(words + ["so" * 15])))
    found, counts = {}, Counter()
    for i, text in rows:
        base = brute(text)
        runs = [(m.start(), 3, m.end()) for m in re.finditer(S.CANDIDATE, text)]
        found[i] = [(r, plain_evidence(text[r[0] : r[2]])) for r in runs if not any(b[0] < r[2] and r[0] < b[2] for b in base)]
        counts.update((k, e) for _, (k, ok, e) in found[i] if ok)
    limits = S.least_evidence([(*k, n) for k, n in counts.items()], 0.05)
    want = {i: sorted(brute(t) + [r for r, (k, ok, e) in found[i] if ok and k in limits and e >= limits[k]]) for i, t in rows}
    got = {r["doc_id"]: [tuple(s) for s in r["all_spans"]] for r in S.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert sum(s[1] == 3 for spans in want.values() for s in spans) > 100


def test_redacted_table_with_clashing_names(spark, empty):
    df = spark.createDataFrame([(1, "password = hunter22 end", "x"), (2, None, None), (3, "", "y")], "doc_id int, text string, all_spans string")
    df = df.withColumns({c: F.lit(c) for c in ("base_spans", "t", "base", "runs", "found", "more", "span", "k_text", "c0")})
    out = S.redact_secrets(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["all_spans"], r["base_spans"]) for r in out.collect() if r["text"] is not None) == [(1, "[SECRET] end", "x", "base_spans"), (3, "", "y", "base_spans")]
    assert out.where("text is null").count() == 1
    assert S.redact_secrets(empty).count() == 0


def test_empty_table(empty):
    assert S.secret_spans(empty).count() == 0
