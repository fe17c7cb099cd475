"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.  DataFrame only.

Patterns find the base spans.  Beyond them every long run of letters, digits and ``+ / _ -`` is a candidate:

* its encoding is inferred from its characters (hex, base32, one-case or two-case alphanumeric, base64, or letters only);
* three tests ask if it fits uniform independent symbols of that alphabet: chi-squared uniformity, runs above and below
  the alphabet's middle, and lag-one serial correlation; a candidate that one of them rejects is structured text;
* the same chi-squared value also gives the chance that *natural* text of this length looks so uniform: natural text
  concentrates on few symbols, so its chi-squared is noncentral with a noncentrality in proportion to the length;
* Benjamini-Hochberg over these chances, by class of length over the whole table, keeps the expected part of false
  discoveries at ``level`` in each class.  Short candidates, whose tests have little power, thus need far better values.

Places are running sums over the pieces of a text, in as many passes as their number has binary digits, and every step
reads its arrays in order, so the work grows with the matches of a text and not with their square.  Only counts by class
and rounded chance come to the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, written

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
SPAN = "array<struct<start:int,rank:int,end:int>>"
# Inferred encodings, first match wins: name, pattern of the whole run, alphabet in order.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", DIGITS + "abcdef"),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[a-z0-9]+$|^[A-Z0-9]+$", DIGITS + LOWER),
    ("base62", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r".", UPPER + LOWER + DIGITS + "+/"),
)
#: Index of coincidence of natural text: its part in pairs of equal symbols; at least twice that of a uniform alphabet.
COINCIDENCE = 0.065


#: Distances of a running sum's passes; code points of the pieces in which a long text is cut for redaction.
POWERS = tuple(1 << k for k in range(31))
PIECE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column) -> Column:
    """Running sums of an array of numbers, doubling the distance from pass to pass."""
    add = lambda acc, p: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - p), F.lit(0)))
    return let(values, lambda v: F.aggregate(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.size(v)), v, add))


def matches(text: Column, pattern: str, rank: int, keep: Column | None = None) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches; keep: an array of booleans by match.

    The text between matches and the matches themselves alternate, so running lengths give the places.
    """
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("size"),
        (keep if keep is not None else F.array().cast("array<boolean>")).alias("keep"),
    )

    def spans(parts: Column, ends: Column) -> Column:
        span = lambda m, i: F.struct((F.get(ends, i) - m["size"]).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"))
        return F.filter(F.transform(parts, lambda m, i: F.when(m["size"].isNotNull() & F.coalesce(m["keep"], F.lit(True)), span(m, i))), lambda s: s.isNotNull())

    return let(parts, lambda p: let(running(F.transform(p, lambda m: m["gap"] + F.coalesce(m["size"], F.lit(0)))), lambda ends: spans(p, ends)))


def apart(runs: Column, base: Column) -> Column:
    """Of runs, in order and apart from each other, whether they overlap no base span.

    Sorted ends and starts are counted in passing: a run is free if as many base spans end before it as start before its end.
    """
    mark = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    places = F.concat(F.transform(runs, lambda r: mark(r["end"], 0)), F.transform(base, lambda b: mark(b["end"], 1)), F.transform(base, lambda b: mark(b["start"], 2)), F.transform(runs, lambda r: mark(r["start"], 3)))

    def free(places: Column, sums: Column) -> Column:
        at = lambda kind: F.filter(F.transform(places, lambda e, i: F.when(e["kind"] == kind, F.get(sums, i))), lambda x: x.isNotNull())
        return F.zip_with(at(0), at(3), lambda end, start: F.shiftrightunsigned(end, 32) <= start.bitwiseAND(F.lit((1 << 32) - 1)))

    count = lambda e: F.when(e["kind"] == 2, F.lit(1 << 32)).when(e["kind"] == 1, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return let(F.sort_array(places), lambda p: let(running(F.transform(p, count)), lambda sums: free(p, sums)))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind.  Each pattern runs only where a plain search finds what it needs."""
    lower, none = F.lower(text), F.array().cast(SPAN)
    named = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("apikey") | lower.contains("api_key")
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    return F.sort_array(
        F.concat(
            F.when(named, matches(text, ASSIGN, 0, long_enough)).otherwise(none),
            F.when(text.contains("AKIA"), matches(text, ACCESS, 1)).otherwise(none),
            F.when(text.rlike(HEX), matches(text, HEX, 2)).otherwise(none),
        )
    )


def tested(candidates: DataFrame) -> DataFrame:
    """Adds to candidates (``token``): length class ``class``, ``random`` (no test rejects it), ``evidence`` (-10 log10 of
    the chance that natural text looks so uniform, rounded down)."""
    enc = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        enc = F.when(F.col("token").rlike(ENCODINGS[i][1]), i).otherwise(enc)
    one = F.translate("token", "-_", "+/")
    by_name = {name: i for i, (name, _, _) in enumerate(ENCODINGS)}
    folded = F.when(F.col("enc").isin(by_name["hex"], by_name["base36"]), F.lower(one)).otherwise(one)
    alphabets = F.array(*(F.lit(a) for _, _, a in ENCODINGS))
    steps = [
        {"enc": enc},
        {"s": folded, "alphabet": F.element_at(alphabets, F.col("enc") + 1)},
        {"n": F.length("s").cast("double"), "a": F.length("alphabet").cast("double"), "chars": F.split("s", "")},
        {
            "squares": F.expr("aggregate(array_distinct(chars), 0D, (t, c) -> t + pow(n - length(replace(s, c, '')), 2))"),
            "v": F.expr("transform(chars, c -> cast(instr(alphabet, c) - 1 as double))"),
        },
        {"chi": F.col("a") / F.col("n") * F.col("squares") - F.col("n"), "mean": F.expr("aggregate(v, 0D, (t, x) -> t + x) / n"), "df": F.col("a") - 1},
        {
            "spread": F.expr("aggregate(v, 0D, (t, x) -> t + (x - mean) * (x - mean))"),
            "joint": F.expr("aggregate(zip_with(slice(v, 1, int(n) - 1), slice(v, 2, int(n) - 1), (x, y) -> (x - mean) * (y - mean)), 0D, (t, x) -> t + x)"),
            "high": F.expr("aggregate(v, 0D, (t, x) -> t + if(x >= a / 2, 1D, 0D))"),
            "runs": F.expr("1D + aggregate(zip_with(slice(v, 1, int(n) - 1), slice(v, 2, int(n) - 1), (x, y) -> if((x >= a / 2) = (y >= a / 2), 0D, 1D)), 0D, (t, x) -> t + x)"),
        },
        {"expected": F.expr("2 * high * (n - high) / n + 1")},
        {
            # Wilson-Hilferty turns chi-squared into a normal deviate
            "z_chi": F.expr("(pow(greatest(chi, 0D) / df, 1D / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))"),
            "z_runs": F.expr("if(expected > 2, (runs - expected) / sqrt((expected - 1) * (expected - 2) / (n - 1)), -9D)"),
            "z_serial": F.expr("if(spread > 0, (joint / spread + 1 / n) * sqrt(n), 9D)"),
            "apart": F.expr(f"n * (a * greatest({COINCIDENCE}D, 2 / a) - 1)"),
        },
        {
            # each test's chance is at most exp(-z^2 / 2); three tests, so a third of the level each
            "random": F.expr("3 * exp(-0.5 * pow(greatest(z_chi, 0D, abs(z_runs), abs(z_serial)), 2)) >= 0.01"),
            "z_natural": F.expr("(chi - (df + apart)) / sqrt(2 * (df + 2 * apart))"),
            "class": F.expr("int(floor(2 * log2(n)))"),
        },
        {"evidence": F.expr("int(floor(if(z_natural < 0, 10 * (0.30103 + 0.5 * z_natural * z_natural / ln(10D)), 0D)))")},
    ]
    for step in steps:
        candidates = candidates.withColumns(step)
    return candidates


def least_evidence(counts: Sequence[tuple[int, int, int]], level: float) -> dict[int, int]:
    """Benjamini-Hochberg by class from (class, evidence, count): the least evidence that is accepted."""
    classes, found = defaultdict(list), {}
    for klass, evidence, n in counts:
        classes[klass].append((evidence, n))
    for klass, rows in classes.items():
        total, seen = sum(n for _, n in rows), 0
        for evidence, n in sorted(rows, reverse=True):
            seen += n
            if 10 ** (-evidence / 10) <= level * seen / total:
                found[klass] = evidence
    return found


def secret_spans(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), level: float = 0.05) -> DataFrame:
    """``keep`` columns of every row, with ``base`` and ``spans``: arrays of (start, rank, end), rank indexing KINDS.

    Null and empty texts have no spans.  Very long texts are scanned whole; a long run of characters is one candidate and is
    held as a list of its characters while it is tested.  Ties between spans go by start, then kind.  Rows are told apart by a number of their own, so null or repeated ids are kept
    as they are; equal texts have equal spans.  A random span never overlaps a base span.  An empty table gives no rows;
    columns outside ``keep`` (and text) are not read; ``keep`` has neither base_spans nor all_spans.
    """
    text = F.coalesce("text", F.lit(""))
    runs = F.when(text.rlike(CANDIDATE), matches(text, CANDIDATE, 3)).otherwise(F.array().cast(SPAN))
    scanned = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), text.alias("t"), base_spans(text).alias("base"), runs.alias("runs"))
    free = F.when(F.size("base") > 0, apart(F.col("runs"), F.col("base")))
    pairs = F.arrays_zip(F.col("runs").alias("span"), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("token"), F.coalesce(free, F.array().cast("array<boolean>")).alias("free"))
    tokens = F.when(F.size("runs") > 0, F.transform(F.filter(pairs, lambda f: F.coalesce(f["free"], F.lit(True))), lambda f: F.struct(f["span"].alias("span"), f["token"].alias("token"))))
    scanned = scanned.select(*(f"k_{c}" for c in keep), "base", tokens.alias("found")).withColumn("row", F.monotonically_increasing_id())
    scanned = written(scanned, "scanned")
    candidates = tested(scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*"))
    candidates = written(candidates.select("row", "span", "class", "random", "evidence"), "candidates")
    limits = least_evidence([tuple(r) for r in candidates.where("random").groupBy("class", "evidence").count().collect()], level)
    accepted = F.lit(False)
    for klass, evidence in sorted(limits.items()):
        accepted = accepted | ((F.col("class") == klass) & (F.col("evidence") >= evidence))
    more = candidates.where(F.col("random") & accepted).groupBy("row").agg(F.collect_list("span").alias("more"))
    joined = scanned.drop("found").join(more, "row", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return joined.select(*(F.col(f"k_{c}").alias(c) for c in keep), F.col("base").alias("base_spans"), spans.alias("all_spans"))


def counted(spans: str, rank: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["rank"] == rank))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``.

    It is cut into pieces of PIECE code points, and these at the ends and starts of spans; each cut is then short.
    """
    cut = lambda at, step, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(step).alias("step"))

    def joined(pieces: Column, cuts: Column, depth: Column) -> Column:
        def part(c: Column, i: Column) -> Column:
            place, stop = c["at"], F.get(cuts, i + 1)["at"]
            own = F.substring(F.get(pieces, F.floor(place / PIECE).cast("int")), place % PIECE + 1, stop - place)
            return F.when((c["step"] == 1) & (F.get(depth, i) == 1), F.lit(mark)).when((F.get(depth, i) == 0) & (stop > place), own).otherwise(F.lit(""))

        return F.array_join(F.transform(cuts, part), "")

    def cuts(pieces: Column) -> Column:
        edges = F.transform(pieces, lambda _, i: cut(i * PIECE, 0, 1))
        ends, starts = F.transform(spans, lambda s: cut(s["end"], -1, 0)), F.transform(spans, lambda s: cut(s["start"], 1, 2))
        return F.sort_array(F.concat(edges, ends, starts, F.array(cut(F.length(text), 0, 3))))

    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = let(whole, lambda p: let(cuts(p), lambda c: let(running(F.transform(c, lambda x: x["step"])), lambda depth: joined(p, c, depth))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, each secret in the text replaced by a mark and n_chars counted anew.

    A null text stays null, an empty one empty; very long texts are masked whole; overlapping spans get one mark; repeated
    rows are masked alike, null and repeated ids kept.  Extra columns may have any name.  An empty table gives no rows.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*at.values()).withColumnRenamed(at["text"], "text")
    found = secret_spans(plain, keep=plain.columns)
    changed = found.withColumn("text", redacted(F.col("text"), F.col("all_spans")))
    if "n_chars" in at:
        changed = changed.withColumn(at["n_chars"], F.when(F.size("all_spans") > 0, F.length("text").cast("long")).otherwise(F.col(at["n_chars"])))
    return changed.select(*plain.columns).toDF(*docs.columns)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secret_spans(documents(spark, sf_dir))
    counts = [counted("base_spans", rank).cast("long").alias(f"n_{KINDS[rank]}") for rank in range(3)]
    return found.select("doc_id", *counts, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("all_spans").alias("spans"))
