"""Ordered folds of the segments of a file.

Each gathers a file's segments in order into one array and runs ``aggregate`` over it, so the state can depend on what was
kept or merged so far.  The state holds numbers and array of small integers only; texts are joined afterwards by group.  A
file is one recording (hours at most), which bounds the array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, text


def ordered_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group: ``rows``, an array of structs in order."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *[x for x in columns if x not in order]))).alias("rows"))


def formulas() -> list[str]:
    """Formulas that may repeat, without the letters that normalisation replaces."""
    table = str.maketrans(text.VARIANTS, text.PLAIN)
    return [f.translate(table) for f in lexicon.REPEATABLE_FORMULAS]


def drop_repeats(df: DataFrame, *, window: float = 8.0, shortest: float = 3.0, by: str = "file_id", nfc: bool = True) -> DataFrame:
    """Short segments whose text was kept less than ``window`` seconds before go; formulas always stay.

    State is per text: when it was last kept, which a dropped segment does not change.  The segments of a text are gathered
    with all their columns, so what stays is taken from there and nothing is joined.
    """
    columns = df.columns
    df = df.withColumn("_free", text.normalise_arabic("text", nfc=nfc).isin(formulas()))
    gathered = df.where("NOT _free").groupBy(F.col(by).alias("_by"), text.same_key("text").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "seq", *[x for x in columns if x not in ("start", "seq")]))).alias("rows"))
    state = lambda last, kept: F.struct(last.cast("double").alias("last"), kept.alias("kept"))
    flags = F.aggregate(
        "rows",
        state(F.lit(None), F.array().cast("array<boolean>")),
        lambda acc, r: F.when(acc["last"].isNotNull() & (r["start"] - acc["last"] < window) & (r["end"] - r["start"] < shortest), state(acc["last"], F.array_append(acc["kept"], F.lit(False)))).otherwise(state(r["start"], F.array_append(acc["kept"], F.lit(True)))),
        lambda acc: acc["kept"],
    )
    stay = gathered.select(F.explode(F.filter(F.arrays_zip("rows", flags.alias("kept")), lambda z: z["kept"])).alias("z"))
    return df.where("_free").select(*columns).union(stay.select(*(F.col("z.rows")[x].alias(x) for x in columns)))


def _merge(df: DataFrame, joins, by: str) -> DataFrame:
    """Left fold: a segment joins the current one if ``joins(current, segment)``; what stands after is one row per group."""
    fields = ["start", "seq", "end", "language", "n_words", "has_arabic", "avg_logprob"]
    rows = ordered_rows(df.withColumn("n_words", F.size(text.words(text.column("text")))).withColumn("has_arabic", text.has_arabic("text")), [by], fields[:2], fields[2:])
    first = F.element_at("rows", 1)

    def state(end: Column, start: Column, language: Column, n: Column, arabic: Column, logprob: Column, group: Column, groups: Column) -> Column:
        return F.struct(
            end.cast("double").alias("end"), start.cast("double").alias("start"), language.alias("language"), n.cast("int").alias("n_words"),
            arabic.alias("has_arabic"), logprob.cast("double").alias("avg_logprob"), group.cast("int").alias("group"), groups.alias("groups"),
        )

    begin = state(first["end"], first["start"], first["language"], first["n_words"], first["has_arabic"], first["avg_logprob"], F.lit(0), F.array(F.lit(0)))
    folded = F.aggregate(
        F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))),
        begin,
        lambda cur, r: F.when(
            joins(cur, r),
            state(r["end"], cur["start"], cur["language"], cur["n_words"] + r["n_words"], cur["has_arabic"] | r["has_arabic"], (cur["avg_logprob"] + r["avg_logprob"]) / 2, cur["group"], F.array_append(cur["groups"], cur["group"])),
        ).otherwise(state(r["end"], r["start"], r["language"], r["n_words"], r["has_arabic"], r["avg_logprob"], cur["group"] + 1, F.array_append(cur["groups"], cur["group"] + 1))),
        lambda cur: cur["groups"],
    )
    groups = rows.select(F.col(by).alias("_by"), F.explode(F.arrays_zip(F.transform("rows", lambda r: r["seq"]).alias("s"), folded.alias("g"))).alias("z"))
    groups = groups.select("_by", F.col("z.s").alias("_seq"), F.col("z.g").alias("_group"))
    joined = df.join(groups, F.col(by).eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq")))
    parts = joined.groupBy(by, "_group").agg(F.sort_array(F.collect_list(F.struct("start", "seq", *[x for x in df.columns if x not in ("start", "seq", by)]))).alias("p"))
    return parts.select(F.col(by), *merged_columns([x for x in df.columns if x != by]))


def merged_columns(columns: Sequence[str]) -> list[Column]:
    """A group ``p`` of segments as one: text and words joined, end from the last, log-probabilities averaged pair by pair,
    the largest no-speech probability, word confidence over all words; the rest from the first."""
    rest = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    first = F.element_at("p", 1)
    words = F.flatten(F.transform("p", lambda r: r["words"])) if "words" in columns else None
    special = {
        "end": F.element_at("p", -1)["end"],
        "text": F.array_join(F.transform("p", lambda r: r["text"]), " "),
        "avg_logprob": F.aggregate(rest, first["avg_logprob"].cast("double"), lambda a, r: (a + r["avg_logprob"]) / 2),
        "no_speech_prob": F.array_max(F.transform("p", lambda r: r["no_speech_prob"])) if "no_speech_prob" in columns else None,
        "words": words,
    }
    if words is not None and "avg_word_confidence" in columns:
        mean = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["probability"]) / F.size(words)
        special["avg_word_confidence"] = F.when(F.size("p") == 1, first["avg_word_confidence"]).when(F.size(words) > 0, mean).otherwise(0.0)
    return [(special[x] if special.get(x) is not None else first[x]).alias(x) for x in columns]


def merge_short(df: DataFrame, *, min_words: int = 4, max_gap: float = 1.5, max_duration: float = 30.0, by: str = "file_id") -> DataFrame:
    """Fragments join a neighbour of their language that is close; very short ones also by closeness of log-probability."""

    def joins(cur: Column, r: Column) -> Column:
        gap, same = r["start"] - cur["end"], cur["language"].eqNullSafe(r["language"]) & (r["end"] - cur["start"] < max_duration)
        brief = (cur["n_words"] < min_words) | (r["n_words"] < min_words)
        orphan = (cur["n_words"] < 2) | (r["n_words"] < 2)
        return same & (gap >= 0) & (brief & (gap < max_gap) | orphan & (gap < 0.7) & (F.abs(cur["avg_logprob"] - r["avg_logprob"]) < 0.5))

    return _merge(df, joins, by)


def merge_quotes(df: DataFrame, *, max_gap: float = 2.0, max_duration: float = 45.0, by: str = "file_id") -> DataFrame:
    """Neighbouring Urdu segments that both have Arabic letters become one."""

    def joins(cur: Column, r: Column) -> Column:
        gap = r["start"] - cur["end"]
        urdu = (cur["language"] == "ur") & (r["language"] == "ur") & cur["has_arabic"] & r["has_arabic"]
        return F.coalesce(urdu, F.lit(False)) & (gap >= 0) & (gap < max_gap) & (r["end"] - cur["start"] < max_duration)

    return _merge(df, joins, by)


def trim_overlaps(df: DataFrame, *, overlap: float = 2.0, most: int = 15, by: str = "file_id") -> DataFrame:
    """Words that a segment repeats from the end of the one before go, if the two overlap in time.

    The longest run of up to ``most`` words, equal after normalisation, that ends the segment before (as trimmed) and begins
    this one.  Times stay.  Blank segments go only from files in which words were removed.
    """
    parts = text.words(text.column("text"))
    df = df.withColumn("_words", parts)
    norm = F.transform("_words", lambda w: _normal_word(w))
    rows = ordered_rows(df.withColumn("_norm", norm), [by], ["start", "seq"], ["end", "_norm"])

    def shared(before: Column, here: Column) -> Column:
        """Length of the longest run."""
        n = F.least(F.lit(most), F.size(before), F.size(here))
        sizes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        fits = F.filter(sizes, lambda k: F.slice(before, -k, k) == F.slice(here, F.lit(1), k))
        return F.coalesce(F.array_max(fits), F.lit(0))

    def step(acc: Column, r: Column) -> Column:
        overlaps = (r["start"] < acc["end"]) & (acc["end"] - r["start"] <= overlap + 0.5)
        cut = F.when(overlaps, shared(acc["norm"], r["_norm"])).otherwise(0)
        return F.struct(
            r["end"].cast("double").alias("end"),
            F.slice(r["_norm"], cut + 1, F.greatest(F.size(r["_norm"]) - cut, F.lit(0))).alias("norm"),
            F.array_append(acc["cuts"], cut.cast("int")).alias("cuts"),
        )

    none = F.struct(F.lit(float("-inf")).alias("end"), F.array().cast("array<string>").alias("norm"), F.array().cast("array<int>").alias("cuts"))
    cuts = F.aggregate("rows", none, step, lambda acc: acc["cuts"])
    found = rows.select(F.col(by).alias("_by"), F.transform("rows", lambda r: r["seq"]).alias("s"), cuts.alias("c"))
    found = found.select("_by", F.aggregate("c", F.lit(0), lambda a, x: a + x).alias("_total"), F.explode(F.arrays_zip("s", "c")).alias("z"))
    found = found.select("_by", "_total", F.col("z.s").alias("_seq"), F.col("z.c").alias("removed_words"))
    out = df.join(found, F.col(by).eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq")))
    trimmed = F.array_join(F.slice("_words", F.col("removed_words") + 1, F.greatest(F.size("_words") - F.col("removed_words"), F.lit(0))), " ")
    out = out.withColumn("text", F.when(F.col("removed_words") > 0, trimmed).otherwise(F.col("text")))
    return out.where((F.col("_total") == 0) | ~F.coalesce("text", F.lit("")).rlike(rf"^{text.BLANK}*$")).drop("_by", "_seq", "_total", "_words")


def _normal_word(word: Column) -> Column:
    """``normalise_arabic`` of a word, composed already (a lambda can't leave the JVM)."""
    return text.normalise_arabic(word, nfc=False)
