"""Counts, quantiles and error rates of segments by file and over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, similarity

OURS = ("ur", "ar", "en")


def collection_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("collection")).agg(F.count("*").alias("n"))


def at_rank(values: Column, part: float, n: Column) -> Column:
    """The value at place floor(part n) of a sorted array, counted from 0; below four values quarters are the ends."""
    place = F.floor(n * part).cast("int") + 1
    if part == 0.25:
        place = F.when(n >= 4, place).otherwise(1)
    if part == 0.75:
        place = F.when(n >= 4, place).otherwise(n.cast("int"))
    return F.element_at(values, place)


def summary(df: DataFrame, order: list[str], *, by: str = "file_id") -> DataFrame:
    """One row per file: quantiles of confidence and log-probability (of the sorted values, not interpolated), languages,
    changes of language between neighbours, and counts of what happened."""
    w = Window.partitionBy(by).orderBy(*order)
    moved = df.withColumn("_moved", F.coalesce(F.col("detected_lang") != F.lag("detected_lang").over(w), F.lit(False)))
    languages = df.groupBy(by, "detected_lang").agg(F.count("*").alias("n")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("detected_lang", "n"))).alias("languages"))
    flags = ("language_locked", "quran_match", "hadith_match", "was_corrected", "is_flagged")
    out = moved.groupBy(by).agg(
        F.count("*").alias("total_segments"),
        F.sort_array(F.collect_list("confidence")).alias("_c"),
        F.sort_array(F.collect_list("avg_logprob")).alias("_l"),
        F.count_if("_moved").alias("language_drift_events"),
        *(F.count_if(x).alias(f"n_{x}") for x in flags),
        F.sum("overlap_removed_words").alias("overlap_dedup_total_words"),
    )
    n = F.col("total_segments")
    quantiles = {f"confidence_p{round(100 * p)}": at_rank(F.col("_c"), p, n) for p in (0.25, 0.5, 0.75)} | {"avg_logprob_p50": at_rank(F.col("_l"), 0.5, n)}
    return out.withColumns(quantiles).drop("_c", "_l").join(languages, by)


def drift(df: DataFrame, order: list[str], *, by: str = "file_id", lang: str = "detected_lang") -> DataFrame:
    """How often a file leaves Urdu, Arabic and English for another known language."""
    here = F.coalesce(F.col(lang), F.lit("und"))
    before = F.lag(here).over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_d", F.coalesce(before.isin(*OURS) & ~here.isin(*OURS, "und"), F.lit(False))).groupBy(by).agg(F.count_if("_d").alias("drift_events"))


def mixed_script_ratio(df: DataFrame, column: str, *, by: str = "file_id") -> DataFrame:
    mixed, total = scores.mixed_words(column)
    return df.groupBy(by).agg((F.sum(mixed) / F.greatest(F.sum(total), F.lit(1))).alias("mixed_script_ratio"))


def worst(df: DataFrame) -> DataFrame:
    """Segments that a reviewer should see."""
    c = F.col
    bad = (c("mixed_script_ratio") > 0.10) | (c("avg_logprob") < -1.0) | c("is_flagged") | c("retry_triggered") | (c("repeated_ngram_score") > 0.4)
    return df.where(bad).select(
        "file_id",
        "segment_id",
        c("original_text_preview").alias("original"),
        F.when(c("retry_triggered"), c("text_preview")).otherwise("").alias("retry"),
        c("text_preview").alias("selected"),
        "confidence_delta",
        "mixed_script_ratio",
        (~c("detected_lang").isin(*OURS, "und")).alias("language_drift"),
        "retry_triggered",
        "retry_reason",
    )


def evaluation(df: DataFrame, order: list[str], *, by: str = "file_id") -> DataFrame:
    """Rates and counts by file; the flagged rate counts every flagged row."""
    rates = df.groupBy(by).agg(
        F.count("*").alias("total_segments"), F.avg(F.col("is_flagged").cast("double")).alias("flagged_rate"), F.count_if("quran_match").alias("quran_matches"),
        F.count_if("hadith_match").alias("hadith_matches"), F.avg(F.col("retry_triggered").cast("double")).alias("retry_trigger_rate"),
    )
    return rates.join(drift(df, order, by=by), by).join(mixed_script_ratio(df, "text_preview", by=by), by)


def error_rates(pairs: DataFrame) -> DataFrame:
    """Adds ``wer`` and ``cer`` of (reference, hypothesis); a missing hypothesis counts as empty, a missing reference gives 0."""
    reference, hypothesis = F.coalesce("reference", F.lit("")), F.coalesce("hypothesis", F.lit(""))
    return pairs.withColumns({"wer": similarity.word_error_rate(reference, hypothesis), "cer": similarity.char_error_rate(reference, hypothesis)})


def over_files(files: DataFrame) -> DataFrame:
    """Means of error rates over files and sums of counts; missing values count as 0."""
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return files.agg(F.count("*").alias("files"), F.avg(zero("wer")).alias("mean_wer"), F.avg(zero("cer")).alias("mean_cer"), F.sum(zero("drift_events")).cast("long").alias("drift_events"), F.sum(zero("quran_matches")).cast("long").alias("quran_matches"), F.sum(zero("hadith_matches")).cast("long").alias("hadith_matches"))


def run_counters(enriched: DataFrame, *, by: str = "file_id") -> DataFrame:
    """Counters of a run by file."""
    c = F.col
    return enriched.groupBy(by).agg(
        F.count("*").alias("total_segments"), F.count_if(c("route") == "arabic").alias("arabic_segments"), F.count_if(c("kind") == "formula").alias("formula_hits"),
        F.count_if(c("kind").isin("exact", "fuzzy", "window")).alias("quran_hits"), F.count_if("hadith_hit").alias("hadith_hits"), F.count_if("is_paraphrase").alias("paraphrase_hits"),
        F.count_if("is_flagged").alias("flagged"), F.count_if(c("quality") < 0.25).alias("low_quality_segments"), F.count_if("was_corrected").alias("post_processed"),
    )


def header(df: DataFrame, *, by: str = "file_id") -> DataFrame:
    """Of each file: segments, the end of the last one in order, and segments by language in order of code."""
    languages = df.groupBy(by, "detected_lang").agg(F.count("*").alias("n")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.upper("detected_lang").alias("code"), "n"))).alias("languages"))
    return df.groupBy(by).agg(F.count("*").alias("segments"), F.max_by("end", F.struct("start", "seq")).alias("duration")).join(languages, by)


def run_metadata(segments: DataFrame, files: DataFrame, *, by: str = "file_id") -> DataFrame:
    """What a run cost, by file: ``files`` has duration, transcription_ms, retry_decode_ms and elapsed_seconds (nulls count as 0).

    retries_per_hour_audio (an unknown duration counts as a second) and avg_decode_time_per_segment (0 without segments).
    """
    counts = segments.groupBy(by).agg(F.count("*").alias("total_segments"), F.count_if("retry_triggered").alias("retries"))
    out = files.join(counts, by, "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("total_segments", "retries")} | {x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in ("duration", "transcription_ms", "retry_decode_ms", "elapsed_seconds")})
    hours = F.when(F.col("duration") > 0, F.col("duration")).otherwise(1.0) / 3600
    return out.select(
        by, "total_segments", F.col("elapsed_seconds").alias("runtime_seconds"), F.round(F.col("retry_decode_ms") / 1000, 2).alias("retry_time_seconds"), F.round(F.col("retries") / hours, 2).alias("retries_per_hour_audio"),
        F.when(F.col("total_segments") > 0, F.round(F.col("transcription_ms") / 1000 / F.col("total_segments"), 3)).otherwise(0.0).alias("avg_decode_time_per_segment"),
    )


def evaluated_files(files: DataFrame, hypotheses: DataFrame, references: DataFrame, diagnostics: DataFrame, order: list[str], *, by: str = "file_id") -> DataFrame:
    """One row a file of ``files`` (and its other columns): wer and cer of its hypothesis against its reference (columns
    ``text``), and what ``evaluation`` says of its diagnostics.  Where one of both texts is missing the rates are 0; where
    there are no diagnostics the counts are."""
    pairs = files.join(references.select(by, F.col("text").alias("reference")), by, "left").join(hypotheses.select(by, F.col("text").alias("hypothesis")), by, "left")
    whole = F.col("reference").isNotNull() & F.col("hypothesis").isNotNull()
    rates = error_rates(pairs).withColumns({x: F.when(whole, F.col(x)).otherwise(0.0) for x in ("wer", "cer")}).drop("reference", "hypothesis")
    found = evaluation(diagnostics, order, by=by)
    zeros = {x: F.coalesce(x, F.lit(0).cast(t)) for x, t in found.dtypes if x != by}
    return rates.join(found, by, "left").withColumns(zeros)


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    """One row over all files of ``evaluated_files``: means of rates, sums of counts."""
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return evaluated.agg(
        F.count("*").alias("total_files"), mean("wer").alias("avg_wer"), mean("cer").alias("avg_cer"), mean("flagged_rate").alias("avg_flag_rate"), total("drift_events").alias("total_arabic_drift_events"),
        mean("mixed_script_ratio").alias("avg_mixed_script_ratio"), total("quran_matches").alias("total_quran_matches_detected"), mean("retry_trigger_rate").alias("avg_retry_trigger_rate"),
    )
