"""Renders enriched segments.  Each function returns one row per file with the content of the output, ready to write.

Enriched segments have file_id, seq, start, end, text, detected_lang, raw_text, was_corrected, avg_word_confidence, words,
is_flagged, flag_reason, the nullable structs formula_match, quran_match, hadith_match, and hadith_retrieval_confidence,
hadith_correction_type, hadith_correction_detail, hadith_suggestion_safe.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

c = F.col
RULE = "═" * 72
# The struct types of matches.
FORMULA = "struct<label:string,matched_text:string,confidence:double>"
REFS = "array<struct<surah_id:int,surah_name:string,ayah_id:int>>"
VERSE = f"struct<surah_id:int,surah_name:string,ayah_id:int,original_text:string,matched_text:string,confidence:double,is_exact:boolean,is_ambiguous:boolean,ambiguous_count:int,alternate_refs:{REFS}>"
NARRATION = "struct<collection:string,hadith_number:string,arabic_text:string,english_text:string,matched_text:string,confidence:double,is_paraphrase:boolean,chapter:string>"


def percent(x: Column) -> Column:
    return F.floor(x * 100).cast("int").cast("string")


def shortened(x: Column, n: int = 60) -> Column:
    return F.concat(F.substring(x, 1, n), F.when(F.length(x) > n, "…").otherwise(""))


def badge(lang: Column) -> Column:
    return F.when(lang == "und", "[??]").otherwise(F.concat(F.lit("["), F.upper(lang), F.lit("]")))


def annotation(most_refs: int = 8) -> Column:
    """The line under a segment, null if none: formula before verse before narration."""
    v, h = c("quran_match"), c("hadith_match")
    refs = F.transform(F.slice(v["alternate_refs"], 1, most_refs), lambda r: F.concat_ws(":", r["surah_id"], r["ayah_id"]))
    more = F.size(v["alternate_refs"]) - most_refs
    listed = F.array_join(F.when(more > 0, F.array_append(refs, F.format_string("…+%d more", more))).otherwise(refs), ", ")
    fixed = F.when(c("was_corrected"), " [corrected]").otherwise("")
    span = F.when((v["matched_text"] != "") & (v["matched_text"] != c("text")), F.concat(F.lit(' [span: "'), shortened(v["matched_text"]), F.lit('"]'))).otherwise("")
    several = v["is_ambiguous"] & (F.size(v["alternate_refs"]) > 0)
    pct = F.concat(F.lit("("), percent(v["confidence"]), F.lit("%)"))
    ambiguous = F.concat(F.lit("Quran [ambiguous — "), v["ambiguous_count"].cast("string"), F.lit(" ayahs] "), pct, F.lit(" possible: "), listed)
    single = F.concat(F.lit("Quran "), F.concat_ws(":", v["surah_id"], v["ayah_id"]), F.lit(" — "), v["surah_name"], F.when(v["is_exact"], " ✓exact").otherwise(""), F.lit(" "), pct)
    narration = F.concat(F.lit("Hadith — "), F.initcap(h["collection"]), F.lit(" #"), h["hadith_number"], F.lit(" ("), percent(h["confidence"]), F.lit("%)"), F.when(h["is_paraphrase"], " ⚠ paraphrase").otherwise(""))
    lead = " " * 11 + "↳ "
    return (
        F.when(c("formula_match").isNotNull(), F.concat(F.lit(lead + "☪ "), c("formula_match.label")))
        .when(v.isNotNull(), F.concat(F.lit(lead + "📖 "), F.when(several, ambiguous).otherwise(single), fixed, span))
        .when(h.isNotNull(), F.concat(F.lit(lead + "📜 "), narration))
    )


def in_order(df: DataFrame, line: Column, *more: Column) -> DataFrame:
    """By file: ``lines`` in order of start and seq, and further aggregates."""
    rows = df.withColumn("_line", line).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "_line"))).alias("_rows"), *more)
    return rows.withColumn("lines", F.transform("_rows", lambda r: r["_line"])).drop("_rows")


def txt(df: DataFrame, title: str = "ISLAMIC LECTURE TRANSCRIPT") -> DataFrame:
    """(file_id, content): header with duration and languages, one line a segment with its annotation, footer."""
    bare = c("formula_match").isNull() & c("quran_match").isNull() & c("hadith_match").isNull()
    body = F.concat(c("text"), F.when(bare & c("is_flagged"), "  ⚠ [unverified — see flagged.txt]").otherwise(""))
    line = F.concat_ws("\n", F.concat(F.lit("["), text.timestamp("start"), F.lit("] "), badge(c("detected_lang")), F.lit(" "), body), annotation())
    laid = in_order(df, line, F.max_by("end", F.struct("start", "seq")).alias("last"), F.sort_array(F.collect_list("detected_lang")).alias("langs"))
    counts = F.transform(F.array_distinct("langs"), lambda k: F.concat(F.upper(k), F.lit(": "), F.size(F.filter("langs", lambda x: x == k)).cast("string")))
    n = F.size("lines").cast("string")
    head = [F.lit(RULE), F.lit(f" {title}"), F.concat(F.lit(" Duration: "), text.timestamp("last"), F.lit("  |  Segments: "), n), F.concat(F.lit(" Languages: "), F.array_join(counts, "  ")), F.lit(RULE), F.lit("")]
    foot = [F.lit(""), F.lit(RULE), F.concat(F.lit(" Total segments: "), n), F.lit(RULE)]
    return laid.select("file_id", F.concat_ws("\n", *head, F.array_join("lines", "\n"), *foot).alias("content"))


def srt_text() -> Column:
    """A subtitle's text: verse before narration before formula."""
    v, h = c("quran_match"), c("hadith_match")
    mark = (
        F.when(v.isNotNull(), F.concat(F.lit("\n[QURAN "), F.concat_ws(":", v["surah_id"], v["ayah_id"]), F.lit("]")))
        .when(h.isNotNull(), F.concat(F.lit("\n[HADITH "), h["collection"], F.lit(" #"), h["hadith_number"], F.lit("]")))
        .when(c("formula_match").isNotNull(), F.concat(F.lit("\n[FORMULA "), c("formula_match.label"), F.lit("]")))
        .otherwise("")
    )
    times = F.concat(text.timestamp("start", millis=True, comma=True), F.lit(" --> "), text.timestamp("end", millis=True, comma=True))
    return F.concat(times, F.lit("\n["), F.upper("detected_lang"), F.lit("] "), c("text"), mark, F.lit("\n"))


def srt(df: DataFrame) -> DataFrame:
    laid = in_order(df, srt_text())
    return laid.select("file_id", F.array_join(F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x)), "\n").alias("content"))


def json_objects(df: DataFrame) -> DataFrame:
    """Each segment as the object of the JSON transcript (``json``); raw_text only of corrected ones, verification only where one ran."""
    checked = F.coalesce(c("hadith_correction_type"), F.lit("")) != ""
    verification = F.when(
        checked,
        F.struct(c("hadith_retrieval_confidence").alias("retrieval_confidence"), c("hadith_correction_type").alias("correction_type"), c("hadith_correction_detail").alias("correction_detail"), c("hadith_suggestion_safe").alias("suggestion_safe"), F.lit(False).alias("applied")),
    )
    obj = F.struct(
        "start", "end", text.timestamp("start").alias("timestamp"), "text", F.when(c("was_corrected"), c("raw_text")).alias("raw_text"), "was_corrected", c("detected_lang").alias("detected_language"),
        "avg_word_confidence", "is_flagged", "quran_match", "hadith_match", verification.alias("hadith_verification"), "formula_match",
    )
    return df.select("file_id", "start", "seq", F.to_json(obj, {"ignoreNullFields": "false"}).alias("json"))


def json_array(df: DataFrame) -> DataFrame:
    laid = in_order(json_objects(df), c("json"))
    return laid.select("file_id", F.concat(F.lit("[\n"), F.array_join("lines", ",\n"), F.lit("\n]")).alias("content"))


@F.pandas_udf(T.StringType())
def _wrapped(lines: pd.Series) -> pd.Series:
    """Wraps at double spaces, at 72 characters, following lines indented by eleven."""

    def one(line: str, width: int = 72, indent: str = " " * 11) -> str:
        if line is None or len(line) <= width:
            return line
        out: list[str] = []
        for part in filter(None, line.split("  ")):
            if out and len(out[-1]) + 2 + len(part) <= width:
                out[-1] += "  " + part
            else:
                out.append((indent if out else "") + part)
        return "\n".join(out)

    return lines.map(one)


def flagged(df: DataFrame) -> DataFrame:
    """The review list of each file that has flagged segments."""
    rule = "-" * 72
    words = F.array_join(F.transform("words", lambda w: F.format_string("%s(%.2f)", w["word"], w["probability"])), "  ")
    detail = F.when(F.size("words") > 0, F.concat(F.lit("  Words  : "), words))
    mine = df.where("is_flagged").withColumn("_detail", _wrapped(detail))
    entry = F.concat_ws("\n", F.concat(F.lit("  ["), text.timestamp("start"), F.lit(" → "), text.timestamp("end"), F.lit("]\n  Text   : "), c("text"), F.lit("\n  Reason : "), c("flag_reason")), c("_detail"), F.lit("  Verified: " + "_" * 55 + "\n"))
    laid = in_order(mine, entry)
    head = "\n".join(["=" * 72, "FLAGGED ARABIC SEGMENTS — REQUIRES HUMAN VERIFICATION", "These segments were transcribed as Arabic but could not be", "matched to the Quran corpus or Sunnah.com hadith database.", "Fill in the 'Verified:' field after manual review.", "=" * 72, ""])
    numbered = F.transform("lines", lambda x, i: F.concat(F.lit(rule + "\n#"), (i + 1).cast("string"), x))
    return laid.select("file_id", F.concat_ws("\n", F.lit(head), F.array_join(numbered, "\n"), F.lit(rule), F.concat(F.lit("Total flagged: "), F.size("lines").cast("string")), F.lit(rule)).alias("content"))


def diagnostics(df: DataFrame) -> DataFrame:
    """One row of diagnostics a segment, from enriched segments with the scores of decoding."""
    n = lambda x, zero: F.coalesce(x, F.lit(zero))
    from ..functions import scores

    v, h = c("quran_match"), c("hadith_match")
    done = n(c("hadith_correction_type"), "") != ""
    return df.select(
        "file_id", c("seq").alias("segment_id"), "start", "end", text.preview("text").alias("text_preview"), text.preview(F.coalesce("raw_text", "text")).alias("original_text_preview"),
        "detected_lang", "language_locked", "lock_reason", scores.confidence(c("avg_logprob"), c("no_speech_prob"), c("compression_ratio")).alias("confidence"), "avg_logprob", "no_speech_prob",
        "avg_word_confidence", F.size(text.words(text.column("text"))).alias("word_count"), "prompt_mode", v.isNotNull().alias("quran_match"), n(v["confidence"], 0.0).alias("quran_confidence"),
        n(v["is_exact"], False).alias("quran_is_exact"), n(v["is_ambiguous"], False).alias("quran_is_ambiguous"), h.isNotNull().alias("hadith_match"), n(h["confidence"], 0.0).alias("hadith_confidence"),
        c("formula_match").isNotNull().alias("formula_match"), "was_corrected", "is_flagged", F.lit(0).alias("overlap_removed_words"), "mixed_script_ratio", "repeated_ngram_score", "retry_triggered",
        "retry_reason", "confidence_delta", done.alias("hadith_retrieval_attempted"), n(c("hadith_suggestion_safe"), False).alias("hadith_retrieval_accepted"),
        F.when(c("hadith_correction_type") == "rejected", c("hadith_correction_detail")).otherwise("").alias("hadith_retrieval_rejected_reason"), n(c("hadith_retrieval_confidence"), 0.0).alias("hadith_verification_confidence"),
        (n(c("hadith_suggestion_safe"), False) & (n(c("hadith_correction_detail"), "") != "")).alias("hadith_suggestion_generated"),
    )


def write_files(contents: DataFrame, path: str) -> None:
    """One folder a file, with its content as text."""
    contents.select("file_id", F.col("content").alias("value")).write.mode("overwrite").partitionBy("file_id").option("lineSep", "\n").text(path)
