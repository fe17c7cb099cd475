"""The whole plan: segments of many recordings to enriched segments, as one chain of DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language, scores, text
from ..operators import cleaning, folds, retrieval, verification
from ..operators.stored import stored
from ..sinks.transcripts import FORMULA, NARRATION, VERSE
from .config import Settings, settings

c = F.col


def cleaned(segments: DataFrame, *, nfc: bool = True) -> DataFrame:
    """Repeats, made-up phrases and made-up patterns go, in this order."""
    return cleaning.drop_patterns(cleaning.drop_phrases(folds.drop_repeats(segments, nfc=nfc), nfc=nfc))


def classified(segments: DataFrame, s: Settings, *, nfc: bool = True) -> DataFrame:
    """Languages by script with inheritance, fragments and quote blocks merged, then languages anew."""
    found = language.inherit(stored(segments, "cut").withColumn("lang", language.detect("text", nfc=nfc)), ["start", "seq"])
    found = found.withColumn("language", c("lang")).drop("lang")
    lock = language.lock(c("language"), c("language_probability"), s.language_lock_threshold)
    found = found.withColumn("language_locked", lock["locked"] & F.lit(s.enable_language_locking)).withColumn("lock_reason", lock["reason"])
    merged = folds.merge_short(stored(found, "languages"))
    if s.merge_arabic_quote_blocks:
        merged = folds.merge_quotes(stored(merged, "merged"))
    return merged.withColumn("detected_lang", language.detect("text", nfc=nfc))


def corrected(segments: DataFrame, *, nfc: bool = True) -> DataFrame:
    """Texts corrected; Urdu and unknown ones also in Urdu form; raw_text and was_corrected keep what was."""
    fixed = text.correct("text")
    out = segments.withColumn("raw_text", c("text")).withColumn("text", fixed)
    # a column of its own is computed once
    out = out.withColumn("_urdu", F.when(c("detected_lang").isin("ur", "und"), text.normalise_urdu("text")))
    out = out.withColumn("text", F.when(c("detected_lang").isin("ur", "und"), text.roman_to_urdu("_urdu")).otherwise(c("text"))).drop("_urdu")
    out = out.withColumn("was_corrected", c("text") != c("raw_text"))
    again = language.detect("text", nfc=nfc)
    return out.withColumn("detected_lang", F.when(c("was_corrected") & (again != "und"), again).otherwise(c("detected_lang")))


def routed(segments: DataFrame, s: Settings) -> DataFrame:
    """Adds quality, low_confidence and ``route``: arabic (search the text), urdu (search its Arabic spans), or none."""
    arabic = (c("detected_lang") == "ar") | ((c("detected_lang") != "en") & text.mainly_arabic("text"))
    urdu = (c("detected_lang") == "ur") & text.has_arabic("text")
    return segments.withColumns(
        {
            "quality": scores.quality(c("avg_logprob"), c("avg_word_confidence"), c("no_speech_prob")),
            "low_confidence": scores.low_word_confidence(c("words"), c("avg_word_confidence"), s.low_confidence_threshold),
            "route": F.when(arabic, "arabic").when(urdu, "urdu").otherwise("none"),
        }
    )


def annotate(segments: DataFrame, verses: DataFrame, narrations: DataFrame | None = None, config: Settings | None = None, *, nfc: bool = True) -> DataFrame:
    """Enriched segments.

    verses: (idx, surah_id, surah_name, ayah_id, text, canon).  narrations: (idx, collection, hadith_number, text_ar, text_en,
    chapter, canon), or none.  Segments that need a source and have none are flagged with the reason.
    """
    s = config or settings()
    # a fold reads its rows more than once, so each begins with a table and not with the folds before it
    cut = folds.trim_overlaps(stored(cleaned(segments, nfc=nfc), "cleaned"), overlap=s.chunk_overlap)
    out = stored(routed(corrected(classified(cut, s, nfc=nfc), nfc=nfc), s), "routed")
    key = F.struct("file_id", "seq")
    spans = F.when(c("route") == "arabic", F.array("text")).when(c("route") == "urdu", text.arabic_spans("text")).otherwise(F.array().cast("array<string>"))
    asked = out.select(key.alias("segment"), F.posexplode(spans).alias("pos", "span"), "avg_word_confidence", "low_confidence")
    asked = asked.select(F.struct("segment", "pos").alias("qid"), "span", text.canonical("span", nfc=nfc).alias("query"), c("avg_word_confidence").alias("word_confidence"), (~c("low_confidence")).alias("allow_fuzzy"))
    found = retrieval.match_verses(asked, verses, formula_exclusive=s.formula_exclusive).where("kind IS NOT NULL")
    # the first span with a hit counts
    first = stored(retrieval.first_rows(found, ["qid.segment"], ["qid.pos"], 1, "_first"), "verses")
    meta = verses.select("idx", "surah_id", "surah_name", "ayah_id", c("text").alias("original"))
    refs = verses.select(c("idx").alias("ref"), F.struct("surah_id", "surah_name", "ayah_id").alias("r"))
    others = first.where("refs IS NOT NULL").select("qid", F.posexplode("refs").alias("n", "ref")).join(refs, "ref").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "r"))), lambda x: x["r"]).alias("alternate_refs"))
    hits = first.join(meta, "idx", "left").join(others, "qid", "left").select(
        c("qid.segment.file_id").alias("_f"), c("qid.segment.seq").alias("_s"), "kind", "label", "span", "query", "confidence", "is_exact", "is_ambiguous",
        F.coalesce(F.size("refs"), F.lit(0)).alias("n_refs"), "surah_id", "surah_name", "ayah_id", "original", "alternate_refs",
    )
    out = out.join(hits, c("file_id").eqNullSafe(c("_f")) & (c("seq") == c("_s")), "left").drop("_f", "_s")
    formula = F.when(c("kind") == "formula", F.struct("label", c("query").alias("matched_text"), "confidence")).cast(FORMULA)
    verse = F.when(
        c("kind").isin("exact", "fuzzy", "window"),
        F.struct("surah_id", "surah_name", "ayah_id", c("original").alias("original_text"), c("span").alias("matched_text"), "confidence", "is_exact", "is_ambiguous", F.greatest(F.lit(1), c("n_refs")).alias("ambiguous_count"), "alternate_refs").cast(VERSE),
    )
    out = out.withColumns({"formula_match": formula, "_verse": verse})
    lowered = scores.corrected(c("_verse"), F.when(c("route") == "arabic", c("raw_text")).otherwise(c("span")))
    out = out.withColumn("quran_match", F.when(c("was_corrected"), lowered).otherwise(c("_verse")))
    searched = F.size(text.arabic_spans("text")) > 0
    open_ = c("kind").isNull() & ((c("route") == "arabic") | ((c("route") == "urdu") & searched))
    average = F.format_string("%.2f", "avg_word_confidence")
    low = F.when(c("route") == "arabic", F.concat(F.lit("Low confidence Arabic (avg="), average, F.lit("); fuzzy Quran/Hadith verification skipped"))).otherwise(
        F.concat(F.lit("Low confidence Urdu segment with Arabic quote (avg="), average, F.lit("); fuzzy verification skipped"))
    )
    out = out.withColumns({"pending_hadith": open_ & ~c("low_confidence"), "flag_reason": F.when(open_ & c("low_confidence"), low)})
    out = out.drop("_verse", "label", "span", "query", "confidence", "is_exact", "is_ambiguous", "n_refs", "surah_id", "surah_name", "ayah_id", "original", "alternate_refs")
    out = stored(out, "matched")
    if narrations is None or s.no_hadith:
        out = out.withColumns({"hadith_match": F.lit(None).cast(NARRATION), "flag_reason": F.when(c("pending_hadith"), "Hadith matching disabled; no Quran match").otherwise(c("flag_reason"))})
    else:
        out = _narrations(out, narrations, s, nfc)
    out = out.withColumns({"is_flagged": c("flag_reason").isNotNull(), "prompt_mode": F.lit("bayan"), "is_paraphrase": F.coalesce(c("hadith_match.is_paraphrase"), F.lit(False)), "hadith_hit": c("hadith_match").isNotNull()})
    return _verified(out, s, nfc)


def _narrations(out: DataFrame, narrations: DataFrame, s: Settings, nfc: bool) -> DataFrame:
    asked = out.where("pending_hadith").select(F.struct("file_id", "seq").alias("qid"), retrieval.narration_query(c("detected_lang"), c("text")).alias("span"))
    asked = asked.withColumn("query", text.canonical("span", nfc=nfc))
    best = retrieval.match_narrations(asked, narrations, token_set=s.hadith_token_set_threshold, combined=s.hadith_combined_threshold)
    found = best.join(narrations.drop("canon"), "idx").select(
        c("qid.file_id").alias("_f"),
        c("qid.seq").alias("_s"),
        F.struct("collection", "hadith_number", c("text_ar").alias("arabic_text"), c("text_en").alias("english_text"), c("span").alias("matched_text"), "confidence", "is_paraphrase", F.coalesce("chapter", F.lit("")).alias("chapter")).cast(NARRATION).alias("hadith_match"),
    )
    out = out.join(found, c("file_id").eqNullSafe(c("_f")) & (c("seq") == c("_s")), "left").drop("_f", "_s")
    return out.withColumn("flag_reason", F.when(c("pending_hadith") & c("hadith_match").isNull(), "No Quran or Hadith match found").otherwise(c("flag_reason")))


def _verified(out: DataFrame, s: Settings, nfc: bool) -> DataFrame:
    """Fields of verification, filled for matched narrations if it is switched on."""
    names = {"hadith_retrieval_confidence": "double", "hadith_correction_type": "string", "hadith_correction_detail": "string", "hadith_suggestion_safe": "boolean"}
    if not s.enable_hadith_verification:
        return out.withColumns({k: F.lit({"double": 0.0, "string": "", "boolean": False}[t]) for k, t in names.items()})
    asked = out.where("hadith_match IS NOT NULL").select("file_id", "seq", c("text").alias("asr_text"), c("hadith_match.arabic_text").alias("retrieval_text"), c("avg_word_confidence").alias("asr_word_confidence"), F.transform("words", lambda w: w["probability"]).alias("word_confidences"))
    done = verification.verify(asked, nfc=nfc).select(
        c("file_id").alias("_f"), c("seq").alias("_s"), c("retrieval_confidence").alias("hadith_retrieval_confidence"), c("correction_type").alias("hadith_correction_type"),
        F.when(c("correction_type") == "rejected", c("rejection_reason")).otherwise(c("suggested_patch")).alias("hadith_correction_detail"), c("suggestion_safe").alias("hadith_suggestion_safe"),
    )
    out = out.join(done, c("file_id").eqNullSafe(c("_f")) & (c("seq") == c("_s")), "left").drop("_f", "_s")
    return out.withColumns({k: F.coalesce(c(k), F.lit({"double": 0.0, "string": "", "boolean": False}[t])) for k, t in names.items()})
