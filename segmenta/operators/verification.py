"""Verification of a narration match: metadata for a reviewer; the text is never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, similarity, text


def verify(matches: DataFrame, *, nfc: bool = True) -> DataFrame:
    """Adds to rows (asr_text, retrieval_text, asr_word_confidence, word_confidences) the verdict on a correction.

    token_overlap, fuzzy_similarity, retrieval_confidence; markers and their categories; divergent tokens; low-confidence
    words; suggested_patch, suggestion_safe, rejection_reason, correction_type (suggestion, rejected, none); applied is
    always false.
    """
    heard, source = text.canonical("asr_text", nfc=nfc), text.canonical("retrieval_text", nfc=nfc)
    out = matches.withColumns({"_heard": heard, "_source": source})
    out = out.withColumns({"_s": similarity.retrieval_scores("_heard", "_source"), "divergent_tokens": similarity.token_divergence("_heard", "_source", "word_confidences")})
    out = out.withColumn("marker_categories", scores.marker_categories(scores.markers("asr_text")))
    out = out.withColumns(
        {
            "token_overlap": F.col("_s.token_overlap"),
            "fuzzy_similarity": F.col("_s.fuzzy_similarity"),
            "retrieval_confidence": F.col("_s.combined"),
            "narration_marker_count": F.size("marker_categories"),
            "divergent_token_count": F.size(F.filter("divergent_tokens", lambda d: d["is_divergent"])),
            "low_confidence_word_count": F.size(F.filter(F.coalesce("word_confidences", F.array().cast("array<double>")), lambda c: c < 0.35)),
            "suggested_patch": scores.suggestion(F.col("divergent_tokens")),
        }
    )
    gate = scores.suggestion_gate(F.col("asr_word_confidence"), F.col("retrieval_confidence"), F.col("token_overlap"), F.col("narration_marker_count"), F.col("divergent_tokens"), F.length("_heard"), F.length("_source"))
    out = out.withColumn("rejection_reason", F.coalesce(gate, F.lit("")))
    safe, patch = F.col("rejection_reason") == "", F.col("suggested_patch") != ""
    return out.withColumns(
        {"suggestion_safe": safe, "correction_type": F.when(safe & patch, "suggestion").when(patch, "rejected").otherwise("none"), "applied": F.lit(False)}
    ).drop("_heard", "_source", "_s")
