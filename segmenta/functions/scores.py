"""Scores, classes and gates of segments: Column to Column.  Parameters name columns of the segment schema by default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon, text

c = F.col


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def quality(logprob: Column, word_confidence: Column, no_speech: Column) -> Column:
    return F.round(0.35 * clamp((logprob + 1.5) / 1.5) + 0.45 * word_confidence + 0.20 * (1 - no_speech), 4)


def confidence(logprob: Column, no_speech: Column, compression: Column | None = None) -> Column:
    """Without compression ratios the share of unrepetitive text counts as one."""
    fresh = F.lit(1.0) if compression is None else F.when(compression > 0, clamp(2 - compression)).otherwise(1.0)
    return F.round(0.25 * (1 - no_speech) + 0.50 * F.greatest(F.lit(0.0), 1 + logprob) + 0.25 * fresh, 4)


def low_word_confidence(words: Column, average: Column, threshold: float = 0.35) -> Column:
    """An average of 0 without words is unknown, not low."""
    return (F.size(words) > 0) & (average < threshold)


def retry_reasons(logprob: Column, compression: Column, ngrams: Column, mixed: Column, *, least: float = -0.9, most_compression: float = 1.8, most_ngrams: float = 0.35, most_mixed: float = 0.15) -> Column:
    found = [(logprob < least, "low_logprob"), (compression > most_compression, "high_compression"), (ngrams > most_ngrams, "repeated_ngrams"), (mixed > most_mixed, "mixed_script")]
    return F.array_compact(F.array(*(F.when(test, name) for test, name in found)))


def condition_on_previous(confidence_: Column, logprob: Column, language: Column, previous: Column) -> Column:
    return (confidence_ >= 0.85) & (logprob >= -0.45) & (language == previous)


def trusted(logprob: Column, word_confidence: Column, compression: Column, mixed: Column, flagged: Column, prompt_safe: Column, text_: Column, most_compression: float = 1.8, require_prompt_safe: bool = True) -> Column:
    safe = prompt_safe if require_prompt_safe else F.lit(True)
    return (logprob > -0.45) & (word_confidence > 0.80) & (compression < most_compression) & (mixed < 0.05) & ~flagged & safe & (F.size(text.words(text.column(text_))) >= 3)


def arabic_redraft(language: Column, text_: Column) -> Column:
    return (language == "ar") | text.mainly_arabic(text_)


def fuzzy_threshold(word_confidence: Column) -> Column:
    """Lower for texts heard with middling confidence."""
    return F.when((word_confidence >= 0.55) & (word_confidence < 0.75), 0.82).otherwise(0.88)


def calibrated(score: Column, query_length: Column, source_length: Column) -> Column:
    even = F.least(query_length, source_length) / F.greatest(query_length, source_length)
    return F.when(source_length == 0, 0.0).otherwise(F.round(clamp(score / 100 * (0.70 + 0.30 * even)), 4))


def paraphrase(confidence_: Column, query_length: Column, source_length: Column, token_set: Column, token_sort: Column) -> Column:
    apart = F.abs(query_length - source_length) / F.greatest(query_length, source_length, F.lit(1))
    return F.when(confidence_ >= 0.90, False).when(apart > 0.30, True).otherwise(token_set - token_sort > 15)


def corrected(match: Column, raw: Column) -> Column:
    """A verse match that needed corrections: less sure, never exact, and matched by the raw text."""
    lower = match.withField("confidence", F.round(match["confidence"] * 0.90, 4)).withField("is_exact", F.lit(False)).withField("matched_text", raw)
    return F.when(match.isNotNull(), lower)


# Signals of what a lecture is doing, of two words at most (``signal_bits`` relies on it).
SIGNALS = {
    "quran": ("سورة", "آية", "تلاوت", "قرآن", "اعوذ", "بسم الله"),
    "hadith": ("حدیث", "بخاری", "مسلم", "ترمذی", "روایت", "حدثنا", "اخبرنا", "قال رسول"),
    "naat": ("نعت", "مصطفٰی", "مدینہ", "صلوا", "درود"),
}


def signal_bits(text_: Column) -> dict[str, Column]:
    """Which of all signals a text holds (``held``), and of those of two words with which it ends (``ends``) and starts
    (``starts``), as bits in the order of SIGNALS."""
    lower = F.lower(text.column(text_))
    every = [s for signals in SIGNALS.values() for s in signals]
    bits = lambda test: reduce(lambda a, b: a.bitwiseOR(b), (F.when(test(s), 1 << k).otherwise(0) for k, s in enumerate(every) if test(s) is not None))
    part = lambda s, k: s.split(" ")[k] if s.count(" ") == 1 else None
    return {
        "held": bits(lower.contains),
        "ends": bits(lambda s: lower.endswith(part(s, 0)) if part(s, 0) else None),
        "starts": bits(lambda s: lower.startswith(part(s, 1)) if part(s, 1) else None),
    }


def mode_of(held: Column) -> Column:
    """The mode of whose signals most are among the bits, two at least; else ``bayan``.  Ties go to the earlier mode."""
    counts, at = {}, 0
    for mode, signals in SIGNALS.items():
        counts[mode] = F.bit_count(held.bitwiseAND((1 << len(signals)) - 1 << at))
        at += len(signals)
    best = F.greatest(*counts.values())
    out = F.lit("bayan")
    for mode in reversed(SIGNALS):
        out = F.when((counts[mode] == best) & (best >= 2), mode).otherwise(out)
    return out


def content_mode(recent: Column) -> Column:
    """The mode of one text."""
    return mode_of(signal_bits(recent)["held"])


def markers(text_: Column | str) -> Column:
    """Hits of narration markers, in order of pattern: category and matched text.  Trimmed texts under five characters have none."""
    t = text.column(text_)

    def found(category: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(text.edged(pattern)), F.lit(0)), lambda m: F.struct(F.lit(category).alias("category"), m.alias("matched")))

    hits = [found(*marker) for marker in lexicon.NARRATION_MARKERS]
    return F.when(F.length(F.trim(t)) < 5, F.slice(F.concat(*hits), 1, 0)).otherwise(F.concat(*hits))


def marker_categories(hits: Column) -> Column:
    return F.array_distinct(F.transform(hits, lambda h: h["category"]))


def suggestion_gate(asr_confidence: Column, retrieval: Column, overlap: Column, n_markers: Column, divergences: Column, asr_length: Column, source_length: Column) -> Column:
    """The first gate that rejects a suggestion, null if all pass.  Lengths are of canonical texts."""
    differing = F.filter(divergences, lambda d: d["is_divergent"])
    structural = F.filter(differing, lambda d: (F.trim(d["retrieval_token"]) == "") | F.trim(d["retrieval_token"]).contains(" "))
    sure = F.filter(differing, lambda d: d["asr_word_confidence"] > 0.45)
    longest = F.greatest(asr_length, source_length)
    delta = F.when(longest > 0, F.abs(asr_length - source_length) / longest).otherwise(0.0)
    first = lambda a, f: F.get(a, F.lit(0))[f]
    return (
        F.when(F.size(structural) > 0, F.format_string("structural_mismatch (not a simple 1-to-1 word correction for '%s')", first(structural, "asr_token")))
        .when(asr_confidence >= 0.45, F.format_string("asr_confidence_high (%.3f >= 0.45)", asr_confidence))
        .when(retrieval < 0.85, F.format_string("low_retrieval_similarity (%.3f < 0.85)", retrieval))
        .when(overlap < 0.60, F.format_string("low_token_overlap (%.3f < 0.6)", overlap))
        .when(n_markers < 1, F.format_string("no_narration_markers (count=%d)", n_markers))
        .when(F.size(differing) > 2, F.format_string("span_exceeds_limit (%d > 2)", F.size(differing)))
        .when(delta > 0.30, F.format_string("length_delta_high (%.3f > 0.3)", delta))
        .when(F.size(sure) > 0, F.format_string("divergent_token_high_confidence ('%s' conf=%.3f)", first(sure, "asr_token"), first(sure, "asr_word_confidence")))
    )


def suggestion(divergences: Column) -> Column:
    return F.array_join(F.transform(F.filter(divergences, lambda d: d["is_divergent"]), lambda d: F.concat(d["asr_token"], F.lit("→"), d["retrieval_token"])), ", ")


def mixed_words(text_: Column | str) -> tuple[Column, Column]:
    """(words in which a Latin letter stands next to an Arabic one, words)."""
    parts = text.words(text.column(text_))
    edge = f"[{text.LATIN}][{text.ARABIC}]|[{text.ARABIC}][{text.LATIN}]"
    return F.size(F.filter(parts, lambda w: w.rlike(edge))), F.size(parts)
