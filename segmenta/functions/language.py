"""Language of a segment by script and vocabulary, with an optional statistical detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon, text


def likely_urdu(text_: Column | str, normal: Column | None = None, *, nfc: bool = True) -> Column:
    """A sign or letter of Urdu's own, or two different Urdu words in the normalised text."""
    raw = text.column(text_)
    normal = text.normalise_arabic(raw, nfc=nfc) if normal is None else normal
    own = F.array(*map(F.lit, lexicon.URDU_WORDS))
    return raw.rlike(f"[{text.URDU_SIGNS}]") | (F.size(F.array_intersect(F.split(normal, " "), own)) >= 2)


def detect(text_: Column | str, *, trusted: Column | None = None, guess: Column | None = None, sure: Column | None = None, normal: Column | None = None, nfc: bool = True) -> Column:
    """ar, ur, en, und or what a detector says.

    trusted: a label to keep for texts of three words or more; guess and sure: the answer of a statistical detector and its
    probability, followed from 0.85 on.  Without them script decides: Arabic letters are Urdu or Arabic, Latin ones English.
    """
    raw = text.column(text_)
    urdu = likely_urdu(raw, normal, nfc=nfc)
    by_script = F.when(text.has_arabic(raw), F.when(urdu, "ur").otherwise("ar")).when(raw.rlike("[A-Za-z]"), "en").otherwise(F.coalesce(guess, F.lit("und")) if guess is not None else F.lit("und"))
    out = by_script
    if guess is not None and sure is not None:
        out = F.when(sure >= 0.85, F.when(guess.isin("ar", "ur"), F.when(urdu, "ur").otherwise("ar")).otherwise(guess)).otherwise(out)
    if trusted is not None:
        label = text.language_code(trusted)
        out = F.when((label != "und") & (F.size(text.words(raw)) >= 3), F.when((label == "ar") & urdu, "ur").otherwise(label)).otherwise(out)
    return F.when(raw.rlike(rf"^{text.BLANK}*$"), "und").otherwise(out)


def inherit(df: DataFrame, order: list[str], *, lang: str = "lang", text_: str = "text", by: str = "file_id") -> DataFrame:
    """Short segments (under four words, neither Arabic nor English) take their language from signs or from before.

    An Urdu letter makes Urdu, more than 70 % Latin letters make English; languages that detectors confuse with ours take
    what the row before has got, which is the last row's that did not inherit.  The first row keeps its own.
    """
    w = Window.partitionBy(by).orderBy(*order)
    raw = text.column(text_)
    latin = F.length(F.regexp_replace(raw, "[^A-Za-z]", "")) / F.greatest(F.length(raw), F.lit(1))
    short = (F.size(text.words(raw)) < 4) & ~F.col(lang).isin("ar", "en") & (F.row_number().over(w) > 1)
    doubtful = F.col(lang).isin("fa", "af", "no", "nl", "id")
    settled = F.when(
        short,
        F.when(raw.rlike(f"[{text.URDU_ONLY}]"), "ur").when(latin > 0.7, "en").when(doubtful, F.lit(None)).otherwise(F.col(lang)),
    ).otherwise(F.col(lang))
    return df.withColumn("_settled", settled).withColumn(lang, F.last("_settled", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_settled")


def lock(language: Column, probability: Column, threshold: float = 0.90) -> Column:
    """Whether decoding may be held to the language, and why."""
    held = (probability > threshold) & language.isin("ar", "ur", "en")
    return F.struct(F.coalesce(held, F.lit(False)).alias("locked"), F.when(held, F.format_string("prob=%.2f", probability)).otherwise("").alias("reason"))
