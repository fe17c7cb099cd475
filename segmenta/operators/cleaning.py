"""Filters that drop what speech recognition makes up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plain, text


def drop_phrases(df: DataFrame, column: str = "text", *, nfc: bool = True) -> DataFrame:
    """Rows whose normalised text is a known made-up phrase go; so do rows that normalise to nothing."""
    return df.where(~text.normalise_arabic(column, nfc=nfc).isin(plain.spurious()))


def spurious_pattern(column: Column | str) -> Column:
    """Blank; one word eight times and nothing else (unless words of remembrance occur); only stops; only notes; a web address."""
    t = F.regexp_replace(text.column(column), rf"^{text.BLANK}+|{text.BLANK}+$", "")
    # a list of words and not a back-reference, whose recursion would overflow on a very long text
    parts = text.words(t)
    one_word = (F.size(parts) >= 8) & (F.size(F.array_distinct(parts)) == 1) & ~t.rlike("الله|سبحان|الحمد|استغفر|اكبر")
    return (t == "") | one_word | t.rlike(r"^[\.…,،]+$") | t.rlike("^[♪♫🎵🎶]+$") | t.rlike(r"https?://|www\.|\.com|\.org")


def drop_patterns(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(~spurious_pattern(column))
