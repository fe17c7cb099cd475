"""Extension: segments that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language, text
from ..operators import cleaning


def cleaned_stream(segments: DataFrame, *, nfc: bool = True) -> DataFrame:
    """Made-up phrases and patterns go and languages are added, row by row: as on a stored table."""
    return cleaning.drop_patterns(cleaning.drop_phrases(segments, nfc=nfc)).withColumn("detected_lang", language.detect("text", nfc=nfc))


def language_counts(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Segments by language and window of event time; what is later than ``late`` is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "detected_lang").agg(F.count("*").alias("segments"), F.sum(F.size(text.words(text.column("text")))).alias("words"))


def quiet_sessions(events: DataFrame, *, by: str = "file_id", time: str = "ts", gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Segments of a file that follow each other without a silence of ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("segments"))
