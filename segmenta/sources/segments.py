"""Segments: their schema, stored tables of them, and recognisers as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "struct<word:string,start:double,end:double,probability:double>"
SEGMENT = (
    f"file_id string, seq long, start double, end double, text string, language string, language_probability double, avg_logprob double, words array<{WORD}>, "
    "no_speech_prob double, avg_word_confidence double, compression_ratio double, mixed_script_ratio double, repeated_ngram_score double, prompt_safe boolean, "
    "retry_triggered boolean, retry_reason array<string>, original_text string, confidence_delta double"
)
# Defaults of fields that a source may leave out, and file endings of recordings.
DEFAULTS = {"avg_logprob": 0.0, "no_speech_prob": 0.0, "avg_word_confidence": 0.0, "compression_ratio": 0.0, "mixed_script_ratio": 0.0, "repeated_ngram_score": 0.0, "prompt_safe": False, "retry_triggered": False, "confidence_delta": 0.0, "language_probability": 0.0}
ENDINGS = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".opus", ".webm")


def completed(df: DataFrame) -> DataFrame:
    """All fields of a segment, in order; missing ones and nulls get their defaults."""
    from pyspark.sql.types import StructType

    out = []
    for field in StructType.fromDDL(SEGMENT):
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        default = F.lit(DEFAULTS[field.name]) if field.name in DEFAULTS else F.array() if field.name in ("words", "retry_reason") else None
        value = value.cast(field.dataType)
        out.append((value if default is None else F.coalesce(value, default.cast(field.dataType))).alias(field.name))
    return df.select(*out)


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored segments (parquet, json)."""
    return completed(spark.read.format(fmt).load(path) if fmt != "json" else spark.read.schema(SEGMENT).json(path))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).json(path)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions of evaluation files, one JSON object a file."""
    return spark.read.schema("file string, type string, languages array<string>, reference string, noise string").option("multiLine", True).json(f"{folder}/*.json")


def recordings(spark: SparkSession, path: str, *, most_mb: float = 500.0, most_seconds: float = 14400.0, duration: Callable[[bytes], float | None] | None = None) -> DataFrame:
    """Recordings with a verdict: path, length, problem (null: fit), warning, duration.

    Empty and too large files and, if ``duration`` can tell, too long ones are refused; unknown endings only warn.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if duration is None:
        files = files.select("path", "length").withColumn("duration", F.lit(None).cast("double"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"path": b["path"], "length": b["length"], "duration": [duration(x) for x in b["content"]]})

        files = files.select("path", "length", "content").mapInPandas(run, "path string, length long, duration double")
    problem = F.when(F.col("length") < 1000, "empty").when(F.col("length") > most_mb * 1e6, "too large").when(F.col("duration") > most_seconds, "too long")
    known = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*ENDINGS)
    return files.withColumn("problem", problem).withColumn("warning", F.when(~known, "unknown ending"))


def preprocessed(files: DataFrame, clean: Callable[[bytes], bytes] | None) -> DataFrame:
    """Recordings (path, content) with their audio cleaned before recognition by a function of bytes to bytes.

    Adds ``cleaned``: whether it was.  Without a function, and where it fails, the audio stays as it is.
    """
    if clean is None:
        return files.withColumn("cleaned", F.lit(False))
    shape = T.StructType([*files.schema.fields, T.StructField("cleaned", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for content in batch["content"]:
                try:
                    done.append((clean(content), True))
                except (OSError, ValueError):
                    done.append((content, False))
            yield batch.assign(content=[x for x, _ in done], cleaned=[ok for _, ok in done])

    return files.mapInPandas(run, shape)


def recognised(files: DataFrame, recogniser: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Segments from a recogniser over (path, start, end): a function of batches to rows of SEGMENT.

    Times are kept within the chunk: starts at 0 or later, ends at least 0.05 s after.  Texts are stripped.
    """
    raw = files.mapInPandas(recogniser, SEGMENT)
    start = F.greatest(F.col("start"), F.lit(0.0))
    confidence = F.when(F.size("words") > 0, F.aggregate("words", F.lit(0.0), lambda a, w: a + w["probability"]) / F.size("words")).otherwise(0.0)
    return completed(raw.withColumns({"text": F.trim("text"), "avg_word_confidence": confidence}).withColumns({"end": F.greatest(F.col("end"), start + 0.05), "start": start}))
