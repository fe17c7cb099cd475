"""What a recogniser is told about the segments before: prompts by mode, by language, and with trusted context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts, scores, text


def mode_prompt(mode: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in prompts.MODES.items() for x in pair))
    return F.coalesce(F.element_at(known, mode), F.lit(prompts.MODES["bayan"]))


def language_prompt(language: Column) -> Column:
    """The prompt of one language; others get the mixed one."""
    known = F.create_map(*(F.lit(x) for pair in prompts.LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.coalesce(language, F.lit(""))), F.lit(prompts.MODES["bayan"]))


def content_modes(df: DataFrame, order: list[str], *, window: int = 5, by: str = "file_id") -> DataFrame:
    """Adds ``mode``, from the texts of the last ``window`` segments up to each, joined by spaces.

    Each text is searched once; the window joins bits.  A signal of two words may stand across two segments.
    """
    ordered = Window.partitionBy(by).orderBy(*order)
    bits = scores.signal_bits(text.column("text"))
    laid = df.withColumns({"_held": bits["held"], "_ends": bits["ends"], "_starts": bits["starts"]})
    laid = laid.withColumn("_across", F.coalesce(F.lag("_ends").over(ordered).bitwiseAND(F.col("_starts")), F.lit(0)))
    own = F.bit_or("_held").over(ordered.rowsBetween(1 - window, 0))
    held = own.bitwiseOR(F.bit_or("_across").over(ordered.rowsBetween(2 - window, 0))) if window > 1 else own
    return laid.withColumn("mode", scores.mode_of(held)).drop("_held", "_ends", "_starts", "_across")


def contextual_prompts(df: DataFrame, order: list[str], *, history: int = 5, segments: int = 3, most: int = 50, most_compression: float = 1.8, require_prompt_safe: bool = True, by: str = "file_id") -> DataFrame:
    """Adds ``prompt``: that of ``mode``, and the last words of the trusted ones among the segments before.

    Of the ``history`` segments before, the last ``segments`` trusted ones, from the newest on until ``most`` words are there;
    the last ``most`` words; nothing if they repeat themselves.
    """
    c = F.col
    ok = scores.trusted(c("avg_logprob"), c("avg_word_confidence"), c("compression_ratio"), c("mixed_script_ratio"), c("retry_triggered"), c("prompt_safe"), c("text"), most_compression, require_prompt_safe)
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-history, -1)
    recent = F.slice(F.reverse(F.collect_list(F.when(ok, text.words(text.column("text")))).over(w)), 1, segments)
    gathered = F.aggregate(recent, F.array().cast("array<string>"), lambda acc, ws: F.when(F.size(acc) >= most, acc).otherwise(F.concat(ws, acc)))
    last = F.array_join(F.reverse(F.slice(F.reverse(gathered), 1, most)), " ")
    out = df.withColumn("_context", last)
    plain = (c("_context") == "") | text.repetitive("_context")
    base = mode_prompt(c("mode"))
    return out.withColumn("prompt", F.when(plain, base).otherwise(F.concat(base, F.lit(" "), c("_context")))).drop("_context")


def chunk_plan(files: DataFrame, *, chunk: float = 120.0, overlap: float = 2.0, least: float = 180.0) -> DataFrame:
    """(file_id, chunk, start, end) of files (file_id, duration): whole if shorter than ``least``, else chunks that overlap."""
    step = chunk - overlap
    many = F.greatest(F.lit(1), F.ceil((F.col("duration") - overlap) / step))
    n = F.when(F.col("duration") >= least, many).otherwise(1).cast("int")
    laid = files.select("file_id", "duration", n.alias("n")).select("file_id", "duration", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    start = F.col("chunk") * F.lit(step)
    return laid.select("file_id", "chunk", start.alias("start"), F.when(F.col("n") == 1, F.col("duration")).otherwise(F.least(start + chunk, F.col("duration"))).alias("end"))


def accept_retries(segments: DataFrame, retried: DataFrame, *, by: list[str]) -> DataFrame:
    """Replaces text and scores of segments by those of a second decoding where it is more confident.

    ``retried`` has the keys, text, avg_logprob, no_speech_prob, avg_word_confidence.  Adds retry_triggered, original_text and
    confidence_delta.
    """
    names = ["text", "avg_logprob", "no_speech_prob", "avg_word_confidence"]
    new = retried.select(*by, *(F.col(x).alias(f"_new_{x}") for x in names))
    out = segments.join(new, by, "left")
    gain = scores.confidence(F.col("_new_avg_logprob"), F.col("_new_no_speech_prob")) - scores.confidence(F.col("avg_logprob"), F.col("no_speech_prob"))
    out = out.withColumn("_gain", gain)
    better = F.coalesce(F.col("_gain") > 0, F.lit(False))
    changed = {x: F.when(F.col("_better"), F.col(f"_new_{x}")).otherwise(F.col(x)) for x in names}
    out = out.withColumn("_better", better).withColumns({"retry_triggered": F.col("_new_text").isNotNull(), "original_text": F.when(F.col("_better"), F.col("text")), "confidence_delta": F.when(F.col("_better"), F.round("_gain", 4)).otherwise(0.0)})
    return out.withColumns(changed).drop("_gain", "_better", *(f"_new_{x}" for x in names))


def accept_second_pass(segments: DataFrame, second: DataFrame, *, by: list[str]) -> DataFrame:
    """The second pass over Arabic segments: a text of three characters replaces the first, and scores are averaged."""
    new = second.select(*by, F.col("text").alias("_t"), F.col("avg_logprob").alias("_l"), F.col("avg_word_confidence").alias("_c"))
    out = segments.join(new, by, "left")
    ok = F.coalesce(F.length(F.trim("_t")) >= 3, F.lit(False))
    mean = lambda a, b: F.when(ok, (F.col(a) + F.col(b)) / 2).otherwise(F.col(a))
    return out.withColumns({"avg_logprob": mean("avg_logprob", "_l"), "avg_word_confidence": mean("avg_word_confidence", "_c"), "text": F.when(ok, F.trim("_t")).otherwise(F.col("text"))}).drop("_t", "_l", "_c")
