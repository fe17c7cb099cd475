"""Reference corpora from JSON, delimited text and CSV."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text

log = logging.getLogger("segmenta")
HITS = "array<struct<collection:string,hadith_number:string,text_ar:string,text_en:string>>"
VERSES = "id int, name string, verses array<struct<id:int,text:string>>"
NARRATIONS = ["id", "hadith_id", "source", "chapter_no", "hadith_no", "chapter", "chain_indx", "text_ar", "text_en"]


def verses_of(chapters: DataFrame, *, nfc: bool = True) -> DataFrame:
    """(idx, surah_id, surah_name, ayah_id, text, canon) of chapters; idx counts verses in order of chapter and place.

    Missing names are ``Surah <id>``, missing texts empty.
    """
    flat = chapters.select(F.col("id").alias("surah_id"), F.coalesce("name", F.concat(F.lit("Surah "), F.col("id").cast("string"))).alias("surah_name"), F.size("verses").alias("_n"), F.posexplode("verses").alias("_pos", "v"))
    # chapters are few: where each starts is a running sum over one row each
    starts = chapters.select(F.col("id").alias("_id"), (F.sum(F.size("verses")).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.size("verses")).alias("_start"))
    body = F.coalesce(F.col("v.text"), F.lit(""))
    return flat.join(starts, flat["surah_id"] == starts["_id"]).select((F.col("_start") + F.col("_pos")).cast("long").alias("idx"), "surah_id", "surah_name", F.col("v.id").alias("ayah_id"), body.alias("text"), text.canonical(body, nfc=nfc).alias("canon"))


def read_verses(spark: SparkSession, path: str, *, nfc: bool = True) -> DataFrame:
    """A JSON array of chapters with verses.  A missing file and a file that is no array fail when read."""
    return verses_of(spark.read.schema(VERSES).option("multiLine", True).option("mode", "FAILFAST").json(path), nfc=nfc)


def chapters_of(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Chapters (id, name, verses) from lines ``chapter|verse|text``; blank lines, ``#`` lines and lines of fewer parts are skipped."""
    value = F.trim("value")
    parts = F.split(value, r"\|", 3)
    kept = lines.where((value != "") & ~value.startswith("#") & (F.size(parts) == 3)).select(parts[0].cast("int").alias("id"), F.struct(parts[1].cast("int").alias("id"), F.trim(parts[2]).alias("text")).alias("v"))
    out = kept.groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("verses"))
    named = out.join(names.select("id", "name"), "id", "left") if names is not None else out.withColumn("name", F.lit(None).cast("string"))
    return named.select("id", F.coalesce("name", F.concat(F.lit("Surah "), F.col("id").cast("string"))).alias("name"), "verses")


def collection_name(raw: Column | str) -> Column:
    """The short name of a collection; unknown ones are lower-cased."""
    lower = F.lower(F.trim(F.col(raw) if isinstance(raw, str) else raw))
    known = F.create_map(*(F.lit(x) for pair in lexicon.COLLECTIONS for x in pair))
    return F.coalesce(F.element_at(known, lower), lower)


def narrations_of(raw: DataFrame, order: str, *, nfc: bool = True) -> DataFrame:
    """The narration table from raw rows (strings): texts under ten characters and ids that are no number go, blank ids are 0,
    and of rows with one collection and number the first by ``order`` stays."""
    body = F.trim(F.coalesce("text_ar", F.lit("")))
    number = F.trim(F.coalesce("hadith_id", F.lit("")))
    rows = raw.where(F.length(body) >= 10).withColumn("hadith_id", F.when(number == "", 0).otherwise(number.try_cast("int")))
    rows = rows.where(F.col("hadith_id").isNotNull())
    rows = rows.withColumns({"collection": collection_name("source"), "text_ar": body, "text_ar_normalized": text.normalise_arabic(body, nfc=nfc)})
    first = F.row_number().over(Window.partitionBy("collection", "hadith_no").orderBy(order))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def read_narrations(spark: SparkSession, path: str, *, nfc: bool = True) -> DataFrame:
    """A CSV file with a header, or a folder of such files in order of name; rows of fewer than nine columns are skipped, further
    columns ignored.

    One file is read by one task, since quoted texts have line ends; so a large corpus should be several files.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(", ".join(f"{n} string" for n in NARRATIONS)).csv(path)
    # files are dealt to tasks by size: the name comes before the place in a task
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    laid = raw.withColumn("_row", place).where(F.col("text_en").isNotNull() | F.col("text_ar").isNotNull())
    return narrations_of(laid, "_row", nfc=nfc).drop("_row")


def numbered(narrations: DataFrame) -> DataFrame:
    """Narrations as ``annotate`` reads them (idx, collection, hadith_number, text_ar, text_en, chapter, canon).

    idx is a hash of collection and number, which name a row of ``narrations_of``, so it is the same whenever it is computed.
    """
    key = F.xxhash64("collection", F.coalesce("hadith_no", F.lit("")))
    return narrations.select(key.alias("idx"), "collection", F.col("hadith_no").alias("hadith_number"), "text_ar", "text_en", "chapter", text.canonical("text_ar").alias("canon"))


def write_narrations(narrations: DataFrame, path: str) -> dict[str, int]:
    """The narration table as Parquet, a folder a collection; returns how many rows each has.  A table that is there is replaced."""
    narrations.write.mode("overwrite").partitionBy("collection").parquet(path)
    return dict(narrations.sparkSession.read.parquet(path).groupBy("collection").count().orderBy("collection").collect())


def stored_narrations(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``write_narrations``."""
    return spark.read.parquet(path)


def checked(df: DataFrame, path_column: str, digest: str) -> DataFrame:
    """Adds ``valid``: whether the ``content`` (as the binaryFile source reads it) has the SHA-256 digest."""
    return df.select(path_column, (F.sha2("content", 256) == digest).alias("valid"))


def remote(ask: Callable[[str], list[dict]], *, spacing: float = 1.0, retries: int = 3, backoff: float = 2.0, tasks: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A search for ``cached`` from a function that asks a remote service one query: (query, hits, fetched_at).

    Requests of a task are ``spacing`` seconds apart; a failed one is asked again up to ``retries`` times, each time after
    ``backoff`` times as long; what still fails has no hits.  ``tasks`` bounds how many ask at once.  ``ask`` returns rows of
    collection, hadith_number, text_ar, text_en, best first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            rows = []
            for query in batch["query"]:
                wait, hits = spacing, []
                for left in range(retries, -1, -1):
                    time.sleep(max(0.0, last + wait - time.monotonic()))
                    last = time.monotonic()
                    try:
                        hits = ask(query)
                        break
                    except OSError:
                        wait *= backoff
                        if not left:
                            log.warning("no answer to %r", query)
                rows.append((query, hits, pd.Timestamp.now("UTC").tz_localize(None)))
            yield pd.DataFrame(rows, columns=["query", "hits", "fetched_at"])

    return lambda asked: asked.select("query").repartition(tasks).mapInPandas(run, f"query string, hits {HITS}, fetched_at timestamp_ntz").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def completeness(verses: DataFrame, chapters: int = 114, total: int = 6236) -> DataFrame:
    """One row: chapters and verses that a corpus has, and ``complete``: whether they are as many as they should be."""
    counts = verses.agg(F.count_distinct("surah_id").alias("chapters"), F.count("*").alias("verses"))
    return counts.withColumn("complete", (F.col("chapters") == chapters) & (F.col("verses") == total))


def cached(queries: DataFrame, cache: DataFrame | None, search: Callable[[DataFrame], DataFrame], *, days: int = 30) -> DataFrame:
    """Answers of a remote search (query, hits, fetched_at): fresh ones from the cache table, the rest by ``search``.

    Each different query of twelve characters or more is asked once.
    """
    asked = queries.where(F.length("query") >= 12).select("query").distinct()
    if cache is None:
        return search(asked)
    fresh = cache.where(F.col("fetched_at") > F.current_timestamp() - F.expr(f"INTERVAL {days} DAYS"))
    held = fresh.join(asked, "query", "left_semi")
    return held.unionByName(search(asked.join(held.select("query"), "query", "left_anti")))
