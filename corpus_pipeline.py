"""A training corpus from ``documents``: toxic texts and near copies go, secrets are masked, sources are mixed, tokens come out.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one a row of digests per text of the
mix.  Between stages the rows are a Parquet table, so a lost executor costs at most a stage.  Every stage takes tables with
nulls in any column, empty and very long texts, repeated rows and further columns of any name; of an empty table it makes
an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from segmenta.llm.bpe import VOCABULARY, round_trip
from segmenta.llm.mixing import mix
from segmenta.llm.near_text import drop_near_copies
from segmenta.llm.secrets import redact_secrets
from segmenta.llm.shared import documents, written
from segmenta.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged like others; equal texts share their fate; a chance of exactly 0.5 rejects.  Where there
    is too little to learn from all stay.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8) stays, that of the smallest id.

    SimHash with multi-index hashing connects what lies within three bits, verified; ``near_text`` tells why that is not
    enough for 0.8 and how the rest is found.  Null, empty and wordless texts are copies of each other; null ids come last;
    of rows that share the smallest id one stays.
    """
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; null and empty texts stay, and so does every row."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often, and as far, as the mix of sources takes them.

    Null, empty and wordless texts go: they have no tokens to mix.  A null source is a source of its own; repeated rows are
    mixed one by one.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256 of each text; a null text counts as empty."""
    return round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the trained classifier, the randomness tests and the tokens; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
