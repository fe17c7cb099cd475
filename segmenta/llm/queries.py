"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_bpe_round_trip
from .language_id import op1_language_id
from .lm import op6_lm_scoring
from .mixing import op3_mix_sources
from .quality import op8_quality_rules
from .records import op5_binary_records
from .secrets import op10_secret_scans
from .simhash import op2_simhash_near_dedup
from .telephony import op4_telephony_media
from .toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_simhash_near_dedup, op3_mix_sources, op4_telephony_media, op5_binary_records, op6_lm_scoring, op7_toxicity, op8_quality_rules, op9_bpe_round_trip, op10_secret_scans]
    return {f.__name__: f for f in found}


#: The rules do not depend on their order, so SQL can express the cascade's verdict.
QUALITY_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, count(*) over (partition by doc_id, g) as n from (select doc_id, unnest(range(1, len(ws) - 1)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) as g from w)),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n >= 2) group by all),
b as (select w.doc_id, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(ls) as n_lines, len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) as upper, len(t) - len(regexp_replace(t, '[a-z]', '', 'g')) as lower,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7f]'))) as lettered, len(list_distinct(ws)) as different from w left join r on r.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed,
  not (failed or not word_chars / greatest(1, n_words)::double between 2 and 15 or n_symbols > 0.1 * n_words or n_dup_lines > 0.6 * n_lines or upper / greatest(1, upper + lower)::double > 0.3
  or lettered / greatest(1, n_words)::double < 0.7 or different / greatest(1, n_words)::double < 0.08) as kept
from (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed from b)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {"op8_quality_rules": QUALITY_SQL}
