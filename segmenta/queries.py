"""Queries of the segment operators over the test tables, and their SQL.

Segments come from ``conversations``: each turn is cut into pieces of 1 to 6 words, so that all its text is used.  The tables
have no Arabic letters; ``arabic`` maps the Latin ones to them, which reaches the rules for both scripts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import language, lexicon, plain, prompts, scores, similarity, text
from .operators import cleaning, context, folds, metrics, retrieval, verification
from .operators.stored import fresh_folder
from .plans.annotate import annotate, routed
from .plans.config import settings
from .sinks import transcripts
from .sources import corpora
from .sources.segments import completed, read_jsonl

LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC = "أبةدیفگہئجکلمنوىقرستؤحعخيز"
c = F.col
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def keep(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the whole table is small: a file of one row group is one task otherwise.

    A table beyond some megabytes a core has row groups enough and is left as it is, so nothing large is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if stated_size(df) <= cores * (64 << 20) else df


def stated_size(df: DataFrame) -> int:
    """Bytes of a table by its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def texts(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on."""
    return spread(table(spark, d, name))


def arabic(column: Column | str) -> Column:
    return F.translate(F.lower(column), LATIN, ARABIC)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_arabic(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{ARABIC}')"


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def sql_normal(x: str, nfc: bool = False) -> str:
    x = f"nfc_normalize({x})" if nfc else x
    marks, signs = text.MARKS, text.PUNCTUATION.replace("'", "''")
    return sql_collapse(f"regexp_replace(translate(regexp_replace({x}, '[{marks}]', '', 'g'), '{text.VARIANTS}', '{text.PLAIN}'), '[{signs}]', ' ', 'g')")


def sql_canon(x: str, nfc: bool = False) -> str:
    return sql_normal(f"translate({x}, '{text.CROSS}', '{text.CROSS_PLAIN}')", nfc)


def decomposed(x: Column) -> Column:
    """Text of even documents with letters and marks that composition joins: e and o get one."""
    return F.when(c("doc_id") % 2 == 0, F.replace(F.replace(x, F.lit("e"), F.lit("e\u0301")), F.lit("o"), F.lit("ا\u0653"))).otherwise(x)


def sql_decomposed(x: str) -> str:
    return f"case when doc_id % 2 = 0 then replace(replace({x}, 'e', 'e' || chr(769)), 'o', 'ا' || chr(1619)) else {x} end"


def sql_words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[\s\p{{Z}}]+'), lambda w: w <> '')"


def sql_list(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def lines(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    """Sentences of all texts: the table's columns, pos, line."""
    df = texts(spark, d, name)
    return df.select(*[x for x in df.columns if x != "text"], F.posexplode(F.split("text", r"[.\n]+")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line != ''")


def sql_lines(name: str = "documents") -> str:
    return rf"(select * from (select * exclude (text), unnest(parts) as raw, generate_subscripts(parts, 1) - 1 as pos, trim(unnest(parts)) as line from (select *, string_split_regex(text, '[.\n]+') as parts from {name})) where line <> '')"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of conversations as segments."""
    words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != "")
    df = texts(spark, d, "conversations").withColumns({"ws": words, "k": (1 + (c("conv_id") + c("turn")) % 6).cast("int")}).where(F.size("ws") > 0)
    df = df.withColumn("pos", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ws") / c("k")).cast("int") - 1)))
    start = c("turn") * 1000.0 + c("pos") * 2.0
    return df.select(
        c("conv_id").alias("file_id"), (c("turn") * 1000 + c("pos")).alias("seq"), start.alias("start"), (start + 0.3 * c("k")).alias("end"),
        F.array_join(F.slice("ws", c("pos") * c("k") + 1, c("k")), " ").alias("text"), F.when(c("turn") % 5 < 4, "ur").otherwise("en").alias("language"),
        (-((c("conv_id") * 7 + c("turn") * 3 + c("pos")) % 20) / 10.0).alias("avg_logprob"), ((c("conv_id") + c("pos")) % 10 / 10.0).alias("avg_word_confidence"),
        (c("pos") % 5 / 10.0).alias("no_speech_prob"), (c("turn") % 4 * 0.7).alias("compression_ratio"), (c("pos") % 7 / 10.0).alias("repeated_ngram_score"), (c("pos") % 3 / 10.0).alias("mixed_script_ratio"), "turn", "pos",
    )


SEGMENTS = r"""(select conv_id as file_id, turn * 1000 + pos as seq, turn * 1000.0::double + pos * 2.0::double as start, (turn * 1000.0::double + pos * 2.0::double) + 0.3::double * k as "end",
  array_to_string(list_slice(ws, pos * k + 1, pos * k + k), ' ') as text, case when turn % 5 < 4 then 'ur' else 'en' end as language,
  -((conv_id * 7 + turn * 3 + pos) % 20) / 10.0::double as avg_logprob, (conv_id + pos) % 10 / 10.0::double as avg_word_confidence, pos % 5 / 10.0::double as no_speech_prob,
  turn % 4 * 0.7::double as compression_ratio, pos % 7 / 10.0::double as repeated_ngram_score, pos % 3 / 10.0::double as mixed_script_ratio, turn, pos
  from (select *, unnest(range(0, (len(ws) + k - 1) // k)) as pos from (select conv_id, turn, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda w: w <> '') as ws, 1 + (conv_id + turn) % 6 as k from conversations)))"""


# texts


@query(f"select doc_id, {sql_canon(sql_arabic('text'))} as canon, {sql_canon(sql_decomposed('text'), True)} as composed from documents")
def canon_text(spark, d):
    return texts(spark, d).select("doc_id", text.canonical(arabic("text"), nfc=False).alias("canon"), text.canonical(decomposed(c("text"))).alias("composed"))


@query(f"select doc_id, {sql_normal(sql_decomposed('text'), True)} as normal from documents")
def normalise_text(spark, d):
    return texts(spark, d).select("doc_id", text.normalise_arabic(decomposed(c("text"))).alias("normal"))


_CLASS = f"[{text.ARABIC_NARROW}]"
_ARABIC_SQL = sql_arabic("text")


@query(
    f"""select doc_id, regexp_matches(a, '[{text.ARABIC}]') as has_arabic, total > 0 and (block - urdu) > 0.6 * total and urdu < 0.2 * greatest(block, 1) as mainly_arabic
    from (select *, block + len(regexp_replace(regexp_replace(a, '{_CLASS}', '', 'g'), '[^\\p{{L}}]', '', 'g')) as total from (select doc_id, a, len(a) - len(regexp_replace(a, '{_CLASS}', '', 'g')) as block,
    len(a) - len(regexp_replace(a, '[{text.URDU_ONLY}]', '', 'g')) as urdu from (select doc_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then {_ARABIC_SQL} else translate({_ARABIC_SQL}, '{text.CROSS}گ', '{text.CROSS_PLAIN}ع') end as a from documents)))"""
)
def script_stats(spark, d):
    a = F.when(c("doc_id") % 3 == 0, c("text")).when(c("doc_id") % 3 == 1, arabic("text")).otherwise(F.translate(arabic("text"), text.CROSS + "گ", text.CROSS_PLAIN + "ع"))
    return texts(spark, d).select("doc_id", text.has_arabic(a).alias("has_arabic"), text.mainly_arabic(a).alias("mainly_arabic"))


def _mapped(x: str) -> str:
    return f"translate({sql_arabic(x)}, '{text.CROSS}گ', '{text.CROSS_PLAIN}ع')"


def mapped(x: str) -> Column:
    to = str.maketrans(text.CROSS + "گ", text.CROSS_PLAIN + "ع")
    return F.translate(F.lower(x), LATIN + text.CROSS + "گ", (ARABIC + text.CROSS_PLAIN + "ع").translate(to))


_URDU = f"(regexp_matches(a, '[{text.URDU_SIGNS}]') or len(list_intersect(string_split({sql_normal('a', True)}, ' '), {sql_list(lexicon.URDU_WORDS)})) >= 2)"


@query(
    f"""select doc_id, pos, case when regexp_matches(a, '[{text.ARABIC}]') then case when {_URDU} then 'ur' else 'ar' end when regexp_matches(a, '[A-Za-z]') then 'en' else 'und' end as lang
    from (select doc_id, pos, case when pos % 2 = 0 then line else {_mapped('line')} || case when pos % 5 = 1 then ' مسجد نماز' when pos % 5 = 3 then ' نماز' else '' end end as a from {sql_lines()})"""
)
def lang_script(spark, d):
    extra = F.when(c("pos") % 5 == 1, " مسجد نماز").when(c("pos") % 5 == 3, " نماز").otherwise("")
    a = F.when(c("pos") % 2 == 0, c("line")).otherwise(F.concat(mapped("line"), extra))
    # a column of its own is computed once, an expression wherever the rules name it
    return lines(spark, d).select("doc_id", c("pos").cast("long").alias("pos"), a.alias("a")).select("doc_id", "pos", language.detect("a").alias("lang"))


@query(f"select doc_id, {_URDU} as urdu from (select doc_id, {_mapped('text')} || case when doc_id % 2 = 0 then ' مسجد، نماز' else ' مسجد مسجد' end as a from documents)")
def urdu_vocab(spark, d):
    a = F.concat(mapped("text"), F.when(c("doc_id") % 2 == 0, " مسجد، نماز").otherwise(" مسجد مسجد"))
    return texts(spark, d).select("doc_id", a.alias("a")).select("doc_id", language.likely_urdu("a").alias("urdu"))


@query(f"select doc_id, replace(lower({sql_collapse('text')}), 'ß', 'ss') as same from documents")
def dedup_key(spark, d):
    return texts(spark, d).select("doc_id", text.same_key("text").alias("same"))


@query(rf"select doc_id, regexp_replace(regexp_replace(regexp_replace(translate({_ARABIC_SQL}, '{text.TO_URDU}', '{text.URDU}'), '[{text.INVISIBLE}]', '', 'g'), '[\s\p{{Z}}]{{2,}}', ' ', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as urdu from documents")
def urdu_normalise(spark, d):
    return texts(spark, d).select("doc_id", text.normalise_urdu(arabic("text")).alias("urdu"))


_ROMAN = "line || ' ' || " + quoted("Sahih Bukhari, pbuh; xpbuh Insha Allah")
_ROMAN_SQL = _ROMAN
for _p, _r in lexicon.ROMAN_PHRASES:
    _ROMAN_SQL = f"regexp_replace({_ROMAN_SQL}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){_p}($|[^\\p{{L}}\\p{{N}}_])', '\\1{_r}\\2', 'g')"


@query(f"select item_id, pos, {_ROMAN_SQL} as urdu from {sql_lines('benchmark')}")
def roman_urdu(spark, d):
    a = F.concat("line", F.lit(" Sahih Bukhari, pbuh; xpbuh Insha Allah"))
    return lines(spark, d, "benchmark").select("item_id", c("pos").cast("long").alias("pos"), text.roman_to_urdu(a).alias("urdu"))


_S = "(value * 37.25::double)"


@query(
    f"""select event_id, printf('%02d:%02d:%02d', floor(floor(s) / 3600)::bigint, floor(floor(s) % 3600 / 60)::bigint, (floor(s) % 60)::bigint) as hms,
    printf('%02d:%02d:%02d,%03d', floor(floor(s) / 3600)::bigint, floor(floor(s) % 3600 / 60)::bigint, (floor(s) % 60)::bigint, floor((s - floor(s)) * 1000)::bigint) as hms_millis from (select event_id, {_S} as s from events)"""
)
def timestamps(spark, d):
    s = c("value") * 37.25
    return table(spark, d, "events").select("event_id", text.timestamp(s).alias("hms"), text.timestamp(s, millis=True, comma=True).alias("hms_millis"))


_GRAMS = "list_transform(range(1, greatest(len(text) - 1, 1)), lambda i: substr(text, i, 3))"


@query(f"select conv_id, turn, len(g)::bigint as n, len(list_distinct(g))::bigint as n_distinct from (select conv_id, turn, {_GRAMS} as g from conversations)")
def trigram_counts(spark, d):
    g = text.trigrams("text")
    return texts(spark, d, "conversations").select("conv_id", "turn", F.size(g).cast("long").alias("n"), F.size(F.array_distinct(g)).cast("long").alias("n_distinct"))


@query(
    f"""select item_id, pos, len(w)::bigint as n, w[1] as first from (select item_id, pos, list_filter(flatten(list_transform(range(least(12, len(ws)), 4, -1), lambda n: list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(list_slice(ws, i, i + n - 1), ' ')))), lambda x: len(x) >= 20) as w
    from (select item_id, pos, {sql_words('line')} as ws from {sql_lines('benchmark')}))"""
)
def word_windows(spark, d):
    w = text.word_windows("line")
    return lines(spark, d, "benchmark").select("item_id", c("pos").cast("long").alias("pos"), F.size(w).cast("long").alias("n"), F.get(w, F.lit(0)).alias("first"))


@query(f"select doc_id, len(list_filter({sql_words(_mapped('text'))}, lambda w: len(w) >= 3 and not list_contains({sql_list(lexicon.GENERIC_NARRATION_WORDS)}, w)))::bigint as n from documents")
def distinctive_tokens(spark, d):
    return texts(spark, d).select("doc_id", text.distinctive_words(mapped("text")).cast("long").alias("n"))


@query(
    f"""select doc_id, coalesce(n, 0) >= 6 and coalesce(most, 0) > 3 as repetitive from documents left join (select doc_id, max(m) as most, sum(m) + 1 as n from (select doc_id, p, count(*) as m
    from (select doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as p from (select doc_id, {sql_words('text')} as ws from documents)) group by all) group by all) using (doc_id)"""
)
def repetition_flag(spark, d):
    return texts(spark, d).select("doc_id", text.repetitive("text").alias("repetitive"))


@query("select doc_id, substr(text, 1, 60) as preview from documents")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", text.preview("text").alias("preview"))


@query("select case lang when 'en' then 'en' else 'und' end as code, count(*) as n from documents group by all")
def language_codes(spark, d):
    return table(spark, d, "documents").groupBy(text.language_code("lang").alias("code")).agg(F.count("*").alias("n"))


_LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنو"
_WORD_SQL, _PLAIN_WORD = r"[\p{L}\p{N}_]", f"regexp_matches(w, '[{text.ARABIC_NARROW}]') and not regexp_matches(w, '[{text.URDU_ONLY}]')"
_SIGNS = f"len(regexp_extract_all(r, '(^|[^\\p{{L}}\\p{{N}}_])ال[\\p{{L}}\\p{{N}}_]{{2,}}')) + len(list_intersect(string_split(r, ' '), {sql_list(lexicon.ARABIC_STOPWORDS)}))"


@query(
    f"""select item_id, pos, len(spans)::bigint as n, array_to_string(spans, ' | ') as spans from (select item_id, pos, list_filter(runs, lambda r: contains(r, ' ') and (regexp_matches(r, '[ً-ٰٟؤئأإةى]') or len(string_split(r, ' ')) >= 5 or {_SIGNS} >= case when len(string_split(r, ' ')) >= 3 then 1 else 2 end)) as spans
    from (select item_id, pos, list_transform(string_split(array_to_string(list_transform({sql_words('mixed')}, lambda w: case when {_PLAIN_WORD} then w else chr(1) end), ' '), chr(1)), lambda r: trim(r)) as runs
    from (select item_id, pos, array_to_string(list_transform(string_split(line, ' '), lambda w, i: case when (i - 1) % 7 < 4 then translate(lower(w), '{LATIN}', '{_LETTERS}') else w end), ' ') as mixed from {sql_lines('benchmark')})))"""
)
def arabic_spans(spark, d):
    mixed = F.array_join(F.transform(F.split("line", " "), lambda w, i: F.when(i % 7 < 4, F.translate(F.lower(w), LATIN, _LETTERS)).otherwise(w)), " ")
    spans = text.arabic_spans(mixed)
    return lines(spark, d, "benchmark").select("item_id", c("pos").cast("long").alias("pos"), F.size(spans).cast("long").alias("n"), F.array_join(spans, " | ").alias("spans"))


def _sql_rule(x: str, pattern: str, to: str) -> str:
    """A rule of correction for an engine without look-around: what stands beside it is matched and put back."""
    edge, blank = r"[^\p{L}\p{N}_]", text.BLANK
    start, stop = pattern.startswith(r"\b"), pattern.endswith((r"\b", f"(?!{text.WORD})"))
    body = pattern.removeprefix(r"\b").removesuffix(r"\b").removesuffix(f"(?!{text.WORD})")
    body = body if blank in body else body.replace(r"\s", blank)
    ahead = f"(?={blank}|$)"
    own = body.count("(") - body.count("(?")
    after = f"\\{own + start + 1}" if stop or body.endswith(ahead) else ""
    to = ("\\1" if start else "") + to.replace("$1", "\\1") + after
    body = (f"(^|{edge})" if start else "") + (body.removesuffix(ahead) + f"({blank}|$)" if body.endswith(ahead) else body) + (f"($|{edge})" if stop else "")
    return f"regexp_replace({x}, {quoted(body)}, {quoted(to)}, 'g')"


_FIXED = "t"
for _p, _r in (*lexicon.EXPANSIONS, *lexicon.TERMS, *text.ENGLISH, *text.REPAIRS, text.TRIM, (" {2,}", " "), text.TRIM):
    _FIXED = _sql_rule(_FIXED, _p, _r)
_DAMAGE = " PBUH SAW insha allah اللah انشاءالله قران ab"


@query(f"select item_id, pos, {_FIXED} as fixed from (select item_id, pos, line || {quoted(_DAMAGE)} as t from {sql_lines('benchmark')})")
def post_process(spark, d):
    damaged = F.concat("line", F.lit(_DAMAGE))
    return lines(spark, d, "benchmark").select("item_id", c("pos").cast("long").alias("pos"), text.correct(damaged).alias("fixed"))


# filters


@query(f"select doc_id, count(*) as kept from {sql_lines()} where {sql_normal('line', True)} not in (select unnest({sql_list(plain.spurious())})) group by all")
def blocklist_filter(spark, d):
    return cleaning.drop_phrases(lines(spark, d), "line").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(
    rf"""select doc_id, count(*) as kept from (select doc_id, {sql_collapse('line')} as t from {sql_lines()}) where not (t = '' or (len(string_split(t, ' ')) >= 8 and len(list_distinct(string_split(t, ' '))) = 1 and not regexp_matches(t, 'الله|سبحان|الحمد|استغفر|اكبر'))
    or regexp_matches(t, '^[\.…,،]+$') or regexp_matches(t, '^[♪♫🎵🎶]+$') or regexp_matches(t, 'https?://|www\.|\.com|\.org')) group by all"""
)
def pattern_filter(spark, d):
    return cleaning.drop_patterns(lines(spark, d), "line").groupBy("doc_id").agg(F.count("*").alias("kept"))


# scores


@query(
    f"""select file_id, seq, round(0.35 * least(1, greatest(0, (avg_logprob + 1.5) / 1.5)) + 0.45 * avg_word_confidence + 0.2 * (1 - no_speech_prob), 4) as quality,
    round(0.25 * (1 - no_speech_prob) + 0.5 * greatest(0, 1 + avg_logprob) + 0.25 * case when compression_ratio > 0 then least(1, greatest(0, 2 - compression_ratio)) else 1 end, 4) as confidence from {SEGMENTS}"""
)
def quality_scores(spark, d):
    return segments(spark, d).select("file_id", "seq", scores.quality(c("avg_logprob"), c("avg_word_confidence"), c("no_speech_prob")).alias("quality"), scores.confidence(c("avg_logprob"), c("no_speech_prob"), c("compression_ratio")).alias("confidence"))


@query(
    f"""select file_id, seq, array_to_string(list_filter([case when avg_logprob < -0.9 then 'low_logprob' end, case when compression_ratio > 1.8 then 'high_compression' end, case when repeated_ngram_score > 0.35 then 'repeated_ngrams' end,
    case when mixed_script_ratio > 0.15 then 'mixed_script' end], lambda x: x is not null), ',') as reasons from {SEGMENTS}"""
)
def retry_reasons(spark, d):
    found = scores.retry_reasons(c("avg_logprob"), c("compression_ratio"), c("repeated_ngram_score"), c("mixed_script_ratio"))
    return segments(spark, d).select("file_id", "seq", F.array_join(found, ",").alias("reasons"))


@query(f"select file_id, seq, case when avg_word_confidence >= 0.55 and avg_word_confidence < 0.75 then 0.82::double else 0.88::double end as threshold from {SEGMENTS}")
def adaptive_threshold(spark, d):
    return segments(spark, d).select("file_id", "seq", scores.fuzzy_threshold(c("avg_word_confidence")).alias("threshold"))


@query("select l_orderkey, l_linenumber, case when l_discount * 10 >= 0.9 then false when abs(l_quantity - l_linenumber * 8) / greatest(l_quantity, l_linenumber * 8) > 0.3 then true else l_tax * 1000 - l_linenumber * 5 > 15 end as is_paraphrase from lineitem")
def paraphrase_flag(spark, d):
    flag = scores.paraphrase(c("l_discount") * 10, c("l_quantity"), c("l_linenumber") * 8, c("l_tax") * 1000, c("l_linenumber") * 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("is_paraphrase"))


_MODES = {m: " + ".join(f"(case when contains(t, {quoted(s)}) then 1 else 0 end)" for s in signals) for m, signals in scores.SIGNALS.items()}


@query(
    f"""select file_id, seq, case when best >= 2 then case when q = best then 'quran' when h = best then 'hadith' else 'naat' end else 'bayan' end as mode from (select *, greatest(q, h, n) as best from (select file_id, seq, {_MODES['quran']} as q, {_MODES['hadith']} as h, {_MODES['naat']} as n
    from (select file_id, seq, lower(string_agg(t, ' ') over (partition by file_id order by seq rows between 4 preceding and current row)) as t from (select file_id, seq, text || case seq % 4 when 0 then ' سورة' when 1 then ' بخاری حدیث' when 2 then ' نعت درود مدینہ' else ' قرآن' end as t from {SEGMENTS}))))"""
)
def content_mode(spark, d):
    extra = F.element_at(F.array(*map(F.lit, (" سورة", " بخاری حدیث", " نعت درود مدینہ", " قرآن"))), (c("seq") % 4 + 1).cast("int"))
    return context.content_modes(segments(spark, d).withColumn("text", F.concat("text", extra)), ["seq"]).select("file_id", "seq", "mode")


def _sql_edged(pattern: str) -> str:
    """A marker's pattern for an engine without look-around: what stands beside it is matched too."""
    start = r"(^|[^\p{L}\p{N}_])" if pattern.startswith(r"\b") else ""
    stop = r"($|[^\p{L}\p{N}_])" if pattern.endswith(r"\b") else ""
    return start + pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\s", r"[\s\p{Z}]") + stop


_MARKED = ", ".join(f"case when regexp_matches(t, {quoted(_sql_edged(p))}) then '{k}' end" for k, p in lexicon.NARRATION_MARKERS)
_EXTRA = ["", " عن أبي هريرة قال رسول الله", " حدثنا وسمعت", " صحیح بخاری نبی کریم", " سمعت عن زيد رضي الله عنه صلى الله عليه وسلم", " حضرت عائشہ سنن ترمذی"]


@query(f"select file_id, seq, array_to_string(list_sort(list_distinct(list_filter([{_MARKED}], lambda x: x is not null))), ',') as categories from (select file_id, seq, text || {sql_list(_EXTRA)}[1 + seq % 6] as t from {SEGMENTS})")
def narration_markers(spark, d):
    extra = F.element_at(F.array(*map(F.lit, _EXTRA)), (c("seq") % 6 + 1).cast("int"))
    found = scores.marker_categories(scores.markers(F.concat("text", extra)))
    return segments(spark, d).select("file_id", "seq", F.array_join(F.array_sort(found), ",").alias("categories"))


_SOME_ARABIC = f"case seq % 3 when 0 then text when 1 then {sql_arabic('text')} else {_mapped('text')} end"
_BLOCK, _OWN = f"(len(a) - len(regexp_replace(a, '{_CLASS}', '', 'g')))", f"(len(a) - len(regexp_replace(a, '[{text.URDU_ONLY}]', '', 'g')))"
_MAINLY = f"coalesce({_BLOCK} + len(regexp_replace(regexp_replace(a, '{_CLASS}', '', 'g'), '[^\\p{{L}}]', '', 'g')) > 0 and {_BLOCK} - {_OWN} > 0.6 * ({_BLOCK} + len(regexp_replace(regexp_replace(a, '{_CLASS}', '', 'g'), '[^\\p{{L}}]', '', 'g'))) and {_OWN} < 0.2 * greatest({_BLOCK}, 1), false)"


def some_arabic(spark: SparkSession, d: str) -> DataFrame:
    """Segments, a third of them in Arabic letters and a third in Urdu ones, with a detected language."""
    a = F.when(c("seq") % 3 == 0, c("text")).when(c("seq") % 3 == 1, arabic("text")).otherwise(mapped("text"))
    return segments(spark, d).withColumns({"text": a, "detected_lang": F.element_at(F.array(*map(F.lit, ("ur", "ar", "en", "und"))), (c("seq") % 4 + 1).cast("int"))})


@query(
    f"""select route, low_confidence, count(*) as n, round(sum(quality), 4) as quality from (select case when l = 'ar' or l <> 'en' and {_MAINLY} then 'arabic' when l = 'ur' and regexp_matches(a, '[{text.ARABIC}]') then 'urdu' else 'none' end as route,
    seq % 2 = 0 and avg_word_confidence < 0.35 as low_confidence, round(0.35 * least(1, greatest(0, (avg_logprob + 1.5) / 1.5)) + 0.45 * avg_word_confidence + 0.2 * (1 - no_speech_prob), 4) as quality
    from (select *, {_SOME_ARABIC} as a, ['ur', 'ar', 'en', 'und'][1 + seq % 4] as l from {SEGMENTS})) group by all"""
)
def route_segments(spark, d):
    words = F.when(c("seq") % 2 == 0, F.array(F.struct(F.lit(0.5).alias("probability")))).otherwise(F.array().cast("array<struct<probability:double>>"))
    found = routed(some_arabic(spark, d).withColumn("words", words), settings())
    return found.groupBy("route", "low_confidence").agg(F.count("*").alias("n"), F.round(F.sum("quality"), 4).alias("quality"))


@query(
    f"""select file_id, seq, seq % 2 = 0 and avg_word_confidence < 0.35 as low, coalesce(round(0.25 * (1 - no_speech_prob) + 0.5 * greatest(0, 1 + avg_logprob / 4) + 0.25, 4) >= 0.85 and avg_logprob / 4 >= -0.45 and language = before, false) as follows,
    avg_logprob / 4 > -0.45 and avg_word_confidence > 0.8 and compression_ratio < 1.8 and mixed_script_ratio < 0.05 and not seq % 5 = 0 and not seq % 7 = 0 and len({sql_words('text')}) >= 3 as trusted, l = 'ar' or {_MAINLY} as redraft
    from (select *, {_SOME_ARABIC} as a, ['ur', 'ar', 'en', 'und'][1 + seq % 4] as l, lag(language) over (partition by file_id order by seq) as before from {SEGMENTS})"""
)
def segment_gates(spark, d):
    logprob, before = c("avg_logprob") / 4, F.lag("language").over(Window.partitionBy("file_id").orderBy("seq"))
    df = some_arabic(spark, d).withColumn("before", before)
    words = F.when(c("seq") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    follows = scores.condition_on_previous(scores.confidence(logprob, c("no_speech_prob")), logprob, c("language"), c("before"))
    trusted = scores.trusted(logprob, c("avg_word_confidence"), c("compression_ratio"), c("mixed_script_ratio"), c("seq") % 5 == 0, c("seq") % 7 != 0, c("text"))
    return df.select("file_id", "seq", scores.low_word_confidence(words, c("avg_word_confidence")).alias("low"), F.coalesce(follows, F.lit(False)).alias("follows"), trusted.alias("trusted"), scores.arabic_redraft(c("detected_lang"), c("text")).alias("redraft"))


@query("select l_orderkey, l_linenumber, case when b = 0 then 0 else round(least(1, greatest(0, l_quantity * 2.2137 / 100 * (0.7 + 0.3 * (least(a, b) / greatest(a, b)::double)))), 4) end as confidence from (select *, l_linenumber * 10 as a, l_orderkey % 7 * 10 as b from lineitem)")
def calibrated_scores(spark, d):
    found = scores.calibrated(c("l_quantity") * 2.2137, c("l_linenumber") * 10, c("l_orderkey") % 7 * 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", found.alias("confidence"))


_GUESSED = f"""case when trim(a) = '' then 'und' when label <> 'und' and len({sql_words('a')}) >= 3 then case when label = 'ar' and {_URDU} then 'ur' else label end
  when sure >= 0.85 then case when guess in ('ar', 'ur') then case when {_URDU} then 'ur' else 'ar' end else guess end
  when regexp_matches(a, '[{text.ARABIC}]') then case when {_URDU} then 'ur' else 'ar' end when regexp_matches(a, '[A-Za-z]') then 'en' else coalesce(guess, 'und') end"""


@query(f"select file_id, seq, {_GUESSED} as lang from (select file_id, seq, {_SOME_ARABIC} as a, case seq % 5 when 0 then 'ar' when 1 then 'ur' when 2 then 'en' else 'und' end as label, ['fr', 'ar', 'ur', 'de'][1 + (seq // 2) % 4] as guess, seq % 10 / 10.0::double as sure from {SEGMENTS})")
def detected_languages(spark, d):
    trusted = F.when(c("seq") % 5 == 0, "Arabic").when(c("seq") % 5 == 1, "urdu").when(c("seq") % 5 == 2, "EN").otherwise("xx")
    guess = F.element_at(F.array(*map(F.lit, ("fr", "ar", "ur", "de"))), (F.expr("seq div 2") % 4 + 1).cast("int"))
    return some_arabic(spark, d).select("file_id", "seq", language.detect("text", trusted=trusted, guess=guess, sure=c("seq") % 10 / 10.0).alias("lang"))


@query(
    f"""select file_id, seq, case when ok then trim(t) else text end as text, case when ok then (avg_logprob + avg_logprob / 2) / 2 else avg_logprob end as avg_logprob, case when ok then (avg_word_confidence + 0.9) / 2 else avg_word_confidence end as avg_word_confidence
    from (select *, coalesce(seq % 3 = 0 and len(trim(t)) >= 3, false) as ok from (select *, '  ' || substr(text, 1, (seq % 8)::int) || ' ' as t from {SEGMENTS}))"""
)
def second_pass(spark, d):
    own = segments(spark, d)
    again = own.where(c("seq") % 3 == 0).select("file_id", "seq", F.concat(F.lit("  "), F.substring("text", F.lit(1), (c("seq") % 8).cast("int")), F.lit(" ")).alias("text"), (c("avg_logprob") / 2).alias("avg_logprob"), F.lit(0.9).alias("avg_word_confidence"))
    return context.accept_second_pass(own, again, by=["file_id", "seq"]).select("file_id", "seq", "text", "avg_logprob", "avg_word_confidence")


@query(f"select file_id, seq, case when seq % 4 <> 0 then round(avg_word_confidence * 0.9, 4) end as confidence, case when seq % 4 <> 0 then false end as is_exact, case when seq % 4 <> 0 then text end as matched_text from {SEGMENTS}")
def downgraded_match(spark, d):
    verse = F.when(c("seq") % 4 != 0, F.struct(c("avg_word_confidence").alias("confidence"), F.lit(True).alias("is_exact"), F.lit("before").alias("matched_text")))
    return segments(spark, d).select("file_id", "seq", scores.corrected(verse, c("text")).alias("m")).select("file_id", "seq", "m.*")


_GATE = """case when k = 2 then 'structural_mismatch' when asr >= 0.45 then 'asr_confidence_high' when ret < 0.85 then 'low_retrieval_similarity' when overlap < 0.6 then 'low_token_overlap' when n < 1 then 'no_narration_markers'
  when k = 3 then 'span_exceeds_limit' when greatest(a, b) > 0 and abs(a - b) / greatest(a, b) > 0.3 then 'length_delta_high' when k = 1 and sure > 0.45 then 'divergent_token_high_confidence' else '' end"""
_DIVERGED = "array<struct<asr_token:string,retrieval_token:string,position:int,asr_word_confidence:double,is_divergent:boolean,similarity:double>>"


@query(f"select reason, count(*) as n from (select {_GATE} as reason from (select (l_orderkey + l_linenumber) % 5 as k, l_tax * 10 as sure, l_discount * 6 as asr, 1 - l_tax * 2 as ret, 1 - l_discount * 5 as overlap, l_linenumber - 1 as n, l_quantity as a, l_quantity + l_linenumber * 2 as b from lineitem)) group by all")
def safety_gates(spark, d):
    k, sure = (c("l_orderkey") + c("l_linenumber")) % 5, (c("l_tax") * 10).cast("double")
    one = lambda source, confidence, apart: F.struct(F.lit("heard").alias("asr_token"), F.lit(source).alias("retrieval_token"), F.lit(0).alias("position"), confidence.alias("asr_word_confidence"), F.lit(apart).alias("is_divergent"), F.lit(0.5).alias("similarity"))
    low = F.lit(0.1)
    found = F.when(k == 1, F.array(one("said", sure, True))).when(k == 2, F.array(one("two words", low, True))).when(k == 3, F.array_repeat(one("said", low, True), 3)).when(k == 4, F.array(one("heard", sure, False))).otherwise(F.array().cast(_DIVERGED))
    gate = scores.suggestion_gate(c("l_discount") * 6, 1 - c("l_tax") * 2, 1 - c("l_discount") * 5, (c("l_linenumber") - 1).cast("int"), found.cast(_DIVERGED), c("l_quantity"), c("l_quantity") + c("l_linenumber") * 2)
    return table(spark, d, "lineitem").select(F.substring_index(F.coalesce(gate, F.lit("")), " ", 1).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# folds


@query(
    """with recursive e as (select user_id, event_type, event_id, epoch(ts)::double as start, value % 5 as dur, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
    f as (select user_id, event_type, event_id, n, start as last, true as kept from e where n = 1 union all
    select e.user_id, e.event_type, e.event_id, e.n, case when e.start - f.last < 7200 and e.dur < 3 then f.last else e.start end, not (e.start - f.last < 7200 and e.dur < 3) from f join e on e.user_id = f.user_id and e.event_type = f.event_type and e.n = f.n + 1)
    select user_id, event_type, count(*) as kept from f where kept group by all"""
)
def dedup_window(spark, d):
    start = F.unix_micros(c("ts").cast("timestamp")) / 1e6
    events = table(spark, d, "events").select(c("user_id").alias("file_id"), c("event_id").alias("seq"), start.alias("start"), (start + c("value") % 5).alias("end"), c("event_type").alias("text"), (c("value") % 5).alias("dur"))
    events = events.withColumns({"start": c("start"), "end": F.when(c("dur") < 3, c("start")).otherwise(c("start") + 10)})
    return folds.drop_repeats(events, window=7200.0, nfc=False).groupBy(c("file_id").alias("user_id"), c("text").alias("event_type")).agg(F.count("*").alias("kept"))


def _sql_merge(joins: str, source: str) -> str:
    return f"""with recursive s as (select *, len({sql_words('text')}) as nw, regexp_matches(text, '[{text.ARABIC}]') as ar, row_number() over (partition by file_id order by start, seq) as n from {source}),
    f as (select file_id, n, seq, seq as g, start as cs, "end" as ce, language as cl, nw as cw, ar as ca, avg_logprob as cp from s where n = 1 union all
    select file_id, n, seq, case when j then g else seq end, case when j then cs else start end, "end", case when j then cl else language end, case when j then cw + nw else nw end, case when j then ca or ar else ar end, case when j then (cp + avg_logprob) / 2 else avg_logprob end
    from (select s.*, f.g, f.cs, f.cl, f.cw, f.ca, f.cp, ({joins}) as j from f join s on s.file_id = f.file_id and s.n = f.n + 1))
    select f.file_id, f.g as seq, max(s."end") as "end", string_agg(s.text, ' ' order by s.n) as text, arg_max(f.cp, s.n) as avg_logprob, max(s.no_speech_prob) as no_speech_prob from f join s on s.file_id = f.file_id and s.n = f.n group by all"""


_SHORT = """f.cl = s.language and s."end" - f.cs < 30 and s.start - f.ce >= 0 and (((f.cw < 4 or s.nw < 4) and s.start - f.ce < 1.5) or ((f.cw < 2 or s.nw < 2) and s.start - f.ce < 0.7 and abs(f.cp - s.avg_logprob) < 0.5))"""


@query(_sql_merge(_SHORT, SEGMENTS))
def merge_short(spark, d):
    return folds.merge_short(segments(spark, d)).select("file_id", "seq", "end", "text", "avg_logprob", "no_speech_prob")


_QUOTES = """f.cl = 'ur' and s.language = 'ur' and f.ca and s.ar and s.start - f.ce >= 0 and s.start - f.ce < 2 and s."end" - f.cs < 45"""
_HALF = f"(select * replace (case when seq % 4 = 3 then text else {sql_arabic('text')} end as text) from {SEGMENTS})"


@query(_sql_merge(_QUOTES, _HALF))
def merge_quotes(spark, d):
    half = segments(spark, d).withColumn("text", F.when(c("seq") % 4 == 3, c("text")).otherwise(arabic("text")))
    return folds.merge_quotes(half).select("file_id", "seq", "end", "text", "avg_logprob", "no_speech_prob")


_DOUBLED = f"""(select file_id, seq, start, e, t, ws, list_transform(ws, lambda w: {sql_normal('w')}) as norm, row_number() over (partition by file_id order by start, seq) as n from (select file_id, seq, start, "end" + 2 as e, t, {sql_words('t')} as ws
  from (select *, case when seq % 2 = 0 then text else concat_ws(' ', lag(text) over (partition by file_id order by seq), text) end as t from {SEGMENTS})))"""
_CUT = "case when s.start < f.e and f.e - s.start <= 2.5 then coalesce(list_max(list_filter(range(1, least(15, len(f.rest), len(s.norm)) + 1), lambda k: list_slice(f.rest, len(f.rest) - k + 1, len(f.rest)) = list_slice(s.norm, 1, k))), 0) else 0 end"


@query(
    f"""with recursive s as materialized (select * from {_DOUBLED}), f as (select file_id, n, seq, t, ws, e, norm as rest, 0::bigint as cut from s where n = 1 union all
    select file_id, n, seq, t, ws, e, list_slice(norm, cut + 1, len(norm)), cut from (select s.file_id, s.n, s.seq, s.t, s.ws, s.e, s.norm, ({_CUT})::bigint as cut from f join s on s.file_id = f.file_id and s.n = f.n + 1))
    select file_id, seq, text, removed_words from (select file_id, seq, case when cut > 0 then array_to_string(list_slice(ws, cut + 1, len(ws)), ' ') else t end as text, cut::int as removed_words, sum(cut) over (partition by file_id) as total from f) where total = 0 or trim(text) <> ''"""
)
def overlap_trim(spark, d):
    w = Window.partitionBy("file_id").orderBy("seq")
    doubled = segments(spark, d).withColumn("text", F.when(c("seq") % 2 == 0, c("text")).otherwise(F.concat_ws(" ", F.lag("text").over(w), "text"))).withColumn("end", c("end") + 2.0)
    return folds.trim_overlaps(doubled).select("file_id", "seq", "text", "removed_words")


_LANGS = "['fa', 'ur', 'en', 'nl', 'und', 'id'][1 + (seq * 7 + file_id) % 6]"


@query(
    f"""select file_id, seq, last_value(settled ignore nulls) over (partition by file_id order by seq rows unbounded preceding) as lang from (select file_id, seq, case when nw < 4 and lang not in ('ar', 'en') and n > 1 then
    case when regexp_matches(text, '[{text.URDU_ONLY}]') then 'ur' when len(regexp_replace(text, '[^A-Za-z]', '', 'g')) / len(text)::double > 0.7 then 'en' when lang in ('fa', 'af', 'no', 'nl', 'id') then null else lang end else lang end as settled
    from (select file_id, seq, lang, n, text, len({sql_words('text')}) as nw from (select file_id, seq, {_LANGS} as lang, row_number() over (partition by file_id order by seq) as n, case when seq % 3 = 0 then regexp_replace(text, '[a-z]', '1', 'g') when seq % 11 = 1 then {sql_arabic('text')} else text end as text from {SEGMENTS})))"""
)
def lang_inherit(spark, d):
    langs = F.array(*map(F.lit, ("fa", "ur", "en", "nl", "und", "id")))
    df = segments(spark, d).withColumn("lang", F.element_at(langs, ((c("seq") * 7 + c("file_id")) % 6 + 1).cast("int")))
    df = df.withColumn("text", F.when(c("seq") % 3 == 0, F.regexp_replace("text", "[a-z]", "1")).when(c("seq") % 11 == 1, arabic("text")).otherwise(c("text")))
    return language.inherit(df, ["seq"]).select("file_id", "seq", "lang")


@query(f"select language, count(*) filter (avg_word_confidence > 0.75 and language in ('ar', 'ur', 'en')) as locked, count(*) as n from {SEGMENTS} group by all")
def language_lock(spark, d):
    lock = language.lock(c("language"), c("avg_word_confidence"), 0.75)["locked"]
    return segments(spark, d).groupBy("language").agg(F.count_if(lock).alias("locked"), F.count("*").alias("n"))


@query("select user_id, count(*) filter (event_type <> before) as drift_events from (select user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) group by all")
def drift_events(spark, d):
    df = table(spark, d, "events").select(c("user_id"), "ts", "event_id", c("event_type").alias("detected_lang"), c("value").alias("confidence"), c("value").alias("avg_logprob"), F.lit(0).alias("overlap_removed_words"), *(F.lit(False).alias(x) for x in ("language_locked", "quran_match", "hadith_match", "was_corrected", "is_flagged")))
    return metrics.summary(df, ["ts", "event_id"], by="user_id").select("user_id", c("language_drift_events").alias("drift_events"))


_EV = "(select user_id as file_id, event_id as seq, ts, ['ur', 'fa', 'en', 'nl', 'und', 'ar'][1 + event_id % 6] as detected_lang, value from events)"


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    langs = F.array(*map(F.lit, ("ur", "fa", "en", "nl", "und", "ar")))
    return table(spark, d, "events").select(c("user_id").alias("file_id"), c("event_id").alias("seq"), "ts", F.element_at(langs, (c("event_id") % 6 + 1).cast("int")).alias("detected_lang"), "value", "event_type", "props")


@query(f"select file_id, count(*) filter (before in ('ur', 'ar', 'en') and detected_lang not in ('ur', 'ar', 'en', 'und')) as drift_events from (select *, lag(detected_lang) over (partition by file_id order by ts, seq) as before from {_EV}) group by all")
def arabic_drift(spark, d):
    return metrics.drift(evaluated(spark, d), ["ts", "seq"])


_NAAT = quoted(prompts.MODES["naat"])
_TRUSTED = f"avg_logprob / 4 > -0.45 and compression_ratio / 2 < 1.8 and len({sql_words('text')}) >= 3"


@query(
    f"""select file_id, seq, case when x = '' or len(ws) >= 6 and coalesce(list_max(list_transform(ps, lambda p: len(list_filter(ps, lambda q: q = p)))), 0) > 3 then {_NAAT} else {_NAAT} || ' ' || x end as prompt from (select *, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) as ps
    from (select *, {sql_words('x')} as ws from (select file_id, seq, coalesce(array_to_string(list_slice(l, greatest(len(l) - 2, 1), len(l)), ' '), '') as x from (select file_id, seq, list_filter(list(case when {_TRUSTED} then text end) over (partition by file_id order by seq rows between 5 preceding and 1 preceding), lambda t: t is not null) as l from {SEGMENTS}))))"""
)
def context_prompts(spark, d):
    df = segments(spark, d).withColumns({"mode": F.lit("naat"), "retry_triggered": F.lit(False), "prompt_safe": F.lit(True), "avg_logprob": c("avg_logprob") / 4, "compression_ratio": c("compression_ratio") / 2, "mixed_script_ratio": F.lit(0.0), "avg_word_confidence": F.lit(0.9)})
    return context.contextual_prompts(df, ["seq"]).select("file_id", "seq", "prompt")


_PROMPT = "case l " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in prompts.LANGUAGES.items()) + f" else {quoted(prompts.MODES['bayan'])} end"


@query(f"select l as lang, {_PROMPT} as prompt, count(*) as n from (select case lang when 'de' then 'ar' when 'es' then 'ur' else lang end as l from documents) group by all")
def language_prompts(spark, d):
    lang = F.when(c("lang") == "de", "ar").when(c("lang") == "es", "ur").otherwise(c("lang"))
    return table(spark, d, "documents").groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).withColumn("prompt", context.language_prompt(c("lang")))


_MODE_PROMPT = "case m " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in prompts.MODES.items()) + f" else {quoted(prompts.MODES['bayan'])} end"


@query(f"select m as mode, {_MODE_PROMPT} as prompt, count(*) as n from (select ['quran', 'hadith', 'naat', 'bayan', 'other'][1 + event_id % 5] as m from events) group by all")
def mode_prompts(spark, d):
    mode = F.element_at(F.array(*map(F.lit, ("quran", "hadith", "naat", "bayan", "other"))), (c("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").groupBy(mode.alias("mode")).agg(F.count("*").alias("n")).withColumn("prompt", context.mode_prompt(c("mode")))


# retrieval


def verses(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of ``benchmark`` as a corpus of verses."""
    return lines(spark, d, "benchmark").select((c("item_id") * 1000 + c("pos")).alias("idx"), c("item_id").cast("int").alias("surah_id"), F.concat(F.lit("item "), c("item_id").cast("string")).alias("surah_name"), c("pos").cast("int").alias("ayah_id"), c("line").alias("text"), text.canonical("line", nfc=False).alias("canon"))


_VERSES = f"(select item_id * 1000 + pos as idx, item_id, {sql_canon('line')} as canon from {sql_lines('benchmark')})"


@query(
    f"""select lang, item_id, count(*) as hits, count(*) filter (n > 1) as ambiguous from (select doc_id, lang, {sql_canon('line')} as query from {sql_lines()}) q join (select canon, min(idx) as idx, arg_min(item_id, idx) as item_id, count(*) as n from {_VERSES} group by canon) v on q.query = v.canon where len(query) >= 12 group by all"""
)
def exact_match(spark, d):
    asked = lines(spark, d).select(F.struct("doc_id", "pos").alias("qid"), "lang", text.canonical("line", nfc=False).alias("query"))
    found = retrieval.exact(asked, verses(spark, d))
    return found.groupBy("lang", F.expr("idx div 1000").alias("item_id")).agg(F.count("*").alias("hits"), F.count_if("is_ambiguous").alias("ambiguous"))


_FORMULAS = "case " + " ".join(f"when contains(q, {quoted(k)}) then {quoted(v)}" for k, v in plain.formulas().items()) + " end"
_SOME = ["سبحان الله", "الحمد لله رب العالمين", "رضي الله عنها", "اللهم صل على محمد", "لا شيء", "بارك الله فيك و ان شاء الله", "صلی اللہ علیہ وسلم"]


@query(f"select label, count(*) as n from (select {_FORMULAS} as label from (select {sql_canon('line || chr(32) || ' + sql_list(_SOME) + '[1 + (doc_id + pos) % 7]')} as q from {sql_lines()})) group by all")
def formula_match(spark, d):
    some = F.element_at(F.array(*map(F.lit, _SOME)), ((c("doc_id") + c("pos")) % 7 + 1).cast("int"))
    asked = lines(spark, d).select(text.canonical(F.concat_ws(" ", "line", some), nfc=False).alias("query"))
    return asked.select(retrieval.formula("query").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def _sql_grams(x: str) -> str:
    return f"list_transform(range(1, greatest(len({x}) - 1, 1)), lambda i: substr({x}, i, 3))"


@query(f"select gram, count(*) as n, min(idx) as first from (select distinct idx, unnest({_sql_grams('canon')}) as gram from {_VERSES}) group by all")
def trigram_index(spark, d):
    return retrieval.gram_index(verses(spark, d)).groupBy("gram").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(c("item_id").alias("idx"), text.canonical("text", nfc=False).alias("canon"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "conversations").select((c("conv_id") * 1000 + c("turn")).alias("qid"), text.canonical("text", nfc=False).alias("query"))


_ITEMS = f"(select item_id as idx, {sql_canon('text')} as canon from benchmark)"
_TURNS = f"(select conv_id * 1000 + turn as qid, {sql_canon('text')} as query from conversations)"
_TOPK = f"""(select *, row_number() over (partition by qid order by shared desc, first, idx) as rank from (select qid, idx, sum(n) as shared, min(p) as first from
  (select qid, gram, count(*) as n, min(p) as p from (select qid, unnest({_sql_grams('query')}) as gram, unnest(range(0, greatest(len(query) - 2, 0))) as p from {_TURNS}) group by all) q
  join (select distinct idx, unnest({_sql_grams('canon')}) as gram from {_ITEMS}) v using (gram) group by all))"""


@query(f"select qid, idx, shared::bigint as shared, rank from {_TOPK} where rank <= 10")
def trigram_topk(spark, d):
    return retrieval.gram_candidates(turns(spark, d), retrieval.gram_index(items(spark, d)), n=10).withColumn("rank", c("rank").cast("long"))


@query(
    f"""select qid, idx, place as rank from (select *, row_number() over (partition by qid order by overlap desc, rank) as place from (select qid, idx, rank, len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b)))::double as overlap
    from (select k.qid, k.idx, k.rank, {_sql_grams('t.query')} as a, {_sql_grams('v.canon')} as b from (select * from {_TOPK} where rank <= 10) k join {_TURNS} t using (qid) join {_ITEMS} v on v.idx = k.idx))) where place <= 5"""
)
def jaccard_rerank(spark, d):
    asked, corpus = turns(spark, d), items(spark, d)
    near = retrieval.gram_candidates(asked, retrieval.gram_index(corpus), n=10, overlap=True)
    return retrieval.rerank(near, n=5, above=0).select("qid", "idx", c("rank").cast("long").alias("rank"))


_TERMS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


@query(
    f"""with t as (select idx, {_TERMS.format('canon')} as ts from {_ITEMS}), p as (select idx, len(ts) as dl, term, count(*) as tf from (select idx, ts, unnest(ts) as term from t) group by all),
    s as (select count(*)::double as total, avg(len(ts)) as mean from t), df as (select term, count(*) as df from p group by all),
    w as (select qid, unnest(list_slice(list_transform(list_sort(list_transform({sql_words('query')}, lambda x, i: {{'l': -len(x), 'i': i, 'w': x}})), lambda z: z.w), 1, 6)) as word from {_TURNS}),
    q as (select qid, term, count(*) as times from (select qid, unnest({_TERMS.format('word')}) as term from w where len(word) >= 3) group by all)
    select qid, idx, score, rank from (select *, row_number() over (partition by qid order by score desc, idx) as rank from (select qid, p.idx, round(sum(times * greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)))), 9) as score
    from q join df using (term) join p using (term), s group by all)) where rank <= 20"""
)
def bm25_topk(spark, d):
    return retrieval.bm25(turns(spark, d).withColumn("terms", retrieval.longest_words("query")), items(spark, d)).select("qid", "idx", "score", c("rank").cast("long").alias("rank"))


def damaged(spark: SparkSession, d: str) -> DataFrame:
    """Verses with every seventh word missing, and all pieces of conversations: what fuzzy search should and should not find."""
    kept = F.array_join(F.filter(F.split("canon", " "), lambda w, i: i % 7 != 5), " ")
    own = verses(spark, d).select(F.struct(F.lit("verse").alias("kind"), c("idx").alias("n")).alias("qid"), kept.alias("query"))
    pieces = segments(spark, d).select(F.struct(F.lit("piece").alias("kind"), (c("file_id") * 1_000_000 + c("seq")).alias("n")).alias("qid"), text.canonical("text", nfc=False).alias("query"))
    return own.union(pieces).withColumns({"word_confidence": F.lit(0.6), "allow_fuzzy": F.lit(True)})


@query()
def fuzzy_match(spark, d):
    return retrieval.fuzzy(damaged(spark, d), verses(spark, d)).select("qid.kind", "qid.n", "idx", "confidence", "is_ambiguous", "close")


@query()
def window_fuzzy(spark, d):
    own = damaged(spark, d).withColumn("query", F.concat_ws(" ", F.lit("some words before it"), "query"))
    return retrieval.window_fuzzy(own, verses(spark, d)).select("qid.kind", "qid.n", "matched_window", "idx", "confidence", "is_ambiguous", "close")


@query()
def verse_match(spark, d):
    return retrieval.match_verses(damaged(spark, d), verses(spark, d)).select("qid.kind", "qid.n", c("kind").alias("found_by"), "label", "idx", "confidence", "is_exact", "is_ambiguous")


@query()
def narration_match(spark, d):
    asked = damaged(spark, d).select("qid", "query")
    return retrieval.match_narrations(asked, items(spark, d)).select("qid.kind", "qid.n", "idx", "confidence", "is_paraphrase")


@query()
def remote_match(spark, d):
    asked = damaged(spark, d).select("qid", "query")
    return retrieval.match_remote(asked, items(spark, d)).select("qid.kind", "qid.n", "idx", "confidence")


@query(f"select conv_id, turn, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double as jaccard from (select conv_id, turn, list_distinct({sql_words('text')}) as a, list_distinct({sql_words('before')}) as b from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations) where before is not null)")
def token_jaccard(spark, d):
    return paired(spark, d).select("conv_id", "turn", similarity.scored("jaccard")("text", "before")["jaccard"].alias("jaccard"))


def paired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")


@query()
def similarity_measures(spark, d):
    pieces = segments(spark, d).withColumn("before", F.lag("text").over(Window.partitionBy("file_id").orderBy("seq"))).where("before IS NOT NULL")
    m = similarity.scored("ratio", "partial", "token_sort", "token_set", "jaccard")("text", "before")
    return pieces.select("file_id", "seq", m.alias("m")).select("file_id", "seq", "m.*")


@query("select conv_id, turn, levenshtein(a, b) / len(a)::double as cer from (select conv_id, turn, regexp_replace(before, '[^ -~]', '?', 'g') as a, regexp_replace(text, '[^ -~]', '?', 'g') as b from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations) where before is not null)")
def cer_metric(spark, d):
    a, b = (F.regexp_replace(x, "[^ -~]", "?") for x in ("before", "text"))
    return paired(spark, d).select("conv_id", "turn", similarity.char_error_rate(a, b).alias("cer"))


_PAIRS = f"(select *, {sql_words('before')} as r, {sql_words('text')} as h from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations) where before is not null)"
#: Rows of edit distances, one word of the reference after the other; the least over all shorter prefixes stands for insertions.
_ROWS = f"""f as (select conv_id, turn, r, h, 0 as i, range(0, len(h) + 1) as d from {_PAIRS} union all
  select conv_id, turn, r, h, i + 1, list_transform(range(0, len(h) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: case when k = 0 then i + 1 else least(d[k + 1] + 1, d[k] + case when r[i + 1] = h[k] then 0 else 1 end) - k end)))
  from f where i < len(r))"""


@query(f"with recursive {_ROWS} select conv_id, turn, round(d[len(h) + 1] / len(r)::double, 6) as wer from f where i = len(r)")
def wer_metric(spark, d):
    rates = metrics.error_rates(spread(paired(spark, d).select("conv_id", "turn", c("before").alias("reference"), c("text").alias("hypothesis"))))
    return rates.select("conv_id", "turn", F.round("wer", 6).alias("wer"))


@query()
def verify_narrations(spark, d):
    kept = F.array_join(F.transform(F.split("canon", " "), lambda w, i: F.when(i % 9 == 5, F.concat(w, F.lit("x"))).otherwise(w)), " ")
    rows = verses(spark, d).select("idx", F.concat(F.lit("حدثنا "), kept).alias("asr_text"), F.concat(F.lit("حدثنا "), "canon").alias("retrieval_text"), (c("idx") % 10 / 10.0).alias("asr_word_confidence"), F.array_repeat(F.lit(0.3), 5).alias("word_confidences"))
    return verification.verify(rows, nfc=False).select("idx", "token_overlap", "retrieval_confidence", "narration_marker_count", "divergent_token_count", "low_confidence_word_count", "suggested_patch", "suggestion_safe", "rejection_reason", "correction_type", "applied")


# metrics


@query("select source as collection, count(*) as n from documents group by all")
def collection_counts(spark, d):
    return metrics.collection_counts(table(spark, d, "documents"), "source")


@query(
    f"""select file_id, count(*) as total_segments, case when count(*) >= 4 then list_sort(list(value))[1 + count(*) // 4] else list_sort(list(value))[1] end as confidence_p25, list_sort(list(value))[1 + count(*) // 2] as confidence_p50,
    case when count(*) >= 4 then list_sort(list(value))[1 + 3 * count(*) // 4] else list_sort(list(value))[count(*)] end as confidence_p75, list_sort(list(-value))[1 + count(*) // 2] as avg_logprob_p50,
    count(*) filter (before <> detected_lang) as language_drift_events, count(*) filter (seq % 3 = 0) as n_quran_match, count(*) filter (seq % 5 = 0) as n_is_flagged, sum(seq % 2)::bigint as overlap_dedup_total_words
    from (select *, lag(detected_lang) over (partition by file_id order by ts, seq) as before from {_EV}) group by file_id"""
)
def diag_summary(spark, d):
    df = evaluated(spark, d).withColumns({"confidence": c("value"), "avg_logprob": -c("value"), "language_locked": F.lit(False), "quran_match": c("seq") % 3 == 0, "hadith_match": F.lit(False), "was_corrected": F.lit(False), "is_flagged": c("seq") % 5 == 0, "overlap_removed_words": c("seq") % 2})
    names = ["total_segments", "confidence_p25", "confidence_p50", "confidence_p75", "avg_logprob_p50", "language_drift_events", "n_quran_match", "n_is_flagged", "overlap_dedup_total_words"]
    return metrics.summary(df, ["ts", "seq"]).select("file_id", *names)


_MIXED = f"case when seq % 4 = 0 then text || 'اب' else text end"
_EDGE = f"[{text.LATIN}][{text.ARABIC}]|[{text.ARABIC}][{text.LATIN}]"


@query(f"select file_id, sum(len(list_filter(ws, lambda w: regexp_matches(w, '{_EDGE}')))) / greatest(sum(len(ws)), 1)::double as mixed_script_ratio from (select file_id, {sql_words(_MIXED)} as ws from {SEGMENTS}) group by all")
def mixed_script_ratio(spark, d):
    df = segments(spark, d).withColumn("t", F.when(c("seq") % 4 == 0, F.concat("text", F.lit("اب"))).otherwise(c("text")))
    return metrics.mixed_script_ratio(df, "t")


def diagnosed(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).withColumns({"segment_id": c("seq"), "text_preview": text.preview("text"), "original_text_preview": text.preview("text"), "detected_lang": c("language"), "is_flagged": c("seq") % 17 == 0, "retry_triggered": c("seq") % 19 == 0, "retry_reason": F.array(F.lit("x")), "confidence_delta": F.lit(0.0), "quran_match": c("seq") % 3 == 0, "hadith_match": c("seq") % 4 == 0})


@query(f"select file_id, seq as segment_id, substr(text, 1, 60) as selected, case when seq % 19 = 0 then substr(text, 1, 60) else '' end as retry, seq % 19 = 0 as retry_triggered from {SEGMENTS} where mixed_script_ratio > 0.1 or avg_logprob < -1 or seq % 17 = 0 or seq % 19 = 0 or repeated_ngram_score > 0.4")
def worst_segments(spark, d):
    return metrics.worst(diagnosed(spark, d)).select("file_id", "segment_id", "selected", "retry", "retry_triggered")


@query(f"select file_id, count(*) as total_segments, count(*) filter (seq % 17 = 0) / count(*)::double as flagged_rate, count(*) filter (seq % 3 = 0) as quran_matches, count(*) filter (seq % 4 = 0) as hadith_matches, count(*) filter (seq % 19 = 0) / count(*)::double as retry_trigger_rate, 0::bigint as drift_events, 0::double as mixed_script_ratio from {SEGMENTS} group by all")
def eval_summary(spark, d):
    return metrics.evaluation(diagnosed(spark, d), ["seq"])


def told(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (a turn each), their hypotheses (that turn) and references (the turn before; of some files there is none)."""
    rows = paired(spark, d).withColumn("file_id", c("conv_id") * 1000 + c("turn"))
    ascii_ = lambda x: F.regexp_replace(x, "[^ -~]", "?")
    return rows.select("file_id", F.lit("lecture").alias("type")), rows.select("file_id", ascii_("text").alias("text")), rows.where("file_id % 5 != 0").select("file_id", ascii_("before").alias("text"))


def told_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return diagnosed(spark, d).withColumn("file_id", c("file_id") * 1000 + c("turn")).where("file_id % 7 != 0")


_TOLD = f"""with recursive {_ROWS.replace("conv_id, turn, text, lag", "conv_id, turn, regexp_replace(text, '[^ -~]', '?', 'g') as text, lag").replace("lag(text)", "lag(regexp_replace(text, '[^ -~]', '?', 'g'))").replace('select conv_id, turn, r, h, 0 as i', 'select conv_id, turn, text, before, r, h, 0 as i').replace('select conv_id, turn, r, h, i + 1', 'select conv_id, turn, text, before, r, h, i + 1')},
  w as (select conv_id * 1000 + turn as file_id, case when file_id % 5 = 0 then 0 else d[len(h) + 1] / len(r)::double end as wer, case when file_id % 5 = 0 then 0 else levenshtein(before, text) / len(before)::double end as cer from f where i = len(r)),
  g as (select file_id * 1000 + turn as file_id, count(*) as total_segments, count(*) filter (seq % 17 = 0) / count(*)::double as flagged_rate, count(*) filter (seq % 3 = 0) as quran_matches, count(*) filter (seq % 19 = 0) / count(*)::double as retry_trigger_rate from {SEGMENTS} where (file_id * 1000 + turn) % 7 <> 0 group by all),
  e as (select w.file_id, wer, cer, coalesce(total_segments, 0) as total_segments, coalesce(flagged_rate, 0) as flagged_rate, coalesce(quran_matches, 0) as quran_matches, coalesce(retry_trigger_rate, 0) as retry_trigger_rate from w left join g on g.file_id = w.file_id)"""


@query(f"{_TOLD} select file_id, round(wer, 6) as wer, round(cer, 6) as cer, total_segments, flagged_rate, quran_matches, retry_trigger_rate from e")
def evaluated_files(spark, d):
    files, heard, known = told(spark, d)
    found = metrics.evaluated_files(files, heard, known, told_diagnostics(spark, d), ["seq"])
    return found.select("file_id", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"), "total_segments", "flagged_rate", "quran_matches", "retry_trigger_rate")


@query(f"{_TOLD} select count(*) as total_files, round(avg(wer), 6) as avg_wer, round(avg(cer), 6) as avg_cer, round(avg(flagged_rate), 6) as avg_flag_rate, 0::bigint as total_arabic_drift_events, 0::double as avg_mixed_script_ratio, sum(quran_matches)::bigint as total_quran_matches_detected, round(avg(retry_trigger_rate), 6) as avg_retry_trigger_rate from e")
def eval_over_files(spark, d):
    files, heard, known = told(spark, d)
    out = metrics.evaluation_summary(metrics.evaluated_files(files, heard, known, told_diagnostics(spark, d), ["seq"]))
    return out.select(*(F.round(x, 6).alias(x) if t == "double" else c(x) for x, t in out.dtypes))


@query(
    f"""select o_orderkey as file_id, coalesce(n, 0) as total_segments, o_orderkey % 50 + 1.5::double as runtime_seconds, round(o_totalprice / 1000 / 1000, 2) as retry_time_seconds, round(coalesce(retries, 0) / (case when d > 0 then d else 1 end / 3600), 2) as retries_per_hour_audio, case when coalesce(n, 0) > 0 then round(o_totalprice / 1000 / n, 3) else 0 end as avg_decode_time_per_segment
    from (select *, case when o_orderkey % 5 = 0 then null else o_totalprice / 100 end as d from orders) left join (select l_orderkey, count(*) as n, count(*) filter (l_linenumber % 2 = 0) as retries from lineitem where l_orderkey % 3 <> 0 group by all) on l_orderkey = o_orderkey"""
)
def run_metadata(spark, d):
    own = table(spark, d, "lineitem").where("l_orderkey % 3 != 0").select(c("l_orderkey").alias("file_id"), (c("l_linenumber") % 2 == 0).alias("retry_triggered"))
    price = c("o_totalprice").cast("double")
    files = table(spark, d, "orders").select(c("o_orderkey").alias("file_id"), F.when(c("o_orderkey") % 5 != 0, price / 100).alias("duration"), price.alias("transcription_ms"), (price / 1000).alias("retry_decode_ms"), (c("o_orderkey") % 50 + 1.5).alias("elapsed_seconds"))
    return metrics.run_metadata(own, files)


@query(f"select file_id, count(*) as total_segments, count(*) filter (seq % 3 = 0) as arabic_segments, count(*) filter (seq % 7 = 0) as formula_hits, count(*) filter (avg_logprob < -1.5) as low_quality_segments from {SEGMENTS} group by all")
def run_counters(spark, d):
    df = segments(spark, d).withColumns({"route": F.when(c("seq") % 3 == 0, "arabic").otherwise("none"), "kind": F.when(c("seq") % 7 == 0, "formula"), "hadith_hit": F.lit(False), "is_paraphrase": F.lit(False), "is_flagged": F.lit(False), "was_corrected": F.lit(False), "quality": F.when(c("avg_logprob") < -1.5, 0.1).otherwise(0.9)})
    return metrics.run_counters(df).select("file_id", "total_segments", "arabic_segments", "formula_hits", "low_quality_segments")


@query(f"""select file_id, count(*) as segments, arg_max("end", seq) as duration, count(*) filter (language = 'ur') as ur from {SEGMENTS} group by all""")
def header_stats(spark, d):
    df = metrics.header(segments(spark, d).withColumn("detected_lang", c("language")))
    ur = F.coalesce(F.get(F.filter("languages", lambda x: x["code"] == "UR"), F.lit(0))["n"], F.lit(0))
    return df.select("file_id", "segments", "duration", ur.alias("ur"))


# sources, sinks and plans


_SPAN = "a span of more words than sixty letters can show, which is cut"
_VERSE_SQL = "seq % 7 = 1"
_REFS_SQL = "2:1, 2:2, 2:3, 2:4, 2:5, 2:6, 2:7, 2:8, …+2 more"
_QURAN_SQL = f"""case when seq % 14 = 1 then 'Quran [ambiguous — 10 ayahs] (93%) possible: {_REFS_SQL}' else 'Quran 2:' || (seq % 6 + 1) || ' — Al-Baqarah' || case when seq % 3 = 0 then ' ✓exact' else '' end || ' (93%)' end || case when seq % 2 = 0 then '' else ' [span: "{_SPAN[:60]}…"]' end"""


def enriched(spark: SparkSession, d: str) -> DataFrame:
    none = {"formula_match": transcripts.FORMULA, "quran_match": transcripts.VERSE, "hadith_match": transcripts.NARRATION}
    df = segments(spark, d).withColumns({k: F.lit(None).cast(t) for k, t in none.items()} | {"detected_lang": c("language"), "is_flagged": c("seq") % 9 == 0, "flag_reason": F.lit("No Quran or Hadith match found"), "was_corrected": F.lit(False), "raw_text": c("text"), "words": F.array(F.struct(F.lit("w").alias("word"), F.lit(0.0).alias("start"), F.lit(0.1).alias("end"), F.lit(0.94).alias("probability")))})
    df = df.withColumn("formula_match", F.when(c("seq") % 5 == 0, F.struct(F.lit("Takbir").alias("label"), F.lit("x").alias("matched_text"), F.lit(1.0).alias("confidence"))).cast(transcripts.FORMULA))
    refs = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct(F.lit(2).alias("surah_id"), F.lit("x").alias("surah_name"), i.alias("ayah_id")))
    verse = F.struct(
        F.lit(2).alias("surah_id"), F.lit("Al-Baqarah").alias("surah_name"), (c("seq") % 6 + 1).cast("int").alias("ayah_id"), F.lit("o").alias("original_text"), F.when(c("seq") % 2 == 0, c("text")).otherwise(F.lit(_SPAN)).alias("matched_text"), F.lit(0.93).alias("confidence"),
        (c("seq") % 3 == 0).alias("is_exact"), (c("seq") % 14 == 1).alias("is_ambiguous"), F.lit(10).alias("ambiguous_count"), F.when(c("seq") % 14 == 1, refs).alias("alternate_refs"),
    )
    narration = F.struct(*(F.lit(x).alias(k) for k, x in (("collection", "bukhari"), ("hadith_number", "7"), ("arabic_text", "a"), ("english_text", "e"), ("matched_text", "m"), ("confidence", 0.91))), (c("seq") % 2 == 0).alias("is_paraphrase"), F.lit("").alias("chapter"))
    df = df.withColumns({"quran_match": F.when(c("seq") % 7 == 1, verse).cast(transcripts.VERSE), "hadith_match": F.when(c("seq") % 7 == 2, narration).cast(transcripts.NARRATION)})
    return df.withColumns({"hadith_retrieval_confidence": F.lit(0.0), "hadith_correction_type": F.lit(""), "hadith_correction_detail": F.lit(""), "hadith_suggestion_safe": F.lit(False), "language_locked": F.lit(False), "lock_reason": F.lit(""), "prompt_mode": F.lit("bayan"), "retry_triggered": F.lit(False), "retry_reason": F.array().cast("array<string>"), "confidence_delta": F.lit(0.0)})


def _sql_time(x: str, millis: bool = True) -> str:
    parts = f"floor(floor({x}) / 3600)::bigint, floor(floor({x}) % 3600 / 60)::bigint, (floor({x}) % 60)::bigint"
    return f"printf('%02d:%02d:%02d,%03d', {parts}, floor(({x} - floor({x})) * 1000)::bigint)" if millis else f"printf('%02d:%02d:%02d', {parts})"


@query(
    f"""select file_id, string_agg(n || chr(10) || {_sql_time('start')} || ' --> ' || {_sql_time('"end"')} || chr(10) || '[' || upper(language) || '] ' || text || case when {_VERSE_SQL} then chr(10) || '[QURAN 2:' || (seq % 6 + 1) || ']' when seq % 7 = 2 then chr(10) || '[HADITH bukhari #7]' when seq % 5 = 0 then chr(10) || '[FORMULA Takbir]' else '' end || chr(10), chr(10) order by n) as content
    from (select *, row_number() over (partition by file_id order by start, seq) as n from {SEGMENTS}) group by all"""
)
def srt_lines(spark, d):
    return transcripts.srt(enriched(spark, d))


@query(
    f"""select file_id, '{transcripts.RULE}' || chr(10) || ' ISLAMIC LECTURE TRANSCRIPT' || chr(10) || ' Duration: ' || {_sql_time('arg_max("end", seq)', False)} || '  |  Segments: ' || count(*) || chr(10) || ' Languages: ' || array_to_string(list_filter([case when count(*) filter (language = 'en') > 0 then 'EN: ' || count(*) filter (language = 'en') end, case when count(*) filter (language = 'ur') > 0 then 'UR: ' || count(*) filter (language = 'ur') end], lambda x: x is not null), '  ')
    || chr(10) || '{transcripts.RULE}' || chr(10) || chr(10) || string_agg('[' || {_sql_time('start', False)} || '] [' || upper(language) || '] ' || text || case when seq % 5 = 0 then chr(10) || '           ↳ ☪ Takbir' when {_VERSE_SQL} then chr(10) || '           ↳ 📖 ' || {_QURAN_SQL} when seq % 7 = 2 then chr(10) || '           ↳ 📜 Hadith — Bukhari #7 (91%)' || case when seq % 2 = 0 then ' ⚠ paraphrase' else '' end when seq % 9 = 0 then '  ⚠ [unverified — see flagged.txt]' else '' end, chr(10) order by start, seq)
    || chr(10) || chr(10) || '{transcripts.RULE}' || chr(10) || ' Total segments: ' || count(*) || chr(10) || '{transcripts.RULE}' as content from {SEGMENTS} group by all"""
)
def txt_transcripts(spark, d):
    return transcripts.txt(enriched(spark, d))


@query()
def json_transcripts(spark, d):
    return transcripts.json_array(enriched(spark, d))


_REVIEW = f"""string_agg('{'-' * 72}' || chr(10) || '#' || n || '  [' || {_sql_time('start', False)} || ' → ' || {_sql_time('"end"', False)} || ']' || chr(10) || '  Text   : ' || text || chr(10) || '  Reason : No Quran or Hadith match found' || chr(10) || '  Words  : w(0.94)' || chr(10) || '  Verified: {'_' * 55}' || chr(10), chr(10) order by n)"""
_HEAD = " || chr(10) || ".join(quoted(x) for x in ("=" * 72, "FLAGGED ARABIC SEGMENTS — REQUIRES HUMAN VERIFICATION", "These segments were transcribed as Arabic but could not be", "matched to the Quran corpus or Sunnah.com hadith database.", "Fill in the 'Verified:' field after manual review.", "=" * 72, ""))


@query(f"select file_id, {_HEAD} || chr(10) || {_REVIEW} || chr(10) || '{'-' * 72}' || chr(10) || 'Total flagged: ' || count(*) || chr(10) || '{'-' * 72}' as content from (select *, row_number() over (partition by file_id order by start, seq) as n from {SEGMENTS} where seq % 9 = 0) group by all")
def flagged_lists(spark, d):
    return transcripts.flagged(enriched(spark, d))


@query(
    f"""select file_id, seq as segment_id, start, "end", substr(text, 1, 60) as text_preview, language as detected_lang, round(0.25 * (1 - no_speech_prob) + 0.5 * greatest(0, 1 + avg_logprob) + 0.25 * case when compression_ratio > 0 then least(1, greatest(0, 2 - compression_ratio)) else 1 end, 4) as confidence, avg_logprob,
    len({sql_words('text')})::int as word_count, {_VERSE_SQL} as quran_match, case when {_VERSE_SQL} then 0.93::double else 0 end as quran_confidence, coalesce({_VERSE_SQL} and seq % 3 = 0, false) as quran_is_exact, coalesce({_VERSE_SQL} and seq % 14 = 1, false) as quran_is_ambiguous,
    seq % 7 = 2 as hadith_match, case when seq % 7 = 2 then 0.91::double else 0 end as hadith_confidence, seq % 5 = 0 as formula_match, seq % 9 = 0 as is_flagged, mixed_script_ratio from {SEGMENTS}"""
)
def diagnostics_rows(spark, d):
    return transcripts.diagnostics(enriched(spark, d)).select(
        "file_id", "segment_id", "start", "end", "text_preview", "detected_lang", "confidence", "avg_logprob", "word_count", "quran_match", "quran_confidence", "quran_is_exact", "quran_is_ambiguous",
        "hadith_match", "hadith_confidence", "formula_match", "is_flagged", "mixed_script_ratio",
    )


@query(f"select collection, hadith_no, hadith_id, text_ar_normalized from (select *, row_number() over (partition by collection, hadith_no order by doc_id) as n from (select doc_id, lower(trim(source)) as collection, (n_chars % 50)::varchar as hadith_no, doc_id::int as hadith_id, {sql_normal('trim(text)')} as text_ar_normalized from documents where len(trim(text)) >= 10)) where n = 1")
def corpus_first_wins(spark, d):
    raw = table(spark, d, "documents").select(c("doc_id").cast("string").alias("hadith_id"), "source", (c("n_chars") % 50).cast("string").alias("hadith_no"), c("text").alias("text_ar"), "doc_id")
    return corpora.narrations_of(raw, "doc_id", nfc=False).select("collection", "hadith_no", "hadith_id", "text_ar_normalized")


@query("select conv_id, turn, role, text from conversations")
def jsonl_rows(spark, d):
    """Rows written as JSON lines and read again."""
    path = fresh_folder(spark, "jsonl")
    table(spark, d, "conversations").select("conv_id", "turn", "role", "text").write.json(path)
    return read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


_SPOKEN = f"(select item_id, pos, line, row_number() over (order by item_id, pos) - 1 as idx from {sql_lines('benchmark')})"


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Items of ``benchmark`` as chapters, their sentences as verses, written as a JSON array and read as a corpus."""
    path = fresh_folder(spark, "chapters")
    verse = F.struct((c("pos") + 1).alias("id"), c("line").alias("text"))
    chapters = lines(spark, d, "benchmark").groupBy(c("item_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", verse.alias("v")))).alias("x"))
    objects = chapters.select(F.to_json(F.struct("id", F.when(c("id") % 2 == 0, F.concat(F.lit("n"), c("id").cast("string"))).alias("name"), F.transform("x", lambda x: x["v"]).alias("verses"))).alias("o"))
    objects.agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ",\n"), F.lit("]")).alias("value")).write.text(path)
    return corpora.read_verses(spark, path, nfc=False)


@query(f"select idx, item_id::int as surah_id, case when item_id % 2 = 0 then 'n' || item_id else 'Surah ' || item_id end as surah_name, (pos + 1)::int as ayah_id, line as text, {sql_canon('line')} as canon from {_SPOKEN}")
def verse_corpus(spark, d):
    return spoken(spark, d)


@query(f"select count(distinct item_id) as chapters, count(*) as verses, count(distinct item_id) = 114 and count(*) = 6236 as complete from {_SPOKEN}")
def corpus_counts(spark, d):
    return corpora.completeness(spoken(spark, d))


_CSV = "(select doc_id, lower(trim(source)) as collection, (n_chars % 50)::varchar as hadith_no, case when doc_id % 11 = 0 then 'x1' else doc_id::varchar end as hadith_id, trim(text) as t from documents)"
_CSV_KEPT = f"(select * from (select *, row_number() over (partition by collection, hadith_no order by doc_id) as first from {_CSV} where len(t) >= 10 and hadith_id <> 'x1') where first = 1)"


def told_in_csv(spark: SparkSession, d: str) -> DataFrame:
    """Documents as CSV files of narrations, in order of id within and across files, read again; some ids are no numbers."""
    path = fresh_folder(spark, "csv")
    df = table(spark, d, "documents")
    # one file is one task when it is read: as many as the cores, and one for some megabytes of a larger table
    files = max(spark.sparkContext.defaultParallelism, stated_size(df) >> 25)
    rows = df.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").select(
        c("doc_id").cast("string").alias("id"), F.when(c("doc_id") % 11 == 0, "x1").otherwise(c("doc_id").cast("string")).alias("hadith_id"), "source", F.lit("1").alias("chapter_no"), (c("n_chars") % 50).cast("string").alias("hadith_no"),
        F.lit("c").alias("chapter"), F.lit("0").alias("chain_indx"), c("text").alias("text_ar"), F.lit("e").alias("text_en"),
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return corpora.read_narrations(spark, path, nfc=False)


@query(f"select collection, hadith_no, hadith_id::int as hadith_id, {sql_normal('t')} as normal from {_CSV_KEPT}")
def narration_csv(spark, d):
    return told_in_csv(spark, d).select("collection", "hadith_no", "hadith_id", c("text_ar_normalized").alias("normal"))


@query(f"select collection, count(*) as n from {_CSV_KEPT} group by all")
def narration_table(spark, d):
    """The stored table, a folder a collection."""
    path = fresh_folder(spark, "narrations")
    corpora.write_narrations(told_in_csv(spark, d), path)
    return metrics.collection_counts(corpora.stored_narrations(spark, path), "collection")


@query("select query, case when any_value(conv_id) % 3 = 0 then 'held' else 'asked' end as source from (select 'conversation number ' || conv_id as query, conv_id from conversations) group by query, conv_id")
def cached_search(spark, d):
    """Answers of a third of the queries are held, those of another third are too old."""
    asked = table(spark, d, "conversations").select(F.concat(F.lit("conversation number "), c("conv_id").cast("string")).alias("query"), "conv_id")
    age = F.when(c("conv_id") % 3 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 40 DAYS"))
    cache = asked.where("conv_id % 3 < 2").distinct().select("query", F.lit("held").alias("source"), (F.current_timestamp() - age).alias("fetched_at"))
    search = lambda q: q.select("query", F.lit("asked").alias("source"), F.current_timestamp().alias("fetched_at"))
    return corpora.cached(asked, cache, search).select("query", "source")


@query(r"select conv_id::int as id, count(*) as n, string_agg(trim(replace(text, chr(10), ' ')), '|' order by turn) as texts from conversations group by all")
def chapters_from_text(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws("|", "conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    return corpora.chapters_of(rows).select("id", F.size("verses").cast("long").alias("n"), F.array_join(F.transform("verses", lambda v: v["text"]), "|").alias("texts"))


_NAMES = "case (doc_id % 4) when 0 then ' Sahih Bukhari' when 1 then 'Jami'' al-Tirmidhi' when 2 then 'Sunan Ibn Majah ' else source end"


@query(f"select collection, count(*) as n from (select case lower(trim(s)) when 'sahih bukhari' then 'bukhari' when 'jami'' al-tirmidhi' then 'tirmidhi' when 'sunan ibn majah' then 'ibnmajah' else lower(trim(s)) end as collection from (select {_NAMES} as s from documents)) group by all")
def collection_names(spark, d):
    s = F.when(c("doc_id") % 4 == 0, " Sahih Bukhari").when(c("doc_id") % 4 == 1, "Jami' al-Tirmidhi").when(c("doc_id") % 4 == 2, "Sunan Ibn Majah ").otherwise(c("source"))
    return table(spark, d, "documents").select(corpora.collection_name(s).alias("collection")).groupBy("collection").agg(F.count("*").alias("n"))


@query(
    """select o_orderkey as file_id, unnest(range(0, n)) as chunk, unnest(range(0, n)) * 118.0::double as start, case when n = 1 then dur else least(unnest(range(0, n)) * 118.0::double + 120, dur) end as "end"
    from (select o_orderkey, o_totalprice / 100 as dur, case when o_totalprice / 100 >= 180 then greatest(1, ceil((o_totalprice / 100 - 2) / 118))::bigint else 1 end as n from orders)"""
)
def chunk_plan(spark, d):
    files = table(spark, d, "orders").select(c("o_orderkey").alias("file_id"), (c("o_totalprice") / 100).alias("duration"))
    return context.chunk_plan(files).withColumn("chunk", c("chunk").cast("long"))


@query(
    f"""select file_id, seq, case when better then text || '!' else text end as text, case when better then text end as original_text, seq % 2 = 0 as retry_triggered from (select *, coalesce(seq % 2 = 0 and round(0.25 * 0.8 + 0.5 * greatest(0, 1 + avg_logprob / 2) + 0.25, 4) - round(0.25 * (1 - no_speech_prob) + 0.5 * greatest(0, 1 + avg_logprob) + 0.25, 4) > 0, false) as better from {SEGMENTS})"""
)
def retry_acceptance(spark, d):
    own = segments(spark, d)
    again = own.where(c("seq") % 2 == 0).select("file_id", "seq", F.concat("text", F.lit("!")).alias("text"), (c("avg_logprob") / 2).alias("avg_logprob"), F.lit(0.2).alias("no_speech_prob"), "avg_word_confidence")
    return context.accept_retries(own, again, by=["file_id", "seq"]).select("file_id", "seq", "text", "original_text", "retry_triggered")


@query()
def annotated_segments(spark, d):
    """The whole plan, over conversations as lectures and benchmark as both corpora."""
    own = segments(spark, d).withColumns({"file_id": c("file_id").cast("string"), "text": F.when(c("seq") % 2 == 0, arabic("text")).otherwise(c("text")), "words": F.array(F.struct(F.lit("w").alias("word"), F.lit(0.0).alias("start"), F.lit(0.1).alias("end"), c("avg_word_confidence").alias("probability"))), "language_probability": F.lit(0.95)})
    corpus = verses(spark, d).withColumn("canon", text.canonical(arabic("text"), nfc=False))
    told = table(spark, d, "benchmark").select(c("item_id").alias("idx"), F.lit("bukhari").alias("collection"), c("item_id").cast("string").alias("hadith_number"), arabic("text").alias("text_ar"), c("text").alias("text_en"), F.lit("").alias("chapter"), text.canonical(arabic("text"), nfc=False).alias("canon"))
    out = annotate(completed(own), corpus, told, settings(enable_hadith_verification=True), nfc=False)
    return out.select("file_id", "seq", "start", "end", "text", "detected_lang", "route", "is_flagged", "flag_reason", c("quran_match.confidence").alias("verse_confidence"), c("hadith_match.confidence").alias("narration_confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
