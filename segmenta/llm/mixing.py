"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. ``size`` is the number of words of a document.  Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...
   and share the total of all sizes.  A target stops at ``max_repeat`` times its source's size and the excess goes to
   the others by weight, until none is above (``water_level``).
2. A source is one stream of words: its documents by bucket (a hash of id and text; the number of buckets follows the
   words), and inside a bucket in a seeded order.  The stream is cut into blocks of ``block_words`` words; only the last
   block of a source may be shorter.  A source with a third of all rows is spread over all buckets.
3. The target is taken as whole passes over the stream, and a rest.  The rests are apportioned: blocks go one by one to
   the source with the highest quotient rest / (2 q + 1), as long as it is half a block or more.  So a source gets its
   rest in blocks, rounded half up, whatever the other sources are; the short last block is one of them where that comes
   nearer.  No source misses its target by more than half a block.
4. The blocks of a source are its shards, ``shard_words`` words in each (fewer in the last).  Its quota is apportioned to
   them by highest quotients again, with the sizes of the shards for votes: an integer quota per source and shard.
5. In a shard of m blocks those are taken to which a seeded permutation of the block numbers gives places under its
   quota.  All of this follows from a few numbers of the source, so what a document contributes follows from its place.

Rows that agree in everything are counted first and placed together, so a crowd of them is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, documents, written

#: Primes above any block number of a shard; one of them, chosen by seed, spreads the chosen blocks.
STRIDES = (2654435761, 2246822519, 3266489917, 668265263)
#: Buckets whose words are added up together, and copies of a row that are listed together.
TOGETHER = 4096
#: Numbers of a source that tell which of its blocks are taken once more.
RULE = ("blocks", "shards", "last", "last_quota", "each", "more", "turn", "tail", "stride", "mark")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, the number of a source in code point order with null last.

    Sources are sorted over partitions and each partition counts from where the ones before it end; only one number per
    partition comes to the driver.
    """
    spark = sources.sparkSession
    laid = written(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "sources"
    )
    counts = sorted(laid.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect())
    start, offsets = 0, []
    for part, n, first in counts:
        offsets.append((part, start - first))
        start += n
    return laid.join(F.broadcast(spark.createDataFrame(offsets, "part int, shift long")), "part").select(
        "source", "source_size", (F.col("row") + F.col("shift")).alias("place")
    )


def water_level(sources: DataFrame, total: int, max_repeat: int) -> float:
    """The level at which min(level * weight, max_repeat * source_size) sums to ``total``.

    Each pass is one small aggregate over the sources; a pass can only stop more sources, so it ends.
    """
    level = 0.0
    while True:
        stopped = F.col("weight") * F.lit(level) > max_repeat * F.col("source_size")
        capped, weight = sources.agg(
            F.sum(F.when(stopped, max_repeat * F.col("source_size")).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight")))
        ).first()
        if not weight:
            return level
        found = (total - capped) / weight
        if found <= level:
            return level
        level = found


def rest_quotas(rest: Column, source_size: Column, block_words: int) -> tuple[Column, Column]:
    """Of a rest of words: how many whole blocks, and whether the short last one, come nearest to it."""
    whole, short = F.floor(source_size / block_words), source_size % block_words
    nearest = lambda words: F.least(whole, F.greatest(F.lit(0), F.floor(words / block_words + 0.5))).cast("long")
    without, along = nearest(rest), nearest(rest - short)
    tail = (short > 0) & (F.abs(rest - short - along * block_words) < F.abs(rest - without * block_words))
    return F.when(tail, along).otherwise(without), tail


def shard_quotas(sources: DataFrame, shard_blocks: int) -> DataFrame:
    """Adds to sources (``blocks`` blocks, ``quota`` of them) the quotas of its shards by highest quotients.

    ``shards``, ``last`` (blocks of the last one), ``last_quota``; the others get ``each``, ``more`` of them one above.
    Ties go to shards before the last one.
    """
    numbers = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("blocks") / shard_blocks)).cast("long"))
    numbers = numbers.withColumns({"last": F.col("blocks") - (F.col("shards") - 1) * shard_blocks, "near": F.expr("if(blocks > 0, quota * (blocks - (shards - 1) * %d) div blocks, 0L)" % shard_blocks)})
    # the last shard's j-th quotient last / (2 j + 1) comes after all of the others' that are as high
    comes = f"(shards - 1) * (({shard_blocks} * (2 * j + 1) + last) div (2 * last)) + j < quota"
    last = F.expr(f"if(shards = 1, quota, greatest(0L, near - 2) + aggregate(sequence(greatest(0L, near - 2), near + 3), 0L, (n, j) -> n + if({comes}, 1L, 0L)))")
    numbers = numbers.withColumn("last_quota", F.greatest(F.col("quota") - (F.col("shards") - 1) * shard_blocks, F.least(last, F.col("last"))))
    return numbers.withColumns({"each": F.expr("(quota - last_quota) div greatest(shards - 1, 1L)"), "more": F.expr("(quota - last_quota) % greatest(shards - 1, 1L)")}).drop("near")


def taken_once_more(block: str, shard_blocks: int) -> str:
    """SQL: whether a block of a source is taken once more, from the numbers in RULE."""
    k = f"({block} div {shard_blocks})"
    m = f"if({k} < shards - 1, {shard_blocks}L, last)"
    quota = f"if({k} < shards - 1, each + if(({k} + turn) % greatest(shards - 1, 1L) < more, 1L, 0L), last_quota)"
    return f"if({block} >= blocks, tail, (({block} % {shard_blocks}) * stride + pmod(xxhash64(mark, {k}), {m})) % {m} < {quota})"


def targets(sized: DataFrame, *, weights: Sequence[int], max_repeat: int, block_words: int, shard_words: int, seed: int) -> tuple[DataFrame, int]:
    """Of each source: source_size, target, passes and the numbers in RULE; and the words of all."""
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, total, max_repeat)
    target = F.least(F.col("weight") * F.lit(float(level)), (max_repeat * F.col("source_size")).cast("double"))
    sources = sources.select("source", "source_size", target.alias("target"))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes)
    rest = F.when(F.col("passes") < max_repeat, F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0.0)
    quota, tail = rest_quotas(rest, F.col("source_size"), block_words)
    mark = F.xxhash64("source", F.lit(seed + 1))
    sources = sources.withColumns({
        "blocks": F.floor(F.col("source_size") / block_words).cast("long"),
        "quota": quota,
        "tail": tail,
        "mark": mark,
        "stride": F.element_at(F.array(*map(F.lit, STRIDES)), (F.pmod(mark, F.lit(len(STRIDES))) + 1).cast("int")),
        "turn": F.pmod(F.shiftright(mark, 8), F.lit(1 << 31)),
    })
    return shard_quotas(sources, shard_words // block_words), total


def placed(sized: DataFrame, *, weights: Sequence[int], max_repeat: int, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """Rows that agree in everything together, as often as ``copies`` says: doc_id, source_size, target, size, copies, row
    (the least), start (in the source's stream, of the first copy), passes and the numbers in RULE.

    ``sized`` has doc_id, source, size, digest (of the text), same (of what else tells rows apart) and row.
    """
    sources, total = targets(sized, weights=weights, max_repeat=max_repeat, block_words=block_words, shard_words=shard_words, seed=seed)
    buckets = max(1, -(-total // shard_words))
    keyed = sized.withColumns({"of": F.coalesce("source", F.lit("")), "none": F.col("source").isNull(), "bucket": F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed)), F.lit(buckets))})
    runs = keyed.groupBy("of", "none", "bucket", "doc_id", "digest", "size", "same").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    words = F.col("size") * F.col("copies")
    sums = written(keyed.groupBy("of", "none", "bucket").agg(F.sum("size").alias("words")).withColumn("part", F.expr(f"bucket div {TOGETHER}")), "buckets")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("of", "none", "part").agg(F.sum("words").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before("of", "none", "part")), F.lit(0)))
    sums = sums.withColumn("earlier", F.coalesce(F.sum("words").over(before("of", "none", "part", "bucket")), F.lit(0))).join(parts.drop("n"), ["of", "none", "part"])
    own = sources.withColumns({"of": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()}).drop("source", "quota")
    sums = sums.select("of", "none", "bucket", (F.col("earlier") + F.col("ahead")).alias("from")).join(own, ["of", "none"])
    order = Window.partitionBy("of", "none", "bucket").orderBy(F.xxhash64("doc_id", "digest", F.lit(seed + 2)), "doc_id", "digest", "size", "same")
    runs = runs.withColumn("here", F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, 0)) - words)
    joined = runs.join(written(sums, "offsets"), ["of", "none", "bucket"])
    return joined.select("doc_id", "source_size", "target", "size", "copies", "row", (F.col("from") + F.col("here")).alias("start"), "passes", *RULE)


def each_copy(runs: DataFrame, block_words: int, shard_words: int) -> DataFrame:
    """One row a copy, each with its own ``start`` and what is ``taken`` of it; copies are listed some thousand at once."""
    wide = runs.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {TOGETHER})")))
    wide = wide.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {TOGETHER}, least(copies, (chunk + 1) * {TOGETHER}) - 1)")))
    wide = wide.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    once = taken_once_more("i", shard_words // block_words)
    taken = F.expr(f"""if(size = 0, 0L, passes * size + if(each + more + last_quota = 0 and not tail, 0L, aggregate(sequence(start div {block_words}, (start + size - 1) div {block_words}), 0L,
        (sum, i) -> sum + if({once}, least(start + size, (i + 1) * {block_words}) - greatest(start, i * {block_words}), 0L))))""")
    return wide.withColumn("taken", taken).drop("chunk", "copy", "copies")


def sizes(docs: DataFrame, same: Column, row: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), same.alias("same"), row.alias("row")), "sizes")


def mix_plan(
    docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, block_words: int = 64, shard_words: int = 200_000, seed: int = 20
) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    Null or empty text: size 0, nothing taken.  Null source: a source of its own, last.  Very long texts span blocks and
    shards like any words.  Null or repeated ids: each row counts by itself; of rows that agree in id, source and text it
    does not show which is which.  An empty table gives no rows.  Other columns of ``docs`` are not read.  Reruns agree,
    whatever the number of partitions.
    """
    shard_words -= shard_words % block_words
    sized = sizes(docs, F.lit(0), F.lit(0))
    runs = placed(sized, weights=weights, max_repeat=max_repeat, block_words=block_words, shard_words=shard_words, seed=seed)
    return each_copy(runs, block_words, shard_words).select("doc_id", "size", "source_size", "target", "taken")


def mix(
    docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, block_words: int = 64, shard_words: int = 200_000, seed: int = 20
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as it is taken whole, and once more with the words
    of its chosen blocks if some are taken once more (white space before a word goes with it; n_chars is counted anew).

    Rows of which nothing is taken go, and so do null and empty texts and those without a word.  A very long text is held
    with its list of words while its chosen blocks are put together.  Repeated rows are mixed one by one, equal ones in
    any order.  Extra columns may have any name.  An empty table gives no rows.
    """
    shard_words -= shard_words % block_words
    columns = docs.columns
    numbered = written(docs.toDF(*(f"c_{c}" for c in columns)).withColumn("mix_row", F.monotonically_increasing_id()), "mixed")
    slim = numbered.select("mix_row", *(F.col(f"c_{c}").alias(c) for c in ("doc_id", "text", "source")), F.xxhash64(*(f"c_{c}" for c in columns if c != "text")).alias("mix_same"))
    runs = placed(sizes(slim, F.col("mix_same"), F.col("mix_row")), weights=weights, max_repeat=max_repeat, block_words=block_words, shard_words=shard_words, seed=seed)
    plan = each_copy(runs, block_words, shard_words).where("taken > 0").drop("doc_id", "source_size", "target")
    # 0: the chosen blocks once; 1 to passes: the whole text
    plan = plan.withColumn("once", F.explode(F.expr("sequence(if(taken > passes * size, 0L, 1L), passes)")))
    words = F.regexp_extract_all("c_text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    rule = taken_once_more("i", shard_words // block_words)
    picked = f"transform(sequence(start div {block_words}, (start + size - 1) div {block_words}), i -> {rule})"
    joined = numbered.join(plan, F.col("mix_row") == F.col("row")).withColumn("parts", F.when(F.col("once") == 0, words))
    # an array of one holds what is picked, so that it is computed once a text
    chosen = f"get(transform(array({picked}), p -> array_join(filter(parts, (w, k) -> get(p, cast((start % {block_words} + k) div {block_words} as int))), '')), 0)"
    text = F.when(F.col("once") > 0, F.col("c_text")).otherwise(F.expr(chosen))
    taken = joined.withColumn("taken_text", text)
    out = {c: F.col(f"c_{c}") for c in columns} | {"text": F.col("taken_text")} | ({"n_chars": F.length("taken_text").cast("long")} if "n_chars" in columns else {})
    return taken.select(*(out[c].alias(c) for c in columns))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each: doc_id, size, source_size, target, taken."""
    return mix_plan(documents(spark, sf_dir))
