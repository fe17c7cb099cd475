"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; two fingerprints link if they differ in at most three.  Cut into two segments of 32 bits,
one segment of such a pair differs in at most one bit.  So every fingerprint probes a table of segments with the Hamming
ball of radius one around each of its own segments, and the whole distance of what it finds is verified.  Of two segments
that differ in one bit, one has it set, so each fingerprint enumerates only the half of the ball with a set bit cleared.

A segment value that more than ``bucket`` different fingerprints share is not expanded into pairs.  Its members (exact
value) and visitors (one bit off) meet instead at the points one bit around their *other* segment: all members at a
point are within two bits of each other, and a visitor is within two bits of them there and one bit off here.  Members
three bits apart meet where one is one bit away and the other two.  Each point links what it holds to one member, which
keeps every connection with a number of rows that is linear in the fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import documents, written

SEED = 42
#: Shingles whose bits are counted at once, and bytes whose words are held at once: they bound the memory for a long text.
CHUNK, PIECE = 65_536, 4 << 20
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def word_groups(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes of it at once."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            blank = BLANK.search(raw, end)
            end = blank.start() if blank else len(raw)
        yield raw[at:end].split()
        at = end


def print_of(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of ``hashes`` (uint64); 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text: bit b is set if it is set in over half of the shingles' hashes.

    A-Z is lower-cased; words are runs without ASCII white space; shingles are ``width`` words joined by spaces, repeats
    included.  Fewer words: one shingle of them all.  No word (or null): 0.
    """
    counts, n, held, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for more in word_groups((text or "").encode("utf-8", "replace").lower()):
        words = held + more
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(width)), strict=False)), np.uint64)
        for at in range(0, len(hashes), CHUNK):
            counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
        held = words[-(width - 1) :] if width > 1 else []
    if not n:
        return digest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def signed_print(text: Column, width: int) -> Column:
    """The fingerprint of a text as a signed long."""
    return F.arrow_udf(lambda x: pa.array(np.array([fingerprint(t.as_py(), width) for t in x], np.uint64).view(np.int64)), "long")(text)


def links(prints: DataFrame, bucket: int = 64) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp`` that connect all pairs at three bits or fewer.

    Every link is verified or within three bits by construction; pairs in crowded segments are connected through a
    member of the point they share instead of being listed.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    sides = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("key"), low.alias("rest")), F.struct(F.lit(1).alias("seg"), low.alias("key"), high.alias("rest")))).alias("s")).select("fp", "s.*")
    table = sides.groupBy("seg", "key").agg(F.count("*").alias("n"))
    crowded = table.where(F.col("n") > bucket).select("seg", "key")
    crowded = written(crowded, "crowded")
    any_crowded = bool(crowded.head(1))
    # the ball: the segment itself, and each set bit cleared
    ball = F.expr("concat(array(key), transform(filter(sequence(0, 31), b -> (shiftrightunsigned(key, b) & 1L) = 1L), b -> key & ~shiftleft(1L, b)))")
    probes = sides.select("fp", "seg", "rest", F.posexplode(ball).alias("off", "key"))
    listed = sides.select("seg", "key", F.col("fp").alias("other"))
    calm = listed
    if any_crowded:
        calm = listed.join(crowded, ["seg", "key"], "left_anti")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 3) & ((F.col("off") > 0) | (F.col("fp") < F.col("other")))
    found = probes.join(calm, ["seg", "key"]).where(near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if not any_crowded:
        return found
    here = written(probes.join(crowded, ["seg", "key"]).select("seg", "key", "rest", "fp", (F.col("off") == 0).alias("member")), "visits")
    flips = "transform(sequence(0, 31), b -> rest ^ shiftleft(1L, b))"
    one = F.expr(f"concat(array(rest), {flips})")
    points = here.select("seg", "key", "fp", "member", F.explode(one).alias("point"))
    at = Window.partitionBy("seg", "key", "point")
    starred = points.withColumn("hub", F.min(F.when(F.col("member"), F.col("fp"))).over(at)).where(F.col("hub").isNotNull() & (F.col("hub") != F.col("fp")))
    found = found.union(starred.select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    # members three bits apart: one within one bit of the point, the other two bits from it
    two = F.expr("flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> rest ^ shiftleft(1L, i) ^ shiftleft(1L, j))))")
    members = here.where("member")
    hubs = members.select("seg", "key", "fp", F.explode(one).alias("point")).groupBy("seg", "key", "point").agg(F.min("fp").alias("hub"))
    far = members.select("seg", "key", "fp", F.explode(two).alias("point")).join(hubs, ["seg", "key", "point"]).where("hub != fp")
    return found.union(far.select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct())


def roots(distinct: DataFrame, bucket: int) -> DataFrame:
    """(fp, root) of the fingerprints that have links; root names the component."""
    groups = connected_components(links(distinct.select("fp"), bucket))
    return groups.select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, *, width: int = 3, bucket: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most three differing bits reach, itself included.  Null and
    empty texts have fingerprint zero and link like any other.  Equal texts have equal fingerprints and meet there, so
    copies are never paired.  Null ids are kept, in the component of their fingerprint; repeated rows are.  Very
    long texts count whole, some megabytes of words at once.  Other columns are not read; an empty table gives no rows.
    """
    prints = written(docs.select("doc_id", signed_print(F.col("text"), width).alias("fp")), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = written(roots(distinct, bucket), "roots")
    least = groups.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(distinct.join(groups.join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "labels")
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: doc_id, fingerprint, component_id."""
    return near_duplicates(documents(spark, sf_dir))
