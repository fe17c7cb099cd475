"""Near copies by the similarity of their texts: at least 0.8 of all five-word shingles of two texts are in both.

Texts with the same set of shingles are one from the start.  The others are compared in three steps, each for the texts
that the ones before left unconnected; a pair links only if the similarity of its sets, counted whole, reaches the bound.

1. SimHash: 64-bit fingerprints of the sets, and multi-index hashing (``simhash.links``) for those within three bits.
   Fingerprints of a pair at 0.8 differ in about ten bits of 64 (an angle of acos(8/9)), far more than small balls around
   segments reach, so this step alone would lose most links; the next ones find them.
2. MinHash: the least values of 80 hash functions over a set form 20 keys of four; texts that share a key are candidates
   (of pairs at 0.8, one in 40,000 shares none).  Every key compares its texts with its most central one, that which
   shares the most keys with others, then with the next, and a key whose texts are all connected is done.  So a large
   group of near copies takes work of linear size.
3. Of a key that stays open all pairs of unconnected texts are looked at: sketches of 256 bytes screen them (of pairs at
   0.8, about one in 10,000 is lost), and the rest are verified.  That work grows with the square of the unconnected
   texts that share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .shared import written
from .simhash import SEED, print_of, word_groups

WIDTH = 5
#: A pair links if inner * LEAST[1] >= union * LEAST[0].
LEAST = (4, 5)
KEYS, EACH = 20, 4
#: Bytes of a sketch, and how many of them agree at least in a pair that is verified.
SKETCH, AGREE = 256, 181
#: Odd factors and offsets of the hash functions, those of keys first.
FACTORS, OFFSETS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, KEYS * EACH + SKETCH, 1), np.uint64)
FACTORS = FACTORS * np.uint64(2) + np.uint64(1)
#: Shingles hashed at once, and shingles of sets that a task remembers.
CHUNK, REMEMBER = 1024, 1 << 20


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Rising different hashes of a text's shingles; words, shingles and short texts are those of ``simhash.fingerprint``."""
    found, held, digest = [], [], xxhash.xxh64_intdigest
    for more in word_groups((text or "").encode("utf-8", "replace").lower()):
        words = held + more
        found.append(np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(width)), strict=False)), np.uint64))
        held = words[-(width - 1) :] if width > 1 else []
    if held and not any(map(len, found)):
        return np.array([digest(b" ".join(held), SEED)], np.uint64)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def least(own: np.ndarray, functions: slice) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    return np.min([(own[at : at + CHUNK] * FACTORS[functions] + OFFSETS[functions]).min(1) for at in range(0, len(own), CHUNK)], axis=0)


def keys_of(own: np.ndarray) -> list[int]:
    """The keys of a set of shingles, as signed longs; the empty set has none."""
    if not len(own):
        return []
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least(own, slice(KEYS * EACH)).reshape(KEYS, EACH))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch_of(own: np.ndarray) -> bytes:
    return least(own, slice(KEYS * EACH, None)).astype(np.uint8).tobytes() if len(own) else bytes(SKETCH)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    inner = len(np.intersect1d(a, b, assume_unique=True))
    return inner * LEAST[1] >= (len(a) + len(b) - inner) * LEAST[0]


def marks(text: pa.Array) -> pa.Array:
    """Of each text: the digest of its set of shingles, the size of the set, its keys, and its fingerprint."""
    same, sizes, keys, prints = [], [], [], []
    for x in text:
        own = shingles(x.as_py())
        for held, value in ((same, xxhash.xxh3_128_digest(own.tobytes())), (sizes, len(own)), (keys, keys_of(own)), (prints, print_of(own))):
            held.append(value)
    arrays = [pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
    return pa.StructArray.from_arrays(arrays, ["same", "n", "keys", "fp"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose ``texts`` (node, text) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                both = []
                for node, column in ((a, 2), (b, 3)):
                    own = sets.get(node)
                    if own is None:
                        own = shingles(batch.column(column)[i].as_py())
                        if held + len(own) > REMEMBER:
                            sets.clear()
                            held = 0
                        sets[node] = own
                        held += len(own)
                    both.append(own)
                kept.append(alike(*both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    first, second = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def screened(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs (a, b) of unconnected texts of a key whose sizes and sketches allow for the bound.

    A pair comes from the first of the keys that it shares; that one is open too, since it holds unconnected texts.
    """
    node, n, part = (table.column(c).to_numpy() for c in ("node", "n", "part"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(-1, KEYS)
    place = int(np.flatnonzero(keys[0] == key[0].as_py())[0])
    found = []
    for i in range(len(node) - 1):
        other = i + 1 + np.flatnonzero((part[i + 1 :] != part[i]) & (np.minimum(n[i + 1 :], n[i]) * LEAST[1] >= np.maximum(n[i + 1 :], n[i]) * LEAST[0]))
        for at in range(0, len(other), CHUNK):
            some = other[at : at + CHUNK]
            some = some[(keys[some] == keys[i]).argmax(1) == place]
            some = some[np.count_nonzero(sketch[some] == sketch[i], axis=1) >= AGREE]
            found.append(np.stack([np.minimum(node[some], node[i]), np.maximum(node[some], node[i])]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def by_fingerprint(nodes: DataFrame, bucket: int = 64) -> DataFrame:
    """Candidates (a, b): a node and the least one of its fingerprint, and the least ones of fingerprints within three bits."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "prints")
    same = nodes.join(least, "fp").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    first, second = (least.select(F.col("fp").alias(k), F.col("hub").alias(f"hub_{k}")) for k in "ab")
    near = simhash.links(least.select("fp"), bucket).join(first, "a").join(second, "b")
    return same.union(near.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b"))).distinct()


def links(nodes: DataFrame, texts: DataFrame, *, rounds: int = 3) -> DataFrame:
    """Links (a, b) that connect all candidates of ``nodes`` (node, n, keys, fp) that are alike.

    First fingerprints, then ``rounds`` in which every open key compares its texts with one of them, then all pairs left.
    Links found so far are held as stars, one link a node.
    """
    near = F.least("n", "hub_n") * LEAST[1] >= F.greatest("n", "hub_n") * LEAST[0]  # else the sets can't be alike
    stars, used = nodes.sparkSession.createDataFrame([], "a long, b long"), nodes.sparkSession.createDataFrame([], "node long")

    def more(pairs: DataFrame) -> DataFrame:
        """The stars with what is alike of ``pairs``; the same ones if nothing is."""
        found = written(verified(written(pairs, "pairs"), texts), "alike")
        if not found.head(1):
            return stars
        return connected_components(stars.union(found)).where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))

    def connected(held: DataFrame) -> DataFrame:
        """The keys that stay open, with the components so far."""
        held = held.join(stars.select(F.col("b").alias("node"), F.col("a").alias("found")), "node", "left")
        held = written(held.select("node", "n", "central", "key", F.coalesce("found", "node").alias("part")), "held")
        return written(held.join(held.groupBy("key").agg((F.min("part") < F.max("part")).alias("open")).where("open").select("key"), "key"), "held")

    stars = more(by_fingerprint(nodes))
    held = written(nodes.select("node", "n", F.explode("keys").alias("key")), "keys")
    shared = written(held.join(held.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "shared")
    held = connected(shared.join(shared.groupBy("node").agg(F.sum("size").alias("central")), "node"))
    for k in range(rounds):
        hub = F.max(F.struct("central", F.xxhash64("node", F.lit(k)).alias("order"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("part").alias("hub_part")))
        hubs = written(held.join(used, "node", "left_anti").groupBy("key").agg(hub.alias("h")).select("key", "h.hub", "h.hub_n", "h.hub_part"), "hubs")
        used = used.union(hubs.select("hub")).distinct()
        pairs = held.join(hubs, "key").where((F.col("part") != F.col("hub_part")) & near)
        before, stars = stars, more(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
        if stars is not before:
            held = connected(held.select("node", "n", "central", "key"))
    sketch = F.arrow_udf(lambda text: pa.array([sketch_of(shingles(x.as_py())) for x in text], pa.binary()), "binary")
    sketches = written(texts.join(held.select("node").distinct(), "node").select("node", sketch("text").alias("sketch")), "sketches")
    return more(held.join(sketches, "node").join(nodes.select("node", "keys"), "node").groupBy("key").applyInArrow(screened, "a long, b long"))


def drop_near_copies(docs: DataFrame, *, rounds: int = 3) -> DataFrame:
    """One row of each group of near copies in ``docs``, with all its columns: that of the smallest doc_id (null last).

    A group is what links between texts of similarity 0.8 or more connect.  Texts without a word (or null) are alike; a
    text of fewer than five words has one shingle, of them all; very long texts count whole.  Of rows that share the
    smallest id one stays, so repeated rows leave one.  Extra columns may have any name.  An empty table gives no rows.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    names, text, doc_id = plain.columns, F.col(at["text"]), at["doc_id"]
    seen = F.arrow_udf(marks, "struct<same:binary,n:bigint,keys:array<bigint>,fp:bigint>")
    rows = plain.withColumns({"seen": seen(text), "row": F.monotonically_increasing_id()}).select(*names, "row", "seen.*")
    rows = written(rows, "rows")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("row").alias("row")))
    distinct = written(rows.groupBy("same").agg(first.alias("first")).select("first", F.col("first.row").alias("node")), "distinct")
    nodes = rows.select(F.col("row").alias("node"), "n", "keys", "fp").join(distinct.select("node"), "node")
    stars = links(written(nodes, "nodes"), rows.select(F.col("row").alias("node"), text.alias("text")), rounds=rounds)
    groups = distinct.join(stars.withColumnRenamed("b", "node"), "node", "left").groupBy(F.coalesce("a", "node").alias("root")).agg(F.min("first").alias("first"))
    # as many rows are kept as there are groups, so they are never broadcast, however small the table
    kept = written(groups.select(F.col("first.row").alias("row")), "kept").hint("merge")
    return rows.join(kept, "row", "left_semi").select(*names).toDF(*docs.columns)
