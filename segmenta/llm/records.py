"""Token ids in files of length-delimited binary records, with an offset index for shuffled reads.

A record is a length (8 bytes), the masked CRC-32C of those bytes, the payload, and the masked CRC-32C of the payload; all
numbers are little-endian.  The payload is an id (8 bytes), a flag for a null id, the width of a token (2 or 4 bytes), and the
tokens.  Beside each file of records stands an index of where they start, 8 bytes each, and the end.  A manifest names the
files that count, so what a failed or repeated task left behind is never read.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Encoder
from .shared import documents, fresh_path

HEAD, FRAME = struct.Struct("<qBB"), 16
#: 16-bit words of a payload whose checksum is taken in one lane.
LANE = 256
#: Bytes read from a file of records at once, one record at least.
READ = 8 << 20
_MASK = 0xFFFFFFFF


@lru_cache(1)
def by_word() -> np.ndarray:
    """CRC-32C (reflected) of each 16-bit word."""
    crc = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0x82F63B78), crc >> 1)
    return crc


@lru_cache(64)
def shift(words: int) -> np.ndarray:
    """Tables (4 by 256) of what ``words`` zero words do to a CRC; ``words`` is a power of two."""
    if words == 1:
        v = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
        return by_word()[v & 0xFFFF] ^ (v >> 16)
    return moved(shift(words // 2), shift(words // 2))


def moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def masked_crcs(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of runs of 16-bit words: lanes of LANE words go step by step together, then lanes are joined."""
    lanes = -(-counts // LANE)
    ends = np.cumsum(lanes)
    record = np.repeat(np.arange(len(counts)), lanes)
    nth = np.arange(len(record)) - (ends - lanes)[record]
    first = (nth + 1 - lanes[record]) * LANE + counts[record] - LANE  # from the run's start; before it count zeros
    table, crc = by_word(), np.zeros(len(record), np.uint32)
    base, padded = starts[record] + first, np.append(words, np.uint16(0))
    short = np.maximum(0, -first)
    for k in range(LANE):
        w = padded[np.where(k >= short, base + k, len(words))]
        crc = table[(crc ^ w) & 0xFFFF] ^ (crc >> 16)
    out, by_lane = np.zeros(len(counts), np.uint32), shift(LANE)
    for k in range(int(lanes.max(initial=0))):
        at = np.flatnonzero(lanes > k)
        out[at] = moved(by_lane, out[at]) ^ crc[(ends - lanes)[at] + k]
    start = np.full(len(counts), _MASK, np.uint32)
    for k in range(int(counts.max(initial=0)).bit_length()):
        start = np.where((counts >> k) & 1, moved(shift(1 << k), start), start)
    crc = (out ^ start ^ np.uint32(_MASK)).astype(np.uint64)
    return ((((crc >> 15) | (crc << 17)) & _MASK) + 0xA282EAD8 & _MASK).astype(np.uint32)


def framed(payloads: Sequence[bytes]) -> list[bytes]:
    """Records of payloads (of even length)."""
    sizes = np.array([len(p) for p in payloads], "<u8")
    heads = masked_crcs(sizes.view("<u2"), 4 * np.arange(len(sizes)), np.full(len(sizes), 4))
    ends = np.cumsum(sizes.astype(np.int64)) // 2
    counts = sizes.astype(np.int64) // 2
    bodies = masked_crcs(np.frombuffer(b"".join(payloads), "<u2"), ends - counts, counts)
    size, head, body = sizes.tobytes(), heads.astype("<u4").tobytes(), bodies.astype("<u4").tobytes()
    return [b"".join((size[8 * k : 8 * k + 8], head[4 * k : 4 * k + 4], p, body[4 * k : 4 * k + 4])) for k, p in enumerate(payloads)]


def unframed(data: bytes, offsets: np.ndarray) -> list[memoryview]:
    """Payloads of the records at ``offsets`` (their starts and the end); ValueError if a length or checksum is wrong."""
    starts, spans = offsets[:-1], np.diff(offsets)
    heads = np.array([data[a : a + 12] for a in starts.tolist()], "S12") if len(starts) else np.zeros(0, "S12")
    raw = np.frombuffer(b"".join(data[a : a + 12] for a in starts.tolist()), np.uint8).reshape(len(heads), 12)
    sizes = raw[:, :8].copy().view("<u8")[:, 0].astype(np.int64)
    if not np.array_equal(sizes + FRAME, spans):
        raise ValueError("a record's length is not that of the index")
    if not np.array_equal(raw[:, 8:].copy().view("<u4")[:, 0], masked_crcs(sizes.astype("<u8").view("<u2"), 4 * np.arange(len(sizes)), np.full(len(sizes), 4))):
        raise ValueError("a record's length has a wrong checksum")
    if len(data) % 2 or (starts % 2).any():
        raise ValueError("records are not on even offsets")
    found = np.array([struct.unpack_from("<I", data, e - 4)[0] for e in offsets[1:].tolist()], np.uint32)
    if not np.array_equal(found, masked_crcs(np.frombuffer(data, "<u2"), (starts + 12) // 2, sizes // 2)):
        raise ValueError("a record's payload has a wrong checksum")
    view = memoryview(data)
    return [view[a + 12 : a + 12 + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return HEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=HEAD.size)


_encoders: dict[str, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """The tokenizers library behind a table of recent pre-tokens: the library encodes each pre-token that isn't there."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)

        def misses(words: list[bytes]) -> list[list[int]]:
            return [e.ids for e in library.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

        _encoders[path] = Encoder(path, bits=20, misses=misses)
    return _encoders[path]


def write_records(docs: DataFrame, path: str, folder: str, *, end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Encodes every text (null: empty), appends ``end_id``, and writes records in ascending order of doc_id (null first).

    Rows are dealt to ``shards`` ranges (by default as many as the input has partitions) and sorted in each; rows of one id
    stand in order of a hash of their text, then as they are read, so that many of them are still dealt to several ranges.
    A task writes one file and its index, under a name of its own attempt.  Returns the manifest, which is also written: a
    file, its number of records and of tokens by shard, in order.  The tokens of a text are one record, held whole.
    """
    shards = shards or max(1, docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        machine = library_encoder(path)
        width = 2 if machine.vocab.size <= 1 << 16 else 4
        offsets, at, tokens = [0], 0, 0
        with system.open_output_stream(f"{base}/{name}.rec") as out:
            for batch in batches:
                keys, group, held = batch.column(0).to_pylist(), [], 0
                for k, ids in enumerate(machine.encode([t.as_py() for t in batch.column(1)])):
                    group.append(serialize(keys[k], np.append(ids, end_id), width))
                    tokens, held = tokens + len(ids) + 1, held + len(group[-1])
                    if held > READ or k + 1 == len(keys):
                        for record in framed(group):
                            out.write(record)
                            at += len(record)
                            offsets.append(at)
                        group, held = [], 0
        with system.open_output_stream(f"{base}/{name}.idx") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        yield pa.record_batch([[context.partitionId()], [name], [len(offsets) - 1], [tokens]], ["shard", "file", "records", "tokens"])

    order = ("doc_id", "mix", "place")
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mix"), F.monotonically_increasing_id().alias("place"))
    laid = laid.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = sorted(laid.mapInArrow(run, "shard long, file string, records long, tokens long").collect())
    manifest = [r.asDict() for r in found]
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> list[dict]:
    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def read_shard(folder: str, file: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one file in order, some megabytes at a time, each checked."""
    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{base}/{file}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with system.open_input_file(f"{base}/{file}.rec") as f:
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ, side="right")) - 1)
            data = f.read_at(int(offsets[to] - offsets[at]), int(offsets[at]))
            for payload in unframed(data, offsets[at : to + 1] - offsets[at]):
                yield deserialize(payload)
            at = to


def read_record(folder: str, file: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the index: what a shuffled reader does."""
    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{file}.idx") as f:
        pair = np.frombuffer(f.read_at(16, 8 * number), "<u8").astype(np.int64)
    with system.open_input_file(f"{base}/{file}.rec") as f:
        return deserialize(unframed(f.read_at(int(pair[1] - pair[0]), int(pair[0])), pair - pair[0])[0])


def described(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, read from the files; one task a file, which is sent its name."""
    manifest = read_manifest(folder)
    before = np.concatenate([[0], np.cumsum([m["tokens"] for m in manifest])]).tolist()
    files = spark.createDataFrame([(m["file"], k, before[k]) for k, m in enumerate(manifest)], "file string, shard long, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, ids in read_shard(folder, file):
                    rows.append((doc_id, start, len(ids), crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    laid = files.repartitionByRange(max(1, len(manifest)), "shard").select("file", "start")
    return laid.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as records in ascending doc_id order, and read back.

    Null texts count as empty and give the end id alone; a very long text is one record.  Null ids come first; rows of one
    id, equal ones too, stand one after the other in a fixed order.  An empty table gives no rows; other columns are not
    read.
    """
    folder = fresh_path(spark, "records")
    write_records(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), folder)
    return described(spark, folder)
