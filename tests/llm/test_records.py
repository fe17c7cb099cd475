import struct
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segmenta.llm import bpe, records
from segmenta.llm.shared import fresh_path

PATH = public_tokenizers.path(bpe.VOCABULARY)


def masked(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for x in data:
        crc ^= x
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) & 0xFFFFFFFF) + 0xA282EAD8 & 0xFFFFFFFF


def test_frames_equal_a_plain_checksum():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 2 * n, dtype=np.uint8).tobytes() for n in (5, 6, 255, 256, 257, 1000, 513)]
    frames = records.framed(payloads)
    for p, f in zip(payloads, frames, strict=True):
        size = struct.pack("<Q", len(p))
        assert f == size + struct.pack("<I", masked(size)) + p + struct.pack("<I", masked(p))
    offsets = np.cumsum([0, *map(len, frames)])
    data = b"".join(frames)
    assert [bytes(x) for x in records.unframed(data, offsets)] == payloads
    for at in (3, 9, 20, len(data) - 1):
        with pytest.raises(ValueError):
            records.unframed(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], offsets)


def test_files_hold_all_rows_in_order(spark, docs, rows, empty):
    folder = fresh_path(spark, "test-records")
    manifest = records.write_records(docs, PATH, folder, shards=3)
    order = {r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    library, start, want = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, order[r[1] or ""])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in records.described(spark, folder).orderBy("start").collect()] == want
    number = 0
    for m in manifest:
        for k in range(0, m["records"], 7):
            doc_id, ids = records.read_record(folder, m["file"], k)
            assert (doc_id, len(ids)) == (want[number + k][0], want[number + k][2])
        number += m["records"]
    folder = fresh_path(spark, "test-records")
    records.write_records(empty, PATH, folder)
    assert records.described(spark, folder).count() == 0


def test_rows_of_one_id_are_dealt_to_several_files(spark):
    df = spark.createDataFrame([(None, "same text")] * 300 + [(5, f"text {k}") for k in range(300)], "doc_id int, text string").repartition(4)
    folder = fresh_path(spark, "test-records")
    manifest = records.write_records(df, PATH, folder, shards=6)
    assert max(m["records"] for m in manifest) < 250
    found = records.described(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None] * 300 + [5] * 300
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))
