import math
import struct
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmenta.llm import telephony as tel
from segmenta.llm.shared import fresh_path


def test_expansion_values():
    mu, a = tel.expansion(tel.MULAW), tel.expansion(tel.ALAW)
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_adpcm(block: bytes) -> list[int]:
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 7) - 6)))
            out.append(value)
    return out


def test_adpcm_equals_a_plain_decoder(monkeypatch):
    monkeypatch.setattr(tel, "TOGETHER", 3)
    data = np.random.default_rng(2).integers(0, 256, 192 * 8 + 50, dtype=np.uint8)
    want = [x for k in range(8) for x in plain_adpcm(data[192 * k : 192 * (k + 1)].tobytes())]
    assert tel.decode_adpcm(data).tolist() == want


def test_resampling_keeps_a_tone():
    t = np.arange(4000)
    tone = np.rint(9000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    wide = tel.resample(tone, 8000, 16000)
    want = 9000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert len(wide) == 8000 and np.abs(wide[200:-200] - want[200:-200]).max() < 120
    assert len(tel.resample(tone, 8000, 11025)) in (5512, 5513)


def plain_loudness(pcm):
    pcm = [int(x) for x in pcm]
    return f"{math.isqrt(sum(x * x for x in pcm) // max(1, len(pcm)))}/{max(map(abs, pcm), default=0)}/{sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))}"


def plain_wide(pcm, piece):
    """Resampling to twice the rate by loops, cut in pieces."""
    rows, reach = tel.taps(2, 1), tel.HALF
    out = []
    for i in range(len(pcm)):
        for row in rows.tolist():
            total = sum(w * int(pcm[i + reach - k]) for k, w in enumerate(row) if 0 <= i + reach - k < len(pcm))
            out.append(max(-32768, min(32767, (total + (1 << 13)) >> 14)))
    return [struct.pack(f"<{len(x)}h", *x) for x in (out[k : k + 2 * piece] for k in range(0, len(out), 2 * piece))]


@pytest.mark.parametrize("piece", [tel.PIECE, 384])
def test_features_equal_plain_decoders(spark, piece):
    texts = ["", "a", "some words here " * 40, "é🙂" * 150, "x" * 1000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: r["feature"] for r in tel.described(tel.stored(df), piece).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        mu, a = ([int(tel.expansion(tag)[x]) for x in payload] for tag in (tel.MULAW, tel.ALAW))
        blocks = [x for k in range(0, len(payload), 192) for x in plain_adpcm(payload[k : k + 192])]
        pcm = plain_wide(mu, piece)
        crc = crc32(",".join(str(crc32(x)) for x in pcm).encode())
        assert found[i] == f"mulaw={plain_loudness(mu)};alaw={plain_loudness(a)};adpcm={plain_loudness(blocks)};pcm16k={sum(map(len, pcm)) // 2}/{crc:08x}"


def test_stored_pcm_is_the_resampled_recording(spark):
    df = spark.createDataFrame([(1, "long words " * 200), (2, "short")], "doc_id long, text string")
    media = tel.stored(df)
    rows = tel.decoded(media, fresh_path(spark, "test-pcm"), 384).collect()
    assert max(r["part"] for r in rows) == 5
    for doc_id, held in media.select("doc_id", "media").collect():
        row = next(r["row"] for r in rows if r["doc_id"] == doc_id)
        pcm = b"".join(bytes(r["pcm"]) for r in sorted((r for r in rows if r["row"] == row), key=lambda r: r["part"]))
        _, rate, _, data = tel.parse(bytes(held))
        assert pcm == tel.resample(tel.pcm_of(tel.MULAW, data), rate, tel.OUT_RATE).astype("<i2").tobytes()


def test_pieces_do_not_show():
    pcm = np.random.default_rng(5).integers(-32768, 32768, 5000).astype(np.int16)
    for rate in (16000, 11025, 6000, 8000):
        assert tel.resample(pcm, 8000, rate, 960).tolist() == tel.resample(pcm, 8000, rate).tolist()


def test_query_rows(docs, rows, empty):
    found = tel.described(tel.stored(docs)).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        want[doc_id, len(raw), len(payload), sha256(payload).hexdigest(), crc32(payload[-16:])] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    values = {(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in found}
    assert len(values) == len({v[0] for v in values})
    assert tel.described(tel.stored(empty)).count() == 0


def test_to_pcm(spark):
    data = bytes(range(192))
    rows = [(1, tel.container(tel.MULAW, data)), (2, tel.container(tel.ALAW, data)), (3, tel.container(tel.ADPCM, data, block=192)), (4, None), (5, b"junk"), (6, tel.container(tel.MULAW, b""))]
    out = {r[0]: r[1] for r in tel.to_pcm(spark.createDataFrame(rows, "id long, media binary").withColumn("pcm", F.lit(1)), out_rate=8000).select("id", "pcm").collect()}
    assert out[4] is None and out[5] is None
    for k, tag in ((1, tel.MULAW), (2, tel.ALAW), (3, tel.ADPCM)):
        found = tel.parse(bytes(out[k]))
        assert found[:2] == (tel.PCM, 8000)
        assert np.array_equal(tel.pcm_of(tel.PCM, found[3]), tel.pcm_of(tag, memoryview(data), 192))
    assert len(tel.parse(bytes(out[6]))[3]) == 0
