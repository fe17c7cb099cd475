"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

Logarithmic codes expand by lookup in tables of 256 entries.  ADPCM is sequential inside a block but blocks are
independent, so the k-th code of all blocks is decoded at once.  Resampling is a polyphase low-pass filter in whole numbers,
so it does not depend on how samples are cut.  Recordings are worked on in pieces, with as many samples on either side as the
filter reaches, and their PCM is stored in rows of one piece each: what is held beside a recording itself is bounded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from hashlib import sha256
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, fresh_path, removed, written

RATE, OUT_RATE = 8000, 16000
#: Payloads are whole blocks of so many bytes; an ADPCM block of this size holds one header and 376 more samples.
BLOCK = 192
# Format tags of the container, and the step sizes and index changes of IMA ADPCM.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: ADPCM blocks decoded together; bounds the memory for a long recording.
TOGETHER = 1 << 15
#: Samples of a recording that are decoded and resampled at once, and that one row of PCM has at most: whole ADPCM blocks.
PIECE = 4096 * BLOCK
#: Bytes of pieces that are decoded together.
GROUP = 4 << 20
#: Samples on either side that the filter reaches at the lower rate.
HALF = 8


@lru_cache(2)
def expansion(law: int) -> np.ndarray:
    """PCM of each of the 256 codes of mu-law or A-law."""
    code = np.arange(256)
    if law == MULAW:
        code = ~code & 0xFF
        size = ((((code & 15) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
        return np.where(code & 0x80, -size, size).astype(np.int16)
    code = code ^ 0x55
    part, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part > 0, (size + 0x100) << np.maximum(part - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def decode_adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """IMA ADPCM blocks (mono): a 16-bit first sample, a step index, then codes, low half of each byte first.

    An incomplete last block is left out; a step index above 88 counts as 88.
    """
    blocks = data[: len(data) // block * block].reshape(-1, block)
    out = np.empty((len(blocks), 2 * (block - 4) + 1), np.int16)
    for at in range(0, len(blocks), TOGETHER):
        b = blocks[at : at + TOGETHER]
        value = b[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
        index = np.minimum(b[:, 2], 88).astype(np.int32)
        codes = np.empty((2 * (block - 4), len(b)), np.uint8)
        codes[0::2], codes[1::2] = b[:, 4:].T & 15, b[:, 4:].T >> 4
        rows = np.empty((len(codes) + 1, len(b)), np.int16)
        rows[0] = value
        for k, code in enumerate(codes):
            step = STEPS[index]
            # half a step more than the code's low bits, in units of an eighth, each part rounded down
            change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + CHANGES[code], 0, 88)
            rows[k + 1] = value
        out[at : at + TOGETHER] = rows.T
    return out.reshape(-1)


@lru_cache(8)
def taps(up: int, down: int, half: int = HALF) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both rates, one row a phase, each summing to 2 ** 14."""
    cut = 1 / max(up, down)
    n = np.arange(-half * up, half * up + 1)
    h = np.sinc(n * cut) * np.hanning(len(n) + 2)[1:-1]
    rows = np.zeros((up, 2 * half + 1))
    for p in range(up):
        row = h[p::up]
        rows[p, : len(row)] = row / row.sum()
    whole = np.rint(rows * (1 << 14)).astype(np.int32)
    whole[np.arange(up), np.abs(whole).argmax(1)] += (1 << 14) - whole.sum(1, dtype=np.int32)
    return whole


def filtered(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All phases of samples that have as many more on either side as the filter reaches, in turn."""
    reach, wide = rows.shape[1] - 1, x.astype(np.int32)
    n = len(x) - reach
    out = np.empty((n, len(rows)), np.int16)
    for p, row in enumerate(rows):
        total = np.full(n, 1 << 13, np.int32)
        for k in np.flatnonzero(row).tolist():
            total += row[k] * wide[reach - k : reach - k + n]
        out[:, p] = np.clip(total >> 14, -32768, 32767)
    return out.reshape(-1)


def resampled(n: int, samples: Callable[[int, int], np.ndarray], rate: int, out_rate: int, piece: int = PIECE) -> Iterator[np.ndarray]:
    """16-bit samples at another rate, piece by piece; ``samples`` gives those from one place to another of ``n``."""
    common = int(np.gcd(rate, out_rate))
    up, down = out_rate // common, rate // common
    rows = taps(up, down)
    reach, step = (rows.shape[1] - 1) // 2, piece // down * down  # a piece starts where a sample of the output stands
    for at in range(0, n, step):
        stop = min(n, at + step)
        if up == down:
            yield samples(at, stop)
            continue
        first, last = max(0, at - reach), min(n, stop + reach)
        x = np.concatenate([np.zeros(first - (at - reach), np.int16), samples(first, last), np.zeros(stop + reach - last, np.int16)])
        yield filtered(x, rows)[::down]


def resample(pcm: np.ndarray, rate: int, out_rate: int, piece: int = PIECE) -> np.ndarray:
    """16-bit samples at another rate."""
    return np.concatenate([np.zeros(0, np.int16), *resampled(len(pcm), lambda a, b: pcm[a:b], rate, out_rate, piece)])


def container(tag: int, data: bytes, rate: int = RATE, block: int = 1) -> bytes:
    """A RIFF file of one channel."""
    bits = {PCM: 16, ADPCM: 4}.get(tag, 8)
    if tag == ADPCM:
        extra = struct.pack("<HH", 2, 2 * (block - 4) + 1)
        each = rate * block // (2 * (block - 4) + 1)
    else:
        extra, block, each = (b"" if tag == PCM else struct.pack("<H", 0)), bits // 8, rate * bits // 8
    fmt = struct.pack("<HHIIHH", tag, 1, rate, each, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, memoryview]:
    """(tag, rate, block size, data) of a RIFF file; ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found.setdefault(name, memoryview(media)[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    if b"fmt " not in found or b"data" not in found:
        raise ValueError("no format or no data")
    tag, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    return tag, rate, block, found[b"data"]


def pcm_of(tag: int, data: memoryview, block: int = BLOCK) -> np.ndarray:
    """16-bit samples of stored data."""
    raw = np.frombuffer(data, np.uint8)
    if tag in (MULAW, ALAW):
        return expansion(tag)[raw]
    if tag == ADPCM:
        return decode_adpcm(raw, block)
    if tag == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    raise ValueError(f"unknown format {tag}")


def to_pcm(df: DataFrame, media: str = "media", *, out_rate: int = OUT_RATE) -> DataFrame:
    """Adds ``pcm``: the media column (RIFF with mu-law, A-law, IMA ADPCM or PCM) as 16-bit PCM at ``out_rate`` in a RIFF file.

    Null media, and media that can't be read, give null; empty recordings give an empty one.  A column ``pcm`` that is
    there already is replaced.
    """
    keep = [c for c in df.columns if c != "pcm"]
    shape = df.select(*keep).schema.add("pcm", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(keep.index(media)):
                try:
                    tag, rate, block, data = parse(value.as_py() or b"")
                    out.append(container(PCM, resample(pcm_of(tag, data, block), rate, out_rate).astype("<i2").tobytes(), out_rate))
                except (ValueError, struct.error):
                    out.append(None)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], shape.names)

    return df.select(*keep).mapInArrow(run, shape)


class Loudness:
    """Root of the mean square, peak, and sign changes of samples that come in pieces."""

    def __init__(self):
        self.n, self.squares, self.peak, self.changes, self.last = 0, 0, 0, 0, None

    def add(self, pcm: np.ndarray) -> None:
        wide, below = pcm.astype(np.int64), pcm < 0
        self.n, self.squares = self.n + len(pcm), self.squares + int((wide * wide).sum())
        self.peak = max(self.peak, int(np.abs(wide).max()))
        self.changes += int(np.count_nonzero(below[1:] != below[:-1])) + int(self.last is not None and self.last != below[0])
        self.last = bool(below[-1])

    def __str__(self) -> str:
        return f"{isqrt(self.squares // max(1, self.n))}/{self.peak}/{self.changes}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's bytes, padded with spaces to whole blocks, as mu-law samples in a RIFF
    file; a table in the shared folder, read again."""
    shape = docs.select("doc_id").schema.add("n_bytes", T.LongType()).add("media", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode("utf-8", "replace")
                sizes.append(len(raw))
                media.append(container(MULAW, raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], shape.names)

    return written(docs.select("doc_id", "text").mapInArrow(run, shape), "media")


def loudness(data: Sequence[memoryview], piece: int = PIECE) -> list[str]:
    """Of some recordings their loudness read as mu-law, as A-law and as ADPCM blocks, which are decoded together."""
    found = [{tag: Loudness() for tag in (MULAW, ALAW, ADPCM)} for _ in data]
    waiting, size = [], 0

    def decode() -> None:
        together = decode_adpcm(np.concatenate([np.zeros(0, np.uint8), *(x for _, x in waiting)]))
        at = 0
        for k, x in waiting:
            n = len(x) // BLOCK * (2 * (BLOCK - 4) + 1)
            if n:
                found[k][ADPCM].add(together[at : at + n])
            at += n

    for k, d in enumerate(data):
        for at in range(0, len(d), piece):
            raw = np.frombuffer(d[at : at + piece], np.uint8)
            for tag in (MULAW, ALAW):
                found[k][tag].add(expansion(tag)[raw])
            waiting.append((k, raw[: len(raw) // BLOCK * BLOCK]))
            size += len(raw)
            if size >= GROUP:
                decode()
                waiting, size = [], 0
    decode()
    return [f"mulaw={x[MULAW]};alaw={x[ALAW]};adpcm={x[ADPCM]}" for x in found]


DIGESTS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "loudness")


def decoded(media: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """Digests of what was stored, and its samples at OUT_RATE as 16-bit PCM: a table at ``path``, read again.

    A recording has a row for each piece of PCM: ``row`` (its number), ``part``, ``pcm``; part 0 has doc_id, n_bytes and the
    digests.
    """
    shape = media.select("doc_id", "n_bytes").schema
    for name, kind in zip(DIGESTS, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()), strict=True):
        shape = shape.add(name, kind)
    shape = shape.add("row", T.LongType()).add("part", T.LongType()).add("pcm", T.BinaryType())
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The first rows of some recordings."""
        files = [m.as_py() for m in batch.column(2)]
        parsed = [parse(held) for held in files]
        rows = []
        for row, held, (_, rate, _, d), loud in zip(batch.column(3).to_pylist(), files, parsed, loudness([d for *_, d in parsed], piece), strict=True):
            rows.append((len(d), sha256(d).hexdigest(), crc32(d[-16:]), len(held), sha256(held).hexdigest(), loud, row, 0, next(parts(d, rate), b"")))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], shape.names)

    def parts(d: memoryview, rate: int) -> Iterator[bytes]:
        return (x.astype("<i2").tobytes() for x in resampled(len(d), lambda a, b: expansion(MULAW)[np.frombuffer(d[a:b], np.uint8)], rate, OUT_RATE, piece))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([0, *(len(m.as_buffer()) for m in batch.column(2))])
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(size, size[start] + GROUP, side="right")) - 1)
                some = batch.slice(start, stop - start)
                first = rows_of(some)
                yield first
                for k in range(some.num_rows):
                    if size[start + k + 1] - size[start + k] > piece:
                        _, rate, _, d = parse(some.column(2)[k].as_py())
                        for part, pcm in enumerate(parts(d, rate)):
                            if part:
                                empty = [pa.nulls(1, t) for t in first.schema.types[: 2 + len(DIGESTS)]]
                                yield pa.record_batch([*empty, pa.array([some.column(3)[k].as_py()]), pa.array([part]), pa.array([pcm], pa.binary())], shape.names)
                start = stop

    numbered = media.select("doc_id", "n_bytes", "media", F.monotonically_increasing_id().alias("row"))
    # small row groups: a task holds one while it writes or reads
    numbered.mapInArrow(run, shape).write.options(**{"compression": "zstd", "parquet.block.size": GROUP}).parquet(path)
    return media.sparkSession.read.schema(shape).parquet(path)


def features(pcm: DataFrame) -> DataFrame:
    """One row a recording of a table of ``decoded``: doc_id, n_bytes, the digests and ``feature``."""
    each = F.struct("part", F.crc32("pcm").alias("crc"))
    found = pcm.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_bytes", *DIGESTS)), F.sum(F.octet_length("pcm") / 2).cast("long").alias("samples"), F.array_sort(F.collect_list(each)).alias("crcs"))
    checked = F.lower(F.lpad(F.hex(F.crc32(F.array_join(F.transform("crcs", lambda c: c["crc"]), ","))), 8, "0"))
    feature = F.concat("loudness", F.lit(";pcm16k="), "samples", F.lit("/"), checked)
    return found.select("doc_id", "n_bytes", *DIGESTS[:-1], feature.alias("feature"))


def described(media: DataFrame, piece: int = PIECE, slices: int = 8) -> DataFrame:
    """Digests of what was stored, and features of what it decodes to.

    ``feature`` has loudness (root mean square / peak / sign changes) of the samples read as mu-law, as A-law and as ADPCM
    blocks, then the length and the crc32 (of that of each piece) of the PCM at 16 kHz, read from where it was stored.  PCM
    takes some seven times the room of mu-law, so it is made for a slice of the files of ``media`` after the other, and goes
    when its features are written; ``decoded`` makes PCM to keep.
    """
    spark, files, found = media.sparkSession, sorted(media.inputFiles()), []
    for some in (files[k::slices] for k in range(min(slices, len(files)))):
        path = fresh_path(spark, "pcm")
        found.append(written(features(decoded(spark.read.schema(media.schema).parquet(*some), path, piece)), "features"))
        removed(spark, path)
    return reduce(DataFrame.unionAll, found)


def op4_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a recording that is stored, read back, decoded and resampled to PCM that is stored and read back.

    Null texts count as empty (one block of spaces); a very long text is one recording, whose PCM has several rows; equal
    texts have equal values; null and repeated ids are kept; an empty table gives no rows; other columns are not read.
    """
    return described(stored(documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))))
