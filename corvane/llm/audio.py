"""Media columns: telephony audio.

Stored forms are RIFF files of 8-bit mu-law or A-law samples, IMA ADPCM blocks or 16-bit PCM. Reading
expands the companded forms by lookup tables and decodes ADPCM with numpy across blocks: step t of all
blocks of a batch at once. Decoded samples are resampled by linear interpolation and stored as PCM.

``payload`` turns a text into bytes of whole blocks; mu-law samples keep any bytes as they are, so a
stored payload is read back losslessly. Features come from the bytes read back: statistics of both
companded readings and of the ADPCM reading from the media, checksum and digest from the resampled PCM,
which is written beside them and read back in its turn.

Null and empty texts give one block of filler. Equal bytes give equal values, and repeated rows one
row each; an empty table gives none. Texts are worked through in runs of blocks, whatever their length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Workspace, texts

RATE, BLOCK, FILLER = 8000, 576, 255
#: RIFF format codes.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
#: Changes of the IMA ADPCM step index by the code's low three bits.
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int16)
#: IMA ADPCM step sizes.
STEPS = np.array(
    # fmt: off
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
     2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    # fmt: on
    np.int32,
)
#: Blocks decoded at once.
AT_ONCE = 4096
#: Parts in which the PCM form is written, read back and given up: it takes twice the room of compressed media.
PARTS = 3


@cache
def mulaw() -> np.ndarray:
    """PCM of each mu-law byte: inverted bits, three of exponent, four of mantissa, bias 33 << 2."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@cache
def alaw() -> np.ndarray:
    """PCM of each A-law byte: even bits inverted, three of exponent, four of mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


@cache
def moves() -> tuple[np.ndarray, np.ndarray]:
    """By step index and code: the change of the predictor and the next index."""
    code, step = np.arange(16), STEPS[:, None]
    size = (step >> 3) + ((code & 1) > 0) * (step >> 2) + ((code & 2) > 0) * (step >> 1) + ((code & 4) > 0) * step
    change = np.where(code & 8, -size, size).astype(np.int32)
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX[code & 7], 0, len(STEPS) - 1).astype(np.int32)
    return change.ravel(), after.ravel()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples, block by row, of IMA ADPCM mono blocks (uint8, block by row, four bytes of head)."""
    change, after = moves()
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    now = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = now
    codes = np.empty((2 * (size - 4), n), np.uint8)
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    for t in range(len(codes)):
        cell = index * 16 + codes[t]
        now = np.clip(now + change[cell], -32768, 32767)
        index = after[cell]
        out[t + 1] = now
    return out.T


def companded(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The byte whose expansion by ``table`` is nearest to each sample; the smaller expansion on ties."""
    order = np.argsort(table, kind="stable")
    levels = table[order].astype(np.int32)
    right = np.clip(np.searchsorted(levels, x), 1, len(levels) - 1)
    wide = x.astype(np.int32)
    return order[right - (wide - levels[right - 1] <= levels[right] - wide)].astype(np.uint8)


def adpcm_blocks(x: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """IMA ADPCM mono blocks of samples, all blocks at once; the last block repeats the last sample."""
    each = 1 + 2 * (size - 4)
    count = -(-len(x) // each)
    if not count:
        return np.empty((0, size), np.uint8)
    wide = np.concatenate([x, np.repeat(x[-1:], count * each - len(x))]).reshape(count, each).astype(np.int32)
    out = np.zeros((count, size), np.uint8)
    out[:, :2] = wide[:, 0].astype("<i2")[:, None].view(np.uint8)
    change, after = moves()
    now, index = wide[:, 0].copy(), np.zeros(count, np.int32)
    # a start near the first steps' size
    first = np.abs(np.diff(wide[:, : min(16, each)], axis=1)).max(1, initial=0)
    index[:] = np.clip(np.searchsorted(STEPS, first // 2), 0, len(STEPS) - 1)
    out[:, 2] = index
    for t in range(1, each):
        gap = wide[:, t] - now
        step = STEPS[index]
        code = np.where(gap < 0, 8, 0)
        gap = np.abs(gap)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = gap >= part
            code |= np.where(on, bit, 0)
            gap = np.where(on, gap - part, gap)
        cell = index * 16 + code
        now = np.clip(now + change[cell], -32768, 32767)
        index = after[cell]
        out[:, 4 + (t - 1) // 2] |= (code << (4 * ((t - 1) % 2))).astype(np.uint8)
    return out


def stored(x: np.ndarray, kind: int, rate: int = RATE) -> bytes:
    """Samples as a RIFF file of any of the forms; the companded ones and ADPCM lose precision."""
    if kind == PCM:
        return riff(PCM, x.astype("<i2").tobytes(), rate)
    if kind == ADPCM:
        return riff(ADPCM, adpcm_blocks(x).tobytes(), rate)
    return riff(kind, companded(x, mulaw() if kind == MULAW else alaw()).tobytes(), rate)


def payload(text: bytes, block: int = BLOCK) -> bytes:
    """The bytes, filled up to a positive multiple of ``block``."""
    return text + bytes([FILLER]) * (-len(text) % block if text else block)


def riff(kind: int, data: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A RIFF file of mono samples."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, ADPCM: 4}[kind]
    align = block if kind == ADPCM else bits // 8
    second = rate * block // (2 * (block - 4) + 1) if kind == ADPCM else rate * bits // 8
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", kind, 1, rate, second, align, bits) + extra
    samples = len(data) if bits == 8 else len(data) // 2 if kind == PCM else len(data) // block * (2 * (block - 4) + 1)
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(head)) + head + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def opened(media: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, block, data) of a RIFF file; (0, 0, 0, b"") for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return 0, 0, 0, b""
    at, kind, rate, align, data = 12, 0, 0, 0, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt " and size >= 16:
            kind, _, rate, _, align, _ = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return kind, rate, align, data


def samples(media: bytes) -> tuple[np.ndarray, int]:
    """(int16 samples, rate) of a stored form."""
    kind, rate, align, data = opened(media)
    if kind == MULAW:
        return mulaw()[np.frombuffer(data, np.uint8)], rate
    if kind == ALAW:
        return alaw()[np.frombuffer(data, np.uint8)], rate
    if kind == ADPCM and align > 4:
        blocks = np.frombuffer(data[: len(data) // align * align], np.uint8).reshape(-1, align)
        return (np.concatenate([adpcm(blocks[i : i + AT_ONCE]).ravel() for i in range(0, len(blocks), AT_ONCE)]) if len(blocks) else np.empty(0, np.int16)), rate
    return (np.frombuffer(data[: len(data) // 2 * 2], "<i2") if kind == PCM else np.empty(0, np.int16)), rate


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate; whole multiples are interpolated in integers."""
    if rate == to or not len(x):
        return x
    if to % rate == 0:
        n, wide = to // rate, x.astype(np.int32)
        ahead = np.append(wide[1:], wide[-1:])
        return ((wide[:, None] * np.arange(n, 0, -1) + ahead[:, None] * np.arange(n)) // n).astype(np.int16).ravel()
    at = np.arange(len(x) * to // rate) * (rate / to)
    return np.round(np.interp(at, np.arange(len(x)), x)).astype(np.int16)


def store_pcm(media: bytes, to: int = 16_000) -> bytes:
    """The stored form's samples, resampled, as a RIFF file of PCM."""
    x, rate = samples(media)
    return riff(PCM, resampled(x, rate or to, to).astype("<i2").tobytes(), to)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` written in the shared folder and read again."""
    return Workspace(docs.sparkSession, "media").save(encode(docs, id_col, text_col), "media", "zstd")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as mu-law samples."""
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = list(texts(part))
                media = [riff(MULAW, payload(t)) for t in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return chosen.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(media: DataFrame, to: int = 16_000) -> DataFrame:
    """``media`` (with a binary column media) and pcm, the resampled PCM form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                raw = part.column(part.schema.get_field_index("media"))[0].as_py()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if raw is None else store_pcm(raw, to)], pa.binary())], names=[*part.schema.names, "pcm"])

    return media.mapInArrow(run, StructType([*media.schema.fields, StructField("pcm", BinaryType())]))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
FEATURES_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in FEATURES.split(", ")])
#: What the media alone give, and the PCM form made from them.
MEASURED_ARROW = pa.schema([*list(FEATURES_ARROW)[:-2], ("pcm", pa.binary())])
MEASURED = FEATURES.rsplit(", ", 2)[0] + ", pcm binary"


def described(group: list[bytes]) -> list[tuple[str, bytes]]:
    """(features, resampled PCM form) of stored forms; the blocks of all of them are decoded together."""
    data = [opened(m)[3] for m in group]
    blocks = [len(d) // BLOCK for d in data]
    every = np.frombuffer(b"".join(data), np.uint8).reshape(-1, BLOCK)
    owner = np.repeat(np.arange(len(data)), blocks)
    total, peak = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    for at in range(0, len(every), AT_ONCE):
        wide = adpcm(every[at : at + AT_ONCE]).astype(np.int32)
        own = owner[at : at + AT_ONCE]
        np.add.at(total, own, np.abs(wide).sum(1, dtype=np.int64))
        np.maximum.at(peak, own, np.abs(wide).max(1))
    out = []
    for i, m in enumerate(group):
        x, rate = samples(m)
        y = alaw()[np.frombuffer(data[i], np.uint8)]
        counts = np.bincount(np.frombuffer(data[i], np.uint8), minlength=256)
        u, a = mulaw().astype(np.int64), alaw().astype(np.int64)
        crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        feature = f"seconds={len(x) / rate:.3f};mulaw_power={int(counts @ (u * u)) // len(x)};alaw_power={int(counts @ (a * a)) // len(y)};crossings={crossings};adpcm_mean={total[i] // (blocks[i] * (2 * (BLOCK - 4) + 1))};adpcm_peak={peak[i]}"
        out.append((feature, riff(PCM, resampled(x, rate, 2 * rate).astype("<i2").tobytes(), 2 * rate)))
    return out


def measured(media: DataFrame) -> DataFrame:
    """MEASURED from stored media: what they give, and their resampled PCM form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            column = batch.column(2)
            while at < batch.num_rows:
                group, size, begin = [], 0, at
                while at < batch.num_rows and size < AT_ONCE * BLOCK:
                    group.append(column[at].as_py())
                    size += len(group[-1])
                    at += 1
                data = [opened(m)[3] for m in group]
                rows = [(len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-32:]), len(m), hashlib.sha256(m).hexdigest(), *f) for d, m, f in zip(data, group, described(group))]
                part = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), t) for c, t in zip(zip(*rows), MEASURED_ARROW.types[2:]))], schema=MEASURED_ARROW)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, MEASURED)


def digested(stored_pcm: DataFrame) -> DataFrame:
    """FEATURES from rows of MEASURED whose PCM form has been read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for feature, form in zip(batch.column(7).to_pylist(), batch.column(8)):
                pcm = form.as_py()
                rows.append((f"{feature};pcm_crc32={zlib.crc32(opened(pcm)[3])}", len(pcm), hashlib.sha256(pcm).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], *(pa.array(list(c), t) for c, t in zip(zip(*rows), FEATURES_ARROW.types[7:]))], schema=FEATURES_ARROW)

    return stored_pcm.mapInArrow(run, FEATURES)


def features(media: DataFrame, parts: int = PARTS) -> DataFrame:
    """FEATURES from the stored bytes read back. The PCM form of a part of the media is written, read back and given up before the next one's; ``decoded`` keeps it."""
    space, out = Workspace(media.sparkSession, "pcm"), []
    for part in range(parts):
        own = media.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part)
        pcm = space.save(measured(own), f"pcm{part}", "zstd")
        out.append(space.save(digested(pcm), f"features{part}"))
        space.drop(f"pcm{part}")
    return reduce(DataFrame.unionAll, out)
