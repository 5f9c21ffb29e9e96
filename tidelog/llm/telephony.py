"""Telephony audio columns: mu-law, A-law and block ADPCM in WAV containers, and resampled PCM.

``store`` keeps a payload of bytes losslessly as the samples of a WAV file: for the two logarithmic
laws a byte is a sample, for ADPCM 192 payload bytes are the 384 nibbles of a block that follow the
block's header (predictor 0, step index 0). ``load`` walks the chunks of a stored file and gives the
payload back. ``decode`` expands the stored samples to linear PCM, the laws by tables of 256 entries,
ADPCM with one numpy step for each nibble position over all blocks of all files of a slice.

A null or empty text is a payload of 192 spaces. Equal payloads give equal files: the law is chosen by
the payload's CRC-32. Files are independent of each other, so repeated rows, ties and any order give
equal values; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import id_text, map_steps

RATE, TARGET_RATE, BLOCK = 8000, 16000, 192
MULAW, ALAW, ADPCM = 7, 6, 17  # format tags of the WAV container
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
#: How a 4-bit code moves the step index of the 4-bit block ADPCM format.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: The step sizes of that format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte: sign, 3-bit segment and 4-bit step, all inverted, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte; even bits are inverted, a set top bit means positive."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, size + 8, size + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


LAWS = {MULAW: mulaw_table(), ALAW: alaw_table()}


def padded(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def law_of(payload: bytes) -> int:
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def store(payload: bytes, law: int) -> bytes:
    """A WAV file whose samples are the payload; for ADPCM its length is a multiple of 192."""
    if law == ADPCM:
        blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data = np.concatenate([np.zeros((len(blocks), 4), np.uint8), blocks], axis=1).tobytes()
        samples, per_block = len(blocks) * (2 * BLOCK + 1), 2 * BLOCK + 1
        fmt = struct.pack("<HHIIHHHH", law, 1, RATE, RATE * (BLOCK + 4) // per_block, BLOCK + 4, 4, 2, per_block)
    else:
        data, samples = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", law, 1, RATE, RATE, 1, 8, 0)
    body = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def chunks_of(media: bytes) -> dict[bytes, bytes]:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    found, at = {}, 12
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return found


def load(media: bytes) -> tuple[int, bytes]:
    """The law of a stored file, and its payload read back."""
    found = chunks_of(media)
    law, data = struct.unpack_from("<H", found[b"fmt "])[0], found[b"data"]
    if law == ADPCM:
        (align,) = struct.unpack_from("<H", found[b"fmt "], 12)
        data = np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()
    return law, data


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks (one a row, header first), one step for all blocks at a time."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    out[:, 0] = value
    for k, codes in enumerate(np.ascontiguousarray(blocks[:, 4:].T), 0):
        for half, code in ((0, codes & 15), (1, codes >> 4)):
            step = STEPS[index]
            move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + INDEX_MOVES[code], 0, 88)
            out[:, 1 + 2 * k + half] = value
    return out


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Linear PCM of stored files."""
    out: list = [None] * len(files)
    waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        found = chunks_of(media)
        law, data = struct.unpack_from("<H", found[b"fmt "])[0], np.frombuffer(found[b"data"], np.uint8)
        if law == ADPCM:
            (align,) = struct.unpack_from("<H", found[b"fmt "], 12)
            waiting.setdefault(align, []).append((i, data.reshape(-1, align)))
        else:
            out[i] = LAWS[law][data]
    for together in waiting.values():
        pcm, at = adpcm_blocks(np.concatenate([b for _, b in together])), 0
        for i, blocks in together:
            out[i] = pcm[at : at + len(blocks)].reshape(-1)
            at += len(blocks)
    return out


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers; output k lies at k * rate / target, the last sample is held."""
    if rate == target or not len(pcm):
        return pcm
    if target % rate == 0:
        parts, x = target // rate, pcm.astype(np.int32)
        after = np.append(x[1:], x[-1:])
        out = np.empty((len(x), parts), np.int16)
        for k in range(parts):
            out[:, k] = (x * (parts - k) + after * k) // parts
        return out.reshape(-1)
    at = np.arange(len(pcm) * target // rate, dtype=np.int64) * rate
    left, part = at // target, at % target
    x, right = pcm.astype(np.int64), np.minimum(left + 1, len(pcm) - 1)
    return ((x[left] * (target - part) + x[right] * part) // target).astype(np.int16)


def feature_of(law: int, pcm: np.ndarray) -> str:
    """Law, samples, peak, mean square (whole), zero crossings and CRC-32 of resampled PCM."""
    wide = pcm.astype(np.float64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{NAMES[law]}:{TARGET_RATE}:{len(pcm)}:{int(np.abs(wide).max())}:{int(wide @ wide / len(pcm))}:{crossings}:{zlib.crc32(pcm.tobytes()):08x}"


def media_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row a document with the digests of its stored payload; with ``keep_media`` also the columns
    ``media`` (the WAV file) and ``pcm`` (16-bit little-endian PCM at 16 kHz)."""

    def work(part: pa.RecordBatch) -> dict:
        texts = part.column(1).cast(pa.binary()).to_pylist()
        payloads = [padded(t) for t in texts]
        files = [store(p, law_of(p)) for p in payloads]
        pcms = [resample(x, RATE, TARGET_RATE) for x in decode(files)]
        read = [load(f) for f in files]
        got = {
            "doc_id": part.column(0), "n_bytes": [len(t) for t in texts], "payload_bytes": [len(p) for _, p in read],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for _, p in read], "tail_crc32": [zlib.crc32(p[-16:]) for _, p in read],
            "media_bytes": [len(f) for f in files], "media_sha256": [hashlib.sha256(f).hexdigest() for f in files],
            "feature": [feature_of(law, pcm) for (law, _), pcm in zip(read, pcms)],
        }
        return got | ({"media": files, "pcm": [x.astype("<i2").tobytes() for x in pcms]} if keep_media else {})

    return map_steps(id_text(df, id_col, text_col), work, SCHEMA + ", media binary, pcm binary" * keep_media)
