"""Media columns of MPEG audio.

``encode`` puts bytes into a valid MPEG-1 Layer III stream, losslessly, in the ancillary data of silent
frames; ``index`` reads any MPEG audio stream: it skips and parses tags, resynchronises on lost frame
headers, reads Xing/Info and VBRI tables, verifies checksums and gives the exact duration and the
offset of every frame. ``store_audio`` and ``index_audio`` apply both to a DataFrame.

Defined results: a null text is an empty text; an empty payload is one unit of bytes 255; a null media
value has no frames and an empty payload; equal texts give equal bytes; repeated rows stay repeated;
extra columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

UNIT = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, samples a second by index.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ 0x8005 if value & 0x8000 else value << 1
        out.append(value & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    value = 0xFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    return value


@lru_cache(4096)
def header(four: bytes) -> tuple[int, int, int, int, int, int, bool] | None:
    """(version bits, layer, Hz, frame bytes, samples, side-info bytes, protected), None if it is no frame header."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = (four[1] >> 3) & 3, 4 - ((four[1] >> 1) & 3)
    rate, hertz, pad = four[2] >> 4, (four[2] >> 2) & 3, (four[2] >> 1) & 1
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or four[3] & 3 == 2:
        return None
    first = version == 3
    kbits, hz = RATES[(1 if first else 2, layer)][rate], HERTZ[version][hertz]
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    size = (12_000 * kbits // hz + pad) * 4 if layer == 1 else samples * 125 * kbits // hz + pad
    mono = four[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return version, layer, hz, size, samples, side, not four[1] & 1


# Fixed values of the standards: bits of an allocation by subband of Layer II, (bits, subbands) in order.
_ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}


def _layer2_bits(version: int, hz: int, kbits: int, channels: int) -> list[int]:
    each = kbits // channels
    if version != 3:
        name = "low"
    elif each <= 48:
        name = "d" if hz == 32000 else "c"
    else:
        name = "a" if hz == 48000 or each <= 80 else "b"
    return [bits for bits, n in _ALLOCATION[name] for _ in range(n)]


def protected_bits(frame: bytes) -> tuple[bytes, int] | None:
    """What a frame's checksum covers behind its header: bytes and how many bits of them; None if the frame is too short."""
    version, layer, hz, _, _, side, _ = header(frame[:4])
    mode = frame[3] >> 6
    channels = 1 if mode == 3 else 2
    if layer == 3:
        return (frame[6 : 6 + side], 8 * side) if len(frame) >= 6 + side else None
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if mode == 1 else 32
    if layer == 1:
        bound = min(bound, 32)
        used = 4 * (channels * bound + 32 - bound)
    else:
        bits = _layer2_bits(version, hz, RATES[(1 if version == 3 else 2, 2)][frame[2] >> 4], channels)
        body, used, extra = int.from_bytes(frame[6:], "big"), 0, 0
        total = 8 * (len(frame) - 6)
        for band, n in enumerate(bits):
            shared = channels == 2 and band >= bound
            for _ in range(1 if shared else channels):
                if used + n > total:
                    return None
                held = body >> (total - used - n) & ((1 << n) - 1)
                used, extra = used + n, extra + (2 * (2 if shared else 1) if held else 0)
        used += extra
    return (frame[6 : 6 + (used + 7) // 8], used) if len(frame) >= 6 + (used + 7) // 8 else None


def checksum_holds(frame: bytes) -> bool:
    """Whether the checksum of a protected frame is right."""
    found = protected_bits(frame)
    if found is None:
        return False
    body, bits = found
    value = crc16(frame[2:4] + body[: bits // 8])
    for i in range(bits % 8):  # bits of an unfinished byte
        bit = body[bits // 8] >> (7 - i) & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ bit else 0)
    return value == int.from_bytes(frame[4:6], "big")


def _frame_head(rate: int, protect: bool) -> bytes:
    """MPEG-1 Layer III, 48 kHz, mono, with an empty side information: silence."""
    head = bytes((0xFF, 0xFA if protect else 0xFB, rate << 4 | 0x04, 0xC0))
    side = bytes(17)
    return head + (struct.pack(">H", crc16(head[2:] + side)) if protect else b"") + side


_SIZES = [3 * k for k in RATES[(1, 3)]]
_HEADS = {rate: _frame_head(rate, True) for rate in range(1, 15)}
_FULL_RATE = next(r for r in range(1, 15) if _SIZES[r] >= len(_HEADS[r]) + 2 + UNIT)
_FULL_HEAD = _HEADS[_FULL_RATE] + struct.pack(">H", UNIT)
_FULL_TAIL = bytes(_SIZES[_FULL_RATE] - len(_FULL_HEAD) - UNIT)


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * ((-len(data)) % UNIT or (UNIT if not data else 0))


def encode(data: bytes) -> bytes:
    """A stream with an ID3 tag, a variable-bitrate table and one checked frame for each unit of the payload; data is padded to whole units first."""
    data = pad(data)
    frames = [_FULL_HEAD + data[i : i + UNIT] + _FULL_TAIL for i in range(0, len(data), UNIT)]
    first = _frame_head(9, False)
    total, size = len(frames), _SIZES[9] + sum(map(len, frames))
    full, lead = len(_FULL_HEAD) + UNIT + len(_FULL_TAIL), _SIZES[9]
    toc = bytes(min(255, 256 * (lead + full * (i * total // 100)) // size) for i in range(100))
    table = first + b"Xing" + struct.pack(">III", 7, total, size) + toc
    text = b"TENC\x00\x00\x00\x09\x00\x00\x03lossless"
    tag = b"ID3\x04\x00\x00" + bytes((0, 0, 0, len(text))) + text
    return tag + table + bytes(lead - len(table)) + b"".join(frames)


def _tags(data: bytes) -> tuple[int, int, dict[str, bytes]]:
    """Where audio starts and ends, and the frames of ID3v2 tags; ID3v1 and APE tags at the end are cut where no frame reaches into them."""
    start, end, found = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        major, at, stop = data[start + 3], start + 10, min(start + 10 + size, end)
        while major in (3, 4) and at + 10 <= stop and data[at] != 0:
            raw = data[at + 4 : at + 8]
            n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
            found.setdefault(data[at : at + 4].decode("latin-1"), data[at + 10 : min(at + 10 + n, stop)])
            at += 10 + n
        start = stop + (10 if data[start + 5] & 0x10 else 0)
    start = min(start, end)
    id3v1 = end - 128 if end - start >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    cuts = [id3v1, end]
    for stop in cuts[: 2 if id3v1 < end else 1]:  # an APE tag is before the ID3v1 tag, or at the end
        if stop - start >= 32 and data[stop - 32 : stop - 24] == b"APETAGEX":
            size, _, flags = struct.unpack("<III", data[stop - 20 : stop - 8])
            cuts.append(max(start, stop - size - (32 if flags >> 31 else 0)))
    if min(cuts) < end:
        reach = _reach(data, start, cuts)
        end = min(c for c in cuts if c >= min(reach, end))
        if end <= id3v1 < len(data):
            found.setdefault("ID3v1", data[id3v1:])
    return start, end, found


def _reach(data: bytes, start: int, cuts: list[int]) -> int:
    """Behind the last whole frame, or that which a tag follows: bytes of payload that look like a tag are before it."""
    at, kind, last = start, None, start
    while at + 4 <= len(data):
        info = header(data[at : at + 4])
        if info and (kind is None or info[:3] == kind) and at + info[3] <= len(data):
            after = at + info[3]
            follow = header(data[after : after + 4])
            held = info[6] and checksum_holds(data[at : at + info[3]])
            tail = data[after : after + 3] == b"TAG" or data[after : after + 8] == b"APETAGEX"
            if after == len(data) or held or tail or (follow and follow[:3] == info[:3]) or (kind and len(data) - after < 4):
                kind, at, last = info[:3], after, after
                if after in cuts and not follow:
                    break
                continue
        step = data.find(b"\xff", at + 1)
        at = len(data) if step < 0 else step
    return last


def _vbr(data: bytes, at: int, info: tuple) -> dict | None:
    """The variable-bitrate table in the frame at ``at``."""
    spot = at + 4 + info[5]
    for skip in (0, 2):
        kind = data[spot + skip : spot + skip + 4]
        if kind in (b"Xing", b"Info"):
            p = spot + skip + 8
            flags = int.from_bytes(data[p - 4 : p], "big")
            out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit:
                    out[name] = data[p : p + n] if n > 4 else int.from_bytes(data[p : p + n], "big")
                    p += n
            return out
    if data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 62:
        size, frames = struct.unpack(">II", data[at + 46 : at + 54])
        n, scale, width, step = struct.unpack(">HHHH", data[at + 54 : at + 62])
        cells = [int.from_bytes(data[at + 62 + i * width : at + 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": cells, "step": step}
    return None


def index(data: bytes) -> dict:
    """Frames of a stream: offsets, sizes, samples, checks; a header counts if another of its kind, or the end, follows it."""
    start, end, tags = _tags(data)
    offsets: list[int] = []
    infos: list[tuple] = []
    good = bad = lost = 0
    table, at, kind = None, start, None
    while at + 4 <= end:
        info = header(data[at : at + 4])
        if info and (kind is None or info[:3] == kind) and at + info[3] <= end:
            after = at + info[3]
            follow = header(data[after : after + 4]) if after + 4 <= end else None
            if after == end or (follow and follow[:3] == info[:3]) or (offsets and end - after < 4):
                if not offsets and table is None and (table := _vbr(data, at, info)):
                    kind, at = info[:3], after
                    continue
                if info[6]:
                    right = checksum_holds(data[at : at + info[3]])
                    good, bad = good + right, bad + (not right)
                offsets.append(at)
                infos.append(info)
                kind, at = info[:3], after
                continue
        # the last frame before a damaged stretch has no follower: it counts if its checksum holds
        if info and kind == info[:3] and info[6] and at + info[3] <= end and checksum_holds(data[at : at + info[3]]):
            offsets.append(at)
            infos.append(info)
            good, at = good + 1, at + info[3]
            continue
        step = data.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        lost, at = lost + step - at, step
    samples = sum(i[4] for i in infos)
    return {"offsets": offsets, "infos": infos, "samples": samples, "hertz": infos[0][2] if infos else 0, "crc_good": good, "crc_bad": bad, "lost": lost, "vbr": table, "tags": tags}


def decode(data: bytes, found: dict) -> bytes:
    """The payload of a stream made by ``encode``: what its frames hold, nothing added."""
    out = []
    for at, info in zip(found["offsets"], found["infos"], strict=True):
        p = at + 4 + 2 * info[6] + info[5]
        n = int.from_bytes(data[p : p + 2], "big")
        out.append(data[p + 2 : p + 2 + n])
    return b"".join(out)


def _feature(found: dict, payload: bytes) -> str:
    """Frames, duration, rate and an eight-step envelope of the samples around their middle."""
    wave = np.abs(np.frombuffer(payload, np.uint8).astype(np.int16) - 128) if payload else np.zeros(0)
    steps = ",".join(str(int(part.sum() * 100 // max(1, part.size))) for part in np.array_split(wave, 8))
    vbr = found["vbr"]["frames"] if found["vbr"] else "-"
    return f"frames={len(found['offsets'])};table={vbr};samples={found['samples']}/{found['hertz']};crc={found['crc_good']}-{found['crc_bad']};lost={found['lost']};env={steps}"


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an MPEG stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [(x or "").encode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(x) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


INDEX = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate int, duration_seconds double, crc_good long, crc_bad long, lost_bytes long, vbr_kind string, vbr_frames long, seek_offsets array<int>"


def index_audio(media: DataFrame) -> DataFrame:
    """Reads stored streams back: one row each with digests, exact duration (n_samples / sample_rate), checks and the offset of every frame."""

    def row(doc_id, n_bytes, data):
        data = data or b""
        found = index(data)
        payload = decode(data, found)
        hz, vbr = found["hertz"], found["vbr"] or {}
        return (
            doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), _feature(found, payload),
            len(found["offsets"]), found["samples"], hz, found["samples"] / hz if hz else 0.0, found["crc_good"], found["crc_bad"], found["lost"], vbr.get("kind"), vbr.get("frames"), found["offsets"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32())]
        names = [x.split()[0] for x in INDEX.split(", ")]
        for part in slices(batches):
            rows = [row(*x) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, INDEX)
