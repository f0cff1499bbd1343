"""Operator 1, media columns: MPEG audio streams that carry a document's bytes, written and read back.

Stored form: an ID3v2 tag with the unpadded length, a frame with the variable-bitrate table, then MPEG-1
Layer I mono frames at 32 kHz.  A Layer I frame of 384 samples has 12 samples in each of 32 subbands; with 16 subbands
allocated at 8 bits a sample it holds exactly 192 payload bytes as quantised samples, so nothing is lost.
The all-ones code is forbidden in Layer I, so a frame with a byte 255 uses 9 bits a sample and the next bit rate up.

Cases: a null text is empty; an empty text gives one frame of spaces; equal texts give equal streams;
repeated rows give repeated results; a long text is one long stream; an empty table gives an empty one.
A null stream, and bytes that are no audio, read as no frames; a stream's frames of another form than the stored one are timed
and checked like any, and hold no payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import in_arrow, slices, table, texts_of

UNIT = 192
SAMPLES = 384
# Fixed values of the MPEG audio header: kbit/s by index 1..14, sample rates by version, samples a frame.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
FRAME_SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

_CRC = np.zeros(256, np.uint16)
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = ((_c << 1) ^ 0x8005) & 0xFFFF if _c & 0x8000 else _c << 1
    _CRC[_i] = _c


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG CRC-16 (polynomial 8005, start FFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        crc = ((crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ rows[:, k]]).astype(np.uint16)
    return crc


def padded(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def _head(bits: int) -> tuple[bytes, int]:
    """Header, checksum and allocation of a frame with `bits` a sample, and the frame's length."""
    header = bytes((0xFF, 0xFE, 0x58 if bits == 8 else 0x68, 0xC0))
    allocation = bytes([(bits - 1) * 17] * 8 + [0] * 8)
    crc = int(crc16(np.frombuffer(header[2:] + allocation, np.uint8)[None])[0])
    return header + struct.pack(">H", crc) + allocation + bytes(12), 240 if bits == 8 else 288


HEADS = {bits: _head(bits) for bits in (8, 9)}


def _id3(fields: dict[str, str]) -> bytes:
    body = b""
    for k, v in fields.items():
        value = b"\x00" + k.encode("latin-1") + b"\x00" + v.encode("latin-1")
        body += b"TXXX" + struct.pack(">IH", len(value), 0) + value
    n = len(body)
    return b"ID3\x03\x00\x00" + bytes(((n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127)) + body


def encode_stream(text: bytes) -> bytes:
    """The stored form of one text."""
    units = np.frombuffer(padded(text), np.uint8).reshape(-1, UNIT)
    wide = (units == 255).any(axis=1)
    lengths = np.where(wide, HEADS[9][1], HEADS[8][1]).astype(np.int64)
    offsets = np.cumsum(lengths) - lengths
    audio = np.zeros(int(lengths.sum()), np.uint8)
    for bits, rows in ((8, np.flatnonzero(~wide)), (9, np.flatnonzero(wide))):
        if not len(rows):
            continue
        head, length = HEADS[bits]
        frames = np.zeros((len(rows), length), np.uint8)
        frames[:, : len(head)] = np.frombuffer(head, np.uint8)
        if bits == 8:
            frames[:, len(head) : len(head) + UNIT] = units[rows]
        else:
            plain = np.unpackbits(units[rows][:, :, None], axis=2)
            nine = np.concatenate([np.zeros((*plain.shape[:2], 1), np.uint8), plain], axis=2)
            frames[:, len(head) : len(head) + UNIT * 9 // 8] = np.packbits(nine.reshape(len(rows), -1), axis=1)
        audio[(offsets[rows][:, None] + np.arange(length)).ravel()] = frames.ravel()
    total = 240 + len(audio)
    at = offsets[(np.arange(100) * len(offsets)) // 100] + 240
    toc = bytes((at * 256 // total).astype(np.uint8))
    first = (b"\xff\xff\x58\xc0" + bytes(17) + b"Xing" + struct.pack(">III", 7, len(units), total) + toc).ljust(240, b"\x00")
    return _id3({"n_bytes": str(len(text))}) + first + audio.tobytes()


def header_of(four: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """(layer, kbit/s, sample rate, samples, frame bytes, has checksum) of a valid header, else None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = (four[1] >> 3) & 3, 4 - ((four[1] >> 1) & 3)
    index, rate, pad = four[2] >> 4, (four[2] >> 2) & 3, (four[2] >> 1) & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kind = (1 if version == 3 else 2, layer)
    kbit, hz, samples = BITRATES[kind][index - 1], RATES[version][rate], FRAME_SAMPLES[kind]
    length = (12000 * kbit // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hz + pad
    return layer, kbit, hz, samples, length, not four[1] & 1


def _synchsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _tag_text(raw: bytes) -> str:
    """A text field with its encoding byte."""
    kind = {1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[:1][0] if raw else 0, "latin-1")
    return raw[1:].decode(kind, "replace").strip("\x00")


def id3_tag(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Text frames of the ID3v2 tag at a place (versions 2.2 to 2.4), and where it ends; `at` itself if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or data[at + 3] == 255 or max(data[at + 6 : at + 10]) > 127:
        return {}, at
    version, flags = data[at + 3], data[at + 5]
    end = min(len(data), at + 10 + _synchsafe(data[at + 6 : at + 10]))
    body = data[at + 10 : end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    tags, pos, width = {}, 0, 3 if version == 2 else 4
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        pos = _synchsafe(body[:4]) if version == 4 else 4 + struct.unpack(">I", body[:4])[0]
    while pos + (6 if version == 2 else 10) <= len(body) and body[pos : pos + width].strip(b"\x00"):
        name, raw = body[pos : pos + width].decode("latin-1"), body[pos + width : pos + 2 * width]
        n = _synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        pos += 6 if version == 2 else 10
        value = body[pos : pos + n]
        pos += n
        if version == 4 and body[pos - n - 1] & 2:
            value = value.replace(b"\xff\x00", b"\xff")
        if name in ("TXXX", "TXX"):
            k, _, v = _tag_text(value).partition("\x00")
            tags[k] = v.lstrip("\ufeff")
        elif name[0] == "T":
            tags[name] = _tag_text(value)
    return tags, min(len(data), end + (10 if version == 4 and flags & 0x10 else 0))


def vbr_table(frame: bytes) -> dict | None:
    """The variable-bitrate table of a stream's first frame (Xing, Info or VBRI), None if it is an ordinary frame."""
    mono, first = frame[3] >> 6 == 3, frame[1] & 8
    at = 4 + ((17 if mono else 32) if first else (9 if mono else 17))
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, pos, out = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8, {"frames": -1, "bytes": -1, "toc": b""}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and len(frame) >= pos + 4:
                out[name] = struct.unpack(">I", frame[pos : pos + 4])[0]
                pos += 4
        return out | ({"toc": frame[pos : pos + 100]} if flags & 4 else {})
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        entries, _, width, _ = struct.unpack(">HHHH", frame[54:62])
        return {"frames": frames, "bytes": size, "toc": frame[62 : 62 + entries * width]}
    return None


def _layer2_bits(frame: bytes, kbit: int, hz: int, lsf: bool) -> int:
    """Bits of a Layer II frame's allocation and scale factor selection."""
    channels = 1 if frame[3] >> 6 == 3 else 2
    each = kbit // channels
    # Widths of the allocation fields by subband, as (subbands, bits).
    if lsf:
        table = ((4, 4), (7, 3), (19, 2))
    elif (hz == 48000 and each >= 56) or 56 <= each <= 80:
        table = ((11, 4), (12, 3), (4, 2))
    elif hz != 48000 and each >= 96:
        table = ((11, 4), (12, 3), (7, 2))
    elif hz == 32000:
        table = ((2, 4), (10, 3))
    else:
        table = ((2, 4), (6, 3))
    widths = [bits for n, bits in table for _ in range(n)]
    joint = min(len(widths), 4 * ((frame[3] >> 4 & 3) + 1)) if frame[3] >> 6 == 1 else len(widths)
    held = int.from_bytes(frame[6:38].ljust(32, b"\x00"), "big")
    pos, selected = 0, 0
    for k, bits in enumerate(widths):
        for _ in range(channels if k < joint else 1):
            used = held >> (256 - pos - bits) & ((1 << bits) - 1)
            pos += bits
            selected += (channels if k >= joint else 1) * (used > 0)
    return pos + 2 * selected


def guarded_bits(frame: bytes, h: tuple) -> int:
    """How many bits after its checksum a frame's checksum covers."""
    mono = frame[3] >> 6 == 3
    if h[0] == 1:
        joint = 4 * ((frame[3] >> 4 & 3) + 1) if frame[3] >> 6 == 1 else 32
        return 128 if mono else 4 * (2 * joint + 32 - joint)
    if h[0] == 2:
        return _layer2_bits(frame, h[1], h[2], not frame[1] & 8)
    return 8 * ((17 if mono else 32) if frame[1] & 8 else (9 if mono else 17))


def checksum_holds(frame: bytes, h: tuple) -> bool:
    """Whether a guarded frame's checksum is right; a frame too short for what it covers is not."""
    n = guarded_bits(frame, h)
    if len(frame) < 6 + (n + 7) // 8:
        return False
    crc = int(crc16(np.frombuffer(frame[2:4] + frame[6 : 6 + n // 8], np.uint8)[None])[0])
    for k in range(n % 8):
        bit = frame[6 + n // 8] >> (7 - k) & 1
        crc = ((crc << 1) ^ 0x8005) & 0xFFFF if (crc >> 15) ^ bit else crc << 1 & 0xFFFF
    return crc == frame[4] << 8 | frame[5]


def parse_stream(data: bytes) -> dict:
    """Tags, variable-bitrate table, frames (after resynchronising), checksums, duration and offsets of one stream.

    A header counts when the next frame's header, or the end of the audio, stands where its length says.
    Bytes between frames are skipped and counted in `skipped`.  The audio ends before an ID3v1 tag; the word TAG inside a whole frame is
    the frame's, not a tag.
    """
    tags, start, end = {}, 0, len(data)
    while True:
        found, to = id3_tag(data, start)
        if to == start:
            break
        tags, start = tags | found, to
    tag = end - 128 if end - start >= 128 and data[end - 128 : end - 125] == b"TAG" else None
    known: dict[bytes, tuple | None] = {}
    offsets, kinds, pos, skipped = [], [], start, 0
    while pos + 4 <= end and pos != tag:
        four = data[pos : pos + 4]
        h = known[four] if four in known else known.setdefault(four, header_of(four))
        if h is not None:
            to = pos + h[4]
            follows = data[to : to + 4]
            if to in (end, tag) or (to + 4 <= end and (known[follows] if follows in known else known.setdefault(follows, header_of(follows))) is not None):
                offsets.append(pos)
                kinds.append(h)
                pos = to
                continue
        nxt = data.find(b"\xff", pos + 1, end)
        nxt = nxt if nxt >= 0 else end
        if tag is not None and pos < tag < nxt:
            nxt = tag
        skipped += nxt - pos
        pos = nxt
    if tag is not None and pos == tag:
        tags["id3v1"] = data[tag + 3 : tag + 33].rstrip(b"\x00 ").decode("latin-1")
    else:
        skipped += end - pos
    vbr = vbr_table(data[offsets[0] : offsets[0] + kinds[0][4]]) if offsets else None
    if vbr is not None:
        offsets, kinds = offsets[1:], kinds[1:]
    guarded = np.array([k for k, h in enumerate(kinds) if h[5]], np.int64)
    good = 0
    if len(guarded):
        # Mono Layer I frames, the stored form, are checked together.
        raw, at = np.frombuffer(data, np.uint8), np.array(offsets, np.int64)[guarded]
        plain = np.array([kinds[k][0] == 1 and kinds[k][4] >= 22 for k in guarded]) & (raw[at + 3] >> 6 == 3)
        if plain.any():
            rows = raw[at[plain][:, None] + np.concatenate([[2, 3], np.arange(6, 22)])]
            held = raw[at[plain] + 4].astype(np.uint16) << np.uint16(8) | raw[at[plain] + 5]
            good += int((crc16(rows) == held).sum())
        good += sum(checksum_holds(data[offsets[k] : offsets[k] + kinds[k][4]], kinds[k]) for k in guarded[~plain])
    return {"tags": tags, "vbr": vbr, "offsets": offsets, "kinds": kinds, "skipped": skipped, "crc_good": good, "crc_bad": len(guarded) - good, "samples": sum(h[3] for h in kinds)}


def payload_of(data: bytes, parsed: dict) -> bytes:
    """The payload bytes held by the samples of a parsed stream's frames; frames of another form than the stored one hold none."""
    raw, offsets = np.frombuffer(data, np.uint8), np.array(parsed["offsets"], np.int64)
    lengths = np.array([h[4] for h in parsed["kinds"]], np.int64)
    forms = np.zeros(len(offsets), np.int64)
    for bits, (head, length) in HEADS.items():
        rows = np.flatnonzero(lengths == length)
        own = np.frombuffer(head, np.uint8)
        # Header and allocation decide; the checksum may be broken.
        places = np.concatenate([np.arange(4), np.arange(6, 22)])
        forms[rows[(raw[offsets[rows][:, None] + places] == own[places]).all(axis=1)]] = bits
    held_in = np.flatnonzero(forms)
    offsets, bits = offsets[held_in], forms[held_in]
    units, at = np.zeros((len(offsets), UNIT), np.uint8), 34
    for b in (8, 9):
        rows = np.flatnonzero(bits == b)
        if len(rows):
            held = raw[offsets[rows][:, None] + np.arange(at, at + UNIT * b // 8)]
            units[rows] = held if b == 8 else np.packbits(np.unpackbits(held, axis=1).reshape(len(rows), UNIT, 9)[:, :, 1:], axis=2)[:, :, 0]
    return units.tobytes()


def features_of(p: dict) -> str:
    """The stream's features as text, the same for equal streams."""
    rates = {}
    for h in p["kinds"]:
        rates[h[1]] = rates.get(h[1], 0) + 1
    hz = p["kinds"][0][2] if p["kinds"] else 0
    layer = p["kinds"][0][0] if p["kinds"] else 0
    return f"layer={layer};hz={hz};frames={len(p['offsets'])};samples={p['samples']};kbit={','.join(f'{k}x{n}' for k, n in sorted(rates.items()))};crc={p['crc_good']}/{p['crc_good'] + p['crc_bad']};skipped={p['skipped']};vbr_frames={p['vbr']['frames'] if p['vbr'] else -1}"


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as its stored MPEG audio stream."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = rows.select(id_col).withColumn("media", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode_stream(x) for x in texts_of(b.column(1))], pa.binary())], names=[id_col, "media"])

    return in_arrow(rows, run, schema)


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", seek_every: int = 1) -> DataFrame:
    """(id, digests, exact duration in samples, seek offsets of every `seek_every`-th frame) of stored streams."""
    rows = df.select(F.col(id_col), F.col(media_col).alias("media"))
    kind = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate int, seek_offsets array<long>, crc_bad long, skipped_bytes long"

    def one(data: bytes) -> tuple:
        p = parse_stream(data)
        payload = payload_of(data, p)
        hz = p["kinds"][0][2] if p["kinds"] else 0
        n = p["tags"].get("n_bytes", "")
        return (int(n) if n.isdecimal() and len(n) < 19 else -1, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features_of(p), len(p["offsets"]), p["samples"], hz, p["offsets"][::seek_every], p["crc_bad"], p["skipped"])

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = [id_col, *"n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature n_frames n_samples sample_rate seek_offsets crc_bad skipped_bytes".split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            found = list(zip(*map(one, texts_of(b.column(1)))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(v), t) for v, t in zip(found, types))], names=names)

    return in_arrow(rows, run, schema)


def op1_media_audio(spark, sf_dir: str) -> DataFrame:
    return read_media(encode_media(table(spark, sf_dir, "documents")))
