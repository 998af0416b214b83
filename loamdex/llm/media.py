"""Media columns (operator 4): MPEG audio.

`probe` reads any MPEG-1/2/2.5 audio stream of layers I to III: it skips
and parses ID3v2, APE-less ID3v1 and Xing/Info/VBRI headers, finds frame
headers (again after damage: a header counts only if another of the same
stream, a tag or the end follows where it says), checks the checksums of
protected frames of all layers, and returns exact durations and the byte
offset of every frame for seeking (or of every `seek_every`-th).
Free-format frames, whose headers don't give their length, are skipped as
damage. A table that does not lie within its frame counts as none.

`encode_audio` stores bytes losslessly as a layer III stream: each frame
of 576 samples (MPEG-2, 16 kHz, mono, 144 kbit/s, protected) has a silent
granule of length 0, so that its whole main data is ancillary data, and
576 bytes of payload there. The unit of the format is thus 576 bytes.
Decoders play silence; `decode` returns the payload.

The query stores the streams in the shared folder and reads that table back.

Defined results: null text is empty; an empty text has one frame of
padding; a stream without a (valid) `n_bytes` tag gives null for it; repeated rows give repeated rows; an empty table gives an empty
table; other columns are ignored. Damaged media give what frames remain,
with the number of failed checksums and bytes skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import as_bytes, materialise, slices, with_id

# Fixed values of the MPEG audio standards: kbit/s by (MPEG-1?, layer), Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSION_NAMES = {3: "1", 2: "2", 0: "2.5"}

UNIT, PAD = 576, b"\xff"
_PROTECTED, _PLAIN = b"\xff\xf2\xd8\xc4", b"\xff\xf3\xd8\xc4"
_SIDE = 9
_FRAME = 648
#: A seek point at every so many frames.
SEEK_EVERY = 1


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, most significant bit first."""
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


def header(word: bytes) -> dict | None:
    """A frame header's fields, or None if the four bytes aren't one (free format counts as none)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, hz, pad = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or word[3] & 3 == 2:
        return None
    kbit, hertz = BITRATES[version == 3, layer][rate], RATES[version][hz]
    mono = word[3] >> 6 == 3
    if layer == 1:
        length, samples = (12_000 * kbit // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        length = samples // 8 * 1000 * kbit // hertz + pad
    side = ((17 if mono else 32) if version == 3 else (9 if mono else 17)) if layer == 3 else 0
    return {"version": version, "layer": layer, "kbit": kbit, "hz": hertz, "mono": mono, "length": length, "samples": samples, "protected": not word[1] & 1, "side": side}


def _tag_size(data: bytes, at: int) -> int:
    """Bytes of an ID3v2 tag at `at`, or 0."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return 0
    a, b, c, d = data[at + 6 : at + 10]
    return 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 0x10 else 0)


def _id3v2(data: bytes, at: int, size: int) -> dict[str, str]:
    """The text frames of an ID3v2.3 or 2.4 tag."""
    out, p, end, four = {}, at + 10, at + size, data[at + 3] >= 4
    while p + 10 <= end and data[p : p + 4].strip(b"\0"):
        name, n = data[p : p + 4], struct.unpack(">I", data[p + 4 : p + 8])[0]
        if four:
            n = (n >> 24 & 127) << 21 | (n >> 16 & 127) << 14 | (n >> 8 & 127) << 7 | n & 127
        body, p = data[p + 10 : p + 10 + n], p + 10 + n
        if name[:1] == b"T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
            key, _, value = text.partition("\0") if name == b"TXXX" else (name.decode("latin-1"), "", text)
            out[key] = value.rstrip("\0")
    return out


def _vbr(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing, Info or VBRI table of a first frame, if it lies within the frame."""
    frame = data[at : at + h["length"]]
    for p in (4 + h["side"], 6 + h["side"]):
        kind = frame[p : p + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= p + 8:
            flags, p, out = struct.unpack_from(">I", frame, p + 4)[0], p + 8, {"kind": kind.decode()}
            if len(frame) < p + 4 * (flags & 1) + 2 * (flags & 2) + 25 * (flags & 4):
                return None
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = struct.unpack_from(">I", frame, p)[0], p + 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack_from(">IIHHH", frame, 46)
        if len(frame) >= 62 + entries * width:
            toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
            return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


# Fixed values of the standard: bits of a layer II allocation, by runs of subbands, in each of its tables.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "lsf": [4] * 4 + [3] * 7 + [2] * 19}


def _allocation(h: dict) -> list[int]:
    """Bits of each subband's allocation in a layer II frame."""
    if h["version"] != 3:
        return ALLOCATION["lsf"]
    each = h["kbit"] if h["mono"] else h["kbit"] // 2
    if each <= 48:
        return ALLOCATION["d" if h["hz"] == 32000 else "c"]
    return ALLOCATION["a" if h["hz"] == 48000 or each <= 80 else "b"]


def _protected_bits(frame: bytes, h: dict) -> int:
    """Bits after the checksum that it covers: side information; in layers I and II the allocation, in II the scale factor selection too."""
    if h["layer"] == 3:
        return 8 * h["side"]
    bounds = 32 if frame[3] >> 6 != 1 else 4 + 4 * (frame[3] >> 4 & 3)  # joint stereo shares the allocation from a bound on
    channels = 1 if h["mono"] else 2
    if h["layer"] == 1:
        return 4 * (channels * bounds + 32 - bounds) if channels == 2 else 128
    at = 48
    value, size = int.from_bytes(frame[:70], "big"), 8 * len(frame[:70])
    used = 0
    for band, width in enumerate(_allocation(h)):
        for _ in range(channels if band < bounds else 1):
            own = value >> max(0, size - at - width) & (1 << width) - 1
            used += bool(own) * (1 if band < bounds else channels)
            at += width
    return at - 48 + 2 * used


def crc_ok(frame: bytes, h: dict) -> bool:
    """Whether the checksum of a protected frame is right."""
    bits = _protected_bits(frame, h)
    whole, rest = divmod(bits, 8)
    if len(frame) < 6 + whole + (rest > 0):
        return False
    value = crc16(frame[2:4] + frame[6 : 6 + whole])
    if rest:
        last = frame[6 + whole]
        for i in range(rest):
            value ^= (last >> 7 - i & 1) << 15
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value == frame[4] << 8 | frame[5]


def probe(data: bytes, seek_every: int = SEEK_EVERY) -> dict:
    """What a stream holds; `frames` has (offset, length) of its audio frames, without a table frame."""
    tags, at, end, vbr = {}, 0, len(data), None
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    frames, skipped, samples, good, bad, first = [], 0, 0, 0, 0, None
    known: dict[bytes, dict | None] = {}
    checked: dict[bytes, bool] = {}
    while at + 4 <= end:
        word = data[at : at + 4]
        if word not in known:
            known[word] = header(word)
        h = known[word]
        if h is None or at + h["length"] > end or (first and (h["hz"], h["layer"]) != (first["hz"], first["layer"])):
            if size := _tag_size(data, at):
                tags |= _id3v2(data, at, min(size, end - at))
                at += size
                continue
            found = data.find(b"\xff", at + 1, end)
            while found >= 0 and not _synced(data, found, end):
                found = data.find(b"\xff", found + 1, end)
            skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        if first is None:
            if not _synced(data, at, end):
                skipped, at = skipped + 1, at + 1
                continue
            first, vbr = h, _vbr(data, at, h) if h["layer"] == 3 else None
            if vbr:
                at += h["length"]
                continue
        if h["protected"]:
            if h["layer"] == 3:  # the streams of encode() repeat one checksum
                part = data[at : at + 6 + h["side"]]
                ok = checked.get(part)
                if ok is None:
                    if len(checked) > 1000:
                        checked.clear()
                    ok = checked[part] = crc_ok(part, h)
            else:
                ok = crc_ok(data[at : at + min(h["length"], 80)], h)
            good, bad = good + ok, bad + (not ok)
        frames.append((at, h["length"]))
        samples += h["samples"]
        at += h["length"]
    skipped += max(0, end - at)
    hz = first["hz"] if first else 0
    return {
        "tags": tags, "vbr": vbr, "frames": frames, "samples": samples, "hz": hz, "duration_us": samples * 1_000_000 // hz if hz else 0,
        "version": VERSION_NAMES[first["version"]] if first else "", "layer": first["layer"] if first else 0, "mono": bool(first and first["mono"]),
        "crc_good": good, "crc_bad": bad, "skipped": skipped, "seek": [f[0] for f in frames[::seek_every]],
    }


def _synced(data: bytes, at: int, end: int) -> bool:
    """A header stands here, and what follows its frame is another, a tag or the end."""
    h = header(data[at : at + 4])
    if h is None or at + h["length"] > end:
        return False
    after = at + h["length"]
    return after == end or data[after : after + 3] == b"ID3" or (n := header(data[after : after + 4])) is not None and (n["hz"], n["layer"]) == (h["hz"], h["layer"])


def encode(raw: bytes) -> bytes:
    """The stream that stores `raw`, padded with bytes 255 to a positive multiple of 576."""
    n = max(1, -(-len(raw) // UNIT))
    frames = np.zeros((n, _FRAME), np.uint8)
    side = bytes(_SIDE)
    frames[:, :15] = np.frombuffer(_PROTECTED + struct.pack(">H", crc16(_PROTECTED[2:] + side)) + side, np.uint8)
    frames[:, 15 : 15 + UNIT] = np.frombuffer(raw + PAD * (n * UNIT - len(raw)), np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    info = (_PLAIN + side + b"Info" + struct.pack(">III", 7, n, (n + 1) * _FRAME) + toc).ljust(_FRAME, b"\0")
    text = b"\0n_bytes\0" + str(len(raw)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0))
    return b"".join((b"ID3\x03\0\0", size, tag, info, frames.tobytes(), b"TAG".ljust(127, b"\0"), b"\xff"))


def decode(data: bytes, found: dict) -> tuple[bytes, int | None]:
    """The padded payload of a stream by encode(), and the bytes before padding (None if no tag tells); found: probe() of it."""
    at = 6 + _SIDE
    raw = b"".join([data[p + at : p + at + UNIT] for p, n in found["frames"] if n == _FRAME])
    told = found["tags"].get("n_bytes", "")
    return raw, int(told) if told.isascii() and told.isdigit() and int(told) <= len(raw) else None


def encode_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `media`, the stream that stores the text's UTF-8 bytes."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                media = [encode(t or b"") for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return df.mapInArrow(write, with_id(df, "media binary"))


def stored_audio(df: DataFrame, **columns: str) -> DataFrame:
    """encode_audio(), written to the shared folder as a table of media and read back."""
    return materialise(encode_audio(df, **columns), "media")


_FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frames int, crc_bad int, seek_offsets array<long>"


def audio_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored streams hold: digests of the payload read back, durations, seek offsets. A null stream is an empty one."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for data in part.column("media").to_pylist():
                    data = data or b""
                    x = probe(data)
                    raw, n = decode(data, x)
                    vbr = x["vbr"] or {}
                    feature = f"mpeg{x['version']}-layer{x['layer']};{x['hz']}Hz;frames={len(x['frames'])};samples={x['samples']};us={x['duration_us']};crc={x['crc_good']}/{x['crc_bad']};skipped={x['skipped']};table={vbr.get('kind', '')}:{vbr.get('frames', '')};seek={zlib.crc32(np.asarray(x['seek'], '<u8').tobytes()):08x}"
                    rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, x["duration_us"], len(x["frames"]), x["crc_bad"], x["seek"]))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                schema = [f.split()[0] for f in _FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", *schema])

    return df.mapInArrow(read, with_id(df, _FEATURES))
