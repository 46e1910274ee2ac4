"""Byte payloads as AVI motion-JPEG columns: RIFF writing and index parsing, intra-frame decoding, shot detection.

A frame is a baseline JPEG of 16 x 12 blocks (192 payload bytes). Each 8 x 8 block is flat: its DC coefficient, with
quantiser 8, is the byte less 128, and it has no AC part, so decoding is exact: one 8-bit sample a block. The Huffman table
gives DC category c a code of 9 - c bits: every difference takes 9 bits, the end-of-block code 1 bit, a frame
240 bytes before byte stuffing, and whole documents are packed and unpacked by numpy without a loop over bits.

Frames of other coders are decoded by their own segments: quantisers, Huffman tables (the standard's where a frame brings none, as
is usual in AVI files), restart intervals, any baseline size and sampling. Frames are found by the OpenDML index, by idx1, or
by walking the lists of frames where a file has neither.
Clips need no more than the mean level of each 8 x 8 block of brightness, which for the frames above are the samples.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices

BLOCKS_WIDE, BLOCKS_HIGH = 16, 12
FRAME = BLOCKS_WIDE * BLOCKS_HIGH
PACKED = FRAME * 10 // 8
FRAME_MS = 40
BINS = 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code of each difference (-255..255, shifted by 255), with the end-of-block bit; difference of each 9-bit code."""
    code, back = np.zeros(511, np.uint64), np.zeros(512, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2  # canonical: 0, 10, 110, ... for categories 8, 7, 6, ...
        word = (prefix << c) | (d if d > 0 else d + (1 << c) - 1)
        code[d + 255], back[word] = word << 1, d
    return code, back


_CODE, _BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\x08" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, BLOCKS_HIGH * 8, BLOCKS_WIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
_TAIL = b"\xff\xd9"


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload of a multiple of 192 bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16)
    diffs = np.diff(samples, axis=1, prepend=np.int16(128)).ravel()
    words = _CODE[diffs + 255].reshape(-1, 4)
    packed = (words[:, 0] << 30) | (words[:, 1] << 20) | (words[:, 2] << 10) | words[:, 3]
    scan = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    return [_HEAD + scan[i : i + PACKED].replace(b"\xff", b"\xff\0") + _TAIL for i in range(0, len(scan), PACKED)]


def decode_frames(frames: list[bytes]) -> bytes:
    """The samples of frames as encode_frames writes them; a frame with other headers is an error."""
    scans = []
    for frame in frames:
        if not frame.startswith(_HEAD) or not frame.endswith(_TAIL):
            raise ValueError("not a frame of this coder")
        scans.append(frame[len(_HEAD) : -2].replace(b"\xff\0", b"\xff"))
    raw = np.frombuffer(b"".join(scans), np.uint8)
    if raw.size != len(frames) * PACKED:
        raise ValueError("a frame's scan is too short or too long")
    wide = np.zeros((raw.size // 5, 8), np.uint8)
    wide[:, 3:] = raw.reshape(-1, 5)
    bits = wide.view(">u8").ravel().astype(np.uint64)
    words = np.stack([bits >> np.uint64(k) & np.uint64(1023) for k in (30, 20, 10, 0)], axis=1)
    diffs = _BACK[(words >> np.uint64(1)).astype(np.int64)].reshape(-1, FRAME)
    return (np.cumsum(diffs, axis=1, dtype=np.int16) + 128).astype(np.uint8).tobytes()


#: Places of the coefficients of a block in the order of a scan: diagonals, every other one upwards.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (s := k // 8 + k % 8, k % 8 if s % 2 == 0 else k // 8)))
_WAVES = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, 8**-0.5, 0.5)


def _codes(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may follow in a scan: 256 x length of the code they begin with, and its symbol; 0 for none."""
    table, at, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            table[at : at + (1 << 16 - length)] = length << 8 | symbol
            at += 1 << 16 - length
        k += n
    return table


#: Code lengths and symbols of the tables that hold where a frame brings none: table, how many codes of 1 to 16 bits, symbols. Fixed values (JPEG, annex K.3).
_STANDARD_TABLES = {
    0x00: ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: (
        "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 "
        "29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 "
        "8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 "
        "e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    0x11: (
        "0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 "
        "27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 "
        "88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da "
        "e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}


@lru_cache(maxsize=4)
def _standard(table: int) -> np.ndarray:
    if table not in _STANDARD_TABLES:
        raise ValueError("a scan without its Huffman table")
    counts, symbols = _STANDARD_TABLES[table]
    return _codes(bytes(map(int, counts.split())), bytes.fromhex(symbols))


class _Scan:
    """Bits of a scan between two restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\0", b"\xff") + b"\0" * 8, 0

    def bits(self, n: int) -> int:
        byte, shift = divmod(self.at, 8)
        self.at += n
        return int.from_bytes(self.data[byte : byte + 5], "big") >> (40 - shift - n) & (1 << n) - 1

    def symbol(self, table: np.ndarray) -> int:
        found = int(table[self.bits(16)])
        if not found or self.at - 16 > 8 * len(self.data):
            raise ValueError("a scan with a code that is in no table")
        self.at += (found >> 8) - 16
        return found & 255

    def number(self, size: int) -> int:
        x = self.bits(size) if size else 0
        return x if not size or x >> size - 1 else x - (1 << size) + 1


def decode_jpeg(frame: bytes) -> np.ndarray:
    """Brightness (height x width) of a baseline JPEG; Huffman tables that it does not bring are the standard's."""
    quantisers, tables, restart, parts, at = {}, {}, 0, [], 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker, size = frame[at + 1 : at + 2], int.from_bytes(frame[at + 2 : at + 4], "big")
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if len(marker) == 0 or size < 2:
            raise ValueError("a JPEG without a scan")
        if marker == b"\xdb":
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == b"\xc4":
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (b"\xc0", b"\xc1"):
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif b"\xc2" <= marker <= b"\xcf" and marker not in (b"\xc8", b"\xcc"):
            raise ValueError("not a baseline JPEG")
        elif marker == b"\xdd":
            restart = int.from_bytes(body[:2], "big")
        elif marker == b"\xda":
            used = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
            break
    if not parts or set(used) != {p[0] for p in parts}:
        raise ValueError("components in scans of their own")
    if any(p[3] not in quantisers for p in parts):
        raise ValueError("a scan without its quantiser")
    coders = {name: tuple(tables[t] if t in tables else _standard(t) for t in (k >> 4, 16 | k & 15)) for name, k in used.items()}
    end = frame.rfind(b"\xff\xd9")
    scans = re.split(rb"\xff[\xd0-\xd7]", frame[at : end if end >= at else len(frame)])
    wide, high = max(h for _, h, _, _ in parts), max(v for _, _, v, _ in parts)
    if len(parts) == 1:  # a lone component is not interleaved
        parts, wide, high = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    first = parts[0]
    if across * down * sum(h * v for _, h, v, _ in parts) > 4 * len(frame):  # a block takes two bits at least
        raise ValueError("a scan that is too short for its picture")
    found = np.zeros((down * first[2], across * first[1], 64), np.int64)
    scan, last = None, {}
    for unit in range(across * down):
        if scan is None or (restart and unit % restart == 0):
            scan, last = _Scan(scans[unit // restart if restart else 0]), dict.fromkeys(used, 0)
        y, x = divmod(unit, across)
        for part in parts:
            name, h, v, _ = part
            dc, ac = coders[name]
            for k in range(h * v):
                block = found[y * v + k // h, x * h + k % h] if part is first else np.zeros(64, np.int64)
                last[name] += scan.number(scan.symbol(dc))
                block[0], place = last[name], 1
                while place < 64:
                    run, size = divmod(scan.symbol(ac), 16)
                    if not size and run < 15:
                        break
                    place += run
                    if size and place < 64:
                        block[place] = scan.number(size)
                    place += 1
    waves = np.zeros_like(found, np.float64)
    waves[..., _ZIGZAG] = found * quantisers[first[3]]
    pixels = np.einsum("yu,abuv,xv->aybx", _WAVES, waves.reshape(*found.shape[:2], 8, 8), _WAVES, optimize=True)
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(8 * len(found), -1)[:height, :width]


def levels(frames: list[bytes]) -> np.ndarray:
    """Mean level of each 8 x 8 block, a row for each frame; frames of another size than the first are an error."""
    if all(f.startswith(_HEAD) for f in frames):
        return np.frombuffer(decode_frames(frames), np.uint8).reshape(len(frames), -1)
    out = []
    for frame in frames:
        pixels = decode_jpeg(frame).astype(np.float64)
        pixels = np.pad(pixels, [(0, -n % 8) for n in pixels.shape], mode="edge")
        out.append(np.rint(pixels.reshape(pixels.shape[0] // 8, 8, -1, 8).mean(axis=(1, 3))).astype(np.uint8).ravel())
    if len({len(x) for x in out}) > 1:
        raise ValueError("frames of several sizes")
    return np.stack(out)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """One video stream of JPEG frames, with the idx1 index."""
    n, most = len(frames), max(map(len, frames))
    main = struct.pack("<14I", FRAME_MS * 1000, most * 1000 // FRAME_MS, 0, 0x10, n, 0, 1, most, BLOCKS_WIDE * 8, BLOCKS_HIGH * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I", 0, 0, 0, FRAME_MS, 1000, 0, n, most, 0xFFFFFFFF, 0) + struct.pack("<4H", 0, 0, BLOCKS_WIDE * 8, BLOCKS_HIGH * 8)
    picture = struct.pack("<IiiHH4sIiiII", 40, BLOCKS_WIDE * 8, BLOCKS_HIGH * 8, 1, 8, b"MJPG", BLOCKS_WIDE * BLOCKS_HIGH * 64, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    sizes = np.fromiter(map(len, frames), np.uint32, n)
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[1:, 2] = np.cumsum(8 + sizes + (sizes & 1))[:-1]
    index[:, 2] += 4
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + head + movi + _chunk(b"idx1", index.tobytes()))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, first byte and end of each chunk. A list of no bytes, as a recorder that was cut off leaves it, goes to the end."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if not size and name in (b"RIFF", b"LIST"):
            size = end - at - 8
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


#: Place and size of a frame's bytes.
Piece = tuple[int, int]


def _by_opendml(avi: bytes, at: int, end: int) -> list[Piece] | None:
    """Frames that an OpenDML index at these bytes lists, itself or by the indexes it names; None if one of them is not as it should be."""
    longs, kind, n = int.from_bytes(avi[at : at + 2], "little"), avi[at + 3 : at + 4], int.from_bytes(avi[at + 4 : at + 8], "little")
    if kind == b"\0" and longs == 4 and at + 24 + 16 * n <= end:
        parts = [_inner(avi, *struct.unpack_from("<Q", avi, at + 24 + 16 * k)) for k in range(n)]
        return None if None in parts else [piece for part in parts for piece in part]
    if kind == b"\1" and longs == 2 and at + 24 + 8 * n <= end:
        base = int.from_bytes(avi[at + 12 : at + 20], "little")
        entries = np.frombuffer(avi, "<u4", 2 * n, at + 24).reshape(-1, 2).astype(np.int64)
        return list(zip((entries[:, 0] + base).tolist(), (entries[:, 1] & 0x7FFFFFFF).tolist(), strict=True))
    return None


def _inner(avi: bytes, at: int) -> list[Piece] | None:
    """Frames of the chunk index at this place, which another index names."""
    size = int.from_bytes(avi[at + 4 : at + 8], "little")
    return _by_opendml(avi, at + 8, at + 8 + size) if avi[at : at + 2] == b"ix" and avi[at + 11 : at + 12] == b"\1" else None


def _by_walking(avi: bytes, lists: list[Piece], names: tuple[bytes, ...]) -> list[Piece]:
    """Frames in the order of the lists, given as first byte and end, and of the records inside them."""
    out = []
    for start, end in lists:
        for name, a, b in _chunks(avi, start + 4, end):
            if name in names:
                out.append((a, b - a))
            elif name == b"LIST" and avi[a : a + 4] == b"rec ":
                out += [(x, y - x) for inner, x, y in _chunks(avi, a + 4, b) if inner in names]
    return out


def read_avi(avi: bytes) -> tuple[list[bytes], float]:
    """Frames of the first video stream by the RIFF index, and the milliseconds of a frame; other streams are passed over.

    The OpenDML index counts if there is one, then idx1, whose entries count from the list of frames or from the file's begin. Files
    without an index, and those of several segments without an OpenDML index, are walked chunk by chunk. A frame of no bytes
    repeats the one before it.
    """
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    lists: list[Piece] = []
    index = stream = opendml = None
    frame_ms, streams = float(FRAME_MS), 0
    for outer, start, stop in _chunks(avi, 0, len(avi)):
        if outer != b"RIFF" or avi[start : start + 4] not in (b"AVI ", b"AVIX"):
            continue
        for name, a, b in _chunks(avi, start + 4, stop):
            if name == b"LIST" and avi[a : a + 4] == b"movi":
                lists.append((a, b))
            elif name == b"LIST" and avi[a : a + 4] == b"hdrl":
                for name, x, y in _chunks(avi, a + 4, b):
                    if name == b"avih":
                        frame_ms = int.from_bytes(avi[x : x + 4], "little") / 1000
                    elif name == b"LIST" and avi[x : x + 4] == b"strl":
                        found = {inner: (p, q) for inner, p, q in _chunks(avi, x + 4, y)}
                        head = found.get(b"strh", (0, 0))[0]
                        if stream is None and avi[head : head + 4] == b"vids":
                            stream, opendml = streams, found.get(b"indx")
                        streams += 1
            elif name == b"idx1" and index is None:
                index = np.frombuffer(avi, "<u4", (b - a) // 16 * 4, a).reshape(-1, 4)
    if not lists or stream is None:
        raise ValueError("no video stream")
    names = (b"%02ddc" % stream, b"%02ddb" % stream)
    own = _by_opendml(avi, *opendml) if opendml else None
    if own is None and index is not None and len(lists) == 1:
        listed = index[np.isin(index[:, 0], [int.from_bytes(name, "little") for name in names])][:, 2:].tolist()
        base = 8 if listed and avi[listed[0][0] : listed[0][0] + 4] in names else lists[0][0] + 8
        own = [(base + o, n) for o, n in listed]
    if not own:
        own = _by_walking(avi, lists, names)
    frames: list[bytes] = []
    for o, n in own:
        if n or frames:
            frames.append(avi[o : o + n] if n else frames[-1])
    if not frames:
        raise ValueError("no frames")
    return frames, frame_ms


def shots(grey: np.ndarray, span: int = 12, factor: float = 3.0, floor: float = 0.08) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots, and the frames' histograms (blocks in each of 16 grey bins), from a row of levels for each frame.

    A cut is a frame whose histogram differs from the last (half the L1 distance) by more than floor and than the mean
    and `factor` standard deviations of the `span` differences before it.
    """
    n, blocks = grey.shape
    hist = np.bincount((np.arange(n)[:, None] * BINS + (grey >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * blocks)
    total, square = np.cumsum(np.r_[0, diff]), np.cumsum(np.r_[0, diff * diff])
    end = np.arange(len(diff))
    start = np.maximum(0, end - span)
    seen = np.maximum(1, end - start)
    mean = (total[end] - total[start]) / seen
    spread = np.sqrt(np.maximum(0, (square[end] - square[start]) / seen - mean * mean))
    return np.r_[0, np.flatnonzero((diff > floor) & (diff > mean + factor * spread) & (end > 0)) + 1], hist


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME, b" ")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long"
CLIPS = "doc_id long, clip int, start_ms long, end_ms long, first_frame long, n_frames long, mean_level double, reason string"


def _digest(doc: int | None, text: bytes) -> tuple:
    avi = write_avi(encode_frames(padded(text)))
    back = decode_frames(read_avi(avi)[0])
    cuts, hist = shots(np.frombuffer(back, np.uint8).reshape(-1, FRAME))
    share = np.round(hist.sum(axis=0) * 1000 / max(1, hist.sum())).astype(int)
    feature = f"shots={len(cuts)};cuts={zlib.crc32(cuts.astype('<i8').tobytes()):08x};hist={'.'.join(map(str, share))}"
    return doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(avi), hashlib.sha256(avi).hexdigest(), feature, len(hist), len(cuts)


def _clips(doc: int | None, avi: bytes) -> Iterator[tuple]:
    try:
        frames, frame_ms = read_avi(avi)
        grey = levels(frames)
    except ValueError as error:
        yield doc, None, None, None, None, None, None, str(error)
        return
    except (IndexError, struct.error):
        yield doc, None, None, None, None, None, None, "a frame that is cut short"
        return
    cuts, _ = shots(grey)
    level = grey.mean(axis=1)
    for k, (a, b) in enumerate(zip(cuts.tolist(), [*cuts.tolist()[1:], len(grey)], strict=True)):
        yield doc, k, round(a * frame_ms), round(b * frame_ms), a, b - a, float(level[a:b].mean()), None


def _rows(batches: Iterator[pa.RecordBatch], make, schema: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    names = pa.schema([(n, types[t]) for n, t in fields])
    for part in byte_slices(batches, "text", limit):
        got = [row for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for row in make(doc, text or b"")]
        columns = zip(*got, strict=True) if got else [[] for _ in fields]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, names.types, strict=True)], schema=names)


def _mapped(source: DataFrame, make, schema: str, id_col: str, data_col: str) -> DataFrame:
    source = source.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{data_col}` as binary) as text")
    return source.mapInArrow(lambda it: _rows(it, make, schema), schema)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: stored, read back and described.

    A null text is empty (192 spaces of payload). Repeated rows and equal texts give equal values. Other columns
    are not read. An empty table gives no rows.
    """
    return _mapped(docs, lambda d, t: [_digest(d, t)], DIGEST, id_col, text_col)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the AVI file as a binary column, a row for each row of docs.

    A null text is empty (one frame of spaces). Equal texts give equal files; an empty table gives no rows; other columns are not read.
    """
    return _mapped(docs, lambda d, t: [(d, write_avi(encode_frames(padded(t))))], "doc_id long, avi binary", id_col, text_col)


def clips_of(media: DataFrame, id_col: str = "doc_id", avi_col: str = "avi") -> DataFrame:
    """A row for each shot of a column of AVI motion-JPEG files: clip number, times in milliseconds, frames and mean level.

    Files of any baseline coder. A null value and a value that is no such file give one row with a reason and no clip. Repeated rows
    each give their clips; an empty table gives none; other columns are not read.
    """
    return _mapped(media, _clips, CLIPS, id_col, avi_col)


def clip_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """clips_of the media column of texts; every row has a clip at least."""
    return clips_of(media_column(docs, id_col, text_col))
