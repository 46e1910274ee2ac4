"""AVI files as other recorders write them: no Huffman tables, no index, several segments, broken frames; the JVM's image library is the other coder."""

import struct

import numpy as np
import pytest

from parlance.llm import media


def _java_jpeg(spark, pixels):
    """The JVM's JPEG of a grey or colour picture, and what the JVM reads back from it."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], 10 if pixels.ndim == 2 else 5)
    raster = image.getRaster()
    for y, row in enumerate(pixels.tolist()):
        for x, value in enumerate(row):
            for band, level in enumerate(value if pixels.ndim == 3 else [value]):
                raster.setSample(x, y, band, level)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)).getRaster()
    read = np.array([[[back.getSample(x, y, b) for b in range(back.getNumBands())] for x in range(pixels.shape[1])] for y in range(pixels.shape[0])])
    return data, read


def _without_tables(frame):
    """The frame without its Huffman segments, as AVI files hold it."""
    out, at, n = frame[:2], 2, 0
    while True:
        size = 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
        if frame[at + 1] == 0xDA:
            return out + frame[at:], n
        if frame[at + 1] == 0xC4:
            n += 1
        else:
            out += frame[at : at + size]
        at += size


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(8)
    grey = (np.add.outer(np.arange(24) * 5, np.arange(40) * 2) + rng.integers(-30, 30, (24, 40))).clip(0, 255)
    return [_java_jpeg(spark, grey), _java_jpeg(spark, np.stack([grey, 255 - grey, grey // 2], axis=2))]


def test_frames_without_huffman_tables(pictures):
    (grey, grey_read), (colour, colour_read) = pictures
    for frame, read in ((grey, grey_read[..., 0]), (colour, colour_read @ [0.299, 0.587, 0.114])):
        bare, n = _without_tables(frame)
        assert n > 0 and (media.decode_jpeg(bare) == media.decode_jpeg(frame)).all()
        assert np.abs(media.decode_jpeg(bare) - read).mean() < 1.5


def test_standard_tables_are_whole():
    for table, (counts, symbols) in media._STANDARD_TABLES.items():
        known = bytes.fromhex(symbols)
        want = set(range(12)) if table < 16 else {r << 4 | n for r in range(16) for n in range(1, 11)} | {0, 0xF0}
        assert len(known) == len(set(known)) == sum(map(int, counts.split())) and set(known) == want


def _parts(frames):
    chunk = media._chunk
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", b"vidsMJPG" + b"\0" * 48))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 50_000, *[0] * 13)) + strl)
    return chunk, head, b"".join(chunk(b"01wb", b"odd") + chunk(b"00dc", f) for f in frames)


def test_files_without_an_index():
    frames = [b"one", b"", b"three!", b"f"]
    chunk, head, body = _parts(frames)
    want = ([b"one", b"one", b"three!", b"f"], 50.0)
    plain = chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + body))
    assert media.read_avi(plain) == want
    assert media.read_avi(chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + chunk(b"LIST", b"rec " + body)))) == want
    cut = b"RIFF\0\0\0\0AVI " + head + b"LIST\0\0\0\0movi" + body  # a recorder that never came to the end
    assert media.read_avi(cut) == want
    assert media.read_avi(plain + chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + chunk(b"00dc", b"more"))))[0] == [*want[0], b"more"]


@pytest.mark.parametrize("nested", [True, False])
def test_opendml_index(nested):
    """The index names the second frame twice and leaves out the last, so its own order shows."""
    frames, chunk = [b"one", b"second", b"third"], media._chunk
    order = [0, 1, 1]

    def build(offset, places):
        entries = b"".join(struct.pack("<II", places[k] - offset, len(frames[k]) | (k > 0) << 31) for k in order)
        leaf = struct.pack("<HBBI4sQI", 2, 0, 1, len(order), b"00dc", offset, 0) + entries
        at = places[-1] + 64
        top = struct.pack("<HBBI4s3I", 4, 0, 0, 1, b"00dc", 0, 0, 0) + struct.pack("<QII", at, len(leaf) + 8, len(order))
        strl = chunk(b"strh", b"vidsMJPG" + b"\0" * 48) + chunk(b"indx", top if nested else leaf)
        head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 50_000, *[0] * 13)) + chunk(b"LIST", b"strl" + strl))
        begin = 12 + len(head) + 12
        body, at_frames = b"", []
        for f in frames:
            at_frames.append(begin + len(body) + 8)
            body += chunk(b"00dc", f)
        gap = places[-1] + 64 - (begin + len(body)) - 8
        body += chunk(b"JUNK", b"\0" * max(0, gap)) + chunk(b"ix00", leaf)
        return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + body)), at_frames

    _, places = build(0, [0, 0, 1000])
    avi, again = build(100, places)
    assert places == again and media.read_avi(avi)[0] == [b"one", b"second", b"second"]


def test_clips_of_bare_frames_and_reasons(spark, pictures):
    (grey, _), _ = pictures
    light, _ = _java_jpeg(spark, np.full((24, 40), 250))
    frames = [_without_tables(f)[0] for f in [grey] * 6 + [light] * 4]
    chunk, head, body = _parts(frames)
    avi = chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + body))
    huge = grey.replace(struct.pack(">HH", 24, 40), b"\xff\xff\xff\xff", 1)
    broken = chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + chunk(b"00dc", huge)))
    rows = [(1, avi), (2, None), (3, b"no file"), (4, broken), (5, chunk(b"RIFF", b"AVI " + head))]
    got = media.clips_of(spark.createDataFrame(rows, "doc_id long, avi binary")).collect()
    assert sorted((r.clip, r.start_ms, r.end_ms, r.n_frames, r.reason) for r in got if r.doc_id == 1) == [(0, 0, 300, 6, None), (1, 300, 500, 4, None)]
    told = {r.doc_id: (r.clip, r.n_frames, r.reason) for r in got if r.doc_id != 1}
    assert told == {
        2: (None, None, "not an AVI file"),
        3: (None, None, "not an AVI file"),
        4: (None, None, "a scan that is too short for its picture"),
        5: (None, None, "no video stream"),
    }
