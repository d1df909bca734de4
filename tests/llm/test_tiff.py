import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import tiff


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(compression, predictor, order, tile):
    rng = np.random.default_rng(7)
    pages = [rng.integers(0, 4, (37, 45, 3)).astype(np.uint8) * 60, rng.integers(0, 60000, (5, 70, 1)).astype(np.uint16), np.zeros((300, 64, 3), np.uint8)]
    found = list(tiff.read_pages(tiff.write_tiff(pages, compression=compression, predictor=predictor, order=order, tile=tile)))
    assert [p.number for p in found] == [0, 1, 2]
    for p, want in zip(found, pages, strict=True):
        assert np.array_equal(p.pixels, want) and p.tiled == bool(tile) and p.compression == compression


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000, 60000])
def test_codecs(n):
    rng = random.Random(n)
    for data in (bytes(rng.randrange(256) for _ in range(n)), b"ab" * (n // 2), bytes(rng.choice(b"aab ") for _ in range(n)), b"z" * n):
        assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data) or 1) == data
        assert tiff.unpack_bits(tiff.pack_bits(data), len(data) or 1) == data


def test_packbits_of_the_specification():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes([0xAA] * 3 + [0x80, 0, 0x2A] + [0xAA] * 4 + [0x80, 0, 0x2A, 0x22] + [0xAA] * 10)
    assert tiff.unpack_bits(packed, 24) == plain


def test_bad_files_give_an_error_row(spark):
    good = tiff.write_tiff([np.zeros((2, 2, 1), np.uint8)])
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0\xff\xff\xff\xff"), (5, good[:-30]), (6, b"not a picture"), (7, good)]
    df = spark.createDataFrame(rows, "id long, media binary").withColumn("page", F.lit("clash"))
    out = {r.id: r for r in tiff.tiff_pages(df).collect()}
    assert len(out) == 7 and {k for k, r in out.items() if r.error is None} == {1, 7}
    assert out[1].page == 0 and bytes(out[1].pixels) == b"\0" * 4


def test_documents(spark, docs, odd):
    rows = docs(odd)
    pages = tiff.tiff_pages(tiff.texts_to_tiff(rows.withColumn("media", F.lit(1)))).collect()
    assert len(pages) == len(odd)
    by = {r.doc_id: r for r in pages}
    for i, t in enumerate(odd):
        raw = (t or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert bytes(by[i].pixels) == want and by[i].n_bytes == len(raw) and by[i].error is None
    assert hashlib.sha256(by[5].media).digest() == hashlib.sha256(by[10].media).digest() and by[5].feature == by[10].feature
    assert zlib.crc32(bytes(by[0].pixels)[-16:]) == zlib.crc32(b" " * 16)
    assert tiff.tiff_pages(tiff.texts_to_tiff(rows.limit(0))).count() == 0


def entry(order, tag, kind, many, value):
    return struct.pack(order + "HHI", tag, kind, many) + value.ljust(4, b"\0")


def by_hand(order, entries, data):
    """A classic file: header, one directory, then ``data`` at offset 8 + directory size."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    return head + struct.pack(order + "H", len(entries)) + b"".join(entries) + struct.pack(order + "I", 0) + data


def offset(entries):
    return 8 + 2 + 12 * entries + 4


def test_lzw_strip_written_by_hand():
    # codes of nine bits: clear, 7, 7 7 (258), 8, end; pixels 7 7 7 8
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257)).ljust(48, "0")
    strip = int(bits, 2).to_bytes(6, "big")
    at = struct.pack(">I", offset(8))
    short = lambda v: struct.pack(">H", v)
    e = [entry(">", 256, 3, 1, short(4)), entry(">", 257, 3, 1, short(1)), entry(">", 258, 3, 1, short(8)), entry(">", 259, 3, 1, short(5)), entry(">", 262, 3, 1, short(1)), entry(">", 273, 4, 1, at), entry(">", 278, 3, 1, short(1)), entry(">", 279, 4, 1, struct.pack(">I", 6))]
    (page,) = tiff.read_pages(by_hand(">", e, strip))
    assert page.pixels[:, :, 0].tolist() == [[7, 7, 7, 8]] and page.compression == tiff.LZW


def test_planar_tiles_written_by_hand():
    # two samples in planes of their own, 3 x 2 pixels in tiles of 2 x 2 (rounded up), plain
    planes = [np.arange(1, 7).reshape(2, 3), np.arange(11, 17).reshape(2, 3)]
    tiles = [np.pad(p[:, c : c + 2], ((0, 0), (0, 2 - p[:, c : c + 2].shape[1]))).astype(np.uint8).tobytes() for p in planes for c in (0, 2)]
    n = 11
    base = offset(n)
    offsets, counts = base + 16, base + 32
    data = b"".join(tiles) + struct.pack("<4I", *(base + 4 * k for k in range(4))) + struct.pack("<4I", 4, 4, 4, 4)
    short = lambda v: struct.pack("<H", v)
    e = [entry("<", 256, 3, 1, short(3)), entry("<", 257, 3, 1, short(2)), entry("<", 258, 3, 2, struct.pack("<HH", 8, 8)), entry("<", 259, 3, 1, short(1)), entry("<", 262, 3, 1, short(1)), entry("<", 277, 3, 1, short(2)), entry("<", 284, 3, 1, short(2)), entry("<", 322, 3, 1, short(2)), entry("<", 323, 3, 1, short(2)), entry("<", 324, 4, 4, struct.pack("<I", offsets)), entry("<", 325, 4, 4, struct.pack("<I", counts))]
    (page,) = tiff.read_pages(by_hand("<", e, data))
    assert page.tiled and page.pixels[:, :, 0].tolist() == planes[0].tolist() and page.pixels[:, :, 1].tolist() == planes[1].tolist()


def test_float_predictor_written_by_hand():
    values = np.array([[1.5, -2.25, 1e10]], "<f4")
    planes = values.astype(">f4").view(np.uint8).reshape(3, 4).T.reshape(-1)  # all first bytes, then all second ones
    packed = zlib.compress(np.diff(planes.astype(np.int64), prepend=0).astype(np.uint8).tobytes())
    short, long = (lambda v: struct.pack("<H", v)), (lambda v: struct.pack("<I", v))
    e = [entry("<", 256, 3, 1, short(3)), entry("<", 257, 3, 1, short(1)), entry("<", 258, 3, 1, short(32)), entry("<", 259, 3, 1, short(8)), entry("<", 262, 3, 1, short(1)), entry("<", 273, 4, 1, long(offset(10))), entry("<", 278, 3, 1, short(1)), entry("<", 279, 4, 1, long(len(packed))), entry("<", 317, 3, 1, short(3)), entry("<", 339, 3, 1, short(3))]
    (page,) = tiff.read_pages(by_hand("<", e, packed))
    assert page.pixels[0, :, 0].tolist() == values[0].tolist()


def test_big_file_written_by_hand():
    def wide(tag, kind, value):
        return struct.pack("<HHQ", tag, kind, 1) + value.ljust(8, b"\0")

    e = [wide(256, 3, b"\2\0"), wide(257, 3, b"\1\0"), wide(258, 3, b"\x08\0"), wide(259, 3, b"\1\0"), wide(273, 16, struct.pack("<Q", 16 + 8 + 20 * 6 + 8)), wide(279, 16, struct.pack("<Q", 2))]
    data = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", 6) + b"".join(e) + struct.pack("<Q", 0) + b"\x05\x09"
    (page,) = tiff.read_pages(data)
    assert page.pixels[0, :, 0].tolist() == [5, 9]


def test_faulty_entries_give_an_error_row(spark):
    """Every entry's kind, count and value spoiled in turn: each file gives its row, none ends the job."""
    good = tiff.write_tiff([np.zeros((2, 2, 1), np.uint8)], compression=tiff.PLAIN, predictor=1)
    (at,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, at)
    files = []
    for k in range(n):
        spot = at + 2 + 12 * k
        for where, form, values in ((2, "H", (0, 2, 5, 11, 12, 99)), (4, "I", (0, 2, 2**31)), (8, "I", (0, 2**32 - 1, 77))):
            for v in values:
                bad = bytearray(good)
                struct.pack_into("<" + form, bad, spot + where, v)
                files.append(bytes(bad))
    out = tiff.tiff_pages(spark.createDataFrame(list(enumerate(files)), "id long, media binary")).collect()
    assert {r.id for r in out} == set(range(len(files))) and sum(r.error is not None for r in out) > len(files) // 3
