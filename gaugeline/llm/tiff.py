"""TIFF media columns: a reader of pages and a small lossless writer.

The reader walks the chain of image directories, decodes strips or tiles stored
plain, as PackBits, LZW or deflate, undoes predictors, and gives one row a page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import small_batches

# Fixed values of the TIFF 6.0 format and its deflate supplement.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
LZW_CLEAR, LZW_END = 256, 257

#: A row of the query's images has so many pixels of three samples.
ROW_PIXELS, ROW_SAMPLES = 64, 3
ROW_BYTES = ROW_PIXELS * ROW_SAMPLES
STRIP = 128


class TiffError(ValueError):
    """The bytes are not a TIFF file that can be read."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits with runs of three bytes and more."""
    out, i, start = bytearray(), 0, 0

    def literal(end: int) -> None:
        for at in range(start, end, 128):
            piece = data[at : min(at + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    while i < len(data):
        j = i + 1
        while j < len(data) and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i >= 3:
            literal(i)
            out.extend((257 - (j - i), data[i]))
            start = j
        i = j
    literal(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Most significant bit first; codes widen one entry early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = [], 9, b""
            continue
        if code < 256:
            entry = bytes((code,))
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif last and code - 258 == len(table):
            entry = last + last[:1]
        else:
            raise TiffError("an LZW code is not in the table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) + 259 >= 2048 else 11 if len(table) + 259 >= 1024 else 10 if len(table) + 259 >= 512 else 9
        if len(out) >= size:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, known = 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def code_of(entry: bytes) -> int:
        return entry[0] if len(entry) == 1 else table[entry]

    put(LZW_CLEAR)
    for k in range(len(data)):
        longer = known + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            known = longer
            continue
        put(code_of(known))
        table[longer] = 258 + len(table)
        known = longer[-1:]
        if len(table) + 258 >= 4094:
            put(LZW_CLEAR)
            table, width = {}, 9
        else:
            width = max(9, (len(table) + 258).bit_length())
    if known:
        put(code_of(known))
        table[known + b"\0"] = 0
        width = max(9, min(12, (len(table) + 258).bit_length()))
    put(LZW_END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _inflate(kind: int, data: bytes, size: int) -> bytes:
    if kind == PLAIN:
        return data
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    if kind == LZW:
        return unpack_lzw(data, size)
    if kind == PACKBITS:
        return unpack_bits(data, size)
    raise TiffError(f"compression {kind} is not known")


@dataclass
class Page:
    """One image of a file: ``pixels`` is (rows, columns, samples)."""

    number: int
    pixels: np.ndarray
    bits: int
    compression: int
    predictor: int
    photometric: int
    pieces: int
    tiled: bool


def _unpredict(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """Undo differences along rows; block is (rows, columns, samples)."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind in "ui":
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3 and block.dtype.kind == "f":
        rows, columns, samples = block.shape
        n = block.dtype.itemsize
        raw = np.cumsum(np.ascontiguousarray(block).view(np.uint8).reshape(rows, columns * samples * n), axis=1, dtype=np.uint8) if samples == 1 else _sum_by(block, samples)
        planes = raw.reshape(rows, n, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{n}").reshape(rows, columns, samples).astype(block.dtype)
    raise TiffError(f"predictor {predictor} does not fit {block.dtype}")


def _sum_by(block: np.ndarray, samples: int) -> np.ndarray:
    rows = block.shape[0]
    raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, samples)
    return np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, -1)


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    count_kind, entry_size, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    try:
        (at,) = struct.unpack_from(order + word, data, 8 if big else 4)
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(order + count_kind, data, at)
            at += struct.calcsize(count_kind)
            tags: dict[int, tuple] = {}
            for k in range(n):
                spot = at + k * entry_size
                tag, kind, many = struct.unpack_from(order + "HH" + word, data, spot)
                if kind not in KINDS:
                    continue
                form = f"{order}{many * len(KINDS[kind])}{KINDS[kind][0]}"
                value = spot + 4 + struct.calcsize("=" + word)
                if struct.calcsize(form) > struct.calcsize("=" + word):
                    (value,) = struct.unpack_from(order + word, data, value)
                tags[tag] = struct.unpack_from(form, data, value)
            yield _page(len(seen) - 1, data, tags, order)
            (at,) = struct.unpack_from(order + word, data, at + n * entry_size)
    except struct.error as e:
        raise TiffError(f"the file ends early: {e}") from e


def _page(number: int, data: bytes, tags: dict[int, tuple], order: str) -> Page:
    def first(tag: int, default: int | None = None) -> int:
        if tag in tags:
            if not tags[tag] or not isinstance(tags[tag][0], int):
                raise TiffError(f"tag {tag} is not a number")
            return tags[tag][0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    width, length, samples = first(WIDTH), first(LENGTH), first(SAMPLES, 1)
    bits, kind, predictor, form, planar = first(BITS, 1), first(COMPRESSION, PLAIN), first(PREDICTOR, 1), first(FORMAT, 1), first(PLANAR, 1)
    if len(set(tags.get(BITS, (1,)))) > 1:
        raise TiffError("samples of different sizes")
    if bits not in (1, 8, 16, 32, 64) or form not in (1, 2, 3) or (form == 3 and bits < 32):
        raise TiffError(f"samples of {bits} bits in format {form}")
    sample = np.dtype(np.uint8) if bits == 1 else np.dtype(f"{order}{' uif'[form]}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        high, wide, starts, sizes = first(TILE_LENGTH), first(TILE_WIDTH), tags[TILE_OFFSETS], tags.get(TILE_COUNTS)
    else:
        high, wide, starts, sizes = min(first(STRIP_ROWS, length), length), width, tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS)
    if not starts or not sizes or len(starts) != len(sizes) or not (width and length and high and wide):
        raise TiffError("no strips or tiles")
    across, down, deep = -(-width // wide), -(-length // high), samples if planar == 2 else 1
    if len(starts) < across * down * deep:
        raise TiffError("strips or tiles are missing")
    own = 1 if planar == 2 else samples
    pixels = np.zeros((length, width, samples), sample)
    for k in range(across * down * deep):
        plane, rest = divmod(k, across * down)
        top, side = rest // across * high, rest % across * wide
        rows = high if tiled else min(high, length - top)
        line = -(-wide * own // 8) if bits == 1 else wide * own * sample.itemsize
        raw = _inflate(kind, data[starts[k] : starts[k] + sizes[k]], rows * line)
        if len(raw) < rows * line:
            raise TiffError("a strip or tile is too short")
        if bits == 1:
            block = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : wide * own].reshape(rows, wide, own)
        else:
            block = np.frombuffer(raw, sample, rows * wide * own).reshape(rows, wide, own)
        block = _unpredict(block, predictor, order)
        to = pixels[top : top + rows, side : side + wide]
        to[:, :, plane : plane + own] = block[: to.shape[0], : to.shape[1]]
    return Page(number, pixels.astype(sample.newbyteorder("="), copy=False), bits, kind, predictor, first(PHOTOMETRIC, 1), len(starts), tiled)


def write_tiff(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 2, order: str = "<", tile: tuple[int, int] | None = None, strip: int = STRIP, level: int = 6) -> bytes:
    """A classic TIFF file of unsigned images (rows, columns, samples)."""
    pack = {PLAIN: bytes, DEFLATE: lambda b: zlib.compress(b, level), LZW: pack_lzw, PACKBITS: pack_bits}[compression]
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for pixels in pages:
        length, width, samples = pixels.shape
        pixels = pixels.astype(pixels.dtype.newbyteorder(order), copy=False)
        high, wide = tile or (strip, width)
        starts, sizes = [], []
        for top in range(0, length, high):
            for side in range(0, width, wide):
                block = pixels[top : top + high, side : side + wide]
                if tile and block.shape[:2] != (high, wide):
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1).astype(pixels.dtype, copy=False)
                piece = pack(block.tobytes())
                starts.append(len(out))
                sizes.append(len(piece))
                out += piece
        place = (TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS) if tile else (None, STRIP_ROWS, STRIP_OFFSETS, STRIP_COUNTS)
        tags = {WIDTH: (4, [width]), LENGTH: (4, [length]), BITS: (3, [pixels.dtype.itemsize * 8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor]), place[1]: (4, [high]), place[2]: (4, starts), place[3]: (4, sizes)}
        if tile:
            tags[place[0]] = (4, [wide])
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            packed = struct.pack(f"{order}{len(values)}{KINDS[kind]}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                spot, packed = len(out), packed
                out += packed
                packed = struct.pack(order + "I", spot)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def payload_image(payload: bytes) -> np.ndarray:
    """Blanks up to a positive multiple of a row, as one image of 8-bit samples."""
    payload = payload.ljust(max(1, -(-len(payload) // ROW_BYTES)) * ROW_BYTES, b" ")
    return np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, ROW_SAMPLES)


def texts_to_tiff(df: DataFrame, *, key: str = "doc_id", text: str = "text", level: int = 6) -> DataFrame:
    """Every row's key, bytes of text and its TIFF file in column ``media``.

    Null text counts as empty and becomes one row of blanks. Rows are handled
    one by one: repeated keys stay, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
                media = [write_tiff([payload_image(b)], level=level) for b in raw]
                yield pa.record_batch([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


PAGE_FIELDS = "page int, height int, width int, samples int, bits int, compression int, predictor int, pieces int, tiled boolean, pixels binary, feature string, error string"


def feature(page: Page) -> str:
    """Shape, rounded-down mean of each sample, and a histogram of eight ranges; integers only."""
    length, width, samples = page.pixels.shape
    flat = page.pixels.reshape(-1, samples)
    means = ",".join(str(int(x)) for x in flat.sum(axis=0, dtype=np.float64) // max(1, len(flat)))
    ranges = ",".join(map(str, np.bincount(page.pixels.ravel() >> 5, minlength=8))) if page.pixels.dtype == np.uint8 else ""
    return f"{width}x{length}x{samples};{means};{ranges}"


def tiff_pages(df: DataFrame, *, media: str = "media") -> DataFrame:
    """One row for each page of each file: the row's other columns and the page's.

    Pixels are little-endian, row by row. A null or unreadable file gives one row
    with ``error`` set, after the pages read before the fault. Columns of the
    input named like a page's are replaced.
    """
    names = {f.split()[0] for f in PAGE_FIELDS.split(", ")}
    rows = df.select(*[c for c in df.columns if c not in names])
    kept = [c for c in rows.columns if c != media]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{media} binary", PAGE_FIELDS])

    def pages(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise TiffError("no file")
            for p in read_pages(data):
                h, w, n = p.pixels.shape
                yield p.number, h, w, n, p.bits, p.compression, p.predictor, p.pieces, p.tiled, p.pixels.astype(p.pixels.dtype.newbyteorder("<"), copy=False).tobytes(), feature(p), None
        except (ValueError, LookupError, TypeError, OverflowError, MemoryError) as e:
            yield (*[None] * 11, str(e) or type(e).__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = [(i, *p) for i, data in enumerate(part.column(part.schema.get_field_index(media)).to_pylist()) for p in pages(data)]
                if not found:
                    continue
                taken = part.take(pa.array([f[0] for f in found], pa.int32()))
                kinds = kinds or [pa.int32()] * 8 + [pa.bool_(), pa.binary(), pa.string(), pa.string()]
                columns = [taken.column(taken.schema.get_field_index(c)) for c in [*kept, media]]
                columns += [pa.array(v, k) for v, k in zip(list(zip(*found, strict=True))[1:], kinds, strict=True)]
                yield pa.record_batch(columns, names=[*kept, media, *[f.split()[0] for f in PAGE_FIELDS.split(", ")]])

    return rows.mapInArrow(run, schema)


def read_tiff_files(df: DataFrame) -> DataFrame:
    """Pages of files as Spark's ``binaryFile`` source lists them (path, content)."""
    return tiff_pages(df.select("path", F.col("content").alias("media")))


def pages_to_pandas(df: DataFrame) -> pd.DataFrame:
    """A few pages on the driver with their pixels as arrays, for a look or a test."""
    out = df.toPandas()
    out["pixels"] = [None if p is None else np.frombuffer(bytes(p), "u1" if b <= 8 else f"<u{b // 8}").reshape(int(h), int(w), int(n)) for p, b, h, w, n in out[["pixels", "bits", "height", "width", "samples"]].itertuples(index=False)]
    return out
