"""Media columns: Netpbm and BMP images as binary columns, decoded to numpy arrays.

Images are area-resized by integral images (every source pixel weighs in by the area it covers), written as
NPY tiles, and marked with difference hashes. Bytes are stored as the samples of a grey map and read back. The
integral image is summed in strips of rows and held only at the rows where target pixels begin, so what a text
needs beyond its own bytes, those stored and the payload between them, does not grow with it.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import map_arrow, table

WIDTH, UNIT, FILL = 24, 576, 255
HASH_ROWS, HASH_COLUMNS, TILE = 8, 9, 16
#: Pixels of a strip that are summed at once.
STRIP = 1 << 17
_space = re.compile(rb"(?:\s|#[^\n\r]*[\n\r]?)+")


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    """A binary grey map of ``width`` columns; the samples must fill whole rows."""
    if len(samples) % width:
        raise ValueError("samples do not fill whole rows")
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def decode_netpbm(data: bytes) -> np.ndarray:
    """Rows x columns (x 3) samples of P1 to P6; sixteen-bit samples become uint16."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    at, numbers = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        gap = _space.match(data, at)
        digits = re.compile(rb"\d+").match(data, gap.end() if gap else at)
        if not gap or not digits:
            raise ValueError("Netpbm header is cut short")
        numbers.append(int(digits.group()))
        at = digits.end()
    width, height, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * depth
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b" ", data[at:])
        values = [int(x) for x in (re.findall(rb"[01]", body) if kind == b"P1" else body.split())]
        out = np.asarray(values[:count], np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        row = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        out = np.unpackbits(packed, axis=1)[:, :width].ravel()
    else:
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
        out = out.astype(np.uint16) if top > 255 else out
    if len(out) != count:
        raise ValueError("Netpbm samples are cut short")
    if kind in (b"P1", b"P4"):
        out = ((1 - out) * 255).astype(np.uint8)
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel as rows x columns x 3 in RGB order."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    number = lambda at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    start, header, width, height = number(10), number(14), number(18, 4, True), number(22, 4, True)
    bits, packing, colours = number(28, 2), number(30), number(46)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("BMP is compressed or of an unknown depth")
    row = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()
    table_ = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + header).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = rows[:, :width]
    else:
        index = np.unpackbits(rows, axis=1)
        if bits == 4:
            index = (index.reshape(abs(height), -1, 4) * np.array([8, 4, 2, 1], np.uint8)).sum(axis=2, dtype=np.uint8)
        index = index[:, :width]
    return table_[index]


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma in thousandths of a sample, in whole numbers."""
    if image.ndim == 2:
        return image.astype(np.int64) * 1000
    return image.astype(np.int64) @ np.array([299, 587, 114])


def edge_integrals(image: np.ndarray, parts: set[int]) -> dict[int, np.ndarray]:
    """The integral image of ``image`` at the rows that edges of ``parts`` rows touch: row number to sums of all columns."""
    height, width = image.shape[:2]
    wanted = sorted({min(height, k * height // p + d) for p in parts for k in range(p + 1) for d in (0, 1)})
    strip, found, above, at = max(1, STRIP // width), {}, np.zeros(width, np.int64), 0
    for row in wanted:
        while at < row:
            end = min(row, at + strip)
            above = above + grey(image[at:end]).sum(axis=0)
            at = end
        found[row] = np.concatenate([[0], above.cumsum()])
    return found


def area_resize(image: np.ndarray, rows: int, columns: int, integral: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Mean luma over the area that each target pixel covers, from the integral image, in whole thousandths, rounded down.

    Edges that fall inside a pixel are weighted exactly: sums are taken in units of 1/(rows * columns) pixel.
    """
    height, width = image.shape[:2]
    sums = edge_integrals(image, {rows}) if integral is None else integral
    lines = []
    for k in range(rows + 1):
        whole, part = divmod(k * height, rows)
        lines.append(sums[whole] * (rows - part) + sums[min(whole + 1, height)] * part)
    edge = np.arange(columns + 1) * width
    whole, part = edge // columns, edge % columns
    stack = np.stack(lines)
    total = stack[:, whole] * (columns - part) + stack[:, np.minimum(whole + 1, width)] * part
    return np.ascontiguousarray(np.diff(np.diff(total, axis=0), axis=1) // (height * width))


def difference_hash(image: np.ndarray, integral: dict[int, np.ndarray] | None = None) -> str:
    """64 bits, row by row: whether a cell is darker than the one to its right."""
    small = area_resize(image, HASH_ROWS, HASH_COLUMNS, integral)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE, integral: dict[int, np.ndarray] | None = None) -> bytes:
    """A side x side tile of 8-bit grey as an NPY file."""
    buffer = io.BytesIO()
    np.save(buffer, (area_resize(image, side, side, integral) // 1000).clip(0, 255).astype(np.uint8))
    return buffer.getvalue()


def pad_payload(data: bytes, unit: int = UNIT, fill: int = FILL) -> bytes:
    return data + bytes([fill]) * (max(1, -(-len(data) // unit)) * unit - len(data))


_ROW = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(data: bytes) -> tuple:
    """Store ``data`` as an image, read it back and describe both; with the stored bytes and the tile."""
    stored = encode_pgm(pad_payload(data))
    image = decode_image(stored)
    back = memoryview(image).cast("B")
    integral = edge_integrals(image, {HASH_ROWS, TILE})
    tile = npy_tile(image, TILE, integral)
    feature = f"dhash:{difference_hash(image, integral)};tile:{hashlib.sha256(tile).hexdigest()[:16]}"
    return (
        len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored),
        hashlib.sha256(stored).hexdigest(), feature, stored, tile,
    )


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Rows ``(doc_id, n_bytes, ..., feature)``, one per row; ``with_media`` adds the columns media and tile.

    A null or empty text is one unit of fill. Equal texts give equal values; null ids and repeated rows
    pass through; an empty table gives no rows. Rows are handled one at a time; a text is held
    as it is read, as the payload and as stored, three times its bytes.
    """
    names = ["doc_id"] + [c.split()[0] for c in _ROW.split(", ")] + ["media", "tile"] * with_media
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * 2 * with_media

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, data in zip(batch.column(0), batch.column(1)):
                row = describe(data.as_py() or b"")
                rows.append((doc_id.as_py(), *row[: 9 if with_media else 7]))
                held += row[4] if with_media else 0
                if held > 16 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("data"))
    return map_arrow(narrow, scan, f"doc_id long, {_ROW}" + ", media binary, tile binary" * with_media)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
