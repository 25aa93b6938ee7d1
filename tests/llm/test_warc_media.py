import base64
import hashlib
import io
import struct
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tracewright.llm import media, warc


def check_pages(rows, pages, min_bytes=0):
    data = {p: (h or "").encode() for p, h in pages}
    groups = defaultdict(list)
    for p, b in data.items():
        groups[b].append(p)
    assert sorted(r.page_id for r in rows) == sorted(data)
    for r in rows:
        b = data[r.page_id]
        first = max(groups[b])
        revisit = len(b) >= min_bytes and first != r.page_id
        assert r.payload_bytes == len(b) and r.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))


def test_query_reads_back_what_it_wrote(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    check_pages(warc.op8_warc(spark, sf).collect(), pages)


def test_chunks_stream_and_carry_digests(spark):
    rows = [(1, "a" * 1000, "http://x/ä b\n"), (2, None, None), (3, "", "u"), (4, "é" * 500, "u"), (5, "é" * 500, "u"), (6, "x" * 64, "u")]
    df = spark.createDataFrame([(p, u, h, 0) for p, h, u in rows], "page_id long, url string, html string, payload_bytes int")
    check_pages(warc.archive_pages(df).collect(), [(p, h) for p, h, _ in rows])
    check_pages(warc.archive_pages(df, min_bytes=2000).collect(), [(p, h) for p, h, _ in rows], 2000)
    archives = warc.write_archives(warc.assign_roles(df), chunk=64)
    back = warc.read_archives(archives, chunk=64, with_payload=True).collect()
    one = sorted((r for r in back if r.page_id == 1), key=lambda r: r.chunk_no)
    assert b"".join(r.data for r in one) == b"a" * 1000 and len(one) == 16
    assert [r.bytes_so_far for r in one][-1] == 1000 and [r.last for r in one] == [False] * 15 + [True]
    assert one[0].payload_digest is None and one[0].url == "http://x/%C3%A4%20b%0A"


def test_archives_defined_cases(spark):
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame([(None, "u", "same"), (7, "u", "same"), (7, "u", "same"), (None, None, "alone")], schema)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.archive_pages(df).collect())
    assert got == [(0, "response", 0), (0, "revisit", 7), (7, "response", 0), (7, "response", 0)]
    assert warc.archive_pages(df.where("false")).count() == 0


def test_writer_folds_the_digest_over_chunks(spark):
    """A payload that does not add up to its header's digest is an error, whatever chunk it is in."""
    rows = spark.createDataFrame([(1, "u", bytearray(b"x" * 300), 300, hashlib.sha1(b"y" * 300).hexdigest(), "response", None)],
                                 "page_id long, url string, payload binary, size long, digest string, record_type string, refers_to long")
    with pytest.raises(Exception, match="do not match its digest"):
        warc.write_archives(rows, chunk=64)


def test_damaged_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(__import__("gzip").compress(b"nonsense\r\n"))))
    head = warc._header({"page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "digest": hashlib.sha1(b"abc").hexdigest(), "size": 3})
    assert [r[9] for r in warc.read_records(io.BytesIO(__import__("gzip").compress(head + b"abc\r\n\r\n")))]
    for body in (b"abd\r\n\r\n", b"ab"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(__import__("gzip").compress(head + body))))


def bmp(image, bits, palette=None):
    rows = []
    for row in image[::-1]:
        if bits == 24:
            raw = row[:, ::-1].tobytes()
        elif bits == 8:
            raw = row.astype(np.uint8).tobytes()
        elif bits == 4:
            padded = np.append(row, [0] * (len(row) % 2))
            raw = bytes(int(a) << 4 | int(b) for a, b in zip(padded[::2], padded[1::2]))
        else:
            raw = np.packbits(row.astype(np.uint8)).tobytes()
        rows.append(raw + b"\0" * (-len(raw) % 4))
    colours = b"".join(struct.pack("<BBBB", c[2], c[1], c[0], 0) for c in palette or [])
    height, width = image.shape[:2]
    body = b"".join(rows)
    return struct.pack("<2sIHHI", b"BM", 54 + len(colours) + len(body), 0, 0, 54 + len(colours)) + struct.pack(
        "<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(body), 0, 0, len(palette or []), 0
    ) + colours + body


def test_decoders():
    rng = np.random.default_rng(0)
    grey, rgb = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)
    assert (media.decode_image(b"P5 # c\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode_image(b"P2\n7 5 255\n" + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    assert (media.decode_image(b"P6\n3 4\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode_image(b"P3\n3 4\n255\n" + b"\n".join(b"%d" % v for v in rgb.ravel())) == rgb).all()
    wide = rng.integers(0, 65536, (2, 3)).astype(np.uint16)
    assert (media.decode_image(b"P5\n3 2\n65535\n" + wide.astype(">u2").tobytes()) == wide).all()
    bits = rng.integers(0, 2, (3, 10)).astype(np.uint8)
    assert (media.decode_image(b"P4\n10 3\n" + np.packbits(bits, axis=1).tobytes()) == (1 - bits) * 255).all()
    assert (media.decode_image(b"P1\n10 3\n" + b"".join(b"%d" % v for v in bits.ravel())) == (1 - bits) * 255).all()
    assert (media.decode_image(bmp(rgb, 24)) == rgb).all()
    palette = [tuple(int(x) for x in rng.integers(0, 256, 3)) for _ in range(16)]
    for depth, top in ((1, 2), (4, 16), (8, 16)):
        index = rng.integers(0, top, (5, 7))
        assert (media.decode_image(bmp(index, depth, palette[:top])) == np.array(palette)[index]).all()
    for bad in (b"", b"P9\n1 1\n255\n", b"P5\n9 9\n255\n12", b"BM", b"P5\n7"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


def test_area_resize_weighs_pixels_by_covered_area():
    rng = np.random.default_rng(1)
    for shape, target in (((5, 7), (2, 3)), ((8, 9), (8, 9)), ((3, 2), (7, 5)), ((24, 24), (8, 9))):
        plane = rng.integers(0, 1000, shape)
        big = np.repeat(np.repeat(plane, target[0], 0), target[1], 1)
        want = big.reshape(target[0], shape[0], target[1], shape[1]).mean(axis=(1, 3))
        assert (media.area_resize(plane, *target) == np.floor(want * 1000 + 1e-6)).all()


def test_difference_hash_and_tile():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16
    tile = np.load(io.BytesIO(media.npy_tile(ramp)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8 and (np.diff(tile[0].astype(int)) > 0).all()


def check_media(rows, docs):
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes > len(payload)
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()


def brute_cells(plane, rows, columns):
    """Means over covered area, pixel by pixel, in exact fractions."""
    height, width = plane.shape
    out = np.zeros((rows, columns), np.int64)
    for i in range(rows):
        for j in range(columns):
            total = Fraction(0)
            for y in range(i * height // rows, -(-(i + 1) * height // rows)):
                tall = min(Fraction((i + 1) * height, rows), y + 1) - max(Fraction(i * height, rows), y)
                for x in range(j * width // columns, -(-(j + 1) * width // columns)):
                    wide = min(Fraction((j + 1) * width, columns), x + 1) - max(Fraction(j * width, columns), x)
                    total += tall * wide * int(plane[y, x]) * 1000
            out[i, j] = total * rows * columns / (height * width) // 1
    return out


def test_features_are_those_of_brute_force_cells(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 1500][:12]
    got = {r.doc_id: r.feature for r in media.op9_media(spark, sf).collect()}
    for r in docs:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        plane = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        small = brute_cells(plane, 8, 9)
        bits = "".join("1" if small[i, j] < small[i, j + 1] else "0" for i in range(8) for j in range(8))
        buffer = io.BytesIO()
        np.save(buffer, (brute_cells(plane, 16, 16) // 1000).astype(np.uint8))
        assert got[r.doc_id] == f"dhash:{int(bits, 2):016x};tile:{hashlib.sha256(buffer.getvalue()).hexdigest()[:16]}"


def test_strips_give_the_same_sums(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (1000, 24, 3), np.uint8)
    whole = media.difference_hash(image), media.npy_tile(image)
    monkeypatch.setattr(media, "STRIP", 100)
    assert (media.difference_hash(image), media.npy_tile(image)) == whole


def test_media_query_is_lossless(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op9_media(spark, sf).collect()
    assert len(rows) == len(docs)
    check_media(rows, docs)
    by = defaultdict(set)
    for r in rows:
        by[docs[r.doc_id]].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())


def test_media_defined_cases(spark):
    docs = {1: None, 2: "", 3: "x" * 576, 4: "é" * 100000, 5: "x" * 577}
    df = spark.createDataFrame([(k, t, 0) for k, t in docs.items()] + [(None, "x", 0), (5, docs[5], 0)], "doc_id long, text string, feature int")
    rows = media.media_features(df, with_media=True).collect()
    assert len(rows) == 7
    check_media([r for r in rows if r.doc_id is not None], docs)
    by = {r.doc_id: r for r in rows}
    assert by[1].feature == by[2].feature and media.decode_image(bytes(by[3].media)).tobytes() == b"x" * 576
    assert media.media_features(df.where("false")).count() == 0
