"""Image bytes: headers of all formats, pixels of the uncompressed ones."""

import os
import struct
import tempfile

import numpy as np

from kindred.plans import geometry
from kindred.sources import files, images


def bmp(pixels, bits=24, top_down=False):
    h, w, _ = pixels.shape
    rows = b""
    for row in pixels if top_down else pixels[::-1]:
        line = b"".join(bytes([b, g, r] + [255] * (bits // 8 - 3)) for r, g, b in row.tolist())
        rows += line + b"\0" * (-len(line) % 4)
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, len(rows), 0, 0, 0, 0) + rows


def test_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xff\xc4" + struct.pack(">H", 3) + b"x" + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 33, 77) + b"\3\0\0\0"
    assert images.facts(png) == ("png", 640, 480) and images.facts(jpeg) == ("jpeg", 77, 33) and images.facts(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("gif", 5, 6)
    assert images.facts(b"P6 # a\n# b\n12 # c\n7\n255\n") == ("p6", 12, 7)
    for cut in (None, b"", b"P3", b"P3 x", png[:20], jpeg[:12], b"BM12", b"hello", jpeg[:-8]):
        assert images.facts(cut) is None and (cut is None or images.pixels(cut) is None)


def test_pixels():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (4, 2)):
        p = rng.integers(0, 256, (h, w, 3))
        head = f"{w} {h}\n255\n".encode()
        forms = [bmp(p), bmp(p, 32), bmp(p, 24, True), b"P6\n" + head + p.astype(np.uint8).tobytes(), b"P3\n# x\n" + head + " ".join(map(str, p.ravel())).encode()]
        assert all((images.pixels(f) == p).all() for f in forms) and all(images.pixels(f[:-3]) is None for f in forms[:4])
        grey = p[:, :, 0]
        assert (images.pixels(b"P5 " + head + grey.astype(np.uint8).tobytes()) == grey[:, :, None]).all() and (images.pixels(b"P2 " + head + " ".join(map(str, grey.ravel())).encode()) == grey[:, :, None]).all()


def test_tables_of_images(spark, monkeypatch):
    monkeypatch.setattr(images, "PIXELS", 7)
    p = np.random.default_rng(1).integers(0, 256, (9, 6, 3))
    rows = spark.createDataFrame([("a", bytearray(bmp(p))), ("b", None), ("c", bytearray(b"junk"))], "path string, content binary")
    assert {r.path: (r.format, r.width, r.height) for r in images.image_sizes(rows).collect()} == {"a": ("bmp", 6, 9), "b": (None, None, None), "c": (None, None, None)}
    luma = p @ np.array([0.2126, 0.7152, 0.0722])
    got = {(r.row, r.col): r.luma for r in images.luma_grid(rows).collect()}
    assert len(got) == 54 and all(abs(luma[k] - v) < 1e-9 for k, v in got.items())
    few = {(r.row, r.col): r.luma for r in images.luma_grid(rows, rows=4, cols=3).collect()}
    assert len(few) == 12 and all(abs(luma[2 * r, 2 * c] - v) < 1e-9 for (r, c), v in few.items())


def test_packed_files_are_listed_as_single_ones(spark, tmp_path):
    names = {"a.json": b'{"ok":true}', "b.json": b"{}", "manifest.json": b"[]", "c.txt": b"x", "d.ppm": b"P3\n1 1\n255\n1 2 3\n", "e.MP4": b"\0\1", "f.json.bak": b"{}"}
    (tmp_path / "single").mkdir()
    for name, data in names.items():
        (tmp_path / "single" / name).write_bytes(data)
    rows = spark.createDataFrame([(f"/top/{k}", bytearray(v)) for k, v in names.items()], "path string, content binary")
    files.pack(rows, str(tmp_path / "packed"))

    def bundles(folder, packed):
        found = files.bundle_listing(spark, str(tmp_path / folder), packed=packed).collect()
        assert all(r.modified_at_ms > 0 for r in found)
        return sorted((r.file_name, r.bytes, bytes(r.content)) for r in found)

    def kinds(folder, packed):
        return sorted((r.path.split("/")[-1], r.kind, r.bytes, bytes(r.content)) for r in files.media(spark, str(tmp_path / folder), packed).collect())

    assert bundles("single", False) == bundles("packed", True) == [("a.json", 11, b'{"ok":true}'), ("b.json", 2, b"{}")]
    assert kinds("single", False) == kinds("packed", True) and len(kinds("packed", True)) == 7


def test_files_written_do_not_grow_with_the_images(spark, data, monkeypatch):
    made = []
    monkeypatch.setattr(geometry, "shared_folder", lambda s: f"file://{made[0]}")
    for query in ("src4_image_sizes", "src5_file_thumbnails", "geo15_luma_of_files"):
        made[:] = [tempfile.mkdtemp(prefix="spark-")]
        geometry.P.queries[query](spark, data.replace("sf0.001", "sf0.1")).count()
        assert sum(len(found) for _, _, found in os.walk(made[0])) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 4
