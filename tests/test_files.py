"""Image files: round trips, every kind of PNG against a plain encoder, exact value types."""

import struct
import zlib

import numpy as np
import pytest

from tessera.sources import pnm, rasters
from tessera.sources.png import PASSES, encode_png, parse_png


def build(f, depth, kind, filters, interlaced=False, extra=b""):
    """A PNG of samples (height, width, channels) with the given filter on each row, by the format's definition."""
    h, w, ch = f.shape
    size, body = max(1, ch * depth // 8), b""
    for y0, x0, dy, dx in PASSES if interlaced else ((0, 0, 1, 1),):
        part = f[y0::dy, x0::dx]
        if not part.size:
            continue
        above = None
        for n, row in enumerate(part):
            bits = "".join(format(int(v), f"0{depth}b") for v in row.ravel())
            line = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
            above, t = above or bytes(len(line)), filters[n % len(filters)]
            out = []
            for i, v in enumerate(line):
                a, b, c = (line[i - size] if i >= size else 0), above[i], (above[i - size] if i >= size else 0)
                p = a + b - c
                near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                out.append((v - (0, a, b, (a + b) // 2, near)[t]) % 256)
            body += bytes([t, *out])
            above = line
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    z = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, int(interlaced))) + extra + chunk(b"IDAT", z[:7]) + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
def test_png_kinds(interlaced):
    rng = np.random.default_rng(3)
    for kind, ch, depths in ((0, 1, (1, 2, 4, 8, 16)), (2, 3, (8, 16)), (4, 2, (8, 16)), (6, 4, (8, 16))):
        for depth in depths:
            for h, w in ((1, 1), (5, 3), (9, 17)):
                f = rng.integers(0, 1 << depth, (h, w, ch))
                got = parse_png(build(f, depth, kind, (0, 1, 2, 3, 4), interlaced))
                scale = {2: 85, 4: 17}.get(depth, 1)
                assert (got == f * scale).all() and got.dtype == {1: bool, 16: np.uint16}.get(depth, np.uint8)
    colours = rng.integers(0, 256, (5, 3)).astype(np.uint8)
    f = rng.integers(0, 5, (6, 7, 1))
    extra = struct.pack(">I", 15) + b"PLTE" + colours.tobytes() + struct.pack(">I", zlib.crc32(b"PLTE" + colours.tobytes()))
    for depth in (4, 8):
        assert (parse_png(build(f, depth, 3, (4, 3), interlaced, extra)) == colours[f[:, :, 0]]).all()


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(4)
    for ch in (1, 2, 3, 4):
        for kind in (np.uint8, np.uint16):
            f = rng.integers(0, np.iinfo(kind).max + 1, (4, 5, ch)).astype(kind)
            assert (parse_png(encode_png(f)) == f).all()
    f = rng.integers(0, 2, (3, 11, 1)).astype(bool)
    data = encode_png(f)
    assert (parse_png(data) == f).all() and parse_png(data).dtype == bool
    for bad in (b"", data[:20], data[:-14], data[:40] + b"\x00" + data[41:]):
        with pytest.raises(ValueError):
            parse_png(bad)


@pytest.mark.parametrize("kind,top", [("pgm", 255), ("png", 255), ("png", 65535)])
def test_saved_files(spark, tmp_path, kind, top):
    px = rasters.from_rows(spark, [[1, 2, 300], [4, 5, 6]])
    pnm.save_files(px, f"{tmp_path}/out", kind, top)
    pnm.save_files(px, f"{tmp_path}/out", kind, top)
    assert [p.name for p in (tmp_path / "out").iterdir()] == [f"0.{kind}"]
    back = pnm.imread(spark, f"{tmp_path}/out", expect="uint16" if top > 255 else "uint8")
    assert [r.v for r in back.orderBy("y", "x").collect()] == [1, 2, min(300, top), 4, 5, 6]


def test_exact_types(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(encode_png(np.zeros((2, 2, 3), np.uint8)))
    (tmp_path / "b.pbm").write_text("P1\n2 1\n1 0")
    (tmp_path / "c.pgm").write_text("P2\n1 1\n1000\n700")
    for name, kind in (("a.png", "rgb8"), ("b.pbm", "bool"), ("c.pgm", "uint16")):
        assert pnm.imread(spark, f"{tmp_path}/{name}", expect=kind).count() > 0
        with pytest.raises(Exception, match="values are"):
            pnm.imread(spark, f"{tmp_path}/{name}", expect="uint8").count()
    assert pnm.imread(spark, str(tmp_path), True, "rgb8").select("path").distinct().count() == 1
