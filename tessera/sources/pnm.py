"""Netpbm images (P1 to P6), PNG and NIfTI-1 volumes from binary files, and writers; tree tables on disk; DOT text.

Files are read by Spark's binaryFile source and parsed in Arrow batches, one row a file: a folder of images is one scan.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.png import encode_png, parse_png

SCHEMA = "path string, y int, x int, c int, v double"


class RasterError(ValueError):
    """A file that can't be read as asked."""


def parse_pnm(data: bytes) -> np.ndarray:
    """(height, width, channels) of one image, booleans (1 is true), uint8 or uint16."""
    at, tokens = 2, []
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise RasterError("not a Netpbm image")
    need = 2 if kind in (b"P1", b"P4") else 3
    while len(tokens) < need:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        tokens.append(int(data[at:end]))
        at = end
    w, h = tokens[:2]
    ch = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = b" ".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = np.array([int(c) for c in body.replace(b" ", b"").decode()] if kind == b"P1" else body.split(), np.int64)
    elif kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at + 1)[: h * -(-w // 8)].reshape(h, -1), axis=1)
        values = bits[:, :w].astype(np.int64).ravel()
    else:
        values = np.frombuffer(data, np.uint8 if tokens[2] < 256 else ">u2", offset=at + 1, count=h * w * ch).astype(np.int64)
    if len(values) < h * w * ch:
        raise RasterError("image ends early")
    return values[: h * w * ch].astype(bool if need == 2 else np.uint8 if tokens[2] < 256 else np.uint16).reshape(h, w, ch)


#: NIfTI-1 type codes.
NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def parse_nifti(data: bytes) -> np.ndarray:
    """First slice of a NIfTI-1 volume as (height, width, 1)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for order in "<>":
        if struct.unpack_from(order + "i", data)[0] == 348:
            break
    else:
        raise RasterError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", data, 40)
    code, offset = struct.unpack_from(order + "h", data, 70)[0], int(struct.unpack_from(order + "f", data, 108)[0])
    if code not in NIFTI:
        raise RasterError(f"values of type {code} can't be read")
    w, h = dim[1], max(1, dim[2])
    return np.frombuffer(data, order + NIFTI[code], count=w * h, offset=offset).reshape(h, w, 1)


PARSERS = {"pnm": parse_pnm, "pbm": parse_pnm, "pgm": parse_pnm, "ppm": parse_pnm, "nii": parse_nifti, "gz": parse_nifti, "png": parse_png}


def register(extension: str, parser) -> None:
    """Adds a reader for files of an extension: bytes to (height, width, channels)."""
    PARSERS[extension] = parser


def value_type(f: np.ndarray) -> str:
    """Name of an image's value type: bool, uint8, uint16, rgb8, rgb16, rgba8, ... or numpy's name of another one."""
    name = {1: "", 2: "greya", 3: "rgb", 4: "rgba"}.get(f.shape[2], f"{f.shape[2]}x")
    return f"{name}{f.dtype.name.removeprefix('uint')}" if name else f.dtype.name


def imread(spark: SparkSession, path: str, permissive: bool = False, expect: str | None = None) -> DataFrame:
    """Pixels (path, y, x, c, v) of one file, a folder or a glob. Files that can't be read, or whose ``value_type`` isn't
    exactly ``expect`` where it is given, raise, or are left out if ``permissive``."""
    parsers = dict(PARSERS)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    f = parsers.get(name.rsplit(".", 1)[-1].lower(), parse_pnm)(data)
                    if expect and value_type(f) != expect:
                        raise RasterError(f"{name}: values are {value_type(f)}, not {expect}")
                except (RasterError, ValueError, struct.error):
                    if permissive:
                        continue
                    raise
                y, x, c = (i.ravel() for i in np.indices(f.shape))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(y)), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(c, pa.int32()), pa.array(f.ravel().astype(float))], names=["path", "y", "x", "c", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def _pnm(f: np.ndarray, top: int) -> bytes:
    return f"P{5 if f.shape[2] == 1 else 6}\n{f.shape[1]} {f.shape[0]}\n{top}\n".encode() + f.astype(np.uint8 if top < 256 else ">u2").tobytes()


#: Writers by extension: (array of uint8 or uint16, largest value) to bytes.
WRITERS = {"pgm": _pnm, "ppm": _pnm, "pnm": _pnm, "png": lambda f, top: encode_png(f)}


def register_writer(extension: str, writer) -> None:
    """Adds a writer for files of an extension: (array (height, width, channels), largest value) to bytes."""
    WRITERS[extension] = writer


def encode(px: DataFrame, kind: str = "pnm", top: int = 255) -> DataFrame:
    """(image_id, content): each image, of columns v or r, g, b, kept within 0..top, in a format of ``WRITERS``; 8 bits a
    value, or 16 if ``top`` is above 255. An image's rows meet in one task; sites without a pixel are 0."""
    names = ["v"] if "v" in px.columns else ["r", "g", "b"]
    writer = WRITERS[kind]
    from tessera.operators.rasterwise import Grid

    def run(table):
        g = Grid(table, names)
        f = np.stack([g[c] for c in names], 2).clip(0, top).astype(np.uint8 if top < 256 else np.uint16)
        return pa.table({"image_id": pa.array([g.image], pa.int64()), "content": pa.array([writer(f, top)], pa.binary())})

    return px.select("image_id", "y", "x", *names).groupBy("image_id").applyInArrow(run, "image_id long, content binary")


def encode_pnm(px: DataFrame, top: int = 255) -> DataFrame:
    """(image_id, content): each image as a binary PGM or PPM."""
    return encode(px, "pnm", top)


def save_files(px: DataFrame, folder: str, kind: str, top: int = 255) -> None:
    """One file <image_id>.<kind> for each image in a folder that executors share (a path or a URI that pyarrow knows).
    A file gets its name when it is whole, so tasks that are run again replace it by the same."""

    def run(batches):
        import os
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        files.create_dir(base)
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = f"{base}/_{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(data)
                files.move(part, f"{base}/{i}.{kind}")
            yield b.select(["image_id"])

    encode(px, kind, top).mapInArrow(run, "image_id long").write.format("noop").mode("overwrite").save()


def imsave(px: DataFrame, path: str) -> None:
    """Parquet for a path ending in .parquet; else one PGM or PPM line-delimited table of (image_id, base64) rows, read back by ``load_saved``."""
    if path.endswith(".parquet"):
        px.write.mode("overwrite").parquet(path)
    else:
        encode_pnm(px).select("image_id", F.base64("content").alias("content")).write.mode("overwrite").json(path)


def load_saved(spark: SparkSession, path: str) -> DataFrame:
    """px(image_id, y, x, c, v) of what ``imsave`` wrote."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    rows = spark.read.schema("image_id long, content string").json(path).select("image_id", F.unbase64("content").alias("content"))

    def run(batches):
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = parse_pnm(data)
                y, x, c = (k.ravel() for k in np.indices(f.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), i)), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(c, pa.int32()), pa.array(f.ravel().astype(np.int32))], names=["image_id", "y", "x", "c", "v"])

    return rows.mapInArrow(run, "image_id long, y int, x int, c int, v int")


def save_tree(nodes: DataFrame, pmap: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    pmap.write.mode("overwrite").parquet(f"{path}/pmap")


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/pmap")


def graphviz(nodes: DataFrame) -> DataFrame:
    """DOT statements (image_id, n, line): a node for each row, an edge to its parent."""
    own = F.concat(F.col("node_id").cast("string"), F.lit(' [label="'), F.col("level").cast("string"), F.lit('"];'))
    edge = F.concat(F.col("node_id").cast("string"), F.lit(" -> "), F.col("parent_id").cast("string"), F.lit(";"))
    return nodes.select("image_id", "node_id", F.explode(F.filter(F.array(own, edge), lambda s: s.isNotNull())).alias("line"))
