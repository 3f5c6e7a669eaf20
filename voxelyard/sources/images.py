"""Images as pixel rows. Masks and colour images are decoded by Spark's image reader; depth images are PNG files of 16 bits,
which that reader would cut to 8, and are decoded in the task that read their bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channels of the PNG format's colour types.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PNG_MARK = b"\x89PNG\r\n\x1a\n"
MASK, DEPTH, RGB = "path string, w int, h int, pixel long, value int", "path string, w int, h int, pixel long, raw double", "path string, w int, h int, u int, v int, r int, g int, b int"


def frame_of(path: Column) -> Column:
    """The number of a file's folder, whatever zeros it begins with; 0 for files of a flat folder."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/([0-9]+)/[^/]+$", 1), F.lit("")).cast("int"), F.lit(0))


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows whose first byte names their filter."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = rows[y]
        if kind == 1:
            for k in range(step):
                out[y, k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            now, up = bytearray(line.tobytes()), above.tobytes()
            for x in range(len(now)):
                a, b = now[x - step] if x >= step else 0, up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                now[x] = (now[x] + guess) & 255
            out[y] = np.frombuffer(bytes(now), np.uint8)
        else:
            out[y] = line
        above = out[y]
    return out


def decode_png(blob: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG file that isn't interlaced; colours of a palette stay its indices."""
    if blob[:8] != PNG_MARK:
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at + 8 <= len(blob):
        n, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, laced = head
    if laced:
        raise ValueError("an interlaced PNG file")
    channels = PNG_CHANNELS[colour]
    line = (w * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, line + 1)
    rows = _unfiltered(raw, max(1, channels * depth // 8))
    if depth == 16:
        return rows.reshape(h, -1).view(">u2").astype(np.uint16).reshape(h, w, channels)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth)
        return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[..., None]
    return rows.reshape(h, w, channels)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of (height, width[, 1 or 3]) values of 8 or 16 bits."""
    image = image[..., None] if image.ndim == 2 else image
    h, w, channels = image.shape
    wide = image.dtype == np.uint16
    body = image.astype(">u2" if wide else np.uint8).reshape(h, -1).view(np.uint8)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), body], axis=1).tobytes()
    part = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    head = struct.pack(">IIBBBBB", w, h, 16 if wide else 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return PNG_MARK + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def _pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, h, n, data): pictures as Spark's reader decodes them; rows of blue, green, red."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    return raw.select(F.col("image.origin").alias("path"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))


def read_masks(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(path, w, h, pixel v * w + u, value) of masks' pixels whose first channel is ``least`` or more; a file that can't be
    read is an error."""

    def run(batches):
        for b in batches:
            for name, w, h, n, data in zip(*(b.column(c).to_pylist() for c in ("path", "w", "h", "n", "data")), strict=True):
                if w < 1:
                    raise ValueError(f"not an image: {name}")
                value = np.frombuffer(data, np.uint8).reshape(h * w, n)[:, 0]
                at = np.flatnonzero(value >= least)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(np.full(k, w, np.int32)), pa.array(np.full(k, h, np.int32)), pa.array(at), pa.array(value[at].astype(np.int32))], names=["path", "w", "h", "pixel", "value"])

    return _pictures(spark, path).mapInArrow(run, MASK)


def read_colours(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, h, u, v, r, g, b) of every pixel; grey pictures have three equal channels."""

    def run(batches):
        for b in batches:
            for name, w, h, n, data in zip(*(b.column(c).to_pylist() for c in ("path", "w", "h", "n", "data")), strict=True):
                if w < 1:
                    raise ValueError(f"not an image: {name}")
                px = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int32)
                rgb = [px[:, 0]] * 3 if n < 3 else [px[:, 2], px[:, 1], px[:, 0]]
                at = np.arange(h * w)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), w, np.int32)), pa.array(np.full(len(at), h, np.int32)), pa.array((at % w).astype(np.int32)), pa.array((at // w).astype(np.int32)), *map(pa.array, rgb)], names=["path", "w", "h", "u", "v", "r", "g", "b"])

    return _pictures(spark, path).mapInArrow(run, RGB)


def read_depth(spark: SparkSession, path: str, metres: float = 0.0) -> DataFrame:
    """(path, w, h, pixel, raw) of every pixel of depth images, in their own unit; with ``metres`` (units of a metre) in
    metres, values that are not finite or below 0 being 0."""

    def run(batches):
        for b in batches:
            for name, blob in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                image = decode_png(blob)[..., 0].astype(np.float32)
                if metres:
                    image = image / np.float32(metres)
                    image[~np.isfinite(image) | (image < 0)] = 0
                h, w = image.shape
                for s in range(0, h * w, 1 << 18):
                    x = image.reshape(-1)[s : s + (1 << 18)]
                    k = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(np.full(k, w, np.int32)), pa.array(np.full(k, h, np.int32)), pa.array(np.arange(s, s + k)), pa.array(x.astype(float))], names=["path", "w", "h", "pixel", "raw"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, DEPTH)


def png_files(px: DataFrame, keys: list[str], w: int, h: int) -> DataFrame:
    """(keys, content): a PNG file of each key's pixel rows (pixel, value); other pixels are 0. One picture is one row."""

    def run(batches):
        for b in batches:
            out = []
            for rows in b.column("px").to_pylist():
                image = np.zeros(w * h, np.uint8)
                image[[r["pixel"] for r in rows]] = [r["value"] for r in rows]
                out.append(encode_png(image.reshape(h, w)))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(out, pa.binary())], names=[*keys, "content"])

    kinds = {f.name: f.dataType.simpleString() for f in px.schema}
    made = px.filter((F.col("pixel") >= 0) & (F.col("pixel") < w * h)).groupBy(*keys).agg(F.collect_list(F.struct("pixel", F.col("value").cast("int").alias("value"))).alias("px"))
    return made.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Rows (name, content) as files of a folder, through Spark's file system, a task at a time."""
    spark = files.sparkSession
    files.select("name", "content").write.mode("overwrite").parquet(f"{folder}/_content")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    for r in spark.read.parquet(f"{folder}/_content").toLocalIterator():  # one picture at a time
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}"), True)
        out.write(bytearray(r["content"]))
        out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/_content"), True)
