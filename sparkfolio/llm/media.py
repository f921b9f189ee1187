"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized by integral images, to NPY tiles and difference hashes."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

#: Pixels a row of the images that hold payloads: 64 RGB pixels are 192 bytes.
WIDTH = 64


def to_ppm(samples: np.ndarray) -> bytes:
    """A binary Netpbm image (P6 or P5) of an uint8 array, height x width x 3 or height x width."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples).tobytes()


def to_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 24-bit bottom-up BMP of a height x width x 3 uint8 array."""
    height, width = samples.shape[:2]
    stride = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = samples[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHI IiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _numbers(data: bytes, at: int, need: int) -> tuple[list[int], int]:
    """So many numbers of a Netpbm header from place `at`, comments skipped, and the place after them."""
    fields: list[int] = []
    while len(fields) < need:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit() and end - at < 10:
            end += 1
        if end == at or data[end : end + 1].isdigit():
            raise ValueError("a Netpbm header lacks a number of at most ten digits")
        fields.append(int(data[at:end]))
        at = end
    return fields, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap, plain, depth = kind in (1, 4), kind < 4, 3 if kind in (3, 6) else 1
    fields, at = _numbers(data, 2, 2 if bitmap else 3)
    width, height, most = fields[0], fields[1], 1 if bitmap else fields[2]
    if not 0 < most < 65536:
        raise ValueError(f"{most} isn't a greatest Netpbm sample")
    n, wide = width * height * depth, 2 if most > 255 else 1
    if len(data) - at < (n if plain else height * ((width + 7) // 8) if bitmap else n * wide):
        raise ValueError("a Netpbm raster is short")
    if plain and bitmap:
        x = 49 - np.frombuffer(bytes(c for c in data[at:] if c in b"01")[:n], np.uint8).astype(np.int64)
    elif plain:
        x = np.array(data[at:].split()[:n], np.int64)
    elif bitmap:
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        x = 1 - np.unpackbits(rows, axis=1)[:, :width].reshape(-1).astype(np.int64)
    else:
        x = np.frombuffer(data, ">u2" if wide == 2 else np.uint8, n, at + 1)
    if len(x) < n:
        raise ValueError("a Netpbm raster is short")
    if n and most != 255 and not bitmap or plain and n:
        if x.min() < 0 or x.max() > most:
            raise ValueError("a Netpbm sample is out of range")
    if most != 255:
        x = (x.astype(np.int64) * 255 + most // 2) // most
    return x.astype(np.uint8).reshape((height, width, 3) if depth == 3 else (height, width))


def _spread(x: np.ndarray, mask: int) -> np.ndarray:
    """The bits of x under mask as samples from 0 to 255."""
    if not mask:
        return np.zeros(x.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return (((x & mask) >> low).astype(np.int64) * 255 // most).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, header = struct.unpack_from("<II", data, 10)
    if header == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        packed, used, entry = 0, 0, 3
    elif header >= 40:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        used, entry = struct.unpack_from("<I", data, 46)[0], 4
    else:
        raise ValueError(f"a BMP header of {header} bytes isn't read")
    if bits not in (1, 4, 8, 16, 24, 32) or packed not in (0, 3) or packed == 3 and bits < 16:
        raise ValueError(f"a BMP of {bits} bits with compression {packed} isn't read")
    flip, height = height > 0, abs(height)
    if width <= 0 or not height:
        raise ValueError("a BMP has no pixels")
    stride = (bits * width + 31) // 32 * 4
    if len(data) - start < stride * height:
        raise ValueError("a BMP raster is short")
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    if bits <= 8:
        palette = np.frombuffer(data, np.uint8, entry * (used or 1 << bits), 14 + header).reshape(-1, entry)[:, 2::-1]
        each = np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])
        x = palette[each[:, :width]]
    elif packed == 3 or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        cells = np.ascontiguousarray(rows[:, : bits // 8 * width]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        x = np.stack([_spread(cells, m) for m in masks], axis=2)
    else:
        x = rows[:, : bits // 8 * width].reshape(height, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(x[::-1] if flip else x)


def decode(data: bytes) -> np.ndarray:
    """Netpbm P1-P6 or BMP (1, 4, 8, 16, 24, 32 bits, masks, either row order, not run-length encoded) to uint8,
    height x width (x 3). ValueError, struct.error or IndexError for anything else, before memory beyond the
    size of the data is taken."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _corners(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The m + 1 borders of equal areas over n cells: the cells before each, and the share of the next one."""
    p = np.arange(m + 1) * (n / m)
    k = np.minimum(p.astype(np.int64), n - 1)
    used = np.unique(np.concatenate([k, k + 1]))
    return used, np.searchsorted(used, k), p - k


def _integral(x: np.ndarray, used: np.ndarray, axis: int) -> np.ndarray:
    """The integral along an axis, read at the places `used` only: sums of the cells before each."""
    pad = np.zeros([1 if i == axis else n for i, n in enumerate(x.shape)])
    cuts = used[:-1] if used[0] == 0 else np.concatenate([[0], used[:-1]])
    sums = np.cumsum(np.add.reduceat(x, cuts, axis=axis, dtype=np.float64), axis=axis)
    return np.concatenate([pad, sums], axis=axis) if used[0] == 0 else sums


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, exact for fractional borders: the integral image is read at real-valued
    corners by linear interpolation. Float64; enlarges too. The integral is kept only at the rows and columns
    beside corners, so memory is that of the result and of one row for each of its borders."""
    s = image
    for axis, m in ((0, height), (1, width)):
        n = s.shape[axis]
        used, k, w = _corners(n, m)
        sums = _integral(s, used, axis)
        w = w.reshape([-1 if i == axis else 1 for i in range(sums.ndim)])
        s = np.diff(np.take(sums, k, axis) * (1 - w) + np.take(sums, k + 1, axis) * w, axis=axis)
    return s / ((image.shape[0] / height) * (image.shape[1] / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each of 8 x 9 grey areas is darker than its right neighbour."""
    small = area_resize(image, 8, 9)
    small = np.round(small if image.ndim == 2 else small @ np.array([0.299, 0.587, 0.114]), 6)
    return np.packbits((small[:, :-1] < small[:, 1:]).reshape(-1)).tobytes().hex()


def to_npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, media: str = "media", size: int = 16) -> DataFrame:
    """df and, for each media cell: height, width, channels, samples (the decoded raster's bytes), tile (an
    NPY file of size x size areas, rounded to uint8) and dhash. A null, or bytes that don't decode, give
    nulls and the reason in media_error. Rows are independent, so a lost task is simply run again."""
    schema = df.select("*", F.lit(0).alias("height"), F.lit(0).alias("width"), F.lit(0).alias("channels"), F.lit(b"").alias("samples"), F.lit(b"").alias("tile"), F.lit("").alias("dhash"), F.lit("").alias("media_error")).schema
    for f in schema.fields[-7:]:
        f.nullable = True
    clash = {"height", "width", "channels", "samples", "tile", "dhash", "media_error"} & set(df.columns)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    place = df.columns.index(media)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        try:
            x = decode(data)
            if not x.size:
                raise ValueError("an empty raster")
            tile = np.floor(area_resize(x, size, size) + 0.5).clip(0, 255).astype(np.uint8)
            return x.shape[0], x.shape[1], 1 if x.ndim == 2 else 3, x.tobytes(), to_npy(tile), difference_hash(x), None
        except (ValueError, ArithmeticError, struct.error, IndexError) as e:
            return (None,) * 6 + (str(e),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place, 4 << 20):
                made = [one(x) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(c), k) for c, k in zip(zip(*made), kinds))], [*part.schema.names, *(f.name for f in schema.fields[-7:])])

    return df.mapInArrow(run, schema)


def text_images(docs: DataFrame, id_col: str = "doc_id", text: str = "text", kind: str = "ppm") -> DataFrame:
    """id, n_bytes and media: each whole text's UTF-8 bytes, filled with spaces to a positive multiple of
    192, as rows of 64 RGB pixels of a Netpbm or BMP image. Null and empty texts give one row of spaces."""
    write = {"ppm": to_ppm, "bmp": to_bmp}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                made = [write(np.frombuffer(x.ljust(max(1, -(-len(x) // (3 * WIDTH))) * 3 * WIDTH), np.uint8).reshape(-1, WIDTH, 3)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(made, pa.binary())], ["id", "n_bytes", "media"])

    asked = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    return asked.mapInArrow(run, f"id {asked.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = media_tiles(text_images(documents(spark, sf_dir)))
    n = F.length("samples")
    return x.select(
        F.col("id").alias("doc_id"), "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"), "height", "width",
    )
