"""Media columns: Netpbm and BMP bytes to numpy arrays, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import materialize

BLOCK = 576
WIDTH = 24
TILE_ROWS = 4096
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


#: Samples of an image at most: a header may ask for any number.
MOST_SAMPLES = 1 << 31


def _shape(*sides: int) -> int:
    count = 1
    for n in sides:
        count *= n
    if not 0 < count <= MOST_SAMPLES:
        raise ValueError(f"image of {' x '.join(map(str, sides))}"[:100])
    return count


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3): 8 bits a sample, 16 above maxval 255.
    Samples of another maxval are scaled to the full 8 or 16 bits, and held within them."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not a Netpbm file")
    at, fields = 2, []
    for _ in range(2 if kind in b"14" else 3):
        if not (m := _FIELD.match(data, at)) or len(m[1]) > 10:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = fields[0], fields[1], (fields + [1])[2]
    if not 0 < most < 65_536:
        raise ValueError(f"maxval {most}")
    shape = (height, width, 3) if kind in b"36" else (height, width)
    count = _shape(*shape)
    if kind == b"4":
        rows = np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    if kind == b"1":
        bits = re.sub(rb"#[^\n]*|\s", b"", data[at:])[:count]
        return ((1 - (np.frombuffer(bits, np.uint8) - 48)) * 255).astype(np.uint8).reshape(shape)
    if kind in b"23":
        words = re.sub(rb"#[^\n]*", b"", data[at:]).split()[:count]
        if any(len(w) > 10 for w in words):
            raise ValueError("a sample beyond maxval")
        values = np.array(words, np.int64).reshape(shape)
    else:
        values = np.frombuffer(data, "u1" if most < 256 else ">u2", count, at + 1).reshape(shape)
    full, dtype = (255, np.uint8) if most < 256 else (65_535, np.uint16)
    if most != full:
        values = (np.minimum(values.astype(np.int64), most) * full + most // 2) // most
    return np.clip(values, 0, full).astype(dtype)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 16, 24 or 32 bits as (height, width, 3), red first;
    bit fields are read by their masks, or the usual ones where there are none."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, head, width, height = struct.unpack_from("<IIii", data, 10)
    _, bits, packing = struct.unpack_from("<HHI", data, 26)
    if packing not in (0, 3, 6) or bits not in (8, 16, 24, 32):
        raise ValueError(f"BMP with {bits} bits, compression {packing}")
    size = bits // 8
    _shape(max(0, width), abs(height), 3)
    stride = -(-width * size // 4) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = (rows[::-1] if height > 0 else rows)[:, : width * size].reshape(abs(height), width, size)
    if bits == 8:
        used = min(256, struct.unpack_from("<I", data, 46)[0] or 256)
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)
        return palette[rows[:, :, 0]][:, :, 2::-1]
    if bits == 24 or (bits == 32 and packing == 0):
        return np.ascontiguousarray(rows[:, :, 2::-1])
    masks = struct.unpack_from("<III", data, 54) if packing else (0x7C00, 0x3E0, 0x1F)
    pixels = np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4")[:, :, 0].astype(np.int64)
    out = np.zeros((*pixels.shape, 3), np.uint8)
    for k, mask in enumerate(masks):
        if mask:
            low = mask & -mask
            most = mask // low
            out[:, :, k] = ((pixels & mask) // low * 255 + most // 2) // most
    return out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_netpbm(pixels: np.ndarray) -> bytes:
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit, bottom row first."""
    height, width, _ = pixels.shape
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def area_resize(pixels: np.ndarray, height: int, width: int, strip: int = 4096) -> np.ndarray:
    """Mean luminance of the area that each new pixel covers, from the integral image.

    Between pixel corners the integral is linear, so areas that end inside a pixel are exact.
    The image is read by strips; of its integral only the rows beside the new pixels' edges
    are kept."""
    rows, columns = pixels.shape[:2]

    def edges(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(new + 1) * (old / new)
        low = np.minimum(x.astype(int), old - 1)
        return low, x - low

    y, part = edges(rows, height)
    needed = np.unique([y, y + 1])
    kept = np.zeros((len(needed), columns))  # sums of the rows above each
    above = np.zeros(columns)
    for k in range(0, rows, strip):
        sums = luminance(pixels[k : k + strip]).cumsum(0, dtype=np.float64) + above
        inside = np.flatnonzero((needed > k) & (needed <= k + len(sums)))
        kept[inside] = sums[needed[inside] - k - 1]
        above = sums[-1]
    whole = np.zeros((len(needed), columns + 1))
    whole[:, 1:] = kept.cumsum(1)
    low = np.searchsorted(needed, y)
    lines = whole[low] + part[:, None] * (whole[np.searchsorted(needed, y + 1)] - whole[low])
    x, part = edges(columns, width)
    corner = lines[:, x] + part * (lines[:, x + 1] - lines[:, x])
    return np.diff(np.diff(corner, axis=0), axis=1) / (rows / height * columns / width)


def luminance(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 8 area means is below its right neighbour."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_tiles(pixels: np.ndarray, rows: int = TILE_ROWS) -> list[bytes]:
    """The array as NPY files of at most ``rows`` rows each."""
    out = []
    for k in range(0, len(pixels), rows):
        np.lib.format.write_array(file := io.BytesIO(), np.ascontiguousarray(pixels[k : k + rows]), (1, 0), allow_pickle=False)
        out.append(file.getvalue())
    return out


def from_tiles(tiles: list[bytes]) -> np.ndarray:
    parts = [np.lib.format.read_array(io.BytesIO(t), allow_pickle=False) for t in tiles]
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def media_of(payload: bytes) -> bytes:
    """A payload of whole 576-byte blocks as PGM, PPM or BMP in turn, by its number of blocks."""
    samples, blocks = np.frombuffer(payload, np.uint8), len(payload) // BLOCK
    if blocks % 3 == 1:
        return encode_netpbm(samples.reshape(-1, WIDTH))
    pixels = samples.reshape(-1, WIDTH, 3)
    return encode_netpbm(pixels) if blocks % 3 == 2 else encode_bmp(pixels)


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK), len(data)


def tile_media(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, media_error, tiles): each media value decoded and written as NPY tiles.

    Null and undecodable media get no tiles and say why; ids may be null or repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    tiles.append(to_tiles(decode(data)) if data else None)
                    errors.append(None if data else "no media")
                except (ValueError, IndexError, OverflowError, struct.error) as error:
                    tiles.append(None)
                    errors.append(str(error)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string()), pa.array(tiles, pa.list_(pa.binary()))], names=["id", "media_error", "tiles"])

    return materialize(media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, media_error string, tiles array<binary>"), "tiles")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text (null: empty) as UTF-8 bytes in an image of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [media_of(payload_of(t)[0]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["id", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(tiled: DataFrame) -> DataFrame:
    """Digests and difference hash of each row of ``tile_media``, from its stored tiles.

    n_bytes is the payload without the 255 bytes at its end, which UTF-8 never holds.
    Rows without tiles get nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for batch in batches:
            rows = []
            for key, tiles in zip(batch.column("id").to_pylist(), batch.column("tiles").to_pylist()):
                if not tiles:
                    rows.append(dict.fromkeys(names) | {"doc_id": key})
                    continue
                pixels = from_tiles(tiles)
                payload, stored = pixels.tobytes(), b"".join(tiles)
                rows.append(
                    {
                        "doc_id": key,
                        "n_bytes": len(payload.rstrip(b"\xff")),
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-32:]),
                        "media_bytes": len(stored),
                        "media_sha256": hashlib.sha256(stored).hexdigest(),
                        "feature": difference_hash(pixels),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=FEATURE_ROWS)

    return tiled.mapInArrow(run, FEATURES)


FEATURE_ROWS = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in FEATURES.split(", ")])
