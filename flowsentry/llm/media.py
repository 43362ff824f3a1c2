"""Media columns: 8-bit grayscale PNG written and read through its chunks, with cosine-transform hashes.

The reader walks the chunks, tests every checksum, inflates the image data and undoes the five row filters with numpy.
The hash takes the image's 32 x 32 box means, their discrete cosine transform, and the signs of the 64 lowest
frequencies against their median.

Edge cases: null or empty text gives one all-zero row of 64 samples; damaged bytes raise ValueError in ``decode_png``;
equal texts give equal bytes and features; very long texts only give taller images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from flowsentry.llm.common import text_or_empty

#: Fixed by the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, SIDE, LOW = 64, 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, filter_type: int | None = 0, level: int = 6) -> bytes:
    """A grayscale image of uint8 rows; filter_type 0 (none), 1 (left) or 2 (up) for every row, or None: that of the least absolute sum for each row."""
    height, width = samples.shape
    rows = np.empty((height, width + 1), np.uint8)
    if filter_type not in (None, 0, 1, 2):
        raise ValueError(f"no encoder for filter {filter_type}")
    filtered = np.repeat(samples[None], 3, axis=0)
    filtered[1, :, 1:] -= samples[:, :-1]
    filtered[2, 1:] -= samples[:-1]
    if filter_type is None:
        rows[:, 0] = np.minimum(filtered, -filtered).sum(axis=2, dtype=np.int64).argmin(axis=0)
    else:
        rows[:, 0] = filter_type
    rows[:, 1:] = filtered[rows[:, 0], np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes):
    """(kind, content) of every chunk, each checksum tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        content = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + content) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        yield kind, content
        at += 12 + size


def unfilter(rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Samples of filtered rows (first column: filter type). All 'left' rows are summed at once, and each run of 'up' rows."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if not kinds.any():
        return out
    if (kinds > 4).any():
        raise ValueError(f"unknown filter {kinds.max()}")
    height, width = out.shape
    left = kinds == 1
    out[left] = np.cumsum(out[left].reshape(-1, width // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, width)
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), height], strict=True):
        kind = kinds[start]
        if kind == 2:
            first = max(start - 1, 0)
            out[first:end] = np.cumsum(out[first:end], axis=0, dtype=np.uint8)
        for y in range(start, end if kind > 2 else start):
            up = out[y - 1].astype(int) if y else np.zeros(width, int)
            row = out[y].astype(int)
            for x in range(width):
                a, b = (row[x - bpp] if x >= bpp else 0), up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[x - bpp] if x >= bpp else 0
                    near = a + b - c
                    guess = min(((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c)))[2]
                row[x] = (row[x] + guess) & 255
            out[y] = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit, non-interlaced PNG (a row holds its pixels' channels side by side)."""
    head, packed, ended = None, [], False
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            packed.append(content)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended:
        raise ValueError("no header or end")
    width, height, depth, color, _, _, interlace = head
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlace or bpp is None:
        raise ValueError("only 8-bit, non-interlaced gray and color images")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if rows.size != height * (width * bpp + 1):
        raise ValueError("image data of a wrong size")
    return unfilter(rows.reshape(height, width * bpp + 1), bpp)


def _basis(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


_COS = _basis(SIDE, LOW)


def _shrink(a: np.ndarray, side: int) -> np.ndarray:
    """Means of side boxes along the first axis; boxes may share a row's part."""
    n = a.shape[0]
    total = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
    edge = np.arange(side + 1) * n / side
    low = np.minimum(edge.astype(int), n - 1)
    at = total[low] + (edge - low)[:, None] * a[low]
    return np.diff(at, axis=0) * side / n


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies exceed their median."""
    small = _shrink(_shrink(samples.astype(np.float64), SIDE).T, SIDE).T
    low = np.round(_COS @ small @ _COS.T, 6)
    return np.packbits(low > np.median(low)).tobytes()


def store(text: str) -> tuple[int, bytes]:
    """(unpadded length, PNG with a filter chosen for each row) of a text's bytes padded with 0 to a positive multiple of the image width."""
    data = text.encode("utf-8", "surrogatepass")
    padded = data + bytes(-len(data) % WIDTH if data else WIDTH)
    return len(data), encode_png(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH), None)


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a binary PNG column."""

    def fill(batches):
        for batch in batches:
            kept = [store(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [n for n, _ in kept], "media": [m for _, m in kept]}, columns=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(fill, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored images back: the samples' size, digests and cosine hash."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True):
                data = bytes(data)
                samples = decode_png(data)
                payload = samples.tobytes()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples).hex()))
            yield pd.DataFrame(rows, columns=names)

    return media.mapInPandas(read, schema)
