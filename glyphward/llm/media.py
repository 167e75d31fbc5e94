"""Operator 7: a column of JPEG files to dimensions and thumbnail hashes.

The thumbnail is the DC-only luminance (see ``jpeg``), one pixel for 8x8; its exact hash finds the same picture, its
difference hash (signs of 8x8 horizontal steps of a 9x8 mean) similar ones.

The driver's tables hold no pictures, so the registered query renders each page's HTML as one, every byte a grey pixel,
64 to a row, and encodes it as a baseline JPEG; the operator then takes that column like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .jpeg import encode_gray, luminance

ROW = 64
#: Bytes of files that are decoded in step.
_STEP = 4 << 20
FIELDS = "status string, width int, height int, components int, thumb_width int, thumb_height int, thumb_hash string, dhash long"


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of width by height equal areas; an image smaller than that repeats pixels."""

    def spans(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(k) * n // k
        return a, np.maximum(a + 1, (np.arange(k) + 1) * n // k)

    (r0, r1), (c0, c1) = spans(image.shape[0], height), spans(image.shape[1], width)
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    sums[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    return total / ((r1 - r0)[:, None] * (c1 - c0)[None, :])


def dhash(thumb: np.ndarray) -> int:
    small = resize(thumb, 9, 8)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def describe(files: list[bytes | None]) -> list[tuple]:
    """FIELDS of each file."""
    out = []
    for got in luminance(files):
        if got is None or isinstance(got, str):
            out.append((got,) + (None,) * 7)
        else:
            p, thumb = got
            digest = hashlib.sha256(np.array(thumb.shape, "<u4").tobytes() + thumb.tobytes()).hexdigest()[:32]
            out.append(("ok", p.width, p.height, len(p.parts), thumb.shape[1], thumb.shape[0], digest, dhash(thumb)))
    return out


def media_columns(files: DataFrame, key: str, column: str) -> DataFrame:
    """One row per row of files: the key and FIELDS.

    A null file has a null status and nothing else; bytes that are no JPEG or break off are ``corrupt``, other kinds than
    baseline and extended Huffman with 8 bits ``unsupported``.  Repeated rows and null keys stay; other columns are not read.
    """
    kind = files.schema[key].dataType.simpleString()
    names = [key] + [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            keys, blobs = batch.column(0), batch.column(1).to_pylist()
            i = 0
            while i < len(blobs):
                j, held = i, 0
                while j < len(blobs) and (j == i or held < _STEP):
                    held += len(blobs[j] or b"")
                    j += 1
                rows = describe(blobs[i:j])
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), *cols], names=names)
                i = j

    return files.select(key, column).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")


def render(text: str | None) -> bytes | None:
    """A text's bytes as a JPEG, 64 pixels to a row; very long ones in wider rows, as a side has 65,535 pixels at most."""
    if text is None:
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    width = ROW
    while len(raw) > width * 32768:
        width *= 2
    image = np.full((max(1, -(-len(raw) // width)), width), 32, np.uint8)
    image.ravel()[: len(raw)] = raw
    return encode_gray(image)


def rendered_pages(pages: DataFrame) -> DataFrame:
    """page_id, jpeg: every page's HTML as a picture; null html stays null."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), pa.array([render(t) for t in part.column("html").to_pylist()], pa.binary())], names=["page_id", "jpeg"]
                )

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, jpeg binary")
