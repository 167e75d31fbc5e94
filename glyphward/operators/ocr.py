"""What an engine that reads pictures must offer, a scripted one for tests, and its reads as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphward.sources.batches import MOST, slices

#: Bytes of pictures that are read at once.
_BYTES = 1 << 18
READS = "doc_id long, page int, word_ord int, word string, confidence double"


class OcrEngine(Protocol):
    def recognize(self, image: bytes) -> str: ...

    def recognize_scored(self, image: bytes) -> list[tuple[str, float]]: ...


class PlainEngine:
    """Scores for engines that only give text: its words, with full confidence."""

    def recognize(self, image: bytes) -> str:
        raise NotImplementedError

    def recognize_scored(self, image: bytes) -> list[tuple[str, float]]:
        return [(word, 100.0) for word in self.recognize(image).split()]


class ScriptedEngine(PlainEngine):
    """Says what a function of the picture's bytes says."""

    def __init__(self, script: Callable[[bytes], str]):
        self.script = script

    def recognize(self, image: bytes) -> str:
        return self.script(image)


def read_batches(engine: OcrEngine):
    """What a task does with batches of images; see ``read_images``."""
    names = [f.split()[0] for f in READS.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "image", size=_BYTES):
                rows = []
                for doc, page, image in zip(*(some.column(c).to_pylist() for c in ("doc_id", "page", "image"))):
                    rows += [(doc, page, k, w, c) for k, (w, c) in enumerate(engine.recognize_scored(image) if image is not None else [])]
                    if len(rows) >= MOST:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read_images(images: DataFrame, engine: OcrEngine) -> DataFrame:
    """READS of images (doc_id, page, image).  The engine travels with the tasks; a null picture has no words."""
    return images.select("doc_id", "page", "image").mapInArrow(read_batches(engine), READS)
