"""Operator 8: SentencePiece encoding and decoding as DataFrame operators (the algorithm is in ``bpe``)."""

from __future__ import annotations

import gc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import model_of
from .common import slices, string_buffers, tidy

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are encoded in one call.
_STEP = 1 << 20


def load_model(path: str = DEFAULT_MODEL) -> bytes:
    """Read on the driver; the bytes (about half a MB) travel with the tasks, so executors need no file."""
    return Path(path).read_bytes()


def encoded_slices(model, texts: pa.Array):
    """(first row, last row, ids, the rows' offsets in them) of parts of a text column, in order; a null has no ids."""
    data, offsets = string_buffers(texts)
    for i, j in slices(offsets, _STEP):
        collecting = gc.isenabled()
        gc.disable()
        try:
            ids, at = model.encode_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        finally:
            if collecting:
                gc.enable()
        yield i, j, ids, at


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, token_ids, exact (decoding gives the text again).

    A null text has null n_tokens, token_ids and exact; an empty text has no tokens.  Repeated rows and null ids stay.
    ``exact`` is false only for texts with U+2581, which the model writes for a space.  Other columns are not read.
    """
    blob = load_model(model_path)

    def run(batches):
        model = model_of(blob)
        for batch in batches:
            texts = batch.column("text")
            ids_column = batch.column("doc_id")
            data, offsets = string_buffers(texts)
            for i, j, ids, at in encoded_slices(model, texts):
                none = texts.slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                exact = model.gives_back(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids, at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_column.slice(i, j - i),
                        pa.array(np.diff(at).astype(np.int32), mask=none),
                        lists,
                        pa.array(exact, pa.bool_(), mask=none),
                    ],
                    names=["doc_id", "n_tokens", "token_ids", "exact"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run, "bpe"), "doc_id long, n_tokens int, token_ids array<int>, exact boolean")


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and token_ids; null ids give a null text, ids outside the vocabulary an error."""
    blob = load_model(model_path)

    def run(batches):
        model = model_of(blob)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
