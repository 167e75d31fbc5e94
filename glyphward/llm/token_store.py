"""Operator 2: token ids in binary shards, each document a zstandard frame of its own under one shared dictionary.

The dictionary is trained on all serialized id arrays: each part of the data trains a dictionary of its own, and these
are merged by training again on their contents, in a tree of Spark tasks.  A shard is a row with the frames end to end
and an index of offsets, so that one short document is read by a slice and one call.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from .bpe import model_of
from .common import stage_table, tidy
from .sentencepiece_codec import DEFAULT_MODEL, encoded_slices, load_model

DICT_BYTES = 32 << 10
LEVEL = 6
SHARD_BYTES = 4 << 20
#: Serialized bytes that one training call sees; a larger part of the data trains several dictionaries.
TRAIN_BYTES = 8 << 20
_FAN_IN = 64

SHARD_SCHEMA = (
    "kind string, shard long, dict_hash string, doc_ids array<bigint>, offsets array<bigint>, n_tokens array<int>, payload binary"
)


def serialize(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens and raw (ids, two or four bytes each, little-endian).  A null text has null n_tokens and raw."""
    blob = load_model(model_path)

    def run(batches):
        model = model_of(blob)
        for batch in batches:
            for i, j, ids, at in encoded_slices(model, batch.column("text")):
                valid = batch.column("text").slice(i, j - i).is_valid()
                none = ~valid.to_numpy(zero_copy_only=False)
                cuts = pa.py_buffer((at * model.dtype.itemsize).astype(np.int32))
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, cuts, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(at).astype(np.int32), mask=none),
                        pc.if_else(valid, raw, pa.scalar(None, pa.binary())),
                    ],
                    names=["doc_id", "n_tokens", "raw"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run, "bpe"), "doc_id long, n_tokens int, raw binary")


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; short arrays are joined to samples of 64 bytes, so all take part.

    Where there is too little to train one of that size on, a smaller one is trained; where there is too little for any (under
    about a KB in all), the arrays themselves are the dictionary's content (empty for none).
    """
    whole, held = [], b""
    for s in samples:
        held += s
        if len(held) >= 64:
            whole.append(held)
            held = b""
    if held:
        whole.append(held)
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, whole, k=64, d=8).as_bytes()
        except (zstandard.ZstdError, ValueError):
            size //= 2
    return b"".join(whole)


def _content(dictionary: bytes) -> list[bytes]:
    return [dictionary[i : i + 1024] for i in range(0, len(dictionary), 1024)]


def train_dictionary(serialized: DataFrame, size: int = DICT_BYTES) -> bytes:
    """Every array of the table takes part: local dictionaries first, then merged 64 at a time."""

    def local(batches):
        held, n = [], 0
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                if raw:
                    for i in range(0, len(raw), 1 << 17):  # zstandard takes up to 128 KB of a sample into account
                        held.append(raw[i : i + (1 << 17)])
                    n += len(raw)
                if n >= TRAIN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([train(held, size)], pa.binary())], names=["dictionary"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([train(held, size)], pa.binary())], names=["dictionary"])

    def merge(table: pa.Table) -> pa.Table:
        parts = sorted(table.column("dictionary").to_pylist())
        one = parts[0] if len(parts) == 1 else train([x for p in parts for x in _content(p)], size)
        return pa.table({"dictionary": pa.array([one], pa.binary())})

    level = stage_table(serialized.select("raw").mapInArrow(local, "dictionary binary"), "dictionaries")
    n = level.count()
    while n > 1:
        groups = -(-n // _FAN_IN)
        level = level.groupBy(F.pmod(F.xxhash64("dictionary"), F.lit(groups)).alias("g")).applyInArrow(merge, "dictionary binary")
        level = stage_table(level, "dictionaries")
        n = level.count()
    row = level.first()
    return bytes(row["dictionary"]) if row else b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def dict_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shards(serialized: DataFrame, dictionary: bytes, level: int = LEVEL) -> DataFrame:
    """Rows of kind ``shard``: doc_ids, offsets (one more than documents), n_tokens and the frames end to end.

    A null text has an empty slice and null n_tokens; an empty text has a frame of no bytes.
    """
    name = dict_hash(dictionary)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        trained = _dictionary(dictionary)
        packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_dict_id=False) if trained else zstandard.ZstdCompressor(level=level)
        ids, sizes, frames, total, k = [], [], [], 0, 0

        def emit():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(["shard"]),
                    pa.array([part + k], pa.int64()),
                    pa.array([name]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([offsets.tolist()], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([b"".join(frames)], pa.binary()),
                ],
                names=["kind", "shard", "dict_hash", "doc_ids", "offsets", "n_tokens", "payload"],
            )

        for batch in batches:
            for d, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "raw"))):
                frame = b"" if raw is None else packer.compress(raw)
                ids.append(d)
                sizes.append(n)
                frames.append(frame)
                total += len(frame)
                if total >= SHARD_BYTES:
                    yield emit()
                    ids, sizes, frames, total, k = [], [], [], 0, k + 1
        if ids:
            yield emit()

    return serialized.select("doc_id", "n_tokens", "raw").mapInArrow(run, SHARD_SCHEMA)


def build(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """The whole store: one row of kind ``dictionary`` (its bytes in payload) and the shards.

    Repeated rows and null ids are stored like others; other columns are not read.  An empty table gives the dictionary
    row alone, with no bytes.
    """
    serialized = stage_table(serialize(docs, model_path), "token-ids")
    dictionary = train_dictionary(serialized)
    spark = docs.sparkSession
    head = spark.createDataFrame([("dictionary", -1, dict_hash(dictionary), [], [0], [], bytearray(dictionary))], SHARD_SCHEMA)
    return head.unionByName(shards(serialized, dictionary))


def read(store: DataFrame, doc_ids: list[int], model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and token_ids of some documents: Spark slices their frames out of the payloads before Python sees them."""
    width = model_of(load_model(model_path)).dtype
    head = store.filter("kind = 'dictionary'").select("dict_hash", "payload").first()
    data, name = bytes(head["payload"]), head["dict_hash"]
    if dict_hash(data) != name:
        raise ValueError("the dictionary does not match its hash")
    wanted = F.array(*[F.lit(int(d)).cast("long") for d in doc_ids]) if doc_ids else F.array().cast("array<bigint>")
    hit = store.filter((F.col("kind") == "shard") & F.arrays_overlap("doc_ids", wanted))
    one = hit.select("dict_hash", "offsets", "payload", F.posexplode("doc_ids").alias("i", "doc_id"))
    one = one.filter(F.col("doc_id").isin([int(d) for d in doc_ids]) if doc_ids else F.lit(False))
    frame = F.expr("substring(payload, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int))")
    frames = one.select("doc_id", "dict_hash", frame.alias("frame"))

    def run(batches):
        trained = _dictionary(data)
        opener = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
        for batch in batches:
            if any(h != name for h in batch.column("dict_hash").to_pylist()):
                raise ValueError("a shard was written under another dictionary")
            out = [np.frombuffer(opener.decompress(f), width).tolist() if f else None for f in batch.column("frame").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    return frames.mapInArrow(run, "doc_id long, token_ids array<int>")
