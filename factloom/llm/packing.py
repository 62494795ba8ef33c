"""Token ids as fixed-width bit-packed blocks (operator 4).

Every id takes the least number of bits that hold any id of the vocabulary.  A
block packs the ids of whole documents one after the other into 64-bit
little-endian words; its offsets say at which id each document starts, so that
one document (or any id) is read by shifting two words, and a whole block by a
few vectorised numpy operations.  Blocks are made where the documents are read,
without a shuffle, of about ``BLOCK_IDS`` ids; a longer document has a block of its own.

The ids are those of operator 1, by its encoder.

Defined results: a null text has no ids and is marked in ``nulls``; an empty one has none
and isn't.  Repeated rows are packed each; a text is packed whole, however long.  An empty table gives no block.  Columns besides
``doc_id`` and ``text`` are ignored, whatever their names.  Ids
that don't fit the width raise ValueError.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import pieces, raw, relax
from ._util import documents
from .bpe import PATTERN, VOCABULARY, encoder, read_vocabulary

BLOCK_IDS = 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def width(size: int) -> int:
    """Bits that hold the ids 0 to size - 1."""
    return max(1, (max(1, size) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, in 64-bit little-endian words; 64 ids fill ``bits`` words."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id doesn't fit {bits} bits")
    if len(ids) == 0:
        return b""
    groups = -(-len(ids) // 64)
    wide = np.zeros(groups * 64, np.uint64)
    wide[: len(ids)] = ids
    wide = wide.reshape(groups, 64)
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= wide[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= wide[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()[: -(-len(ids) * bits // 64) * 8]


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of packed data; reads only the words that hold them."""
    if stop <= start:
        return np.zeros(0, np.int64)
    at = np.arange(start, stop, dtype=np.int64) * bits
    lo = at[0] >> 6
    hi = (at[-1] + bits - 1) >> 6
    words = np.append(np.frombuffer(data, "<u8", hi - lo + 1, lo * 8), np.uint64(0))
    word, shift = (at >> 6) - lo, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((low | high) & (_ALL >> np.uint64(64 - bits))).astype(np.int64)


def document_ids(block: dict, nth: int) -> np.ndarray:
    """Ids of the nth document of a block (a row of :func:`packed`)."""
    o = block["offsets"]
    return unpack(block["packed"], block["bits"], o[nth], o[nth + 1])


def packed(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(block, bits, n_ids, doc_ids, nulls, offsets, packed): every document's ids in blocks.

    ``block`` numbers blocks within their writing task; ``offsets`` has one entry more than ``doc_ids``.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(held.value, pattern)
        bits, task = enc.vocab.bits, (TaskContext.get() or _Zero).partitionId()
        nth, count, ids, keys, nulls, sizes = 0, 0, [], [], [], []
        names = ["block", "bits", "n_ids", "doc_ids", "nulls", "offsets", "packed"]

        def block() -> pa.RecordBatch:
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            off = np.concatenate([[0], np.cumsum(sizes)])
            k = pa.concat_arrays(keys)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            data = [pa.array([(task << 33) + nth]), pa.array([bits], pa.int32()), pa.array([len(flat)]), one(k), one(pa.array(np.concatenate(nulls))), one(pa.array(off.astype(np.int64))), pa.array([pack(flat, bits)], pa.binary())]
            return pa.RecordBatch.from_arrays(data, names)

        for b in batches:
            for i, part in pieces(b["text"], 1 << 19):
                flat, at = enc.encode_flat(*raw(part))
                ids.append(flat)
                sizes += np.diff(at).tolist()
                keys.append(b["doc_id"].slice(i, len(part)))
                nulls.append(np.asarray(part.is_null()))
                count += len(flat)
                if count >= block_ids:
                    yield block()
                    nth, count, ids, keys, nulls, sizes = nth + 1, 0, [], [], [], []
            relax()
        if keys:
            yield block()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"block long, bits int, n_ids long, doc_ids array<{key}>, nulls array<boolean>, offsets array<long>, packed binary")


class _Zero:
    @staticmethod
    def partitionId() -> int:
        return 0


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed blocks."""
    return packed(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_packing": op4_packing}
