"""Token ids in binary files: patched frame-of-reference blocks.

A file holds the ids of a range of documents, in ascending doc_id order:

    magic   8 bytes, b"PFORIDS1"
    blocks  one after another; each is
            base u32 (the block's least id), count u16, width u8, exceptions u16,
            count values (id - base) cut to width bits and packed little end first,
            exceptions: u16 places, then u32 values of what was cut off (value >> width)
    index   u64 start of each block (blocks hold BLOCK ids, but the last)
    docs    i64 doc_id and u32 number of ids of each document, u8 1 where doc_id is null
    tail    u64 number of blocks, u64 number of documents, u64 number of ids,
            u64 start of the index, magic

The width is the bits that PERCENTILE of a block's values need; the rest are
exceptions. A reader seeks to any block through the index.

Files are written by tasks to the shared folder under names of their own, and
count only once the task's row is in the manifest, a Parquet table that Spark
commits. So a lost or repeated task leaves an unused file, never a wrong one.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import scratch, small_batches, whole, written
from .tokens import Encoder

MAGIC = b"PFORIDS1"
BLOCK = 1024
PERCENTILE = 0.9
HEAD, HEAD_BYTES = "<IHBH", struct.calcsize("<IHBH")
TAIL, TAIL_BYTES = "<QQQQ8s", struct.calcsize("<QQQQ8s")

MANIFEST = "file_no int, path string, n_docs long, n_ids long, n_bytes long"


def packed(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values, each cut to width bits and packed into width words of
    64 bits, little end first."""
    v, out = v.astype(np.uint64), np.zeros((len(v), width), "<u8")
    if width < 32:
        v &= np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out


def unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The rows of 64 values that packed() has made into words."""
    out = np.zeros((len(words), 64), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, j] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ids (BLOCK each, the last may be shorter); those of one
    width are packed together."""
    n, count = -(-len(ids) // BLOCK), len(ids)
    v = np.zeros(n * BLOCK, np.uint32)
    v[:count] = ids
    v[count:] = ids[-1] if count else 0
    v = v.reshape(n, BLOCK)
    base = v.min(axis=1)
    v -= base[:, None]
    v.ravel()[count:] = 0
    counts = np.full(n, BLOCK)
    if count % BLOCK:
        counts[-1] = count % BLOCK
    top = np.zeros(n, np.uint32)
    for m in np.unique(counts):
        rows = counts == m
        at = min(m - 1, int(percentile * m))
        top[rows] = np.partition(v[rows][:, :m], at, axis=1)[:, at]
    widths = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(int)
    out = [b""] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        bits = packed(v[rows].reshape(-1, 64), width).reshape(len(rows), BLOCK // 64 * width)
        high = v[rows] >> np.uint32(width) if width < 32 else np.zeros_like(v[rows])
        for i, row in enumerate(rows.tolist()):
            m = int(counts[row])
            places = np.flatnonzero(high[i, :m])
            out[row] = b"".join(
                (
                    struct.pack(HEAD, int(base[row]), m, width, len(places)),
                    bits[i].tobytes()[: (m * width + 7) // 8],
                    places.astype("<u2").tobytes(),
                    high[i, places].astype("<u4").tobytes(),
                )
            )
    return out


def unpack_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that start at starts, one after another."""
    heads = [struct.unpack_from(HEAD, data, at) for at in starts]
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for width in {h[2] for h in heads}:
        rows = [i for i, h in enumerate(heads) if h[2] == width]
        words = bytearray(len(rows) * BLOCK * width // 8)
        for k, i in enumerate(rows):
            at, size = starts[i] + HEAD_BYTES, (heads[i][1] * width + 7) // 8
            words[k * BLOCK * width // 8 : k * BLOCK * width // 8 + size] = data[at : at + size]
        table = np.frombuffer(words, "<u8").reshape(len(rows) * BLOCK // 64, width)
        out[rows] = unpacked(table, width).reshape(len(rows), BLOCK)
    for i, (base, m, width, n_out) in enumerate(heads):
        at = starts[i] + HEAD_BYTES + (m * width + 7) // 8
        places = np.frombuffer(data, "<u2", n_out, at)
        out[i, places] |= np.frombuffer(data, "<u4", n_out, at + 2 * n_out) << np.uint32(width % 32)
        out[i] += np.uint32(base)
    short = [h[1] for h in heads]
    if all(m == BLOCK for m in short):
        return out.ravel()
    return np.concatenate([out[i, :m] for i, m in enumerate(short)])


class Writer:
    """Writes one file to a stream, block by block."""

    def __init__(self, out, percentile: float = PERCENTILE):
        self.out, self.percentile = out, percentile
        self.at, self.n_ids, self.waiting = 0, 0, b""
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _blocks(self, ids: np.ndarray) -> None:
        for block in pack_blocks(ids, self.percentile):
            self.starts.append(self.at)
            self._put(block)

    def add(self, doc_ids: list, ids: list[bytes]) -> None:
        """Documents with their ids as little-endian unsigned 32-bit integers."""
        self.doc_ids += doc_ids
        self.counts += [len(x) // 4 for x in ids]
        data = self.waiting + b"".join(ids)
        self.n_ids += sum(len(x) // 4 for x in ids)
        full = len(data) // (4 * BLOCK) * 4 * BLOCK
        self._blocks(np.frombuffer(data[:full], "<u4"))
        self.waiting = data[full:]

    def close(self) -> None:
        self._blocks(np.frombuffer(self.waiting, "<u4"))
        index, nulls = self.at, [x is None for x in self.doc_ids]
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self._put(np.array(self.counts, "<u4").tobytes())
        self._put(np.array(nulls, np.uint8).tobytes())
        self._put(struct.pack(TAIL, len(self.starts), len(self.counts), self.n_ids, index, MAGIC))


class Reader:
    """Reads a file given as a seekable stream; blocks load as they are needed."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, io.SEEK_END)
        end = stream.tell() - TAIL_BYTES
        stream.seek(end)
        n_blocks, n_docs, self.n_ids, index, magic = struct.unpack(TAIL, stream.read(TAIL_BYTES))
        if magic != MAGIC:
            raise ValueError("not a token file")
        stream.seek(index)
        data = stream.read(end - index)
        self.starts = np.append(np.frombuffer(data, "<u8", n_blocks), index).astype(np.int64)
        ids = np.frombuffer(data, "<i8", n_docs, 8 * n_blocks)
        self.counts = np.frombuffer(data, "<u4", n_docs, 8 * (n_blocks + n_docs)).astype(np.int64)
        nulls = np.frombuffer(data, np.uint8, n_docs, 8 * n_blocks + 12 * n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls)]

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first .. last - 1, in one read."""
        lo, hi = int(self.starts[first]), int(self.starts[last])
        self.stream.seek(lo)
        data = self.stream.read(hi - lo)
        if first == last:
            return np.zeros(0, np.uint32)
        return unpack_blocks(data, [int(self.starts[i]) - lo for i in range(first, last)])

    def documents(self, step: int = 256):
        """(doc_id, place of its first id, ids) of each document, in order."""
        have, at, block, n = np.zeros(0, np.uint32), 0, 0, len(self.starts) - 1
        for doc_id, count in zip(self.doc_ids, self.counts):
            if len(have) < count:
                parts, got = [have], len(have)
                while got < count and block < n:
                    parts.append(self.blocks(block, min(n, block + step)))
                    got, block = got + len(parts[-1]), min(n, block + step)
                have = np.concatenate(parts)
            yield doc_id, at, have[:count]
            have, at = have[count:], at + int(count)


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        encoder, end, writer = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes(), None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                no = TaskContext.get().partitionId()
                path = f"{folder}/{no:06d}-{uuid.uuid4().hex}.ids"
                store, place = open_store(path)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place, compression=None)
                writer = Writer(out)
            writer.add(
                b.column(0).to_pylist(), [ids + end for ids in encoder.batch(b.column(1).to_pylist())]
            )
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "file_no": pa.array([no], pa.int32()),
                    "path": [path],
                    "n_docs": [len(writer.counts)],
                    "n_ids": [writer.n_ids],
                    "n_bytes": [writer.at],
                }
            )

    return run


def write(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every text, write the files, return their manifest in file order.

    Defined cases: a null or empty text is the end id alone; rows with a null
    id come first; rows that repeat an id stand side by side, ordered by a hash
    of the text; an empty table writes no file; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    folder = folder or scratch(docs.sparkSession, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    order = ("doc_id", F.xxhash64("text"))  # a frequent id falls into several files
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(files.mapInArrow(_write(folder, tokenizer, end_id), MANIFEST), "ids-manifest")


def _read(batches):
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            store, place = open_store(path)
            with store.open_input_file(place) as f:
                rows = [
                    (doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, at, ids in Reader(f).documents()
                ]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files;
    start counts the ids of all documents before it, over all files."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, manifest.count())
    return (
        files.select("path", "start")
        .repartition(n)
        .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
