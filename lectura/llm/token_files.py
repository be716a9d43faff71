"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, in blocks of 1,024. A block subtracts its minimum, packs the
differences at the width that holds a given share of them, and keeps what does not fit in an exception list. An index
of block starts lets a reader open any range of ids without the rest of the file.

    magic 8 bytes | n_docs, n_ids, n_blocks u64 | doc_id i64[n_docs] | has_id u8[n_docs] | n_tokens u64[n_docs]
    | block start u64[n_blocks + 1] | blocks
    block: minimum u32, width u8, 0 u8, ids u16, exceptions u32 | 32 * width words u32 | position u16[] | high bits u32[]

All numbers are little-endian. Value k of a block lies in lane k % 32 of 32 interleaved lanes. Files are written by
Spark, one per row of a table, so that writing is committed as a whole on any store that Spark can reach.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectura.session import ship, stored

from .common import map_rows, whole_text
from .tokens import encoder

MAGIC = b"LECTPFR1"
HEAD, BLOCK_HEAD = struct.Struct("<8sQQQ"), struct.Struct("<IBBHI")
BLOCK, LANES = 1024, 32
HELD_SHARE = 0.95  # of a block's values fit its width
FILE_IDS = 1 << 20
END = (2).to_bytes(4, "little")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of the percentile value of each block."""
    at = int(HELD_SHARE * (values.shape[1] - 1))
    return np.ceil(np.log2(np.partition(values, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) values of `width` bits to (blocks, 32 * width) words."""
    lanes = values.reshape(len(values), BLOCK // LANES, LANES)
    out = np.zeros((len(values), width, LANES), dtype=np.uint32)
    for k in range(BLOCK // LANES):
        word, shift = divmod(k * width, 32)
        out[:, word] |= lanes[:, k] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= lanes[:, k] >> np.uint32(32 - shift)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    packed = words.reshape(len(words), width, LANES)
    out = np.zeros((len(words), BLOCK // LANES, LANES), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(BLOCK // LANES):
        word, shift = divmod(k * width, 32)
        value = packed[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | packed[:, word + 1] << np.uint32(32 - shift)
        out[:, k] = value & mask
    return out.reshape(len(words), BLOCK)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], n_tokens: list[int]) -> bytes:
    """The file of some documents; `ids` are theirs, one after the other."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, dtype=np.uint32)
    padded[:len(ids)] = ids
    if len(ids):
        padded[len(ids):] = ids[-1]
    blocks = padded.reshape(n_blocks, BLOCK)
    least = blocks.min(axis=1, initial=2**32 - 1)
    values = blocks - least[:, None]
    widths = _widths(values) if n_blocks else np.zeros(0, dtype=np.int64)
    parts: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        own = values[chosen]
        packed = _pack(own & np.uint32((1 << int(width)) - 1), int(width)) if width else np.zeros((len(own), 0), np.uint32)
        high = (own.astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
        for row, k in enumerate(chosen):
            at = np.flatnonzero(high[row])
            count = min(BLOCK, len(ids) - k * BLOCK)
            parts[k] = b"".join((
                BLOCK_HEAD.pack(int(least[k]), int(width), 0, count, len(at)), packed[row].tobytes(),
                at.astype("<u2").tobytes(), high[row][at].tobytes(),
            ))
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.uint64))).astype("<u8")
    return b"".join((
        HEAD.pack(MAGIC, len(doc_ids), len(ids), n_blocks), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array(n_tokens, "<u8").tobytes(),
        starts.tobytes(), *parts,
    ))


class TokenFile:
    """Reads the bytes of one file."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        has_id = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [int(d) if h else None for d, h in zip(doc_ids, has_id)]
        self.n_tokens = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", n_blocks + 1, at + 17 * n_docs).astype(np.int64)
        self.data, self.base = data, at + 17 * n_docs + 8 * (n_blocks + 1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids `start` to `stop` of the file; only the blocks that hold them are read."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        heads = [BLOCK_HEAD.unpack_from(self.data, self.base + int(s)) for s in self.starts[first:last + 1]]
        out = np.zeros((len(heads), BLOCK), dtype=np.uint32)
        widths = np.array([h[1] for h in heads])
        for width in np.unique(widths):
            chosen = np.flatnonzero(widths == width)
            if width:
                words = np.stack([np.frombuffer(self.data, "<u4", LANES * width, self._body(first + k)) for k in chosen])
                out[chosen] = _unpack(words, int(width))
        for k, (_, width, _, _, n) in enumerate(heads):
            if n:
                at = self._body(first + k) + 4 * LANES * width
                position = np.frombuffer(self.data, "<u2", n, at)
                out[k, position] |= np.frombuffer(self.data, "<u4", n, at + 2 * n) << np.uint32(width)
        out += np.array([h[0] for h in heads], dtype=np.uint32)[:, None]
        return out.reshape(-1)[start - first * BLOCK:stop - first * BLOCK]

    def _body(self, block: int) -> int:
        return self.base + int(self.starts[block]) + BLOCK_HEAD.size


def write_files(docs: DataFrame, path: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode and write `docs` (doc_id, text); gives the table of files: part, seq, n_docs, n_ids, file.

    (part, seq) is the order of the files. Documents are in ascending order of doc_id, null first, and rows with the
    same doc_id in an order of their own that every run repeats. A file ends behind the document with which it reaches
    `file_ids`.
    """
    ship(docs.sparkSession)
    text = whole_text(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    names = ["part", "seq", "n_docs", "n_ids", "file"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seq = encoder(path, lower=True).encode_bytes, TaskContext.get().partitionId(), 0
        doc_ids, encoded = [], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(encoded), "<u4")
            file = encode_file(ids, doc_ids, [len(e) // 4 for e in encoded])
            columns = [pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (len(doc_ids), pa.int64()), (len(ids), pa.int64()), (file, pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held = 0
        for batch in batches:
            for doc_id, one in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                doc_ids.append(doc_id)
                encoded.append(encode(one) + END)
                held += len(encoded[-1]) // 4
                if held >= file_ids:
                    yield flush()
                    doc_ids, encoded, held, seq = [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    return stored(ordered.mapInArrow(write, "part int, seq int, n_docs long, n_ids long, file binary"), "token-files")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""

    def decode(images: list[bytes]) -> dict:
        out: dict[str, list] = {k: [] for k in ("at", "doc_id", "inside", "n_tokens", "ids_crc32")}
        for k, image in enumerate(images):
            file = TokenFile(image)
            ids = file.ids().astype("<u4").tobytes()
            ends = np.cumsum(file.n_tokens)
            for doc_id, end, n in zip(file.doc_ids, ends.tolist(), file.n_tokens.tolist()):
                for name, value in zip(out, (k, doc_id, end - n, n, zlib.crc32(ids[4 * (end - n):4 * end]))):
                    out[name].append(value)
        return out

    by_part, inside = Window.orderBy("part"), Window.partitionBy("part").orderBy("seq")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before(by_part)), F.lit(0)).alias("_part_start"))
    starts = sizes.withColumn("_in_part", F.coalesce(F.sum("n_ids").over(before(inside)), F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("_part_start") + F.col("_in_part")).alias("_start"))
    found = map_rows(files, decode, "doc_id long, inside long, n_tokens long, ids_crc32 long", ["file"], ["part", "seq"])
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Write `docs` and read them back: one row per row of `docs`, see `write_files` and `read_documents`.

    Null text counts as empty, so every row has at least its end id. An empty table gives no rows; further columns are
    ignored. One document is never split over files, so a task holds one file and one document at a time.
    """
    return read_documents(write_files(docs, path))
