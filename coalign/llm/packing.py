"""Sum-of-squares packing of documents into training sequences.

A document is cut into full windows and a remainder. Remainders are packed online:
with N(h) the number of open windows filled to level h, a remainder goes to the open
window, or a new one, for which the sum of N(h) squared becomes smallest. Only the
level array and a stack of windows for each level are kept. Packing runs side by
side in groups of documents chosen by a hash of the id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, lean
from .word_bpe import word_bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"
_KINDS = (pa.int64(),) * 5


class SumOfSquares:
    """Online packer of sizes 1 .. capacity; ``place`` returns (window, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.windows = capacity, 0
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.levels = np.zeros(capacity + 1, np.int64)

    def place(self, size: int) -> tuple[int, int]:
        capacity, n = self.capacity, self.levels
        if not 0 < size <= capacity:
            raise ValueError(size)
        best, least = 0, 2 * int(n[size]) + 1 if size < capacity else 0  # a new window
        if size < capacity:
            # Level h becomes h + size: the change of the sum of squares is 2 (N(h + size) - N(h) + 1); a full window leaves the array.
            change = 2 * (n[size + 1 : capacity] - n[1 : capacity - size] + 1)
            change = np.append(change, -2 * n[capacity - size] + 1)
            change = np.where(n[1 : capacity - size + 1] > 0, change, 1 << 60)
            # the fullest of equally good levels, so that windows fill up
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= least and change[at] < 1 << 60:
                best = at + 1
        if best:
            window = self.open[best].pop()
            n[best] -= 1
        else:
            window = self.windows
            self.windows += 1
        if best + size < capacity:
            self.open[best + size].append(window)
            n[best + size] += 1
        return window, best


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, block_bytes: int = 4 << 20) -> DataFrame:
    """Documents tokenized and cut: a row a piece, without the ids themselves but with their checksum."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
            keys, at = batch.column(0).to_pylist(), 0
            while at < len(text):
                to = min(max(int(np.searchsorted(ends, ends[at] + block_bytes)), at + 1), len(text))
                ids, offsets = bpe.documents(raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at], end_id)
                data, bounds = memoryview(ids.astype("<u4")).cast("B"), offsets.tolist()
                out: list[tuple] = []
                for key, s, e in zip(keys[at:to], bounds, bounds[1:], strict=False):
                    for p in range(s, e, capacity):
                        q = min(p + capacity, e)
                        out.append((key, p - s, q - p, zlib.crc32(data[4 * p : 4 * q]), e - s))
                at = to
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(_KINDS)], names=[c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(cut_up), PIECES)


def pack(cut: DataFrame, rows: int, capacity: int = 2048, group_rows: int = 16_384) -> DataFrame:
    """Pieces with sequence_id and offset; ``rows`` is about how many documents there are."""
    groups = max(1, -(-rows // group_rows))

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = int(key[0].as_py())
        table = table.drop_columns(["group"]).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        # an order that has nothing to do with the sizes
        order = np.random.Generator(np.random.PCG64(group)).permutation(table.num_rows)
        packer, lengths = SumOfSquares(capacity), table["length"].to_numpy()
        placed = np.empty((table.num_rows, 2), np.int64)
        for i in order.tolist():
            placed[i] = packer.place(int(lengths[i]))
        return table.append_column("sequence_id", pa.array(placed[:, 0] + (group << 32))).append_column("offset", pa.array(placed[:, 1].copy()))

    grouped = cut.withColumn("group", F.pmod(F.xxhash64(doc_key("doc_id"), "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return grouped.groupBy("group").applyInArrow(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has ``end_id`` alone. A document longer than a sequence gives
    full sequences and a remainder. Repeated rows are packed as rows of their own; a
    missing id is kept. The row's number takes part in the choice of its group, so rows
    without an id and repeated rows spread like others; reruns over the same files agree.
    An empty table gives an empty result.
    """
    return pack(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), docs.count(), capacity)
