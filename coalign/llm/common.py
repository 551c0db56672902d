"""What several operators share: white space, the order of documents, chunks of a corpus; scratch tables for all of them."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coalign.sources.scratch import cut, cut_buckets, drop, relieve

__all__ = ["cut", "cut_buckets", "drop", "relieve"]

#: White space of every operator here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A document without an id comes after all others.
NO_ID = 2**63 - 1


def doc_key(id_col: str) -> Column:
    """The id as an order in which a missing id comes last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def power_of_two(n: float, least: int = 1) -> int:
    m = least
    while m < n:
        m *= 2
    return m


def tidy() -> None:
    """Gives what a task has freed back to the system: Python workers live on, and what they keep is missing to later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that leaves its worker as small as it can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        tidy()

    return run


def lean_group(f: Callable) -> Callable:
    """The same for a function of a key and its rows, or of the rows of both sides."""

    def run(first, second):
        out = f(first, second)
        tidy()
        return out

    run.__annotations__, run.__signature__ = f.__annotations__, inspect.signature(f)  # by which Spark tells what the function takes
    return run


# Chunks: one row holds many whole documents. The chunk table is written once, so
# the number of a document in its chunk names the document in all later steps.

CHUNK_SCHEMA = "chunk long, n_docs int, body binary"


def _pack(rows: list[pa.RecordBatch]) -> bytes:
    table = pa.Table.from_batches(rows)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(keys, bytes of all texts, offsets with a last one, present ids, other columns) of a chunk."""
    table = pa.ipc.open_stream(body).read_all().combine_chunks()
    text = table["text"].chunk(0) if table.num_rows else pa.array([], pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8) if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2] if len(text) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return table["key"].to_numpy(), raw, offsets - offsets[0], table["has_id"].to_numpy(zero_copy_only=False), table


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Documents as a table of chunks of about ``chunk_bytes`` of text each (a longer document is a chunk of its own).

    A null text counts as empty. Not cut yet: callers ``cut_buckets`` it by chunk before they use it twice,
    so that what comes back to the chunks is brought to where they lie.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal n
            n += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | n], pa.int64()), pa.array([sum(b.num_rows for b in held)], pa.int32()), pa.array([_pack(held)], pa.binary())],
                names=["chunk", "n_docs", "body"],
            )

        for batch in batches:
            text = batch.column(2).cast(pa.large_binary())
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["key", "has_id", "text"])
            ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(ends, ends[at] + chunk_bytes - size, side="left"))
                to = min(max(to, at + 1), batch.num_rows)
                held.append(batch.slice(at, to - at))
                size += int(ends[to] - ends[at])
                at = to
                if size >= chunk_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    named = docs.select(
        doc_key(id_col).alias("key"),
        F.col(id_col).isNotNull().alias("has_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return named.mapInArrow(pack, CHUNK_SCHEMA)


# Words and hashes of a whole chunk at once.

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """Base to the powers 0 .. n-1 modulo 2**64 ("down": of its inverse)."""
    if len(_powers[kind]) < n:
        step = np.full(power_of_two(n, 1024), _BASE if kind == "up" else _UNBASE, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document with a last one) of the words of a chunk; words never cross documents."""
    inside = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every chunk."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 15  # words a block, so that the sums stay in the processor's cache
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], ends[i : i + step]
        lo, hi = int(s[0]), int(e[-1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo:hi]] * powers(hi - lo), out=sums[1:])
        out[i : i + step] = (sums[e - lo] - sums[s - lo]) * powers(hi - lo, "down")[s - lo]
    return mix(out + (ends - starts).astype(np.uint64))
