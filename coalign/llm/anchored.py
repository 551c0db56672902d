"""Repeated windows of a corpus, found at content-chosen anchors.

A window is ``length`` consecutive units (words or bytes) of one document. Its anchor
is the position in it whose ``k``-gram has the smallest hash, the leftmost of equal
ones, so equal windows have their anchor at the same offset. Whatever two documents
share, they share at anchors; only the suffixes that start at an anchor are exchanged,
with as many units to the left as their windows reach. This is exact: every window
belongs to one anchor, and windows are compared unit by unit.

Steps, each of which ends in a table in the shared scratch folder:

1. ``chunked``: documents become chunks.
2. ``repeated``: chunks exchange short hashes of their anchors; an anchor whose hash
   is in one document only cannot be in a repeated window.
3. ``runs``: each chunk sorts the suffixes at its other anchors and sends each part of
   the corpus its front-coded run. Equal suffixes of one chunk are sent once, under
   the smallest document, so a passage in a third of all documents is one entry a chunk.
4. ``covered``: a part brings its suffixes in order, by a way of the operator's own,
   and decides for every entry at which offsets a smaller document has the window.
5. ``removed``: chunks apply the decisions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, chunked, cut, cut_buckets, lean, lean_group, mix, powers, relieve, unpack, word_bounds, word_hashes

BLOB = "part int, chunk long, kind int, body binary"
_BLOB_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
_BLOCK = 1 << 16
_LOW = np.uint64((1 << 20) - 1)
#: An anchor that occurs more often than this is hot: its suffixes are split by what stands around it.
HOT = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """What the units are, how long a window is and on how many units an anchor is chosen."""

    unit: str  # "word" or "byte"
    length: int
    k: int
    chunk_bytes: int
    part_bytes: int

    @property
    def span(self) -> int:
        """Positions of a window at which its anchor can be; offsets go from 0 to one less."""
        return self.length - self.k + 1

    @property
    def reach(self) -> int:
        """Units that windows of the first half of the offsets have right of the anchor's own; those of the others have ``span - reach`` left of it."""
        return self.span // 2

    @property
    def kind(self) -> type:
        return np.uint64 if self.unit == "word" else np.uint8


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_BLOB_TYPES)], names=["part", "chunk", "kind", "body"])


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.nbytes, np.dtype(a.dtype).num))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int64)}


def _unzip(body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for size, kind in head.tolist():
        dtype = _KINDS[kind]
        out.append(np.frombuffer(data, dtype, size // dtype.itemsize, at))
        at += size
    return out


def units_of(scheme: Scheme, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units of all documents, offsets of the documents in them)."""
    if scheme.unit == "byte":
        return raw, offsets
    starts, ends, first = word_bounds(raw, offsets)
    return word_hashes(raw, starts, ends), first


def _gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams at all positions but the last k - 1."""
    value = _BYTE[units] if units.dtype == np.uint8 else units
    n = len(units)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * powers(n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(n - k + 1, "down"))


@dataclass
class Anchors:
    """Positions, first and last start of their windows, hashes of their k-grams, documents."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def anchors(scheme: Scheme, units: np.ndarray, offsets: np.ndarray) -> Anchors:
    """All anchors of a chunk. One whose windows begin in two blocks comes twice, with windows of its own each time."""
    length, k, span = scheme.length, scheme.k, scheme.span
    n = len(units)
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(n - length + 1, 0), _BLOCK):
        hi = min(lo + _BLOCK, n - length + 1)  # starts of windows
        part = units[lo : hi + length - 1]
        grams = _gram_hashes(part, k)
        low = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
        chosen = (low & _LOW).astype(np.int64)
        valid = np.ones(hi - lo, bool)
        for end in offsets[np.searchsorted(offsets, lo + 1) : np.searchsorted(offsets, hi + length)].tolist():
            valid[max(end - length + 1 - lo, 0) : max(end - lo, 0)] = False
        change = np.empty(hi - lo, bool)
        change[0] = True
        change[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1])
        begin = np.flatnonzero(change)
        last = np.append(begin[1:], hi - lo) - 1
        keep = valid[begin]
        begin, last = begin[keep], last[keep]
        at = chosen[begin]
        found.append((at + lo, begin + lo, last + lo, grams[at]))
    if not found:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none.astype(np.uint64), none)
    at, first, last, key = (np.concatenate(x) for x in zip(*found, strict=True))
    return Anchors(at, first, last, key, np.searchsorted(offsets, at, side="right") - 1)


# Step 2


def _short(key: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 bits more of each hash, as one number that sorts by part."""
    return ((key >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def _distinct(short: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, whether two documents have it, how often it occurs); documents come in order."""
    order = np.argsort(short, kind="stable")
    s, d = short[order], doc[order]
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(s)))
    return s[begin], d[begin] != d[begin + times - 1], times


def _slices(short: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(short):
        return
    part = (short >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    yield from zip(part[begin].tolist(), begin.tolist(), np.append(begin[1:], len(part)).tolist(), strict=True)


def repeated(chunks: DataFrame, scheme: Scheme, parts: int) -> DataFrame:
    """By part and chunk: a bit for each distinct short hash of the chunk in order, set if two documents have it, and which of them are hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                _, raw, offsets, _, _ = unpack(body.as_buffer())
                found = anchors(scheme, *units_of(scheme, raw, offsets))
                short, twice, times = _distinct(_short(found.key, parts), found.doc)
                rows = []
                for p, s, e in _slices(short):
                    more = np.flatnonzero(times[s:e] > 1)
                    rows.append((p, chunk, 0, _zip((short[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.packbits(twice[s:e]), more.astype(np.uint32), times[s:e][more].astype(np.uint32))))
                yield _blobs(rows)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [_unzip(b) for b in table["body"].to_pylist()]
        sizes = [len(g[0]) for g in got]
        bounds = np.cumsum([0, *sizes])
        low = np.concatenate([g[0] for g in got])
        # a hash that is twice in one chunk only stands alone here
        flag = np.concatenate([np.unpackbits(g[1], count=n) for g, n in zip(got, sizes, strict=True)]).astype(bool)
        times = np.ones(len(low), np.int64)
        for g, at in zip(got, bounds.tolist(), strict=False):
            times[at + g[2]] = g[3]
        order = np.argsort(low)
        s = low[order]
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
        of = np.cumsum(np.append(True, s[1:] != s[:-1])[: len(s)]) - 1
        many = np.diff(np.append(begin, len(s))) > 1
        flag[order] |= many[of]
        hot = np.zeros(len(low), bool)
        hot[order] = (np.add.reduceat(times[order], begin) > HOT)[of] if len(s) else False
        return pa.Table.from_batches([_blobs([(p, c, 0, _zip(np.packbits(flag[x:y]), np.flatnonzero(hot[x:y]).astype(np.uint32))) for p, c, x, y in zip(table["part"].to_pylist(), table["chunk"].to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False)])])

    return chunks.mapInArrow(lean(send), BLOB).groupBy("part").applyInArrow(lean_group(compare), BLOB)


# Step 3


@dataclass
class Suffixes:
    """Suffixes at anchors: units from the anchor on, units before it (nearest first), how many of each count, smallest document."""

    right: np.ndarray
    left: np.ndarray
    n_right: np.ndarray
    n_left: np.ndarray
    key: np.ndarray


def _columns(s: Suffixes) -> list[np.ndarray]:
    """Sort keys, the last one first: the right units decide, a prefix comes before its extension."""
    if s.right.dtype == np.uint8:
        wide = lambda m: np.ascontiguousarray(np.pad(m, ((0, 0), (0, -m.shape[1] % 8)))).view(">u8").astype(np.uint64)
        right, left = wide(s.right), wide(s.left)
    else:
        right, left = s.right, s.left
    return [s.n_left, *left.T[::-1], s.n_right, *right.T[::-1]]


def shared(right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Common prefix, in units, of each row with the one before it (0 for the first)."""
    out = np.zeros(len(right), np.int64)
    if len(right) > 1:
        differ = right[1:] != right[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
        out[1:] = np.minimum(out[1:], np.minimum(n_right[1:], n_right[:-1]))
    return out


@dataclass
class Candidates:
    """The possibly repeated suffixes of a chunk, and its distinct ones in order of part and suffix."""

    anchors: Anchors
    which: np.ndarray  # the distinct suffix of each candidate
    again: np.ndarray  # the candidates that are sent to a second part, by what stands left of them
    which_again: np.ndarray
    part: np.ndarray
    distinct: Suffixes


def _hash_of(units: np.ndarray) -> np.ndarray:
    h = np.full(len(units), units.shape[1], np.uint64)
    for i in range(units.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + units[:, i].astype(np.uint64))
    return h


def candidates(scheme: Scheme, units: np.ndarray, offsets: np.ndarray, keys: np.ndarray, bits: dict[int, bytes], parts: int, route: Callable | None) -> Candidates:
    """The anchors of a chunk that two documents have, and to which parts their suffixes go.

    A hot anchor would bring all its contexts to one part. Windows that share it share
    either ``reach`` units more right of it or the units left of it that are left to
    reach; so its suffixes go to two parts, by a hash of either, and are covered where
    either says so.
    """
    found = anchors(scheme, units, offsets)
    short = _short(found.key, parts)
    distinct, _, _ = _distinct(short, found.doc)
    flag, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    for p, s, e in _slices(distinct):
        own, often = _unzip(bits[p])
        flag[s:e] = np.unpackbits(own, count=e - s).astype(bool)
        hot[s + often] = True
    at = np.searchsorted(distinct, short)
    keep = flag[at] if len(short) else np.zeros(0, bool)
    hot = hot[at[keep]]
    found = Anchors(found.at[keep], found.first[keep], found.last[keep], found.key[keep], found.doc[keep])
    n_left, n_right = found.at - found.first, found.last + scheme.length - found.at
    padded = np.concatenate((np.zeros(scheme.span, units.dtype), units, np.zeros(scheme.length, units.dtype)))
    at = found.at + scheme.span
    right = padded[at[:, None] + np.arange(scheme.length)]
    right[np.arange(scheme.length) >= n_right[:, None]] = 0
    left = padded[at[:, None] - 1 - np.arange(max(scheme.span - 1, 1))]
    left[np.arange(left.shape[1]) >= n_left[:, None]] = 0
    part = ((found.key >> np.uint64(32)) % np.uint64(parts) if route is None else route(right)).astype(np.int64)
    wide, deep = scheme.k + scheme.reach, scheme.span - scheme.reach
    by_right, by_left = hot & (n_right >= wide), hot & (n_left >= deep)
    part[by_right] = _hash_of(right[by_right, :wide]) % np.uint64(parts)
    part_left = (_hash_of(np.concatenate((right[by_left, : scheme.k], left[by_left, :deep]), axis=1)) % np.uint64(parts)).astype(np.int64)
    part[by_left & ~by_right] = part_left[~by_right[by_left]]
    again = np.flatnonzero(by_left & by_right)
    rows = np.append(np.arange(len(part)), again)
    part = np.append(part, part_left[by_right[by_left]])
    whole = Suffixes(right[rows], left[rows], n_right[rows], n_left[rows], keys[found.doc[rows]])
    columns = [whole.key, *_columns(whole), part]
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for c in columns[1:]:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]  # of equal ones that of the smallest document
    sent = Suffixes(whole.right[first], whole.left[first], whole.n_right[first], whole.n_left[first], whole.key[first])
    n = len(found.at)
    return Candidates(found, which[:n], again, which[n:], part[first], sent)


def encode_run(s: Suffixes, lo: int, hi: int) -> bytes:
    """Front-coded: of each suffix how many units it has in common with the one before, and the rest."""
    right, n_right, left, n_left = s.right[lo:hi], s.n_right[lo:hi], s.left[lo:hi], s.n_left[lo:hi]
    same = shared(right, n_right)
    at = np.arange(right.shape[1])
    tail = right[(at >= same[:, None]) & (at < n_right[:, None])]
    before = left[np.arange(left.shape[1]) < n_left[:, None]]
    return _zip(same.astype(np.uint8), n_right.astype(np.uint8), n_left.astype(np.uint8), s.key[lo:hi].astype(np.int64), tail, before)


def decode_run(body: bytes, scheme: Scheme) -> tuple[Suffixes, np.ndarray]:
    """The suffixes of a run and what each has in common with the one before."""
    same, n_right, n_left, key, tail, before = _unzip(body)
    n = len(same)
    same, n_right, n_left = same.astype(np.int64), n_right.astype(np.int64), n_left.astype(np.int64)
    at = np.arange(scheme.length)
    own = (at >= same[:, None]) & (at < n_right[:, None])
    right = np.zeros((n, scheme.length), scheme.kind)
    right[own] = tail
    # a unit that isn't a row's own is that of the last row above that had its own there
    source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
    right = np.take_along_axis(right, source, axis=0)
    right[at >= n_right[:, None]] = 0
    left = np.zeros((n, max(scheme.span - 1, 1)), scheme.kind)
    left[np.arange(left.shape[1]) < n_left[:, None]] = before
    return Suffixes(right, left, n_right, n_left, key), same


def _sides(left: pa.Table, right: pa.Table) -> tuple[int, bytes, dict[int, dict[int, bytes]]]:
    """Chunk, its body, and what came back by kind and part."""
    back: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
    for p, kind, body in zip(right["part"].to_pylist(), right["kind"].to_pylist(), right["body"].to_pylist(), strict=True):
        back[kind][p] = body
    return left["chunk"][0].as_py(), left["body"][0].as_buffer(), back


def runs(chunks: DataFrame, bits: DataFrame, scheme: Scheme, parts: int, route: Callable | None = None) -> DataFrame:
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, body, back = _sides(left, right)
        keys, raw, offsets, _, _ = unpack(body)
        c = candidates(scheme, *units_of(scheme, raw, offsets), keys, back[0], parts, route)
        begin = np.flatnonzero(np.append(True, c.part[1:] != c.part[:-1])) if len(c.part) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(c.part))
        return pa.Table.from_batches([_blobs([(int(c.part[s]), chunk, 0, encode_run(c.distinct, s, e)) for s, e in zip(begin.tolist(), ends.tolist(), strict=False)])])

    return chunks.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(lean_group(send), BLOB)


# Step 4


def cover(scheme: Scheme, s: Suffixes, same: np.ndarray) -> np.ndarray:
    """For suffixes in order, ``same`` what each shares with the one before: bits of the offsets at which a smaller document has the window.

    At offset o a window is the o units before the anchor and the length - o from it
    on: suffixes agree in the latter if they are below the same node of that depth,
    that is, if nothing between them in the order shares less.
    """
    n = len(same)
    mask = np.zeros(n, np.uint64)
    if n < 2:
        return mask
    # Only suffixes that share k units with a neighbour can be in a repeated window.
    deep = np.zeros(n, bool)
    deep[1:] = same[1:] >= scheme.k
    deep[:-1] |= deep[1:]
    at_left = np.zeros(n, np.uint64)  # hash of the o units before the anchor
    for o in range(scheme.span):
        depth = scheme.length - o
        node = np.cumsum(same < depth).astype(np.uint64)
        rows = np.flatnonzero(deep & (s.n_left >= o) & (s.n_right >= depth))
        if len(rows) > 1:
            group = mix(at_left[rows] * np.uint64(0x9E3779B97F4A7C15) + node[rows])
            order = np.lexsort((s.key[rows], group))
            g, k = group[order], s.key[rows][order]
            begin = np.append(True, g[1:] != g[:-1])
            least = k[begin][np.cumsum(begin) - 1]
            mask[rows[order[least < k]]] |= np.uint64(1) << np.uint64(o)
        if o < scheme.span - 1:
            value = s.left[:, o]
            at_left = mix(at_left + (_BYTE[value] if value.dtype == np.uint8 else value))
    return mask


def covered(sent: DataFrame, scheme: Scheme, order: Callable[[list[tuple[Suffixes, np.ndarray]], list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """By part and chunk, the bits of each entry of the run. ``order`` gives the rows of all runs in order, and what neighbours share."""

    def decide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        decoded = [decode_run(b, scheme) for b in table["body"].to_pylist()]
        rows, same = order(decoded)
        whole = Suffixes(*(np.concatenate([getattr(x[0], f) for x in decoded])[rows] for f in ("right", "left", "n_right", "n_left", "key")))
        mask = np.empty(len(rows), np.uint64)
        mask[rows] = cover(scheme, whole, same)
        bounds = np.cumsum([0, *(len(x[1]) for x in decoded)])
        return pa.Table.from_batches([_blobs([(p, c, 1, _zip(mask[s:e])) for p, c, s, e in zip(table["part"].to_pylist(), table["chunk"].to_pylist(), bounds, bounds[1:], strict=False)])])

    return sent.groupBy("part").applyInArrow(lean_group(decide), BLOB)


# Step 5


def removed_units(scheme: Scheme, c: Candidates, masks: dict[int, bytes], keys: np.ndarray, n: int) -> np.ndarray:
    """Whether each unit of the chunk is covered."""
    mask = np.concatenate([_unzip(masks[p])[0] for p in np.unique(c.part).tolist()]) if len(c.part) else np.zeros(0, np.uint64)
    found = c.anchors
    own = mask[c.which]
    own[c.again] |= mask[c.which_again]
    # the same suffix is in a smaller document of this chunk: all its windows are covered
    own = np.where(keys[found.doc] > c.distinct.key[c.which], np.uint64(2**64 - 1), own)
    steps = np.zeros(n + scheme.length + 1, np.int64)
    for o in range(scheme.span):
        start = found.at - o
        start = start[((own >> np.uint64(o)) & np.uint64(1)).astype(bool) & (start >= found.first) & (start <= found.last)]
        np.add.at(steps, start, 1)
        np.add.at(steps, start + scheme.length, -1)
    return np.cumsum(steps[:n]) > 0


def drop_repeats(docs: DataFrame, scheme: Scheme, order: Callable, write: Callable, schema: str, id_col: str, text_col: str, router: Callable | None = None) -> DataFrame:
    """The five steps. ``write(raw, offsets, units, unit offsets, removed, keys, has_id)`` makes the result of a chunk.

    Chunks pass through the executors' heaps as values of megabytes, by which these
    grow in each step; so they are collected between the steps.
    """
    spark = docs.sparkSession
    relieve(spark)  # of what came before
    chunks = cut_buckets(chunked(docs, id_col, text_col, scheme.chunk_bytes), "chunk")
    relieve(spark)
    size = chunks.agg(F.sum(F.octet_length("body")), F.count(F.lit(1))).first()
    parts = max(1, -(-(size[0] or 0) // scheme.part_bytes))
    route = router(chunks, parts) if router else None
    bits = cut(repeated(chunks, scheme, parts))
    relieve(spark)
    masks = cut(covered(runs(chunks, bits, scheme, parts, route), scheme, order))
    relieve(spark)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        _, body, back = _sides(left, right)
        keys, raw, offsets, has_id, _ = unpack(body)
        units, first = units_of(scheme, raw, offsets)
        c = candidates(scheme, units, first, keys, back[0], parts, route)
        gone = removed_units(scheme, c, back[1], keys, len(units))
        return write(raw, offsets, units, first, gone, keys, has_id)

    back = bits.unionByName(masks)
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lean_group(finish), schema)
