"""Near duplicates by DartMinHash signatures.

A document is the weighted set of its word shingles, the weight being how often the
shingle occurs. Every element has a region: its weight times the half-line of ranks.
Hashed darts hit that region as a Poisson process of rate one, the same darts in every
document; a dart counts for a document if it lies below the element's weight there,
and each dart belongs to one of ``coordinates`` coordinates. The earliest dart of a
coordinate is the same in two documents with a probability equal to their weighted
Jaccard similarity. Only ranks up to a limit are thrown, which shrinks with the weight
of the document, so a signature costs about as many darts as it has coordinates times
a small factor, whatever the length; if a coordinate stays empty, the limit is doubled.

Signatures are joined by bands. Texts alike are one node from the start. The nodes of a
band key are not turned into pairs: they are compared with a leader, exactly, by the
whole texts' shingles, and what is then connected is one class. Where a band key still
has nodes of several classes, its nodes are dealt to blocks of a bounded size and
pairs of blocks are searched in place: signatures name the pairs of different classes
that can be similar, those are compared exactly, and what leaves a pair of blocks is
at most one link for each node, as many as it takes to connect what is similar. So
rows grow with the nodes and never with the pairs, and no link is lost. Classes are the
connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, lean, mix, word_bounds, word_hashes
from .common import cut as cut_as_dealt

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def cut(df: DataFrame) -> DataFrame:
    """A stage table of about four files for each core, however finely its rows are dealt.

    A task writes one part after the other. For each file an executor may start a
    process to set its mode, which counts as large as the JVM until it has become that
    process, and classes are found in some thirty small tables.
    """
    return cut_as_dealt(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism))


@dataclass(frozen=True)
class NearDuplicates:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5
    block_bytes: int = 1 << 20
    #: Most documents that are signed at once, and about the most nodes and shingles in a block of a band key.
    block_docs: int = 2_000
    block_nodes: int = 384
    block_cells: int = 1 << 19

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> float:
        """Coordinates in common that a similar pair has but for five standard deviations."""
        return self.coordinates * self.similarity - 5 * math.sqrt(self.coordinates * self.similarity * (1 - self.similarity))

    def size(self, weight: Column) -> Column:
        """The weight on a scale on which similar documents differ by one at most (a little wider, for rounding)."""
        return F.floor(F.log(weight) / -math.log(self.similarity - 0.005)).cast("int")


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, document) of the shingles of a block, and a hash of each document's words in order.

    A document of fewer words has them all as its one shingle; one without words has none.
    """
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends)
    count = np.diff(first)
    wide = np.concatenate((words, np.zeros(n, np.uint64)))
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(words)) - first[doc]
    size = np.minimum(count, n)[doc]
    head = place < np.maximum(count - n + 1, 1)[doc]
    h = size.astype(np.uint64)
    for i in range(n):
        h = np.where(size > i, mix(h + wide[i : i + len(words)]), h)
    h, doc_of = h[head], doc[head]
    order = np.lexsort((h, doc_of))
    h, doc_of = h[order], doc_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc_of[1:] != doc_of[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h)))
    # the sequence of words itself: a sum of hashes that depend on the place
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place.astype(np.uint64) * _GOLD + np.uint64(1))))))
    same = mix(sums[first[1:]] - sums[first[:-1]])
    return h[at], weight, doc_of[at], same


def _uniform(h: np.ndarray) -> np.ndarray:
    """From hashes to numbers above 0 and up to 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _throw(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, limit: np.ndarray, k: int, best: np.ndarray, who: np.ndarray) -> None:
    """Throws all darts up to the rank limit of each document; keeps the earliest of each coordinate in ``best`` and ``who``."""
    # A region of weight w is w cells of weight one, with darts of their own: cell c of an element is hit alike in all documents whose weight there is over c.
    cell_of = np.repeat(np.arange(len(element)), weight)
    cell = np.arange(len(cell_of)) - np.repeat(np.cumsum(weight) - weight, weight)
    seed = mix(element[cell_of] + mix(cell.astype(np.uint64) * _GOLD + np.uint64(7)))
    owner = doc[cell_of]
    rank, top = np.zeros(len(seed)), limit[owner]
    step, turn = 1, 0
    while len(seed):
        numbers = np.arange(turn, turn + step, dtype=np.uint64)
        dart = mix(seed[:, None] + (numbers + np.uint64(1)) * _GOLD)
        ranks = rank[:, None] + np.cumsum(-np.log(_uniform(dart)), axis=1)
        hit = ranks <= top[:, None]
        at, r, d = np.broadcast_to(owner[:, None], hit.shape)[hit], ranks[hit], mix(dart[hit] + _GOLD)
        slot = at * k + (d % np.uint64(k)).astype(np.int64)
        order = np.lexsort((r, slot))
        slot, r, d = slot[order], r[order], d[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, r, d = slot[first], r[first], d[first]
        earlier = r < best[slot]
        best[slot[earlier]], who[slot[earlier]] = r[earlier], d[earlier]
        on = hit[:, -1]
        seed, owner, top, rank = seed[on], owner[on], top[on], ranks[on, -1]
        turn += step
        step = 1 if len(seed) > 100_000 else 8 if len(seed) > 5_000 else 32


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """The earliest darts, documents by coordinates; documents without elements get zeros."""
    total = np.bincount(doc, weight, n_docs)
    best, who = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    with np.errstate(divide="ignore"):
        limit = np.where(total > 0, k * (np.log(k) + 2.0) / total, 0.0)
    open_ = total > 0
    while open_.any():
        take = open_[doc]
        _throw(element[take], weight[take], doc[take], limit, k, best, who)
        open_ &= np.isinf(best.reshape(n_docs, k)).any(axis=1)
        limit = limit * 2
    return who.reshape(n_docs, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each document and band."""
    h = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), axis=0)
    for i in range(rows):
        h = mix(h + signature[:, i::rows][:, :bands])
    return h


NODES = "key long, has_id boolean, text_key long, node long, weight long, bands array<long>, signature binary"
HOT_ROWS, MOST_HOT = 1_000, 10_000


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(doc_key(id_col).alias("key"), F.col(id_col).isNotNull().alias("has_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _cut_batch(text: pa.Array, p: NearDuplicates) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of about ``p.block_bytes`` bytes and ``p.block_docs`` texts at most of a column of texts."""
    text = text.cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = min(max(int(np.searchsorted(ends, ends[at] + p.block_bytes)), at + 1), at + p.block_docs, len(text))
        yield at, to, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def signed(docs: DataFrame, p: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """By document: a hash of its words in order (its node; null without words), its weight, its band keys and a byte of each coordinate."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, raw, offsets in _cut_batch(batch.column(3), p):
                element, weight, doc, same = shingles(raw, offsets, p.shingle)
                total = np.bincount(doc, weight, to - at).astype(np.int64)
                darts = signatures(element, weight, doc, to - at, p.coordinates)
                keys, low = band_keys(darts, p.bands, p.rows), darts.astype(np.uint8).tobytes()
                low = [low[i : i + p.coordinates] for i in range(0, len(low), p.coordinates)]
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), p.bands).cast(pa.list_(pa.int64()))
                columns = [*(c.slice(at, to - at) for c in batch.columns[:3]), pa.array(same.view(np.int64), mask=total == 0), pa.array(total), bands, pa.array(low, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODES.split(", ")])

    return _blocks(docs, id_col, text_col).mapInArrow(lean(sign), NODES)


def cells(docs: DataFrame, p: NearDuplicates, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, cells) of the wanted (node, key): sorted 32-bit hashes of the unit cells of a document's regions."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, raw, offsets in _cut_batch(batch.column(0), p):
                element, weight, doc, same = shingles(raw, offsets, p.shingle)
                of = np.repeat(np.arange(len(element)), weight)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(weight) - weight, weight)
                cell = (mix(element[of] + nth.astype(np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32)
                owner = doc[of]
                order = np.lexsort((cell, owner))
                data, bounds = cell[order].tobytes(), 4 * np.searchsorted(owner[order], np.arange(to - at + 1))
                blobs = [data[s:e] for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(same.view(np.int64)), pa.array(blobs, pa.binary())], names=["node", "cells"])

    rows = _blocks(docs, id_col, text_col).join(wanted.select("key").distinct(), "key", "left_semi").select("text").mapInArrow(lean(make), "node long, cells binary")
    # rows that share an id may have other texts, and repeated rows the same one
    return rows.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance) of (a, b): one less the weighted Jaccard similarity of the whole texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                out[i] = _distance(*(np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "distance"])

    a, b = (sets.select(F.col("node").alias(n), F.col("cells").alias(f"cells_{n}")) for n in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "cells_a", "cells_b").mapInArrow(lean(compare), "a long, b long, distance double")


def components(links: DataFrame) -> DataFrame:
    """(node, class) of the nodes of links (a, b): class is the smallest node that can be reached.

    Every node takes the smallest label around it and then its label's label, until
    nothing changes; labels are minima, so they are combined before they are shuffled.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("class")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        least = cut(label.join(near, "node").select("node", F.col("class").alias("before"), F.least("class", "near").alias("class")))
        jump = least.select(F.col("node").alias("class"), F.col("class").alias("further"))
        moved = cut(least.join(jump, "class", "left").select("node", "before", F.coalesce(F.least("class", "further"), "class").alias("class")))
        label = moved.select("node", "class")
        if moved.where("class <> before").isEmpty():
            return label


def _ranked(buckets: DataFrame) -> DataFrame:
    """(bucket, node, score): a node's score is how many nodes its buckets hold. The middle of a group meets most of it, so it leads."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    score = buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("score"))
    return cut(buckets.join(score, "node"))


def links(docs: DataFrame, buckets: DataFrame, texts: DataFrame, p: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """(a, b) such that all similar nodes that share a bucket are connected.

    ``buckets`` has (bucket, band, size, node), ``texts`` (node, key, weight, signature).
    The nodes of a bucket are compared with its leader. A bucket whose nodes are of one
    class then, here or by other buckets, is done; ``search`` goes over the others.
    """
    limit = 1 - p.similarity + 1e-9
    wanted = texts.join(buckets.select("node").distinct(), "node", "left_semi")
    sets = cut(cells(docs, p, id_col, text_col, wanted.select("node", "key")))
    ranked = _ranked(buckets)
    chosen = ranked.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("top")).select("bucket", F.col("top.node").alias("leader"))
    pairs = ranked.join(chosen, "bucket").where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    near = cut(distances(pairs, sets).where(F.col("distance") <= limit).select("a", "b"))
    named = cut(ranked.join(components(near), "node", "left").select("bucket", "band", "size", "node", F.coalesce("class", "node").alias("class")))
    return cut(near.unionByName(search(named, texts, sets, p)))


def search(named: DataFrame, texts: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """(a, b): links that connect all similar nodes of the buckets (bucket, band, size, node, class) that have several classes."""
    rows = search_rows(named, texts, sets, p)
    return rows.repartition("block").sortWithinPartitions("block", "side", "node").mapInArrow(lean(_searcher(p)), "a long, b long").distinct()


def search_rows(named: DataFrame, texts: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """What is searched: a row for each node of a pair of blocks.

    The largest class of a bucket is its core, whose nodes needn't meet each other.
    Core and rest are dealt to blocks by hash, as many as it takes for about
    ``p.block_nodes`` nodes and ``p.block_cells`` shingles in one; every pair of two
    blocks of the rest, or of one of the rest and one of the core, is a row group of its
    own. One straggler so costs a row for each node of the core and no more. A pair is
    compared in the first band only that it shares, and for the size only that both have.
    """
    sized = named.join(texts.select("node", "weight"), "node").groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("nodes"), F.sum("weight").alias("total"))
    total = sized.groupBy("bucket").agg(F.max(F.struct("nodes", "total", "class")).alias("core"), F.sum("nodes").alias("nodes"), F.sum("total").alias("total"))
    blocks = lambda nodes, cells: F.ceil(F.greatest(nodes / p.block_nodes, cells / p.block_cells)).cast("int")
    # of two nodes both have been compared
    open_ = total.where("nodes > 2 and core.nodes < nodes").select(
        "bucket", F.col("core.class").alias("core"), blocks(F.col("core.nodes"), F.col("core.total")).alias("inner"), blocks(F.expr("nodes - core.nodes"), F.expr("total - core.total")).alias("outer")
    )
    mine, other, place = F.col("mine"), F.col("other"), F.xxhash64("node", "bucket")
    rows = named.join(open_, "bucket").withColumn("inside", F.col("class") == F.col("core"))
    rows = rows.withColumn("mine", F.when(F.col("inside"), F.col("outer") + F.pmod(place, "inner")).otherwise(F.pmod(place, "outer")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1 + F.when(F.col("inside"), 0).otherwise(F.col("inner")))))
    block = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (F.col("bucket"), F.least(mine, other), F.greatest(mine, other)))))
    rows = rows.join(texts.select("node", "weight", "signature"), "node").join(sets, "node")
    return rows.select(block.alias("block"), (mine > other).cast("int").alias("side"), "node", "class", "weight", p.size(F.col("weight")).alias("own"), "band", "size", "signature", "cells")


def _searcher(p: NearDuplicates):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one block key after the other; rows of a key follow each other, but may lie in several batches."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            code = batch.column(0).dictionary_encode().indices.to_numpy()
            begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
            for at, to in zip(begin.tolist(), np.append(begin[1:], len(code)).tolist(), strict=True):
                if held and held[0].column(0)[0] != batch.column(0)[at]:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(batch.slice(at, to - at))
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in groups(batches):
            found += _similar(group, p)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _distance(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets of cells."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 1 - shared / (len(both) - shared)


def _similar(group: pa.RecordBatch, p: NearDuplicates) -> list[tuple[int, int]]:
    """Links between the two blocks of a group, or within its one block, that connect what is similar and not of one class."""
    _, side, node, label, weight, own, band, size = (c.to_numpy() if pa.types.is_integer(c.type) else None for c in group.columns[:8])
    signature = np.frombuffer(b"".join(group.column(8).to_pylist()), np.uint8).reshape(-1, p.coordinates)
    lo, hi = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    left, right = (lo, hi) if len(hi) else (lo, lo)
    x, y, matches = [], [], []
    step = max(1, (1 << 23) // (p.coordinates * max(len(right), 1)))
    for i in range(0, len(left), step):
        at = left[i : i + step]
        may = label[at][:, None] != label[right][None, :]
        may &= np.maximum(own[at][:, None], own[right][None, :]) == size[0]
        may &= (weight[at][:, None] >= p.similarity * weight[right][None, :] - 1e-9) & (weight[right][None, :] >= p.similarity * weight[at][:, None] - 1e-9)
        if not len(hi):
            may &= at[:, None] < right[None, :]
        u, v = np.nonzero(may)
        u, v = at[u], right[v]
        for j in range(0, len(u), 1 << 16):
            a, b = u[j : j + (1 << 16)], v[j : j + (1 << 16)]
            same = signature[a] == signature[b]
            hits = same.sum(axis=1)
            first = same.reshape(len(a), p.bands, p.rows).all(axis=2).argmax(axis=1)
            take = (hits >= p.least_matches) & (first == band[0])
            x.append(a[take]), y.append(b[take]), matches.append(hits[take])
    if not x:
        return []
    x, y, matches = (np.concatenate(v) for v in (x, y, matches))
    order = np.argsort(-matches, kind="stable")
    head: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := head.get(c, c)) != c:
            head[c] = head.get(up, up)
            c = up
        return c

    blobs, found = group.column(9), []
    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        r, q = root(int(label[i])), root(int(label[j]))
        if r != q and _distance(*(np.frombuffer(blobs[k].as_buffer(), np.uint32) for k in (i, j))) <= 1 - p.similarity + 1e-9:
            head[max(r, q)] = min(r, q)
            found.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest id of its class), class_size, kept, text_key (xxhash64 of the text).

    Documents are linked if the weighted Jaccard similarity of their shingles is at
    least ``p.similarity``; classes are what links connect. Texts with the same words
    in the same order are alike. Null, empty and blank texts have no shingles and are
    like nothing, so each is a class of its own. A missing id comes last (a class of
    such documents only has a null class_id). Of repeated rows that share the smallest
    id of a class, each is marked as kept.
    """
    rows = cut(signed(docs, p, id_col, text_col))
    texts = cut(rows.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("weight").alias("weight"), F.first("signature").alias("signature")))
    # The sizes of similar documents differ by one at most. So each takes part under its size and the next, and texts of
    # other lengths that share a passage don't meet at all.
    size = p.size(F.col("weight"))
    keyed = texts.select("node", F.explode(F.array(size, size + 1)).alias("size"), "bands").select("node", "size", F.posexplode("bands").alias("band", "value"))
    keyed = keyed.select("node", "band", "size", F.xxhash64("band", "value", "size").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("bucket")
    buckets = cut(keyed.join(shared, "bucket").select("bucket", "band", "size", "node"))
    label = components(links(docs, buckets, texts.drop("bands"), p, id_col, text_col))

    member = rows.select("key", "has_id", "text_key", "node").join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    member = cut(member.select("key", "has_id", "text_key", "class"))
    classes = cut(member.where("class is not null").groupBy("class").agg(F.min(F.struct("key", "has_id")).alias("least"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"))
    # a class with over n / MOST_HOT rows is hot: there are at most MOST_HOT of them
    hot = F.col("class_size") > max(HOT_ROWS, rows.count() // MOST_HOT)
    named = member.join(F.broadcast(classes.where(hot)), "class", "left")
    cold = named.where("class_size is null").select("key", "has_id", "text_key", "class").join(classes.where(~hot), "class", "left")
    own = lambda key, has: F.when(F.col(has), F.col(key))
    return named.where("class_size is not null").unionByName(cold).select(
        own("key", "has_id").alias("doc_id"),
        F.when(F.col("class_size").isNull(), own("key", "has_id")).otherwise(own("least.key", "least.has_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (F.col("class_size").isNull() | (F.col("key") == F.col("least.key"))).alias("kept"),
        "text_key",
    )


def brute_force(texts: dict[int, str], p: NearDuplicates = NearDuplicates()) -> dict[int, int]:
    """For tests: doc_id to the smallest id of its class."""
    import re
    from collections import Counter

    bags = {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if words:
            bags[key] = Counter(tuple(words[i : i + p.shingle]) for i in range(max(len(words) - p.shingle + 1, 1)))
    head = {k: k for k in texts}

    def root(k):
        while head[k] != k:
            k = head[k]
        return k

    keys = sorted(bags)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            least = sum((bags[a] & bags[b]).values())
            if least >= p.similarity * (sum(bags[a].values()) + sum(bags[b].values()) - least):
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}
