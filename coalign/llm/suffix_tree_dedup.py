"""Repeated word sequences, by prefix-partitioned suffix trees.

The suffixes at the anchors of all documents (``anchored``) are split by variable-
length prefixes: a prefix of one word stands for a tree unless too many suffixes
begin with it; then its extensions by a word do, and so on up to the words on which
the anchor was chosen, which any two equal windows share. Trees are dealt out to
parts by a hash of their prefix. A part builds its trees as sorted suffixes with the
common prefixes of neighbours: the nodes of depth d are the stretches in which no
neighbours share less than d words. Nodes deep enough for a whole window, together
with the words before the anchor, are the repeats, and the smallest document below
such a node keeps its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import Scheme, Suffixes, anchors, drop_repeats, shared, units_of
from .common import cut, lean, mix, unpack, word_bounds

RESULT = "doc_id long, n_words long, n_removed long, kept string"


def prefix_hash(right: np.ndarray, n: int) -> np.ndarray:
    """A hash of the first ``n`` words of each suffix."""
    h = np.full(len(right), n, np.uint64)
    for i in range(n):
        h = mix(h + right[:, i])
    return h


#: About as many prefixes of a length as a chunk names, and as many heavy ones as are told apart.
NAMED, MOST_HEAVY = 4096, 2000


def heavy_prefixes(chunks: DataFrame, scheme: Scheme, limit: int) -> list[np.ndarray] | None:
    """By number of words less than k, the hashes of prefixes with over ``limit`` suffixes, sorted.

    A chunk names a prefix only if it has its share of the limit there, and no more
    than ``NAMED`` of a length; so a prefix that isn't found has less than twice the
    limit, and at most ``MOST_HEAVY`` of a length come to the driver. None for a corpus
    that can have more: there every prefix counts as heavy.
    """
    share = limit // max(chunks.count(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                _, raw, offsets, _, _ = unpack(body.as_buffer())
                units, first = units_of(scheme, raw, offsets)
                at = anchors(scheme, units, first).at
                out = [(0, 0, len(at))]
                for n in range(1, scheme.k):
                    value, times = np.unique(prefix_hash(units[at[:, None] + np.arange(n)], n), return_counts=True)
                    often = times >= max(1, share, len(at) // NAMED)
                    out += [(n, h, c) for h, c in zip(value[often].view(np.int64).tolist(), times[often].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["n", "prefix", "times"])

    counted = cut(chunks.mapInArrow(lean(count), "n int, prefix long, times long").groupBy("n", "prefix").agg(F.sum("times").alias("times")))
    total = counted.where("n = 0").agg(F.sum("times")).first()[0] or 0
    if total > MOST_HEAVY * limit:
        return None
    rows = counted.where((F.col("n") > 0) & (F.col("times") > limit)).collect()
    return [np.sort(np.array([r["prefix"] for r in rows if r["n"] == n], np.int64).view(np.uint64)) for n in range(1, scheme.k)]


def router(scheme: Scheme, limit: int):
    def make(chunks: DataFrame, parts: int):
        heavy = heavy_prefixes(chunks, scheme, limit)

        def route(right: np.ndarray) -> np.ndarray:
            if heavy is None:
                return mix(prefix_hash(right, scheme.k)) % np.uint64(parts)
            prefix = prefix_hash(right, 1)
            open_ = np.ones(len(right), bool)  # the prefix so far is heavy
            for n in range(1, scheme.k):
                h = prefix_hash(right, n)
                prefix = np.where(open_, h, prefix)
                open_ &= np.isin(h, heavy[n - 1])
            return mix(np.where(open_, prefix_hash(right, scheme.k), prefix)) % np.uint64(parts)

        return route

    return make


def _tree_order(decoded: list[tuple[Suffixes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of all trees of a part in order, and the depth at which each parts from the one before."""
    right = np.concatenate([s.right for s, _ in decoded])
    n_right = np.concatenate([s.n_right for s, _ in decoded])
    rows = np.lexsort([n_right, *right.T[::-1]])
    return rows, shared(right[rows], n_right[rows])


def _write(raw: np.ndarray, offsets: np.ndarray, units: np.ndarray, first: np.ndarray, gone: np.ndarray, keys: np.ndarray, has_id: np.ndarray) -> pa.Table:
    starts, ends, _ = word_bounds(raw, offsets)
    s, e = starts[~gone], ends[~gone]
    # the kept words with one blank after each; the last blank of a document is cut off
    sizes = e - s + 1
    to = np.cumsum(sizes)
    take = np.repeat(s - (to - sizes), sizes) + np.arange(int(sizes.sum()))
    data = np.append(raw, np.uint8(32))[np.minimum(take, len(raw))]
    data[to - 1] = 32
    text = data.tobytes()
    words = np.concatenate(([0], np.cumsum(~gone)))[first]
    at = np.concatenate(([0], to))[words]
    kept = [text[a : max(a, b - 1)].decode() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
    return pa.table({"doc_id": pa.array(keys, mask=~has_id), "n_words": pa.array(np.diff(first)), "n_removed": pa.array(np.diff(first) - np.diff(words)), "kept": pa.array(kept, pa.string())})


def drop_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, k: int = 5, chunk_bytes: int = 8 << 20, part_bytes: int = 4 << 20, tree_limit: int = 500_000
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one blank).

    A word goes if it is in a window of ``length`` words that also starts in a document
    with a smaller id. A null text has no words; a missing id comes after all others.
    Rows with one id don't remove each other's words. The input is read once. An empty
    table gives an empty result.
    """
    scheme = Scheme("word", length, k, chunk_bytes, part_bytes)
    return drop_repeats(docs, scheme, _tree_order, _write, RESULT, id_col, text_col, router(scheme, tree_limit))


def brute_force(texts: dict[int, str], length: int = 13) -> dict[int, tuple[int, int, str]]:
    """For tests: doc_id to (n_words, n_removed, kept words joined by a blank)."""
    import re

    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts.items()}
    smallest: dict[tuple, int] = {}
    for key in sorted(words):
        for i in range(len(words[key]) - length + 1):
            smallest.setdefault(tuple(words[key][i : i + length]), key)
    out = {}
    for key, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if smallest[tuple(w[i : i + length])] < key:
                gone[i : i + length] = [True] * length
        out[key] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out
