"""Repeated byte strings, by a common-prefix-aware merge sort of suffixes.

Chunks sort the suffixes at their anchors and exchange them as front-coded runs
(``anchored``). Strings that can match agree in the bytes on which their anchor was
chosen, and these decide the part, so each part sorts for itself: its runs meet in a
loser tree whose nodes remember how much their loser has in common with the last
output. A string that has more in common with it is smaller without a look at the
strings; two that have equally much are compared from there on only. The tree also
yields the common prefix of neighbours in the merged order, an LCP array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchored import Scheme, Suffixes, drop_repeats

RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>"


def merge_runs(strings: list[list[bytes]], same: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Sorted runs merged: (run, place) of each string in order, and what it shares with the one before.

    ``same`` has, for each string, what it shares with the one before in its run. Of
    equal strings any may come first.
    """
    runs = len(strings)
    size = 1
    while size < runs:
        size *= 2
    place = [0] * runs
    head: list[bytes | None] = [s[0] if s else None for s in strings] + [None] * (size - runs)
    loser, loser_same = [0] * size, [-1] * size

    def first(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, -1 if head[node - size] is None else 0
        a, with_a = first(2 * node)
        b, with_b = first(2 * node + 1)
        if with_a == with_b == 0:
            x, y = head[a], head[b]
            n = i = 0
            n = min(len(x), len(y))
            while i < n and x[i] == y[i]:
                i += 1
            if (x[i] > y[i]) if i < n else len(x) > len(y):
                a, b = b, a
            with_b = i
        elif with_b > with_a:
            a, with_a, b, with_b = b, with_b, a, with_a
        loser[node], loser_same[node] = b, with_b
        return a, with_a

    run, with_last = first(1)
    order: list[tuple[int, int]] = []
    shared: list[int] = []
    while with_last >= 0:
        at = place[run]
        order.append((run, at))
        shared.append(with_last)
        at += 1
        place[run] = at
        own = strings[run]
        if at < len(own):
            head[run] = own[at]
            with_last = same[run][at]
        else:
            head[run] = None
            with_last = -1
        node = (run + size) >> 1
        while node:
            other = loser_same[node]
            if other > with_last:
                loser_same[node] = with_last
                run, loser[node] = loser[node], run
                with_last = other
            elif other == with_last and other >= 0:
                x, y = head[run], head[loser[node]]
                if x == y:
                    loser_same[node] = len(x)
                else:
                    i, n = other, min(len(x), len(y))
                    while i < n and x[i] == y[i]:
                        i += 1
                    if (x[i] > y[i]) if i < n else len(x) > len(y):
                        run, loser[node] = loser[node], run
                    loser_same[node] = i
            node >>= 1
    return order, shared


def _merge_order(decoded: list[tuple[Suffixes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    strings: list[list[bytes]] = []
    for s, _ in decoded:
        data, wide = s.right.tobytes(), s.right.shape[1]
        strings.append([data[i * wide : i * wide + n] for i, n in enumerate(s.n_right.tolist())])
    order, shared = merge_runs(strings, [same.tolist() for _, same in decoded])
    begin = np.cumsum([0, *(len(x) for x in strings)])
    pairs = np.array(order, np.int64).reshape(-1, 2)
    return begin[pairs[:, 0]] + pairs[:, 1], np.array(shared, np.int64)


def _write(raw: np.ndarray, offsets: np.ndarray, units: np.ndarray, first: np.ndarray, gone: np.ndarray, keys: np.ndarray, has_id: np.ndarray) -> pa.Table:
    edge = np.zeros(len(gone) + 1, bool)
    edge[offsets] = True
    before = np.append(False, gone[:-1])[: len(gone)]
    after = np.append(gone[1:], False)[: len(gone)]
    starts = np.flatnonzero(gone & (~before | edge[:-1]))
    stops = np.flatnonzero(gone & (~after | edge[1:])) + 1
    kept = raw[~gone].tobytes()
    kept_at = np.concatenate(([0], np.cumsum(~gone)))[offsets]
    span_at = np.searchsorted(starts, offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    base = offsets[doc] if len(starts) else starts
    spans = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(stops - base)], names=["start", "stop"])
    return pa.table(
        {
            "doc_id": pa.array(keys, mask=~has_id),
            "n_bytes": pa.array(np.diff(offsets)),
            "kept": pa.array([kept[s:e] for s, e in zip(kept_at.tolist(), kept_at[1:].tolist(), strict=False)], pa.binary()),
            "spans": pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans),
        }
    )


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 20, chunk_bytes: int = 8 << 20, part_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, kept (the bytes left), spans (the maximal runs removed).

    A byte goes if it is in a string of ``length`` bytes that also starts in a document
    with a smaller id. A null text counts as empty; a missing id comes after all
    others. Rows with one id don't remove each other's bytes. The input is read once.
    Cutting a character in two is possible, so what is left is binary. An empty table
    gives an empty result.
    """
    scheme = Scheme("byte", length, k, chunk_bytes, part_bytes)
    return drop_repeats(docs, scheme, _merge_order, _write, RESULT, id_col, text_col)


def brute_force(texts: dict[int, str], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """For tests: doc_id to (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    smallest: dict[bytes, int] = {}
    data = {k: (t or "").encode() for k, t in texts.items()}
    for key in sorted(data):
        b = data[key]
        for i in range(len(b) - length + 1):
            smallest.setdefault(b[i : i + length], key)
    out = {}
    for key, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if smallest[b[i : i + length]] < key:
                gone[i : i + length] = b"\x01" * length
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out
