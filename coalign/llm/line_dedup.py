"""Near-duplicate lines by a deletion-neighbourhood join.

Distance is counted in words: lines are near if one word put in, left out or replaced
makes one the other. A line's neighbourhood is itself and all its variants with one
word deleted, as hashes. Lines of one length are near exactly if they have a variant
in common that was made by deleting at the same place; lines that differ by one word
in length, exactly if the shorter one is a variant of the longer one. So joining the
hashes, with the place of the deletion beside them, verifies the distance as well,
and a line that a third of all documents have is one entry a chunk.

Chunks first exchange their distinct lines, to find the first of equal ones, and 32
bits of each variant; only variants that two lines have are sent in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import BLOB, _blobs, _short, _slices, _unzip, _zip
from .common import _UNBASE, chunked, cut, cut_buckets, lean, lean_group, mix, powers, unpack, word_bounds, word_hashes

RESULT = "doc_id long, n_lines long, n_removed long, kept string"


@dataclass(frozen=True)
class LineRules:
    """Lines of fewer than ``least_words`` words stay; from ``near_words`` on near lines count as well as equal ones."""

    least_words: int = 5
    near_words: int = 10
    chunk_bytes: int = 8 << 20
    part_bytes: int = 8 << 20


@dataclass
class Lines:
    """The lines of a chunk that have enough words, and the distinct ones among them, each at its first place."""

    doc: np.ndarray
    number: np.ndarray  # of the line in its document, from 0
    which: np.ndarray  # its distinct line
    hash: np.ndarray  # of the distinct lines from here on
    first: np.ndarray  # index of the first line of each
    begin: np.ndarray  # words
    end: np.ndarray
    sums: np.ndarray
    n_lines: np.ndarray  # lines with a word, by document


def lines_of(raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, rules: LineRules) -> Lines:
    starts, ends, first_word = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends)
    breaks = np.flatnonzero(raw == 10)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first_word))
    line = np.searchsorted(breaks, starts)
    new = np.ones(len(words), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(words)) if len(begin) else begin
    doc, line = doc[begin], line[begin]
    number = line - np.searchsorted(breaks, offsets[doc]) if len(doc) else line
    n_lines = np.bincount(doc, minlength=len(offsets) - 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(len(words)))))
    keep = end - begin >= rules.least_words
    doc, number, begin, end = doc[keep], number[keep], begin[keep], end[keep]
    down = powers(len(words) + 1, "down")
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    order = np.lexsort((number, keys[doc], hashes))
    h = hashes[order]
    head = np.append(True, h[1:] != h[:-1])[: len(h)]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(head) - 1
    return Lines(doc, number, which, h[head], order[head], begin, end, sums, n_lines)


def variants(x: Lines, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, index into ``distinct``) of the neighbourhoods: place 0 is the line itself, i + 1 the variant without word i."""
    begin, end = x.begin[x.first[distinct]], x.end[x.first[distinct]]
    size = end - begin
    of = np.repeat(np.arange(len(distinct)), size)
    word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + begin[of]
    down = powers(len(x.sums), "down")
    left = x.sums[word] - x.sums[begin[of]]
    right = (x.sums[end[of]] - x.sums[word + 1]) * _UNBASE
    less = mix((left + right) * down[begin[of]] + (size[of] - 1).astype(np.uint64))
    return np.concatenate((x.hash[distinct], less)), np.concatenate((np.zeros(len(distinct), np.int64), word - begin[of] + 1)), np.concatenate((np.arange(len(distinct)), of))


def _long(x: Lines, rules: LineRules) -> np.ndarray:
    return np.flatnonzero((x.end - x.begin)[x.first] >= rules.near_words)


def _sorted_with(value: np.ndarray, bits: int, number: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``value`` (of so many bits) in order, and the ``number`` (below ``most``) beside each; equal values by number."""
    low = max(int(most - 1).bit_length(), 1)
    if bits + low > 64:
        order = np.lexsort((number, value))
        return value[order], number[order]
    both = np.sort((value.astype(np.uint64) << np.uint64(low)) | number.astype(np.uint64))
    return both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int64)


def _distinct_variants(short: np.ndarray, parts: int, of: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct short hashes in order, whether two lines have it)."""
    s, line = _sorted_with(short, 32 + parts.bit_length(), of, lines)
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    last = np.append(begin[1:], len(s)) - 1 if len(s) else begin
    return s[begin], line[begin] != line[last]


def _by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by part and hash, and the stretch of each part."""
    part = (hashes >> np.uint64(32)) % np.uint64(parts)
    order = np.lexsort((hashes, part))
    return order, list(_slices(part[order] << np.uint64(32)))


def offers(chunks: DataFrame, rules: LineRules, parts: int) -> DataFrame:
    """Kind 0: a bit for each distinct line of a chunk, set if it isn't the first of its kind. Kind 1: a bit for each short variant hash that two lines have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                keys, raw, offsets, _, _ = unpack(body.as_buffer())
                x = lines_of(raw, offsets, keys, rules)
                order, stretches = _by_part(x.hash, parts)
                h, key, number = x.hash[order], keys[x.doc[x.first[order]]], x.number[x.first[order]]
                rows = [(p, chunk, 0, _zip(h[s:e], key[s:e], number[s:e])) for p, s, e in stretches]
                v, _, of = variants(x, _long(x, rules))
                short, twice = _distinct_variants(_short(v, parts), parts, of, len(x.hash))
                rows += [(p, chunk, 1, _zip((short[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.packbits(twice[s:e]))) for p, s, e in _slices(short)]
                yield _blobs(rows)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        got = [_unzip(b) for b in table["body"].to_pylist()]
        sizes = [len(g[0]) for g in got]
        value = np.concatenate([g[0] for g in got])
        if kind == 0:
            place = _ranks(np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]))
            order = np.lexsort((place, value))
            v, at = value[order], place[order]
            head = np.append(True, v[1:] != v[:-1])
            flag = np.empty(len(v), bool)
            flag[order] = at[head][np.cumsum(head) - 1] < at
        else:
            flag = np.concatenate([np.unpackbits(g[1], count=n) for g, n in zip(got, sizes, strict=True)]).astype(bool)
            v, order = _sorted_with(value, 32, np.arange(len(value)), len(value))
            same = np.zeros(len(v) + 1, bool)
            same[1:-1] = v[1:] == v[:-1]
            flag[order[same[1:] | same[:-1]]] = True
        return _answers(table, flag, sizes, kind)

    return chunks.mapInArrow(lean(send), BLOB).groupBy("kind", "part").applyInArrow(lean_group(compare), BLOB)


def _ranks(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order of places in the corpus as numbers; equal places get the same."""
    order = np.lexsort((number, key))
    k, n = key[order], number[order]
    rank = np.empty(len(k), np.int64)
    rank[order] = np.cumsum(np.append(False, (k[1:] != k[:-1]) | (n[1:] != n[:-1])))
    return rank


def _answers(table: pa.Table, flag: np.ndarray, sizes: list[int], kind: int) -> pa.Table:
    bounds = np.cumsum([0, *sizes]).tolist()
    rows = zip(table["part"].to_pylist(), table["chunk"].to_pylist(), bounds, bounds[1:], strict=False)
    return pa.Table.from_batches([_blobs([(p, c, kind, np.packbits(flag[s:e]).tobytes()) for p, c, s, e in rows])])


def _bits(order: np.ndarray, stretches: list[tuple[int, int, int]], back: dict[int, bytes]) -> np.ndarray:
    """The answers for entries that were sent in ``order``."""
    flag = np.zeros(len(order), bool)
    for p, s, e in stretches:
        flag[order[s:e]] = np.unpackbits(np.frombuffer(back[p], np.uint8), count=e - s).astype(bool)
    return flag


def _survivors(x: Lines, rules: LineRules, parts: int, back: dict[int, dict[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The variants (hash, place, distinct line) that two lines have, of long distinct lines that aren't repeats."""
    late = _bits(*_by_part(x.hash, parts), back[0])
    long = _long(x, rules)
    v, place, of = variants(x, long)
    s, at = _sorted_with(_short(v, parts), 32 + parts.bit_length(), np.arange(len(v)), max(len(v), 1))
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    flag = np.zeros(int(new.sum()), bool)
    for p, b, e in _slices(s[new]):
        flag[b:e] = np.unpackbits(np.frombuffer(back[1][p], np.uint8), count=e - b).astype(bool)
    keep = np.sort(at[flag[np.cumsum(new) - 1]]) if len(s) else at
    keep = keep[~late[long[of[keep]]]]
    return v[keep], place[keep], long[of[keep]]


def joined(chunks: DataFrame, answers: DataFrame, rules: LineRules, parts: int) -> DataFrame:
    """Kind 2: the numbers of a chunk's distinct lines of which a variant shows an earlier line that is near."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, body, back = _returned(left, right)
        keys, raw, offsets, _, _ = unpack(body)
        x = lines_of(raw, offsets, keys, rules)
        v, place, line = _survivors(x, rules, parts, back)
        order, stretches = _by_part(v, parts)
        v, place, line = v[order], place[order], line[order]
        key, number = keys[x.doc[x.first[line]]], x.number[x.first[line]]
        return pa.Table.from_batches([_blobs([(p, chunk, 2, _zip(v[s:e], place[s:e], key[s:e], number[s:e], line[s:e])) for p, s, e in stretches])])

    def decide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [_unzip(b) for b in table["body"].to_pylist()]
        v, place, keys, number = (np.concatenate([g[i] for g in got]) for i in range(4))
        rank = _ranks(keys, number)
        none = np.iinfo(np.int64).max
        order = np.lexsort((rank, place, v))
        sv, sp, sr = v[order], place[order], rank[order]
        group = np.append(True, sv[1:] != sv[:-1])
        fine = group | np.append(True, sp[1:] != sp[:-1])
        at = np.flatnonzero(group)
        itself = np.minimum.reduceat(np.where(sp == 0, sr, none), at)[np.cumsum(group) - 1]
        less = np.minimum.reduceat(np.where(sp > 0, sr, none), at)[np.cumsum(group) - 1]
        alike = sr[fine][np.cumsum(fine) - 1]
        flag = np.empty(len(sv), bool)
        flag[order] = np.where(sp == 0, less, np.minimum(itself, alike)) < sr
        bounds = np.cumsum([0, *(len(g[0]) for g in got)]).tolist()
        rows = zip(table["part"].to_pylist(), table["chunk"].to_pylist(), (g[4] for g in got), bounds, bounds[1:], strict=False)
        return pa.Table.from_batches([_blobs([(p, c, 2, _zip(np.unique(line[flag[s:e]]))) for p, c, line, s, e in rows])])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean_group(send), BLOB).groupBy("part").applyInArrow(lean_group(decide), BLOB)


def _returned(left: pa.Table, right: pa.Table) -> tuple[int, bytes, dict[int, dict[int, bytes]]]:
    back: dict[int, dict[int, bytes]] = {0: {}, 1: {}, 2: {}}
    for p, kind, body in zip(right["part"].to_pylist(), right["kind"].to_pylist(), right["body"].to_pylist(), strict=True):
        back[kind][p] = body
    return left["chunk"][0].as_py(), left["body"][0].as_buffer(), back


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (with a word), n_removed, kept (the lines left).

    A line goes if an earlier line, in a document with a smaller id or above in the
    same one, is equal to it in its words or near it; judged on the input. Shorter
    lines than ``rules.least_words`` stay. A null text has no lines and gives an empty
    one; a missing id comes last; rows with one id don't remove each other's line of
    the same number. An empty table gives an empty result.
    """
    chunks = cut_buckets(chunked(docs, id_col, text_col, rules.chunk_bytes), "chunk")
    size = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-size // rules.part_bytes))
    first = cut(offers(chunks, rules, parts))
    back = first.where("kind = 0").unionByName(cut(joined(chunks, first, rules, parts)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        _, body, back = _returned(left, right)
        keys, raw, offsets, has_id, _ = unpack(body)
        x = lines_of(raw, offsets, keys, rules)
        gone = _bits(*_by_part(x.hash, parts), back[0])
        for near in back[2].values():
            gone[_unzip(near)[0]] = True
        # of equal lines of a chunk those after the first one
        key, at = keys[x.doc], x.first[x.which]
        later = (key > key[at]) | ((key == key[at]) & (x.number > x.number[at]))
        drop = np.flatnonzero(gone[x.which] | later)
        by_doc = np.searchsorted(x.doc[drop], np.arange(len(keys) + 1))
        numbers, data, bounds = x.number[drop].tolist(), raw.tobytes(), offsets.tolist()
        kept: list[str] = []
        for i, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
            text = data[s:e].decode("utf-8")
            if by_doc[i] < by_doc[i + 1]:
                lost = set(numbers[by_doc[i] : by_doc[i + 1]])
                text = "\n".join(t for n, t in enumerate(text.split("\n")) if n not in lost)
            kept.append(text)
        return pa.table({"doc_id": pa.array(keys, mask=~has_id), "n_lines": pa.array(x.n_lines.astype(np.int64)), "n_removed": pa.array(np.diff(by_doc).astype(np.int64)), "kept": pa.array(kept, pa.string())})

    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lean_group(finish), RESULT)


def near(a: list[str], b: list[str]) -> bool:
    """For tests: is the edit distance of two lists of words 1 at most?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_force(texts: dict[int, str], rules: LineRules = LineRules()) -> dict[int, tuple[int, int, str]]:
    """For tests: doc_id to (n_lines, n_removed, kept)."""
    import re

    seen: list[list[str]] = []
    out = {}
    for key in sorted(texts):
        n, removed, kept = 0, 0, []
        for line in (texts[key] or "").split("\n"):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            n += bool(words)
            late = len(words) >= rules.least_words and any(words == s or min(len(words), len(s)) >= rules.near_words and near(words, s) for s in seen)
            if len(words) >= rules.least_words:
                seen.append(words)
            removed += late
            kept += [] if late else [line]
        out[key] = (n, removed, "\n".join(kept))
    return out
