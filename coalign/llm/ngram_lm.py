"""An interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in sorted hash arrays.

Training: chunks exchange the hashes of their distinct bigrams; each part of the hash
space adds up its bigrams, keeps them (without ``singletons`` those seen at least twice) as a sorted array
with their counts, and tells the chunks which bigrams to count as types. Chunks then
exchange their words with counts, with the types they end and begin, and each part
keeps a sorted array of words with count, continuation count and backoff weight.
The mass of bigrams that are not stored is in the backoff weight, so every
distribution still sums to one.

Scoring: chunks send their distinct words and bigrams to the parts; a worker writes
the array of its part to a file of its own, maps it into memory, looks the hashes up
by binary search and answers; chunks add up the logarithms. No part of the model is
broadcast or collected, and it grows with the corpus like any other table.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import BLOB, _blobs, _unzip, _zip
from .common import chunked, cut, cut_buckets, drop, lean, lean_group, mix, unpack, word_bounds, word_hashes

_GOLD = np.uint64(0x9E3779B97F4A7C15)
START, END = np.uint64(0x5EED00000000005A), np.uint64(0x5EED0000000000E5)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Bits of a bigram's hash beside those that its part takes.
_REST = np.uint64((1 << 40) - 1)
MODEL = -1  # the chunk number of rows that belong to the model


@dataclass(frozen=True)
class LmRules:
    folds: int = 7
    held_out: int = 2
    #: Stores bigrams seen once as well; else their mass is left to the backoff.
    singletons: bool = False
    chunk_bytes: int = 8 << 20
    part_bytes: int = 8 << 20


@dataclass(frozen=True)
class Discounts:
    """What is taken from counts of 1, 2 and 3 or more."""

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        """From the numbers of types seen once, twice, three and four times; halves where they can't tell."""
        n1, n2, n3, n4 = n
        if not (n1 and n2 and n3):
            return cls(0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        return cls(*(float(np.clip(d, 0.05, i - 0.05)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))))

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count <= 0, 0.0, np.where(count == 1, self.one, np.where(count == 2, self.two, self.more)))


@dataclass(frozen=True)
class Totals:
    """Numbers about the whole training corpus."""

    tokens: int
    words: int
    types: int
    bigram: Discounts
    unigram: Discounts
    spread: float  # what the unigrams leave to all words alike

    def unigram_p(self, continuation: np.ndarray) -> np.ndarray:
        """Probability of words by the number of types they end, over the words and one unknown."""
        return (continuation - self.unigram(continuation)) / max(self.types, 1) + self.spread / (self.words + 1)


def planes(a: np.ndarray, n: int = 8) -> np.ndarray:
    """The low ``n`` bytes of sorted numbers by rank of the byte: the high ones compress away."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).ravel()


def from_planes(b: np.ndarray, n: int = 8) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = b.reshape(n, -1).T
    return out.view("<u8").ravel()


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, offsets of the documents in them); A to Z in lower case, an end after each document."""
    upper = (raw >= 65) & (raw <= 90)
    raw = np.where(upper, raw | np.uint8(32), raw)
    starts, ends, first = word_bounds(raw, offsets)
    token = np.insert(word_hashes(raw, starts, ends), first[1:], END)
    bounds = first + np.arange(len(first))
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[bounds[:-1]] = START
    return token, before, bounds


def _held(keys: np.ndarray, has_id: np.ndarray, rules: LmRules) -> np.ndarray:
    return np.array([zlib.crc32(str(k).encode() if h else b"") % rules.folds == rules.held_out for k, h in zip(keys.tolist(), has_id.tolist(), strict=True)], bool)


def _training(raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, has_id: np.ndarray, rules: LmRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and the ones before them of the documents to learn from, and the offsets of these in them."""
    token, before, bounds = tokens(raw, offsets)
    learn = ~_held(keys, has_id, rules)
    keep = np.repeat(learn, np.diff(bounds))
    return token[keep], before[keep], np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(bounds)[learn])))


def _bigrams(token: np.ndarray, before: np.ndarray, parts: int) -> np.ndarray:
    """Part and 40 bits more of the hash of each bigram."""
    h = mix(before * _GOLD + token)
    return ((h >> np.uint64(40)) % np.uint64(parts) << np.uint64(40)) | (h & _REST)


def _stretches(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(part):
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        yield from zip(part[begin].tolist(), begin.tolist(), np.append(begin[1:], len(part)).tolist(), strict=True)


def _word_order(words: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of distinct words by part and hash, and the stretch of each part."""
    part = (words >> np.uint64(32)) % np.uint64(parts)
    order = np.lexsort((words, part))
    return order, list(_stretches(part[order].astype(np.int64)))


def _sums(value: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct values, their sums, the order by value, where each distinct value begins in it)."""
    order = np.argsort(value)
    v = value[order]
    begin = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    return v[begin], [np.add.reduceat(c[order].astype(np.int64), begin) if len(v) else c.astype(np.int64) for c in counts], order, begin


def _words(token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, the start of a text among them, the number of each token's word, that of the word before it); ``bounds`` are the documents' offsets in the tokens."""
    words, which = np.unique(np.append(token, START), return_inverse=True)
    before = np.empty(len(token), np.int64)
    before[1:] = which[:-2] if len(token) else 0
    before[bounds[:-1]] = which[-1]
    return words, which[:-1], before


def _times(a: np.ndarray) -> list[int]:
    return [int((a == i).sum()) for i in (1, 2, 3, 4)]


def count_bigrams(chunks: DataFrame, rules: LmRules, parts: int) -> DataFrame:
    """Kind 0, by chunk: for each distinct bigram 1, 2 or 3 (or more) if the chunk is to count it as a type seen so often, else 0.

    Kind 1 with chunk ``MODEL``: the sorted array of bigrams to store, and
    kind 2: the numbers of types by count.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                keys, raw, offsets, has_id, _ = unpack(body.as_buffer())
                token, before, _ = _training(raw, offsets, keys, has_id, rules)
                value, times = np.unique(_bigrams(token, before, parts), return_counts=True)
                part = (value >> np.uint64(40)).astype(np.int64)
                yield _blobs([(p, chunk, 0, _zip(planes(value[s:e] & _REST, 5), times[s:e].astype(np.uint32))) for p, s, e in _stretches(part)])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [_unzip(b) for b in table["body"].to_pylist()]
        rest = [from_planes(g[0], 5) for g in got]
        value, (times,), order, begin = _sums(np.concatenate(rest), np.concatenate([g[1] for g in got]))
        owner = np.zeros(len(order), np.uint8)
        owner[order[begin]] = np.minimum(times, 3)
        bounds = np.cumsum([0, *map(len, rest)]).tolist()
        p = key[0].as_py()
        rows = [(p, c, 0, _zip(owner[s:e])) for c, s, e in zip(table["chunk"].to_pylist(), bounds, bounds[1:], strict=False)]
        stored = times > (0 if rules.singletons else 1)
        rows += [(p, MODEL, 1, _zip(planes(value[stored], 5), times[stored])), (p, MODEL, 2, _zip(np.array([*_times(times), len(times)], np.int64)))]
        return pa.Table.from_batches([_blobs(rows)])

    return chunks.mapInArrow(lean(send), BLOB).groupBy("part").applyInArrow(lean_group(add), BLOB)


def _back(right: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(k, p): b for k, p, b in zip(right["kind"].to_pylist(), right["part"].to_pylist(), right["body"].to_pylist(), strict=True)}


def count_words(chunks: DataFrame, owned: DataFrame, rules: LmRules, parts: int, bigram: Discounts) -> DataFrame:
    """Chunk ``MODEL``, kind 0: the sorted array of words with count, types they end, and backoff weight; kind 2: numbers of words."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        back = _back(right)
        keys, raw, offsets, has_id, _ = unpack(left["body"][0].as_buffer())
        token, before, bounds = _training(raw, offsets, keys, has_id, rules)
        value, _, order, begin = _sums(_bigrams(token, before, parts))
        at = order[begin]
        seen = np.zeros(len(value), np.uint8)
        for p, s, e in _stretches((value >> np.uint64(40)).astype(np.int64)):
            seen[s:e] = _unzip(back[0, p])[0]
        words, last, first = _words(token, bounds)
        times = np.bincount(last, minlength=len(words))
        times[np.searchsorted(words, START)] = len(bounds) - 1
        own = seen > 0
        last, first, seen = last[at[own]], first[at[own]], seen[own]
        ends = np.bincount(last, minlength=len(words))
        begins = [np.bincount(first[seen == i], minlength=len(words)) for i in (1, 2, 3)]
        order, stretches = _word_order(words, parts)
        columns = [c[order].astype(np.uint32) for c in (times, ends, *begins)]
        words = words[order]
        return pa.Table.from_batches([_blobs([(p, left["chunk"][0].as_py(), 0, _zip(planes(words[s:e]), *(c[s:e] for c in columns))) for p, s, e in stretches])])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [_unzip(b) for b in table["body"].to_pylist()]
        value, (times, ends, one, two, more), _, _ = _sums(np.concatenate([from_planes(g[0]) for g in got]), *(np.concatenate([g[i] for g in got]) for i in range(1, 6)))
        # of bigrams that aren't stored all mass backs off
        backoff = ((bigram.one if rules.singletons else 1.0) * one + bigram.two * two + bigram.more * more) / np.maximum(times, 1)
        real = value != START
        p = key[0].as_py()
        numbers = np.array([*_times(ends[real]), int((ends[real] > 2).sum()), int(times[real].sum()), int(real.sum())], np.int64)
        return pa.Table.from_batches([_blobs([(p, MODEL, 0, _zip(value, times, ends, backoff.view(np.uint64))), (p, MODEL, 2, _zip(numbers))])])

    return chunks.groupBy("chunk").cogroup(owned.groupBy("chunk")).applyInArrow(lean_group(send), BLOB).groupBy("part").applyInArrow(lean_group(add), BLOB)


def _numbers(rows: DataFrame) -> np.ndarray:
    """A few numbers of each part, added up; by ranges of parts, so that little comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for body in batch.column("body").to_pylist():
                total = _unzip(body)[0] if total is None else total + _unzip(body)[0]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "n"])

    found = rows.where("kind = 2").mapInArrow(lean(add), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return np.array([r["n"] for r in sorted(found, key=lambda r: r["i"])], np.int64)


@dataclass
class Model:
    """Sorted hash arrays by part (kind 0 words, kind 1 bigrams) and the totals."""

    arrays: DataFrame
    totals: Totals
    parts: int


def train(chunks: DataFrame, rules: LmRules = LmRules()) -> Model:
    """A model of the documents of a chunk table that aren't held out."""
    size = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-size // rules.part_bytes))
    pairs = cut(count_bigrams(chunks, rules, parts), "kind")
    counts = _numbers(pairs)
    counts = counts if len(counts) else np.zeros(5, np.int64)
    bigram = Discounts.of(counts[:4].tolist())
    words = cut(count_words(chunks, pairs.where("kind = 0"), rules, parts, bigram))
    drop(pairs, part="kind=0")
    ends = _numbers(words)
    ends = ends if len(ends) else np.zeros(7, np.int64)
    unigram, types = Discounts.of(ends[:4].tolist()), int(counts[4])
    left = unigram.one * ends[0] + unigram.two * ends[1] + unigram.more * ends[4]
    totals = Totals(int(ends[5]), int(ends[6]), types, bigram, unigram, float(left / types) if types else 1.0)
    arrays = words.where("kind = 0").unionByName(pairs.where("kind = 1"))
    return Model(arrays, totals, parts)


def _mapped(folder: str, name: str, array: np.ndarray) -> np.ndarray:
    if not len(array):
        return array
    path = f"{folder}/{name}"
    array.tofile(path)
    return np.memmap(path, array.dtype, "r")


def look_up(chunks: DataFrame, model: Model, rules: LmRules) -> DataFrame:
    """By chunk, what the model knows of its distinct words (kind 0: count, types they end, backoff weight) and bigrams (kind 1: count)."""
    parts = model.parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                _, raw, offsets, _, _ = unpack(body.as_buffer())
                token, before, _ = tokens(raw, offsets)
                words = np.unique(np.append(token, START))
                order, stretches = _word_order(words, parts)
                words = words[order]
                yield _blobs([(p, chunk, 0, _zip(planes(words[s:e]))) for p, s, e in stretches])
                value = np.unique(_bigrams(token, before, parts))
                yield _blobs([(p, chunk, 1, _zip(planes(value[s:e] & _REST, 5))) for p, s, e in _stretches((value >> np.uint64(40)).astype(np.int64))])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return asked
        kind, part = asked["kind"][0].as_py(), asked["part"][0].as_py()
        stored = _unzip(own["body"][0].as_py()) if own.num_rows else [np.zeros(0, np.uint64)] * (4 if kind == 0 else 2)
        if kind == 1 and own.num_rows:
            stored[0] = from_planes(stored[0], 5)
        out: list[tuple] = []
        with tempfile.TemporaryDirectory() as folder:
            keys, *values = (_mapped(folder, str(i), a) for i, a in enumerate(stored))
            for chunk, body in zip(asked["chunk"].to_pylist(), asked["body"].to_pylist(), strict=True):
                wanted = from_planes(_unzip(body)[0], 8 if kind == 0 else 5)
                at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
                found = [np.where(hit, v[at], 0).astype(np.uint64) if len(keys) else np.zeros(len(wanted), np.uint64) for v in values]
                out.append((part, chunk, kind, _zip(planes(found[0]), planes(found[1]), *found[2:]) if kind == 0 else _zip(planes(found[0]))))
            del keys, values
        return pa.Table.from_batches([_blobs(out)])

    return chunks.mapInArrow(lean(ask), BLOB).groupBy("kind", "part").cogroup(model.arrays.groupBy("kind", "part")).applyInArrow(lean_group(answer), BLOB)


def score(chunks: DataFrame, model: Model, rules: LmRules = LmRules()) -> DataFrame:
    """The scores of all documents of a chunk table."""
    answers, totals, parts = cut(look_up(chunks, model, rules)), model.totals, model.parts

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        back = _back(right)
        keys, raw, offsets, has_id, _ = unpack(left["body"][0].as_buffer())
        token, before, bounds = tokens(raw, offsets)
        words, w, v = _words(token, bounds)
        order, stretches = _word_order(words, parts)
        count, ends, backoff = np.zeros(len(words)), np.zeros(len(words)), np.ones(len(words))
        for p, s, e in stretches:
            a, b, c = _unzip(back[0, p])
            a, b, rows = from_planes(a), from_planes(b), order[s:e]
            count[rows], ends[rows] = a, b
            backoff[rows] = np.where(a > 0, c.view(np.float64), 1.0)
        value, which = np.unique(_bigrams(token, before, parts), return_inverse=True)
        times = np.zeros(len(value))
        for p, s, e in _stretches((value >> np.uint64(40)).astype(np.int64)):
            times[s:e] = from_planes(_unzip(back[1, p])[0])
        times = times[which]
        total = np.maximum(count, 1)
        p = np.where(times > 0, np.minimum(1.0, np.maximum(times - totals.bigram(times), 0) / total[v]), 0.0) + backoff[v] * totals.unigram_p(ends)[w]
        base = np.log10((count + 1) / (totals.tokens + 1 * (totals.words + 1)))[w]
        at = bounds[:-1]  # no document is without a token
        return pa.table(
            {
                "doc_id": pa.array(keys, mask=~has_id),
                "held_out": pa.array(_held(keys, has_id, rules)),
                "n_tokens": pa.array(np.diff(bounds)),
                "n_known": pa.array(np.add.reduceat((count[w] > 0).astype(np.int64), at)),
                "train_tokens": pa.array(np.full(len(keys), totals.tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, at)),
                "score": pa.array(np.add.reduceat(np.log10(p), at)),
            }
        )

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean_group(finish), RESULT)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LmRules = LmRules()) -> DataFrame:
    """Trains on the documents that aren't held out and scores all: one row per row of ``docs``.

    A document is held out if the CRC-32 of its id as text leaves ``rules.held_out``
    modulo ``rules.folds``; a missing id counts as an empty text. A null or empty text
    is one token, the end. Repeated rows are counted and scored each. Without a
    document to learn from every word is unknown. An empty table gives an empty result.
    """
    chunks = cut_buckets(chunked(docs, id_col, text_col, rules.chunk_bytes), "chunk")
    return score(chunks, train(chunks, rules), rules)
