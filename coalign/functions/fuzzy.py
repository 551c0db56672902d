"""String similarities that Spark doesn't have, as Arrow functions over batches; all from 0 to 1.

Ratio is twice the longest common subsequence over both lengths. The kernels go over
all rows of a batch at once: a row is a lane of 64-bit words with a bit for each
character of its shorter string, and step j takes the j-th character of the longer
one, in all rows. Each distinct pair of a batch is compared once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE = np.uint64(1)
_FULL = np.uint64(2**64 - 1)
#: Words of masks in one go, and characters of a block of pairs.
_LANES, _CELLS = 1 << 20, 1 << 17


class _Texts:
    """Strings as numbers of their characters, one after the other; 0 stands for no character."""

    def __init__(self, texts: list[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.size)))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, code = np.unique(points, return_inverse=True)
        self.code = np.append(code.astype(np.int32) + 1, np.int32(0))
        self.letters = len(letters) + 1

    def matrix(self, which: np.ndarray) -> np.ndarray:
        """A row of characters for each text, filled up with 0."""
        size = self.size[which]
        at = np.arange(int(size.max(initial=0)))
        return self.code[np.where(at < size[:, None], self.begin[which][:, None] + at, len(self.code) - 1)]


def _common(texts: _Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of texts ``x``, none longer than its partner, and texts ``y``."""
    out = np.zeros(len(x), np.int64)
    n, m = texts.size[x], texts.size[y]
    words = -(-n // 64)
    order = np.lexsort((m, words))
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        n_words = int(words[order[at]])
        most = max(1, _LANES // (n_words * (texts.letters + 1)))
        rows = order[at : min(at + most, int(np.searchsorted(words[order], n_words, side="right")))]
        at += len(rows)
        a, b = texts.matrix(x[rows]), texts.matrix(y[rows])
        lane = np.arange(len(rows))
        masks = np.zeros((len(rows), texts.letters, n_words), np.uint64)
        for i in range(a.shape[1]):
            masks[lane, a[:, i], i >> 6] |= _ONE << np.uint64(i & 63)
        masks[:, 0] = 0
        state = np.full((n_words, len(rows)), _FULL)
        for j in range(b.shape[1]):
            hit = masks[lane, b[:, j]].T & state
            carry = np.zeros(len(rows), np.uint64)
            for w in range(n_words):
                s, u = state[w], hit[w]
                total = s + u
                over = total < s
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                state[w] = total | (s ^ u)
        left = n[rows][None, :] - 64 * np.arange(n_words)[:, None]
        inside = np.where(left >= 64, _FULL, (_ONE << np.clip(left, 0, 63).astype(np.uint64)) - _ONE)
        out[rows] = np.bitwise_count(~state & inside).sum(axis=0)
    return out


class _Pairs:
    """Distinct pairs of strings, each with a number."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, str], int] = {}

    def add(self, x: str, y: str) -> int:
        return self.number.setdefault((x, y) if len(x) <= len(y) else (y, x), len(self.number))

    def texts(self) -> tuple[_Texts, np.ndarray, np.ndarray]:
        names: dict[str, int] = {}
        sides = [[names.setdefault(p[i], len(names)) for p in self.number] for i in (0, 1)]
        return _Texts(list(names)), *(np.array(s, np.int64) for s in sides)

    def common(self) -> np.ndarray:
        texts, x, y = self.texts()
        return _common(texts, x, y)


def _indices(pairs: Iterable[int]) -> np.ndarray:
    return np.fromiter(pairs, np.int64)


def _over(n: np.ndarray, d: np.ndarray, empty: float) -> np.ndarray:
    return np.where(d > 0, n / np.maximum(d, 1), empty)


def _in_blocks(pairs: list[tuple[str, str]], rows: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the pairs ``rows``, alike in length: (their numbers, characters of both sides, lengths of both sides); 0 and -1 fill up."""
    names: dict[str, int] = {}
    left, right = (np.array([names.setdefault(pairs[k][i], len(names)) for k in rows], np.int64) for i in (0, 1))
    texts, numbers = _Texts(list(names)), np.array(rows, np.int64)
    n, m = texts.size[left], texts.size[right]
    order = np.lexsort((n, m))
    at = 0
    while at < len(order):
        most = max(1, _CELLS // int((n + m)[order[at : at + 4096]].max()))
        block = order[at : at + min(most, 4096)]
        at += len(block)
        a, b = texts.matrix(left[block]), texts.matrix(right[block])
        yield numbers[block], a, np.where(b == 0, -1, b), n[block], m[block]


def _partial(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The best ratio of the shorter string with a stretch of the longer one, of its length at most; 1 for two empty strings, 0 for one.

    Strands are combed over the grid of both strings, diagonal by diagonal: two that
    meet cross where the characters are equal, or if they haven't crossed before.
    Where the strands end tells the common subsequence with every stretch at once: a
    stretch loses a character for each strand that begins and ends within it.
    """
    out = np.array([float(x in y and bool(x or not y)) for x, y in pairs])
    for rows, a, b, n, m in _in_blocks(pairs, [k for k, (x, y) in enumerate(pairs) if x and x not in y]):
        high, wide = a.shape[1], b.shape[1]
        kind = np.int16 if high + wide < 2**15 else np.int32
        back = np.ascontiguousarray(a[:, ::-1])
        across, down = np.tile(np.arange(high, dtype=kind), (len(rows), 1)), np.tile(np.arange(high, high + wide, dtype=kind), (len(rows), 1))
        for d in range(high + wide - 1):
            low, top = max(0, d - wide + 1), min(high - 1, d)
            i, j = slice(high - 1 - top, high - low), slice(d - top, d - low + 1)
            h, v = across[:, i], down[:, j]
            swap = (back[:, i] == b[:, j]) | (h > v)
            across[:, i], down[:, j] = np.where(swap, v, h), np.where(swap, h, v)
        origin, best = down - kind(high), np.zeros(len(rows))
        # stretches from the start that are shorter than the shorter string, and those that begin at s
        place = np.arange(wide)
        sizes = place + 1
        lost = np.cumsum(origin >= 0, axis=1)
        inside = (sizes < n[:, None]) & (sizes <= m[:, None])
        best = np.where(inside, 2 * (sizes - lost) / (n[:, None] + sizes), 0.0).max(axis=1)
        for s in range(wide):
            until = np.minimum(s + n, m)
            size = until - s
            part = slice(s, min(s + high, wide))
            lost = ((origin[:, part] >= s) & (place[part] < until[:, None])).sum(axis=1)
            np.maximum(best, np.where(size > 0, 2 * (size - lost) / (n + np.maximum(size, 0)), 0.0), out=best)
        out[rows] = best
    return out


def _jaro_winkler(pairs: list[tuple[str, str]]) -> np.ndarray:
    """With a prefix of at most four letters, weighted a tenth, where the Jaro similarity is over 0.7; 1 for equal strings, 0 with an empty one."""
    out = np.array([float(x == y) for x, y in pairs])
    for rows, a, b, n, m in _in_blocks(pairs, [k for k, (x, y) in enumerate(pairs) if x and y and x != y]):
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        place, free, first = np.arange(b.shape[1]), np.ones(b.shape, bool), np.zeros(a.shape, np.int32)
        for i in range(a.shape[1]):
            part = slice(max(0, i - int(reach.max())), i + int(reach.max()) + 1)
            fits = (b[:, part] == a[:, i : i + 1]) & free[:, part] & (np.abs(place[part] - i) <= reach[:, None])
            at = fits.argmax(axis=1) if fits.shape[1] else np.zeros(len(rows), np.int64)
            hit = np.flatnonzero(fits[np.arange(len(rows)), at]) if fits.shape[1] else np.zeros(0, np.int64)
            free[hit, part.start + at[hit]] = False
            first[hit, i] = a[hit, i]
        matched = (~free).sum(axis=1)
        x = np.take_along_axis(first, np.argsort(first == 0, axis=1, kind="stable"), axis=1)
        y = np.take_along_axis(np.where(free, 0, b), np.argsort(free, axis=1, kind="stable"), axis=1)
        both = min(x.shape[1], y.shape[1])
        swapped = (x[:, :both] != y[:, :both]).sum(axis=1) // 2
        jaro = np.where(matched > 0, (matched / n + matched / m + (matched - swapped) / np.maximum(matched, 1)) / 3, 0.0)
        four = min(4, a.shape[1], b.shape[1])
        prefix = np.cumprod(a[:, :four] == b[:, :four], axis=1).sum(axis=1)
        out[rows] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


def similarities(scorer: str, left: list[str], right: list[str]) -> np.ndarray:
    """One scorer of many pairs."""
    return _all([(scorer, left, right)])[0]


def _all(wanted: list[tuple[str, list[str], list[str]]]) -> list[np.ndarray]:
    """Several scorers at once: what needs a longest common subsequence shares one run of the kernel."""
    lcs, whole = _Pairs(), {"partial": _Pairs(), "jaro_winkler": _Pairs()}
    sorted_, split = {}, {}

    def in_order(t: str) -> str:
        if t not in sorted_:
            sorted_[t] = " ".join(sorted(t.split()))
        return sorted_[t]

    def tokens(t: str) -> frozenset[str]:
        if t not in split:
            split[t] = frozenset(t.split())
        return split[t]

    plans = []
    for scorer, left, right in wanted:
        if scorer in whole:
            plans.append(_indices(whole[scorer].add(x, y) for x, y in zip(left, right, strict=True)))
        elif scorer == "token_set":
            seen: dict[tuple[str, str], tuple[int, int, int, int]] = {}
            for x, y in zip(left, right, strict=True):
                if (x, y) not in seen:
                    seen[x, y] = _token_set(tokens(x), tokens(y), lcs)
            plans.append(np.array([seen[p] for p in zip(left, right, strict=True)], np.int64).reshape(-1, 4))
        else:
            fix = in_order if scorer == "token_sort" else str
            x, y = [fix(t) for t in left], [fix(t) for t in right]
            total = np.fromiter(map(len, x), np.int64, len(x)) + np.fromiter(map(len, y), np.int64, len(y))
            plans.append(np.stack((_indices(map(lcs.add, x, y)), total), axis=1))
    common = lcs.common() if lcs.number else np.zeros(1, np.int64)
    done = {"partial": _partial(list(whole["partial"].number)), "jaro_winkler": _jaro_winkler(list(whole["jaro_winkler"].number))}
    out = []
    for (scorer, _, _), plan in zip(wanted, plans, strict=True):
        if scorer in whole:
            out.append(done[scorer][plan] if len(plan) else np.zeros(0))
        elif scorer == "token_set":
            at, joint, one, two = plan.T
            best = _over(2 * (joint + np.where(at >= 0, common[np.maximum(at, 0)], 0)), one + two, 0.0)
            alone = np.where(joint > 0, np.maximum(_over(2 * (joint - 1), joint - 1 + one, 0.0), _over(2 * (joint - 1), joint - 1 + two, 0.0)), 0.0)
            out.append(np.where(at == -2, 0.0, np.where(at == -1, 1.0, np.maximum(best, alone))))
        else:
            out.append(_over(2 * common[plan[:, 0]], plan[:, 1], 1.0) if len(plan) else np.zeros(0))
    return out


def _token_set(x: frozenset[str], y: frozenset[str], lcs: _Pairs) -> tuple[int, int, int, int]:
    """(pair of what only one side has, or -1 where all of a side is shared and -2 where a side has no token; length of the shared tokens with the blank after them; lengths of both sides)."""
    if not x or not y:
        return -2, 0, 0, 0
    both = x & y
    if both and (len(both) == len(x) or len(both) == len(y)):
        return -1, 0, 0, 0
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    joint = sum(map(len, both)) + len(both)
    return lcs.add(only_x, only_y), joint, joint + len(only_x), joint + len(only_y)


def several(wanted: dict[str, tuple[str, list[str], list[str]]]) -> dict[str, np.ndarray]:
    """Similarities of rows by name, {name: (scorer, left, right)}."""
    return dict(zip(wanted, _all(list(wanted.values())), strict=True))


SCORERS = ("ratio", "token_sort", "token_set", "partial", "jaro_winkler")


def scores(wanted: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct of similarities, {name: (scorer, left, right)}; all strings of a row cross to Python once. Nulls count as empty."""
    sides: dict[str, int] = {}
    columns: list[Column] = []
    plan = []
    for scorer, *both in wanted.values():
        for c in both:
            if str(c) not in sides:
                sides[str(c)] = len(columns)
                columns.append(F.coalesce(c, F.lit("")))
        plan.append((scorer, *(sides[str(c)] for c in both)))
    names = list(wanted)

    def compute(*series: pd.Series) -> pd.DataFrame:
        texts = [s.tolist() for s in series]
        return pd.DataFrame(several({n: (scorer, texts[i], texts[j]) for n, (scorer, i, j) in zip(names, plan, strict=True)}))

    compute.__annotations__ = {}
    return F.pandas_udf(compute, ", ".join(f"{name} double" for name in names), F.PandasUDFType.SCALAR)(*columns)
