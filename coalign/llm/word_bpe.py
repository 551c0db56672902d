"""Token ids of a public byte-pair tokenizer with word ends, fast on whole chunks.

The tokenizer lower-cases, drops white space and never lets a token cross it, so the
ids of a text are those of its blank-separated words, one after another. Each
distinct word of a chunk is tokenized once: by a merge engine for words of ASCII and
Latin-1 letters, whose byte-with-word-end symbols are given byte values that such
words never use, and by the tokenizer itself for any other word.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .common import word_bounds, word_hashes

#: Fixed: the tokenizer's pre-tokenization pattern, for lower-case ASCII and Latin-1 text.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SAFE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
END = "</w>"


def _visible_bytes() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    MOST_CACHED = 150_000

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self._whole, self._cache = path, None, {}
        model = json.load(open(path))["model"]
        byte_of = _visible_bytes()
        lasts = [*map(ord, "abcdefghijklmnopqrstuvwxyz0123456789"), *(b for b in range(33, 127) if not chr(b).isalnum()), *range(0x9F, 0xC0)]
        used = {*range(33, 127), 0xC3, *range(0x80, 0xC0)} - set(range(ord("A"), ord("Z") + 1))
        free = iter(b for b in range(256) if b not in used and b not in (9, 10, 11, 12, 13, 32))
        self.end_of = {b: next(free) for b in lasts}
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            ended = token.endswith(END)
            data = [byte_of[c] for c in (token[: -len(END)] if ended else token)]
            if ended and data and data[-1] in self.end_of:
                data[-1] = self.end_of[data[-1]]
            elif ended or any(b not in used for b in data):
                continue
            ranks[bytes(data)] = i
        for b in range(256):
            ranks.setdefault(bytes([b]), 1_000_000 + b)
        self._encode = tiktoken.Encoding("word_bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def whole(self, text: str) -> list[int]:
        """Ids of any text by the tokenizer itself."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole.encode(text, add_special_tokens=False).ids

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word without white space."""
        text = raw.decode("utf-8")
        if not _SAFE.fullmatch(text) or "<|" in text:
            return self.whole(text)
        ids: list[int] = []
        for piece in _PIECES.findall(text.lower()):
            data = bytearray(piece.encode("utf-8"))
            data[-1] = self.end_of[data[-1]]
            ids += self._encode(bytes(data))
        return ids

    def documents(self, raw: np.ndarray, offsets: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a chunk, offsets with a last one); ``after`` follows each document."""
        starts, ends, first = word_bounds(raw, offsets)
        hashes, at, which = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        data = raw.tobytes()
        found: list[list[int]] = []
        if len(self._cache) > self.MOST_CACHED:
            self._cache.clear()
        cache = self._cache
        for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
            word = data[s:e]
            ids = cache.get(word)
            if ids is None:
                ids = cache[word] = self.word(word)
            found.append(ids)
        found.append([after])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        order = np.insert(which, first[1:], len(hashes))
        n = sizes[order]
        to = np.cumsum(n)
        ids = flat[np.repeat(begin[order] - (to - n), n) + np.arange(int(n.sum()))]
        last = first[1:] + np.arange(len(first) - 1)
        return ids, np.concatenate(([0], to[last])) if len(last) else np.zeros(1, np.int64)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One tokenizer in each worker."""
    return WordBpe(path)
