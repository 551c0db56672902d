import random
import zlib

import numpy as np
import pytest

from coalign.llm import packing
from coalign.llm.queries import tokenizer_path
from coalign.llm.word_bpe import WordBpe


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(tokenizer_path())


def test_tokens_are_the_tokenizers(bpe):
    texts = ["l'été n'est-ce pas DON'T it's I'LL 'd've", "œuvre naïve 東京 ½ ² µm <|endoftext|> x<|startoftext|>y  Ⅷ 12345", "éa\xa0b　c \x85ﬁ İ Σς ΟΔΟΣ", "", " \n", "A" * 500 + "!!??...|||", "\x00\x01 ok"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, at = bpe.documents(raw, offsets, 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*bpe.whole(t), 1]


def check_packed(rows, texts, bpe, capacity=2048):
    """All the rules of packed pieces; the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, text in texts.items():
        ids = np.array([*bpe.whole(text or ""), 1], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and 0 < r.length <= capacity and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return 1 - sum(r.length for r in rows) / (capacity * len(by_sequence))


def test_pack(spark, bpe):
    rnd = random.Random(1)
    texts = {i: " ".join(rnd.choices(["alpha", "Beta,", "x", "12", "é"], k=int(rnd.paretovariate(1.1) * 30) % 6000)) for i in range(700)} | {1000: None, 1001: "", 1002: " "}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, offset int")
    assert check_packed(packing.pack_documents(docs, tokenizer_path()).collect(), texts, bpe) < 0.1
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert len(rows) == 4 and sorted(r.offset for r in rows) == sorted({r.offset for r in rows})


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    rnd = random.Random(3)
    fill = {}
    for _ in range(500):
        size = rnd.randint(1, 10)
        before = p.levels.copy()
        window, offset = p.place(size)
        assert fill.get(window, 0) == offset
        fill[window] = offset + size
        score = int((p.levels[1:10] ** 2).sum())
        options = []
        for h in [0, *np.flatnonzero(before[1:10]) + 1]:
            if h + size <= 10:
                n = before.copy()
                n[h] -= h > 0
                n[h + size] += h + size < 10
                options.append(int((n[1:10] ** 2).sum()))
        assert score == min(options)
    with pytest.raises(ValueError):
        p.place(11)
