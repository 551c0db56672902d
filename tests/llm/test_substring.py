import hashlib
import random

import numpy as np
import pytest

from coalign.llm import suffix_array_dedup as sa
from coalign.llm import suffix_tree_dedup as st


def corpus(seed: int, n: int = 60) -> dict:
    """Documents that share passages of many lengths; copies, runs, empty and null texts, other white space."""
    rnd = random.Random(seed)
    words = [rnd.choice("abcdeé") * rnd.randint(1, 4) + rnd.choice(["", "x", "ß", "日"]) for _ in range(40)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(8, 60))) for _ in range(12)]
    texts = {}
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=rnd.randint(0, 50))))
            parts.append(rnd.choice([" ", "\n", "\t ", "\x0b"]))
        texts[i] = "".join(parts)
    texts[n], texts[n + 1], texts[n + 2] = None, "", "a " * 400
    texts[n + 3] = "a " * 300
    texts[n + 4], texts[n + 5] = texts[3], "aaaa" * 100 + "\x00\x00b"
    return texts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk", [1 << 20, 3000])
def test_words(spark, seed, chunk):
    texts = corpus(seed)
    docs = spark.createDataFrame([(k, t, "other") for k, t in texts.items()], "doc_id long, text string, chunk string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in st.drop_repeated_words(docs, chunk_bytes=chunk, part_bytes=2000, tree_limit=20).collect()}
    assert got == st.brute_force(texts)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("chunk", [1 << 20, 3000])
def test_bytes(spark, seed, chunk):
    texts = corpus(seed)
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    rows = sa.drop_repeated_bytes(docs, chunk_bytes=chunk, part_bytes=2000).collect()
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert got == sa.brute_force(texts)
    for r in rows:
        left = (texts[r.doc_id] or "").encode()
        for s in reversed(r.spans):
            left = left[: s.start] + left[s.stop :]
        assert left == bytes(r.kept)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_anchors(spark, monkeypatch, hot):
    """Anchors that are split by what stands around them, and a corpus with too many heavy prefixes to tell apart."""
    from coalign.llm import anchored

    monkeypatch.setattr(anchored, "HOT", hot)
    monkeypatch.setattr(st, "MOST_HEAVY", 0 if hot else 2000)
    rnd = random.Random(hot)
    phrase = "the one phrase of all "
    texts = corpus(7) | {1000 + i: " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 9))) + " " + phrase * rnd.randint(1, 2) + " ".join(rnd.choices(["a", "bb", "ccc"], k=rnd.randint(0, 12))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in st.drop_repeated_words(docs, chunk_bytes=3000, part_bytes=2000, tree_limit=20).collect()}
    assert got == st.brute_force(texts)
    rows = sa.drop_repeated_bytes(docs, chunk_bytes=3000, part_bytes=2000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows} == sa.brute_force(texts)


def test_hot_anchor_spreads():
    """One anchor in many contexts goes to many parts, and equal windows still meet."""
    from coalign.llm import anchored

    scheme, parts, n = anchored.Scheme("byte", 50, 20, 1, 1), 50, 2000
    rnd = random.Random(1)
    body = [bytes(rnd.choices(range(97, 123), k=40)) + b"~" * 5 + b"AN ANCHOR OF 20 BYTES" + b"~" * 5 + bytes(rnd.choices(range(97, 123), k=40)) for _ in range(n)]
    raw, offsets = np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)])
    found = anchored.anchors(scheme, raw, offsets)
    short, _, times = anchored._distinct(anchored._short(found.key, parts), found.doc)
    bits = {p: anchored._zip(np.packbits(times[s:e] > 100), np.flatnonzero(times[s:e] > 100).astype(np.uint32)) for p, s, e in anchored._slices(short)}
    c = anchored.candidates(scheme, raw, offsets, np.arange(n), bits, parts, None)
    assert len(c.which) > 0.8 * n and np.bincount(c.part, minlength=parts).max() < 4 * len(c.part) / parts


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert st.drop_repeated_words(empty).count() == 0
    assert sa.drop_repeated_bytes(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    twice = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in st.drop_repeated_words(twice).collect()) == [(False, 0), (False, 0), (True, 30)]
    assert sorted((r.doc_id is None, len(r.kept)) for r in sa.drop_repeated_bytes(twice).collect()) == [(False, len(text)), (False, len(text)), (True, 0)]


def test_merge_runs():
    rnd = random.Random(5)
    runs = [sorted(bytes(rnd.choices(b"ab", k=rnd.randint(0, 6))) for _ in range(rnd.randint(0, 30))) for _ in range(7)]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    same = [[0, *(common(a, b) for a, b in zip(r, r[1:]))] if r else [] for r in runs]
    order, shared = sa.merge_runs(runs, same)
    merged = [runs[r][i] for r, i in order]
    assert merged == sorted(x for r in runs for x in r)
    assert shared == [0, *(common(a, b) for a, b in zip(merged, merged[1:]))]
