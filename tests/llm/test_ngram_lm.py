import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from coalign.llm import ngram_lm as lm


def model_by_hand(texts: dict):
    """Counts and probabilities in plain Python."""
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"] for k, t in texts.items()}
    uni, bi = Counter(), Counter()
    for k, w in words.items():
        if not held[k]:
            uni.update(w)
            bi.update(zip(["<s>", *w], w))
    ends = Counter(w for _, w in bi)
    context = Counter()
    rest = defaultdict(float)
    d = lm.Discounts.of([sum(c == i for c in bi.values()) for i in (1, 2, 3, 4)])
    e = lm.Discounts.of([sum(ends[w] == i for w in uni) for i in (1, 2, 3, 4)])
    for (v, _), c in bi.items():
        context[v] += c
        rest[v] += 1 if c == 1 else d.two if c == 2 else d.more
    off = lambda f, c: 0 if c == 0 else (f.one, f.two, f.more)[min(c, 3) - 1]
    types, size = len(bi), len(uni)
    spread = sum(off(e, ends[w]) for w in uni) / types if types else 1

    def p(w, v):
        p1 = ((ends[w] - off(e, ends[w])) / types if types else 0) + spread / (size + 1)
        c = bi[v, w]
        return ((c - off(d, c)) / context[v] if c > 1 else 0) + (rest[v] / context[v] if context[v] else 1) * p1

    return held, words, uni, p


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_scores(spark, chunk):
    rnd = random.Random(4)
    vocabulary = [f"W{i}é" for i in range(60)]
    texts = {i: " ".join(rnd.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rnd.randint(0, 40))) for i in range(80)}
    texts |= {80: None, 81: "", 82: "unseen Words here\n\x0bx", 83: "a\tb " * 30}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, kind int")
    got = {r.doc_id: r for r in lm.score_documents(docs, rules=lm.LmRules(chunk_bytes=chunk, part_bytes=300)).collect()}
    held, words, uni, p = model_by_hand(texts)
    n = sum(uni.values())
    assert len(got) == len(texts)
    for k, w in words.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(x in uni for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + len(uni) + 1)) for x in w), abs=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(x, v)) for v, x in zip(["<s>", *w], w)), abs=1e-9)
    for v in ("<s>", "w0é", "w59é", "never"):
        assert sum(p(w, v) for w in uni) + p("<unk>", v) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (r,) = lm.score_documents(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    (r,) = lm.score_documents(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert (r.doc_id, r.held_out, r.n_tokens, r.n_known) == (None, False, 1, 1)


def test_planes():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64))
    assert (lm.from_planes(lm.planes(a)) == a).all()
    assert (lm.from_planes(lm.planes(a >> np.uint64(24), 5), 5) == a >> np.uint64(24)).all()
