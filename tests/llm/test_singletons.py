import math
import random
import re
import zlib
from collections import Counter

import pytest

from coalign.llm import ngram_lm as lm


def model_by_hand(texts: dict):
    """Probabilities with all bigrams, those seen once included."""
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", t.lower()), "</s>"] for k, t in texts.items()}
    learn = [w for k, w in words.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    uni, bi = Counter(x for w in learn for x in w), Counter(x for w in learn for x in zip(["<s>", *w], w))
    ends = Counter(w for _, w in bi)
    d = lm.Discounts.of([sum(c == i for c in bi.values()) for i in (1, 2, 3, 4)])
    e = lm.Discounts.of([sum(ends[w] == i for w in uni) for i in (1, 2, 3, 4)])
    off = lambda f, c: (0, f.one, f.two, f.more)[min(c, 3)]
    context, rest = Counter(), Counter()
    for (v, _), c in bi.items():
        context[v] += c
        rest[v] += off(d, c)
    spread = sum(off(e, ends[w]) for w in uni) / len(bi)

    def p(w, v):
        p1 = (ends[w] - off(e, ends[w])) / len(bi) + spread / (len(uni) + 1)
        return ((bi[v, w] - off(d, bi[v, w])) / context[v] + rest[v] / context[v] * p1) if context[v] else p1

    return words, uni, bi, p


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_scores(spark, chunk):
    rnd = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(60)]
    texts = {i: " ".join(rnd.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rnd.randint(0, 40))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(docs, rules=lm.LmRules(chunk_bytes=chunk, part_bytes=300, singletons=True)).collect()}
    words, uni, bi, p = model_by_hand(texts)
    assert 1 in bi.values()
    for k, w in words.items():
        assert got[k] == pytest.approx(sum(math.log10(p(x, v)) for v, x in zip(["<s>", *w], w)), abs=1e-9)
    for v in ("<s>", "w0é", "w59é", "never"):
        assert sum(p(w, v) for w in uni) + p("<unk>", v) == pytest.approx(1)
