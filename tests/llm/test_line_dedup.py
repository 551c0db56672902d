import random

import pytest

from coalign.llm import line_dedup as ld


def corpus(seed: int) -> dict:
    rnd = random.Random(seed)
    words = [f"w{i}é"[: rnd.randint(2, 5)] for i in range(30)]
    lines = [rnd.choices(words, k=rnd.randint(0, 16)) for _ in range(40)]
    texts: dict = {}
    for i in range(40):
        own = []
        for _ in range(rnd.randint(0, 8)):
            line = list(rnd.choice(lines))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randint(0, len(line))
                line[at : at + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(words)]])
            own.append(rnd.choice([" ", "\t", "  "]).join(line))
        texts[i] = rnd.choice(["", "\n"]) + "\n".join(own)
    texts[40], texts[41] = None, "a " * 30 + "\n" + "a " * 29 + "\n\n \nx"
    return texts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk", [1 << 20, 900])
def test_lines(spark, seed, chunk):
    texts = corpus(seed)
    rules = ld.LineRules(least_words=3, near_words=5, chunk_bytes=chunk, part_bytes=700)
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, part int")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in ld.drop_repeated_lines(docs, rules=rules).collect()}
    assert got == ld.brute_force(texts, rules)


def test_empty_null_ids_and_repeated_rows(spark):
    assert ld.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "one two three four five six\nx"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed, r.kept) for r in ld.drop_repeated_lines(docs).collect())
    assert got == [(False, 0, text), (False, 0, text), (True, 1, "x")]


def test_near():
    assert ld.near("a b c".split(), "a c".split()) and ld.near("a b".split(), "a b".split()) and ld.near(["a"], [])
    assert not ld.near("a b c".split(), "b c d".split())
