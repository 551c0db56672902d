import random

from coalign.llm import quality as q


def test_a_small_language_is_its_own_reference(spark):
    rnd = random.Random(3)
    make = lambda letters: " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 6))) for _ in range(150))
    large = [(i, make("abcdefghijklmnop"), "en") for i in range(100)]
    small = [(1000 + i, make("天地人山水火木金土日月星"), "zh") for i in range(5)]
    docs = spark.createDataFrame(large + small, "doc_id long, text string, lang string")
    assert {r.doc_id for r in q.keep_good(docs).collect()} == {r[0] for r in large + small}
    assert all(r.kept for r in q.quality_rules(docs).collect())


def test_no_reference_does_not_reject():
    assert q.verdict("word " * 100, None) == (None, None, False)
