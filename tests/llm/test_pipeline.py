"""The pipeline's stages against plain rewrites of their rules."""

import random

import pytest

import corpus_pipeline as cp
from coalign.llm import quality
from coalign.llm.common import cut
from coalign.llm.queries import tokenizer_path
from coalign.llm.word_bpe import WordBpe

from .test_packing import check_packed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9)))
    texts = [" ".join(word() for _ in range(rnd.randint(30, 200))) for _ in range(120)]
    texts += [texts[3].replace(" ", "  "), texts[4], texts[5] + " end", texts[6].upper(), "short", None, ""]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x") for i, t in enumerate(texts)] + [(7, texts[7], "en", "s3", 1, "y")]
    return cut(spark.createDataFrame(rows, SCHEMA))


def test_stages(spark, docs):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "packing"]
    good = cut(cp.quality_rules(spark, docs, ""))
    want = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    exact = cut(cp.exact_copies(spark, good, ""))
    ids = sorted(r.doc_id for r in exact.collect())
    assert ids == sorted(want - {3, 121}) and exact.columns == docs.columns  # 120 is 3 with more blanks, 121 is 4

    near = cut(cp.near_copies(spark, exact, ""))
    assert sorted(r.doc_id for r in near.collect()) == [i for i in ids if i != 122] and near.columns == docs.columns  # 122 is near 5

    mixed = cut(cp.mix(spark, near, ""))
    assert mixed.columns == docs.columns
    n_in = {r.doc_id: len(r.text.split()) for r in near.collect()}
    taken: dict = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) or r.doc_id == 7
    assert all(taken[k] <= 2 * n_in[k] for k in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(n_in.values())) < 10

    bpe = WordBpe(tokenizer_path())
    rows = cp.pack(spark, mixed, "").collect()
    assert sum(r.length for r in rows) == sum(len(bpe.whole(r.text)) + 1 for r in mixed.collect())


def test_run_and_empty_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() > 0
    nothing = cut(docs.limit(0))
    for _, stage in cp.STAGES:
        nothing_left = stage(spark, nothing, "")
        assert nothing_left.count() == 0


def test_pieces(spark):
    texts = {1: "a b c", 2: "d " * 3000}
    rows = cp.pack(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    check_packed(rows, texts, WordBpe(tokenizer_path()))


def test_columns_with_the_stages_own_names(spark, docs):
    """Extra columns come through every stage but the last as they were."""
    extra = ("__key", "__text_key", "__copy", "__taken", "__size", "size", "row", "node")
    wide = cut(docs.selectExpr("*", *(f"concat('{c} ', doc_id) AS {c}" for c in extra)))
    for name, stage in cp.STAGES[:-1]:
        wide = cut(stage(spark, wide, ""))
        assert wide.columns == [*docs.columns, *extra]
        for r in wide.collect():
            assert [r[c] for c in extra] == [f"{c} {r.doc_id}" for c in extra]
    assert cp.pack(spark, wide, "").count() > 0


def test_null_ids_and_texts_through_the_stages(spark):
    good = " ".join(f"word{i % 40} other{i}" for i in range(60))
    rows = [(None, good, "en", "s", 1, "x"), (None, good, "en", "s", 1, "x"), (4, good, "en", None, 1, "x"), (4, good, "en", None, 1, "x"), (5, None, None, None, None, None), (None, None, None, None, None, None)]
    docs = cut(spark.createDataFrame(rows, SCHEMA))
    kept = cut(cp.quality_rules(spark, docs, ""))
    assert kept.count() == 4
    exact = cut(cp.exact_copies(spark, kept, ""))
    assert [r.doc_id for r in exact.collect()] == [4]
    assert cp.near_copies(spark, docs, "").count() == 4  # both rows of 4, and the texts without words
    assert {r.doc_id for r in cp.mix(spark, exact, "").collect()} == {4}
