import hashlib

from coalign.llm import queries


def test_short_lines_that_repeat_go(spark, tmp_path):
    texts = {1: "one two\n你好世界你好世界\nx", 2: "other\none two\n你好世界你好世界", 3: "x\n\n \none  two\nlast"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (3, 0, digest(texts[1])), 2: (3, 2, digest("other")), 3: (3, 2, digest("\n \nlast"))}
