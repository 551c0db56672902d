import time
from types import SimpleNamespace

import pytest

from coalign.operators import model, records
from coalign.sources import files, scratch


def test_tsv_round_trip(spark, tmp_path):
    text = 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted, name\t\tUS\nS1-2\t\t12 Main\tFR\n'
    (tmp_path / "train_source1.tsv").write_text(text)
    rows = files.load_source(spark, str(tmp_path), "train", 1)
    assert [tuple(r) for r in rows.orderBy("entity_id").collect()] == [("S1-1", 'A "quoted, name', "", "US"), ("S1-2", "", "12 Main", "FR")]
    files.write_tsv(rows, str(tmp_path / "out"), 1)
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == text


def test_tables_json_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, country string")
    files.save_table(df, str(tmp_path / "t"), "country")
    assert [r.id for r in files.load_table(spark, str(tmp_path / "t"), ["id"], "country = 'b'").collect()] == [2]
    assert sorted(files.columns_of(spark, str(tmp_path / "t"))) == ["country", "id"]
    files.save_json(spark, {"é": [1]}, str(tmp_path / "j"))
    assert files.load_json(spark, str(tmp_path / "j")) == {"é": [1]}
    files.write_report(df, str(tmp_path / "report"))
    (report,) = (tmp_path / "report").glob("part-*")
    assert sorted(report.read_text().split()) == ["1,a", "2,b", "id,country"]
    for _ in range(2):
        files.append_experiment(spark, str(tmp_path / "log"), "run", "", {"x": 1})
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    assert files.package(str(tmp_path), str(tmp_path / "p.zip"), (".md",)) == ["a.md"]


def test_extra_columns_of_wanted_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x")], "a int, b int, c string").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7), (9, 9, 0.9)], "a int, b int, f double").write.parquet(str(tmp_path / "extra"))
    got = files.load_with_extra(spark, str(tmp_path / "t"), str(tmp_path / "extra"), ["a", "b"], "a = 1")
    assert sorted(map(tuple, got.select("a", "b", "c", "f").collect())) == [(1, 1, "x", 0.5), (1, 2, "y", None)]


def test_models_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 7 > 3)) for i in range(100)], "a int, x double, y double")
    fitted = model.fit(rows, ["x"], model.boosted(maxIter=2, maxDepth=2))
    files.save_model(fitted, str(tmp_path / "m"))
    again = files.load_model(str(tmp_path / "m"))
    shown = lambda m: {r.a: r.p_raw for r in model.predict(m, rows).collect()}
    assert shown(again) == shown(fitted)


def test_prepared_registers(spark):
    raw = lambda rows: spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    sources = {1: raw([("S1-1", "Acme Ltd", "12 Main Street", "IN")]), 2: raw([("S2-1", "शर्मा Foods", None, "IN")]), 3: raw([("S3-1", None, "5 Bengalooru", "IN")])}
    maps = {"transliterated": spark.createDataFrame([("shrma", "sharma")], "token string, target string"), "aliases": spark.createDataFrame([("IN", "5 bengalooru", "5 bengaluru")], "country string, component string, canonical string")}
    a, b = records.prepare(sources, **maps)
    assert [(r.src, r.core, r.addr) for r in a.collect()] == [(1, "acme", "12 main st")]
    assert sorted((r.src, r.core, r.addr) for r in b.collect()) == [(2, "sharma foods", ""), (3, "", "5 bengaluru")]


def test_parts_are_written_in_turn(spark):
    there = []

    def parts():
        for i in range(3):
            yield spark.range(i, i + 1)
            there.append(i)

    rows = scratch.cut_in_turn(parts())
    assert there == [0, 1, 2] and sorted(r.id for r in rows.collect()) == [0, 1, 2]
    scratch.drop(rows)


@pytest.mark.parametrize(("total", "times"), [(400, 0), (600, 1)])
def test_a_large_heap_is_collected(monkeypatch, total, times):
    monkeypatch.setattr(scratch, "_trim", lambda spark: None)
    found = []
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 1000)), System=SimpleNamespace(gc=lambda: found.append(1)))
    scratch._let_go(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))))
    assert len(found) == times


def test_freed_memory_is_given_back(spark):
    scratch._trim(spark)  # no error: the command is there and can be reached


def test_memory_is_given_back_while_a_learner_works(spark, monkeypatch):
    looks = []
    monkeypatch.setattr(scratch, "PAUSE", 0.02)
    monkeypatch.setattr(scratch, "_let_go", lambda spark: looks.append(1) or True)
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 7 > 3)) for i in range(100)], "a int, x double, y double")
    model.fit(rows, ["x"], model.boosted(maxIter=2, maxDepth=2))
    assert len(looks) > 2
    time.sleep(0.3)
    n = len(looks)
    time.sleep(0.3)
    assert len(looks) == n  # and not afterwards


def test_learners_have_few_parts(spark, monkeypatch):
    monkeypatch.setattr(model, "PARTS", 2)
    n, fitted = 2 * spark.sparkContext.defaultParallelism, []
    monkeypatch.setattr(model.Pipeline, "fit", lambda self, rows: fitted.append(rows))
    rows = spark.range(0, 1000, 1, 5 * n).selectExpr("id AS a", "double(id) AS x", "double(id % 2) AS y")
    model.fit(rows, ["x"])
    assert fitted[0].rdd.getNumPartitions() == n and fitted[0].count() == 1000
