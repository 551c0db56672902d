from coalign.llm import suffix_tree_dedup as st
from coalign.sources import scratch


def test_heaps_of_executors_are_collected_between_steps(spark, monkeypatch):
    """Before the first step and after each of the three whose rows are chunks or runs; here the driver's JVM is the only executor."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(scratch, "_let_go", lambda spark: True)
    monkeypatch.setattr(scratch, "_executors", lambda spark: 1, raising=False)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    before = full()
    assert [(r.doc_id, r.kept) for r in st.drop_repeated_words(docs).orderBy("doc_id").collect()] == [(1, "a b c d e f g h i j k l m"), (2, "n")]
    assert full() - before >= 4
