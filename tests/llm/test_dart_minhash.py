import random

import numpy as np
from pyspark.sql import functions as F

from coalign.llm import dart_minhash as dm
from coalign.sources import scratch


def test_collisions_follow_weighted_jaccard():
    rnd = np.random.Generator(np.random.PCG64(3))
    k, n = 64, 300
    for overlap in (0.2, 0.5, 0.9):
        hits, truth = 0, 0.0
        for t in range(20):
            a = rnd.integers(1, 2**63, n, dtype=np.uint64)
            b = np.where(rnd.random(n) < overlap, a, rnd.integers(1, 2**63, n, dtype=np.uint64))
            wa, wb = rnd.integers(1, 4, n), rnd.integers(1, 4, n)
            same = a == b
            truth += np.minimum(wa, wb)[same].sum() / (np.maximum(wa, wb)[same].sum() + wa[~same].sum() + wb[~same].sum())
            s = dm.signatures(np.concatenate((a, b)), np.concatenate((wa, wb)), np.repeat([0, 1], n), 3, k)
            assert not s[2].any() and s[:2].all()
            hits += (s[0] == s[1]).sum()
        assert abs(hits / (20 * k) - truth / 20) < 0.05


def corpus(seed: int) -> dict:
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts: dict = {}
    for base in range(12):
        text = rnd.choices(words, k=rnd.choice([3, 30, 200, 600]))
        for _ in range(rnd.randint(1, 12)):
            copy = [rnd.choice(words) if rnd.random() < rnd.choice([0, 0.004, 0.02, 0.05]) else w for w in text]
            texts[len(texts)] = rnd.choice([" ", "\n"]).join(copy)
    texts[len(texts)] = None
    texts[len(texts)] = " \n"
    texts[len(texts)] = "again " * 50
    texts[len(texts)] = "again " * 60
    texts[len(texts)] = "one"
    return texts


def test_classes(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, node int")
        got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in dm.near_duplicates(docs).collect()}
        want = dm.brute_force(texts)
        sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
        assert got == {k: (c, sizes[c], k == c) for k, c in want.items()}


def test_chain_is_followed(spark):
    """Each text is like the next one only, so leaders alone would not connect them."""
    words = [f"v{i}" for i in range(200)]
    texts = {}
    for i in range(12):
        texts[i] = " ".join(words)
        words[(i * 16) % 200 : (i * 16) % 200 + 12] = [f"n{i}_{j}" for j in range(12)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dm.near_duplicates(docs).collect()} == dm.brute_force(texts)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert dm.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (3, "other words here"), (None, "x y"), (None, "x y")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in dm.near_duplicates(docs).collect())
    assert got == sorted([("None", "3", 4, False)] * 2 + [("3", "3", 4, True)] * 2 + [("3", "3", 1, True)] + [("None", "None", 2, True)] * 2)


def group_at_the_limit(n: int, seed: int = 8) -> dict:
    """Copies of one text with words replaced, so that most pairs are a little below the limit or above it."""
    rnd = random.Random(seed)
    base = [f"g{i}" for i in range(146)]
    return {i: " ".join(f"r{rnd.randint(0, 10**6)}" if rnd.random() < 0.018 else w for w in base) for i in range(n)}


def similar_pairs(texts: dict, p: dm.NearDuplicates) -> np.ndarray:
    """All pairs at once, as a product of the matrix of shingles by itself."""
    ids: dict = {}
    rows = [{ids.setdefault((tuple(w[i : i + p.shingle])), len(ids)) for i in range(len(w) - p.shingle + 1)} for w in (t.split() for t in texts.values())]
    m = np.zeros((len(rows), len(ids)), np.float32)
    for i, r in enumerate(rows):
        m[i, list(r)] = 1
    both, size = m @ m.T, m.sum(1)
    return both / (size[:, None] + size[None, :] - both) >= p.similarity - 1e-6


def test_large_group_at_the_limit(spark):
    """2,700 near copies that no leader connects: of all linked pairs at least 0.99 share a class, and no others are joined."""
    p = dm.NearDuplicates(block_nodes=256)
    texts = group_at_the_limit(2700)
    linked = similar_pairs(texts, p)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dm.near_duplicates(docs, p=p).collect()}
    label = np.array([got[i] for i in range(len(texts))])
    a, b = np.nonzero(np.triu(linked, 1))
    assert len(a) > 100_000 and (label[a] == label[b]).mean() >= 0.99
    whole = np.arange(len(texts))
    while True:  # the components of all pairs
        least = np.array([whole[linked[i]].min() for i in range(len(texts))])
        if (least == whole).all():
            break
        whole = least
    assert (label >= whole).all() and (label == whole).mean() > 0.98


def test_rows_stay_in_proportion(spark):
    """What the search is given grows with the nodes, not with their pairs: one straggler costs a row for each node of the core."""
    n = 3000
    named = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("band"), F.lit(30).alias("size"), F.col("id").alias("node"), F.when(F.col("id") < n - 1, 0).otherwise(F.col("id")).alias("class"))
    p = dm.NearDuplicates(block_nodes=100)
    texts = spark.range(n).select(F.col("id").alias("node"), F.lit(800).cast("long").alias("weight"), F.unhex(F.lit("00" * p.coordinates)).alias("signature"))
    sets = spark.range(n).select(F.col("id").alias("node"), F.unhex(F.lit("01020304")).alias("cells"))
    assert dm.search_rows(named, texts, sets, p).count() == n - 1 + 31  # with itself and with 30 blocks of the core


def test_long_texts_ties_and_clashing_names(spark):
    rnd = random.Random(6)
    long = [f"w{rnd.randint(0, 50_000)}" for _ in range(60_000)]
    near = [f"x{i}" if i % 400 == 0 else w for i, w in enumerate(long)]
    same = " ".join(f"t{i}" for i in range(50))
    texts = {1: " ".join(near), 2: " ".join(long), 3: "w1 w2", 4: same, 5: same, 6: same + " ", 7: "x" * 200_000}
    columns = ("node", "key", "class", "bucket", "signature", "text_key", "class_id")
    docs = spark.createDataFrame([(k, t, *range(len(columns))) for k, t in texts.items()], "doc_id long, text string, " + ", ".join(f"{c} int" for c in columns))
    got = {r.doc_id: r.class_id for r in dm.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7}


def test_stage_tables_have_few_files(spark, monkeypatch, tmp_path):
    """However many partitions the rows of a shuffle are dealt to."""
    rows = spark.createDataFrame([(k, t) for k, t in corpus(5).items()], "doc_id long, text string")
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    files, real = [], scratch.cut
    for module in (scratch, dm):
        for name in ("cut", "cut_as_dealt"):
            if getattr(module, name, None) is real:
                monkeypatch.setattr(module, name, lambda df, *by: counted(real(df, *by)))

    def counted(table):
        files.append(len(table.inputFiles()))
        return table

    try:
        for c, v in zip(before, ("100", "false")):
            spark.conf.set(c, v)
        want = dm.near_duplicates(rows).count()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert want == rows.count() and len(files) > 10
    assert max(files) <= 4 * spark.sparkContext.defaultParallelism < 100
