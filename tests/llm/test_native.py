import hashlib
import re
from collections import Counter

import pytest

from coalign.llm import exact_dedup, mixing


def test_exact_dedup(spark):
    texts = {3: "a b", 1: "ab", 2: "a  b", 9: "a\n\tb", 4: None, 5: "", 6: " ", 7: "x", 8: "y" * 5000, 10: "y " * 5000}
    texts |= {100 + i: "hot  text" for i in range(1500)} | {2000: "hot text "}
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in texts.items()], "doc_id long, text string, word string, row int")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    norm = {k: re.sub(r"[\x20\x09-\x0D]", "", t or "") for k, t in texts.items()}
    sizes = Counter(norm.values())
    for k, t in texts.items():
        same = [j for j in texts if norm[j] == norm[k]]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        r = got[k]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, sizes[norm[k]], keep == k, hashlib.sha256(norm[k].encode()).hexdigest())
    assert len(got) == len(texts)


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2
    assert {(r.text_sha256[:4], r.keep_id) for r in rows if r.text_sha256 == hashlib.sha256(b"a").hexdigest()} == {(hashlib.sha256(b"a").hexdigest()[:4], 1)}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def targets_by_hand(sizes: dict, weights=(3, 1, 2), share=1.5, most=2) -> dict:
    """Shares the whole again and again until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            return capped
        room = left - sum(capped.values())
        total = sum(w[s] for s in rest)
        over = [s for s in rest if room * w[s] / total >= most * sizes[s]]
        if not over:
            return capped | {s: room * w[s] / total for s in rest}
        capped |= {s: float(most * sizes[s]) for s in over}


def test_mixing(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), "big") for i in range(300)] + [(1000 + i, "a b\tc", rnd.choice(["s1", "s2", "é", None])) for i in range(100)] + [(2000, None, "none"), (2001, "", "none")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.taken) for r in got} == again and len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i, n in words.items():
        sizes[source[i]] += n
    want, taken = targets_by_hand(sizes), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b", "x"), (None, "a b", "x"), (1, "a b c", "x"), (1, "a b c", None)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 4 and sum(r.taken for r in rows) == 14  # the targets 11.25 and 3.75, each rounded down
