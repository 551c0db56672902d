import random
import re
from collections import Counter

import numpy as np
import pytest

from coalign.llm import quality as q


def repeats_by_hand(words, n=5):
    counts = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    covered = set()
    for i in range(len(words) - n + 1):
        if counts[tuple(words[i : i + n])] > 1:
            covered.update(range(i, i + n))
    return len(covered)


def test_base_metrics():
    rnd = random.Random(1)
    for _ in range(200):
        words = rnd.choices(["a", "bé", "c,", "#x|"], k=rnd.randint(0, 30))
        text = "".join(w + rnd.choice([" ", "\n", "\t", "\x0b", "\n\n"]) for w in words)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dups = sum(x in lines[:i] for i, x in enumerate(lines))
        assert q.base_metrics(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, repeats_by_hand(words))


def test_repeats_in_long_texts():
    words = [f"w{i}" for i in range(60_000)]
    assert q.repeated_words(words) == 0
    assert q.repeated_words(words + words[100:110]) == 20


def test_distance():
    a = np.array([1.0, 2.0, 0.0])
    assert q.js_distance(a, 3 * a) == pytest.approx(0, abs=1e-9)
    assert q.js_distance(np.array([1.0, 0.0]), np.array([0.0, 2.0])) == pytest.approx(1)


def corpus(n=300):
    rnd = random.Random(7)
    common = ["the", "of", "and", "to", "in"]
    make = lambda k: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(k)) + "."
    good = {i: make(rnd.randint(60, 300)) for i in range(n)}
    bad = {n: make(200).upper().replace(" ", "!! "), n + 1: "### ".join(make(100).split()), n + 2: " | ".join("".join(rnd.choices("qrstuvwxyz", k=8)) for _ in range(200)), n + 3: "few words", n + 4: "same line again and\n" * 30, n + 5: None, n + 6: ""}
    return good, bad


def test_verdicts_and_filter(spark):
    good, bad = corpus()
    rows = [(k, t, "en", 1) for k, t in (good | bad).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    rules = q.QualityRules(min_reference_words=1000)
    got = {r.doc_id: r for r in q.quality_rules(docs, rules=rules).collect()}
    assert {k for k, r in got.items() if r.kept} == set(good)
    assert got[303].base_failed and got[304].base_failed and got[305].base_failed and not got[300].base_failed
    kept = q.keep_good(docs, rules=rules)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(good)
    # a language of its own that has too few words goes by the whole corpus
    other = docs.unionByName(spark.createDataFrame([(900, good[0], None, 1), (901, good[1], "xx", 1)], docs.schema))
    assert {r.doc_id for r in q.keep_good(other, rules=rules).collect()} == {*good, 900, 901}
    assert q.quality_rules(docs.limit(0)).count() == 0


def test_references_are_whole_counts(spark):
    good, _ = corpus(50)
    docs = spark.createDataFrame([(k, t, "en") for k, t in good.items()], "doc_id long, text string, lang string").repartition(5)
    ref = q.references(docs)["en"]
    words = Counter(w for t in good.values() for w in re.findall(r"[^\s.]+", t.lower()))
    total = sum(len(t.split()) for t in good.values())
    assert ref.total == total
    assert set(ref.at) == {w for w, n in words.items() if n >= 0.002 * total}
    assert all(ref.words[i] == words[w] for w, i in ref.at.items())
    assert ref.classes.sum() == sum(map(len, good.values()))


def test_common_words_of_many_parts(spark):
    """Parts of a few words, languages of a few words in every part, and a word that is frequent in one part only."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)], k=60)) for _ in range(200)]
    rows = [(i, t + (" burst" * 40 if i == 7 else ""), rnd.choice(["en", "en", "en", "fr", "xx"])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    for rules in (q.QualityRules(part_words=100, least_part_words=10, share=0.01), q.QualityRules(part_words=100, least_part_words=90, share=0.01), q.QualityRules(share=0.01)):
        found = q.references(docs, rules=rules)
        assert set(found) == {"en", "fr", "xx"}
        for lang, ref in found.items():
            words = Counter(w for _, t, x in rows if x == lang for w in t.split())
            total = sum(words.values())
            assert ref.total == total and set(ref.at) == {w for w, n in words.items() if n >= 0.01 * total}
            assert all(ref.words[i] == words[w] for w, i in ref.at.items()) and ref.words.sum() == total


def class_by_hand(c):
    tests = [str.isspace, str.islower, str.isupper, str.isalpha, str.isdigit]
    for i, t in zip((4, 0, 1, 2, 3), tests):
        if t(c):
            return i
    return next((i for i, s in ((5, ".,;:!?"), (6, "\"'()[]{}-–—«»“”‘’„…¿¡"), (7, "#*$%&|<>@+=/\\^~_`")) if c in s), 8)


def test_distances_and_verdicts_by_hand(spark):
    import math

    good, bad = corpus(120)
    rnd = random.Random(9)
    half = {500 + i: " ".join(w.upper() if rnd.random() < i / 20 else w for w in good[i].split()) for i in range(20)}
    texts = good | {k + 1000: t for k, t in bad.items()} | half
    lang = {k: "fr" if k % 3 == 0 else "en" for k in texts}
    docs = spark.createDataFrame([(k, t, lang[k]) for k, t in texts.items()], "doc_id long, text string, lang string")
    rules = q.QualityRules(share=0.01)

    def distance(p, q_):
        p, q_ = ([x / sum(v) for x in v] for v in (p, q_))
        m = [(x + y) / 2 for x, y in zip(p, q_)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        return math.sqrt(max((kl(p) + kl(q_)) / 2, 0))

    tokens = lambda t: re.findall(r"[^\s.,;:!?()\"'«»]+", t.lower())
    verdicts = set()
    for r in q.quality_rules(docs, rules=rules).collect():
        same = [t or "" for k, t in texts.items() if lang[k] == lang[r.doc_id]]
        text = texts[r.doc_id] or ""
        classes = [sum(class_by_hand(c) == i for t in same for c in t) for i in range(9)]
        ours = [sum(class_by_hand(c) == i for c in text) for i in range(9)]
        counts = Counter(w for t in same for w in tokens(t))
        total = sum(counts.values())
        common = sorted(w for w, n in counts.items() if n >= 0.01 * total)
        words = Counter(w if w in common else None for w in tokens(text))
        far_c = distance(ours, classes) if len(text) >= 200 else None
        far_w = distance([words[w] for w in [*common, None]], [*(counts[w] for w in common), total - sum(counts[w] for w in common)]) if sum(words.values()) >= 50 else None
        assert r.class_distance == (None if far_c is None else pytest.approx(far_c, abs=1e-9)) and r.word_distance == (None if far_w is None else pytest.approx(far_w, abs=1e-9))
        room = lambda k, n, m: 0.25 * k * (1 / n + 1 / m) / (2 * math.log(2))
        diverges = (far_c is not None and far_c**2 > 0.28**2 + room(8, len(text), sum(classes))) or (far_w is not None and far_w**2 > 0.4**2 + room(len(common), sum(words.values()), total))
        assert r.kept == (not r.base_failed and not diverges)
        verdicts.add((r.base_failed, diverges, r.kept))
    assert len(verdicts) >= 3
