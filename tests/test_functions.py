import random

import pytest
from pyspark.sql import functions as F

from coalign.functions import fuzzy, names
from coalign.functions.addresses import normalize_addresses
from coalign.functions.fold import fold, fold_value
from coalign.operators import features
from coalign.operators.records import explode_truth

NAMES = [
    ("M/s. Sharma & Sons Pvt. Ltd.", "sharma and sons private limited", "sharma sons", "", "limited private", "sharmasons"),
    ("Golden Temple Foods LLC dba Golden Foods", "golden temple foods llc", "golden temple foods", "golden foods", "llc", "goldentemplefoods"),
    ("3rd Wave C0ffee, Inc.", "3rd wave coffee incorporated", "3rd wave coffee", "", "incorporated", "3rdwavecoffee"),
    ("www.acme-tools.com", "acme tools", "acme tools", "", "", "acmetools"),
    ("E.U.R.L. Dupont", "sarl dupont", "dupont", "", "sarl", "dupont"),
    (None, "", "", "", "", ""),
    ("", "", "", "", "", ""),
]


def test_names(spark):
    rows = spark.createDataFrame([(i, n) for i, (n, *_) in enumerate(NAMES)], "id int, business_name string")
    got = {r.id: r for r in names.normalize_names(rows).collect()}
    for i, (_, tok, core, alt, legal, compact) in enumerate(NAMES):
        r = got[i]
        assert (" ".join(r.name_tok), " ".join(r.core_tok), " ".join(r.alt_tok), r.legal, r.compact) == (tok, core, alt, legal, compact)
        assert (r.name_norm, r.core, r.native) == (tok, core, False)


def test_addresses(spark):
    rows = spark.createDataFrame([(0, "Plot No. 12-14, MG Road, Near SBI ATM, Bengaluru 560001"), (1, "<NULL>"), (2, None)], "id int, business_address string")
    got = {r.id: r for r in normalize_addresses(rows).collect()}
    assert got[0].addr_comp == ["12 14", "mg rd", "nr sbi atm", "bengaluru 560001"] and got[0].addr_num == ["12", "14", "560001"] and not got[0].addr_empty
    for i in (1, 2):
        assert got[i].addr_comp == [] and got[i].addr_num == [] and got[i].addr_empty


@pytest.mark.parametrize("a, b, want", [(111, 116, True), (11502, 11507, True), (12, 120, True), (12, 21, False), (103, 3, False), (5, 5, False), (-1, 5, False)])
def test_digit_edit(spark, a, b, want):
    assert spark.range(1).select(features.digit_edit1(F.lit(a), F.lit(b)).alias("x")).first().x is want


def test_skeletons(spark):
    rows = spark.createDataFrame([("private",), ("praivet",), ("company",), ("kampani",), ("",)], "t string")
    assert [r.s for r in rows.select(names.skeleton(F.col("t")).alias("s")).collect()] == ["prvt", "prvt", "knpn", "knpn", ""]


def common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(max(row[j] + 1 if x == y else 0, row[j + 1], 0) for j, y in enumerate(b))]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    return row[-1]


def by_hand(scorer: str, a: str, b: str) -> float:
    ratio = lambda x, y: 2 * common(x, y) / (len(x) + len(y)) if x or y else 1.0
    if scorer == "ratio":
        return ratio(a, b)
    if scorer == "token_sort":
        return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if scorer == "token_set":
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            return 0.0
        both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if both and not (one and two):
            return 1.0
        sides = [" ".join(filter(None, (both, s))) for s in (one, two)]
        return max(ratio(*sides), *(ratio(both, s) if both else 0.0 for s in sides))
    if scorer == "partial":
        a, b = sorted((a, b), key=len)
        if not a:
            return float(not b)
        return max(ratio(a, b[max(i, 0) : i + len(a)]) for i in range(1 - len(a), len(b)))
    if a == b or not a or not b:
        return float(a == b)
    reach, used, found = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            found.append(c)
    if not found:
        return 0.0
    m, other = len(found), [b[j] for j in sorted(used)]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(found, other, strict=True)) // 2) / m) / 3
    same = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@pytest.mark.parametrize("scorer", fuzzy.SCORERS)
def test_string_similarities(scorer):
    rnd = random.Random(5)
    words = ["small", "ring", "red", "alpha", "al", "a", "größe", "limited", "x1", "12"]
    pairs = [("", ""), ("a", ""), ("ab", "ba"), ("a" * 64, "a" * 65), ("ab" * 40, "ba" * 41), ("martha", "marhta"), ("dwayne", "duane"), ("this is a test", "this is a test!")]
    for _ in range(400):
        x = " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 4, 15])))
        y = list(x) if rnd.random() < 0.6 else list(" ".join(rnd.choices(words, k=rnd.randint(0, 4))))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(y))
            y[at : at + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice("abc ")]])
        pairs.append((x, "".join(y)))
    got = fuzzy.similarities(scorer, [x for x, _ in pairs], [y for _, y in pairs])
    assert got.tolist() == pytest.approx([by_hand(scorer, *(p if scorer != "jaro_winkler" else sorted(p, key=len))) for p in pairs])


def test_string_similarities_of_columns(spark):
    rows = spark.createDataFrame([("small ring", "ring small"), (None, ""), ("a", None)], "x string, y string")
    got = rows.select(fuzzy.scores({"r": ("ratio", F.col("x"), F.col("y")), "s": ("token_sort", F.col("x"), F.col("y"))}).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [(pytest.approx(0.5), 1.0), (1.0, 1.0), (0.0, 0.0)]


@pytest.mark.parametrize(
    "text, want",
    [("Ｃafé №５", "Cafe No5"), ("Łódź Świat Ltd", "Lodz Swiat Ltd"), ("Ａｃｍｅ Ltd", "Acme Ltd"), ("शर्मा", "shrma"), ("Müller’s “Straße” – 12", "Muller's \"Strasse\" - 12"), ("Иван", "ivan"), ("東京", "u6771u4eac"), ("タワー", "tawa"), ("서울", "seoul"), ("plain", "plain")],
)
def test_fold_value(text, want):
    assert fold_value(text) == want


def test_fold_column(spark):
    rows = spark.createDataFrame([(1, "Café"), (2, "plain"), (3, None), (4, "Łódź"), (5, "")], "id int, name string")
    assert {r.id: r.f for r in rows.select("id", fold(F.col("name")).alias("f")).collect()} == {1: "Cafe", 2: "plain", 3: None, 4: "Lodz", 5: ""}


def test_names_of_other_scripts(spark):
    rows = spark.createDataFrame([(1, "शर्मा ट्रेडर्स Pvt Ltd"), (2, "Łódź Świat Ltd"), (3, "Ａｃｍｅ Ltd"), (4, "शर्मा dba शर्मा Foods")], "id long, business_name string")
    got = {r.id: (r.name_tok, r.native) for r in names.normalize_names(rows).collect()}
    assert got[1] == (["shrma", "tredrs", "private", "limited"], True)
    assert got[2] == (["lodz", "swiat", "limited"], False) and got[3] == (["acme", "limited"], False)
    mined = spark.createDataFrame([("shrma", "sharma"), ("lodz", "never")], "token string, target string")
    mapped = {r.id: (r.name_tok, r.alt_tok) for r in names.normalize_names(rows, transliterated=mined).collect()}
    assert mapped[1][0][0] == "sharma" and mapped[2][0] == ["lodz", "swiat", "limited"] and mapped[4] == (["sharma"], ["sharma", "foods"])


def test_truth_lists(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", ""), ("S1-3", ",")], "source1_entity_id string, matched_entity_ids string")
    assert sorted((r.s1_id, r.m_id) for r in explode_truth(rows).collect()) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
