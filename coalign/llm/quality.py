"""Quality rules by distribution divergence.

Two histograms of a document, of character classes and of the common words of its
language, are compared with those of the whole corpus in that language by the
Jensen-Shannon distance. The common words, those with at least ``share`` of all words
of a language, are found exactly in two passes: partial counts leave a bounded number
of candidates, which the second pass counts over everything.

A short document scatters around the reference: a histogram of n draws over k bins
has an expected divergence of about (k - 1) / (2 n) nats. The limits are widened by
``noise`` times that, for the document and for its language's reference, and documents below ``min_chars`` or ``min_words`` are not
judged on the histogram in question at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean

#: Fixed classes of characters: lower case, upper case, other letters, digits, white space, stops, quotes and brackets, symbols, the rest.
CLASSES = ("lower", "upper", "letter", "digit", "space", "stop", "quote", "symbol", "other")
_STOPS, _QUOTES, _SYMBOLS = ".,;:!?", "\"'()[]{}-–—«»“”‘’„…¿¡", "#*$%&|<>@+=/\\^~_`"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
#: What counts as a word of the language: a run without white space, stops and quotes, in lower case. A symbol glued to a word makes another word.
_TOKEN = re.compile(r"[^\s.,;:!?()\"'«»]+")


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; distances are square roots of divergences in bits, from 0 to 1."""

    min_words: int = 10
    max_repeat_percent: int = 20
    class_distance: float = 0.28
    word_distance: float = 0.40
    min_chars: int = 200
    min_common_words: int = 50
    noise: float = 0.25
    share: float = 0.002
    part_words: int = 500_000
    least_part_words: int = 20_000
    #: Has no effect: every language is its own reference at every size. Callers that set it still can.
    min_reference_words: int = 20_000


def _class_of(c: str) -> int:
    if c.isspace():
        return 4
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isalpha():
        return 2
    if c.isdigit():
        return 3
    return 5 if c in _STOPS else 6 if c in _QUOTES else 7 if c in _SYMBOLS else 8


_TABLE: np.ndarray | None = None


def _table() -> np.ndarray:
    """The class of each character of the basic plane, made once in each worker; surrogates and the rest are class 8."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([8 if 0xD800 <= c <= 0xDFFF else _class_of(chr(c)) for c in range(0x10000)], np.uint8)
    return _TABLE


def class_counts(text: str) -> np.ndarray:
    """How many characters of each class a text has."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _table()[np.minimum(points, 0xFFFF)]
    return np.bincount(classes, minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts: 0 for equal ones, 1 for disjoint ones."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0.0)))


def repeated_words(words: list[str], n: int = 5) -> int:
    """Words in windows of ``n`` words that the text has twice or more, the first included."""
    if len(words) < n + 1:
        return 0
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    base, many = len(ids), len(words) - n + 1
    windows = codes[:many]
    for i in range(1, n):
        if int(windows.max()) * base + base >= 2**63:  # number the windows so far densely: no collision is possible
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * base + codes[i : many + i]
    order = np.sort(windows)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    steps = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n, minlength=len(words) + 1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def base_metrics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


@dataclass(frozen=True)
class Reference:
    """Counts over a language: characters by class, common words (the last number counts all others), words."""

    classes: np.ndarray
    at: dict[str, int]
    words: np.ndarray
    total: int


def _reference(classes: np.ndarray, counts: dict[str, int], total: int, share: float) -> Reference:
    common = sorted(w for w, k in counts.items() if k >= share * total)
    found = [counts[w] for w in common]
    return Reference(classes.astype(float), {w: i for i, w in enumerate(common)}, np.array([*found, total - sum(found)], float), total)


def base_failed(n_words: int, n_repeat_words: int, rules: QualityRules) -> bool:
    return n_words < rules.min_words or 100 * n_repeat_words > rules.max_repeat_percent * n_words


def _lang_key(lang):
    return F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang")


_COUNTS = "lang string, word string, n long"


def _count_rows(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def _partial_counts(rows: DataFrame, rules: QualityRules) -> DataFrame:
    """(lang, word, n): w and a word with part of its count, n with words, p with words of parts that were counted by their frequent words only, c and a class.

    A language is counted in parts of ``part_words`` words or so. Of a part only words
    of an eighth of the share at least are named, 8 / share of them at most; what a task
    has left of a language is a part too, or if it is small, told in full.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        own: Counter = Counter()
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        totals: Counter = Counter()

        def part(lang: str) -> list[tuple[str, str, int]]:
            words, n = counts.pop(lang), own.pop(lang)
            if n < rules.least_part_words:
                return [(lang, f"w{w}", k) for w, k in words.items()]
            least = rules.share / 8 * n
            return [(lang, "p", n), *((lang, f"w{w}", k) for w, k in words.items() if k >= least)]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _TOKEN.findall(text.lower())
                counts[lang].update(words)
                own[lang] += len(words)
                totals[lang] += len(words)
                classes[lang] += class_counts(text)
                if own[lang] >= rules.part_words:
                    yield _count_rows(part(lang))
            if sum(own.values()) >= 4 * rules.part_words:  # many languages: what is held stays bounded
                yield _count_rows([x for lang in list(counts) for x in part(lang)])
        rest = [x for lang in list(counts) for x in part(lang)]
        rest += [(lang, f"c{i}", int(x)) for lang, c in classes.items() for i, x in enumerate(c)]
        yield _count_rows(rest + [(lang, "n", n) for lang, n in totals.items()])

    return rows.mapInArrow(lean(count), _COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: QualityRules = QualityRules()) -> dict[str, Reference]:
    """The reference of each language.

    A word of the share at least has over seven eighths of that in the partial counts,
    as what they leave out is under an eighth. So fewer than 8 / 7 / share words of a
    language are looked at by the second pass, which counts them exactly, and this many
    numbers a language and no more reach the driver.
    """
    rows = docs.select(_lang_key(lang_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    most = math.ceil(8 / 7 / rules.share) + 1
    # a language's words by count, and apart from them its few other numbers; each task passes on the first ones only
    named = _partial_counts(rows, rules).withColumn("is_word", F.col("word").startswith("w"))
    by_count = W.partitionBy("lang", "is_word").orderBy(F.desc("n"), "word")
    named = named.withColumn("nth", F.row_number().over(by_count)).where(F.col("nth") <= most).select("lang", "word", "n").collect()
    found: dict[str, tuple[np.ndarray, frozenset[str], int]] = {}
    by_lang: dict[str, dict[str, int]] = defaultdict(dict)
    for r in named:
        by_lang[r["lang"]][r["word"]] = r["n"]
    for key, own in by_lang.items():
        n = own.get("n", 0)
        least = rules.share * (n - own.get("p", 0) / 8) - 1e-6
        found[key] = (np.array([own.get(f"c{i}", 0) for i in range(len(CLASSES))]), frozenset(w[1:] for w, k in own.items() if w[0] == "w" and k >= least), n)
    wanted = {key: words for key, (_, words, _) in found.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(filter(wanted[lang].__contains__, _TOKEN.findall(text.lower())))
        yield _count_rows([(k, w, n) for k, c in counts.items() for w, n in c.items()])

    exact: dict[str, dict[str, int]] = defaultdict(dict)
    for r in rows.mapInArrow(lean(count), _COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        exact[r["lang"]][r["word"]] = r["n"]
    return {key: _reference(classes, exact[key], n, rules.share) for key, (classes, _, n) in found.items()}


def verdict(text: str, reference: Reference | None, rules: QualityRules = QualityRules()) -> tuple[float | None, float | None, bool]:
    """(class distance, word distance, diverges); a distance is None where the document is too short to judge or its language has no reference."""
    far_c = far_w = None
    if reference is None:
        return None, None, False
    counts = class_counts(text)
    chars = int(counts.sum())
    bad = False
    if chars >= rules.min_chars and reference.classes.sum():
        far_c = js_distance(counts.astype(float), reference.classes)
        bad |= far_c**2 > rules.class_distance**2 + rules.noise * (len(CLASSES) - 1) * (1 / chars + 1 / reference.classes.sum()) / (2 * np.log(2))
    words = _TOKEN.findall(text.lower())
    rest = len(reference.at)
    if len(words) >= rules.min_common_words and rest:
        ours = np.bincount([reference.at.get(w, rest) for w in words], minlength=rest + 1).astype(float)
        far_w = js_distance(ours, reference.words)
        bad |= far_w**2 > rules.word_distance**2 + rules.noise * rest * (1 / len(words) + 1 / reference.total) / (2 * np.log(2))
    return far_c, far_w, bool(bad)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of ``docs``: the base counts, the two distances and ``kept``.

    A null text counts as empty: it has no words and fails the base rules. A null
    language counts as the language ''. Repeated rows each get their row. Documents are held
    against their own language, whatever its size. An empty table gives an empty result.
    """
    found = references(docs, text_col, lang_col, rules)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, chars, symbols, dups, repeats = base_metrics(text)
                own = found.get(lang)
                far_c, far_w, bad = verdict(text, own, rules)
                failed = base_failed(n, repeats, rules)
                out.append((key, n, chars, symbols, dups, repeats, failed, far_c, far_w, not failed and not bad))
            kinds = (pa.int64(),) * 6 + (pa.bool_(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _lang_key(lang_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(score), RESULT)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns and without a join."""
    found = references(docs, text_col, lang_col, rules)
    n_columns, schema = len(docs.columns), docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for lang, text in zip(batch.column(n_columns).to_pylist(), batch.column(n_columns + 1).to_pylist(), strict=True):
                words = _WORD.findall(text)
                ok = not base_failed(len(words), repeated_words(words), rules)
                if ok:
                    own = found.get(lang)
                    ok = not verdict(text, own, rules)[2]
                good.append(ok)
            rows = pa.RecordBatch.from_arrays(batch.columns[:n_columns], names=batch.schema.names[:n_columns])
            yield rows.filter(pa.array(good, pa.bool_()))

    rows = docs.select("*", _lang_key(lang_col).alias("__lang"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInArrow(lean(keep), schema)
