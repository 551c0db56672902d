"""Normalization of business names: columns in, columns out, all of it built in.

``normalize_names`` adds name_tok, core_tok, alt_tok, name_norm, core, compact, legal
and native. The steps go in the order of the rules, which matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V
from .fold import fold


def literal_map(words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))


def among(c: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*map(F.lit, words)), c)


def is_native(c: Column) -> Column:
    """Has a letter of an Indic script."""
    return c.rlike(V.NATIVE_SCRIPT)


def clean_name(c: Column) -> Column:
    """Lower case, then the patterns in order."""
    c = F.lower(c)
    for _, pattern, to in V.NAME_RULES:
        c = F.regexp_replace(c, pattern, to)
    return c


def split_other_name(c: Column) -> tuple[Column, Column]:
    """Main name and the one it also trades under; without one all of it and an empty string."""
    has = c.rlike(V.OTHER_NAME)
    return F.when(has, F.regexp_extract(c, V.OTHER_NAME, 1)).otherwise(c), F.when(has, F.regexp_extract(c, V.OTHER_NAME, 2)).otherwise("")


def words(c: Column) -> Column:
    """The tokens of a text of letters and digits, in order."""
    return F.filter(F.split(F.regexp_replace(c, "[^a-z0-9]+", " "), " "), lambda t: t != "")


def map_tokens(tokens: Column, mapping: Column | dict[str, str]) -> Column:
    """Tokens replaced by an exact lookup, others unchanged."""
    m = literal_map(mapping) if isinstance(mapping, dict) else mapping
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(m, t), t))


def unconfuse(token: Column) -> Column:
    """Digits that stand for letters, in tokens of both that aren't ordinals."""
    mixed = token.rlike("[a-z]") & token.rlike("[0-9]") & ~token.rlike(V.ORDINAL)
    return F.when(mixed, F.translate(token, *V.DIGIT_LOOKS)).otherwise(token)


def raw_words(c: Column) -> Column:
    """The tokens of a cleaned name before anything is mapped."""
    return words(F.regexp_replace(c, r"'s\b", "s"))


def name_tokens(c: Column, native: Column, transliterated: Column | None = None) -> Column:
    """Tokens of a cleaned name, mapped, split again and distinct in order."""
    tokens = raw_words(c)
    if transliterated is not None:
        tokens = F.when(native, map_tokens(tokens, transliterated)).otherwise(tokens)
    tokens = map_tokens(F.transform(tokens, unconfuse), V.LEGAL_FORMS)
    return F.array_distinct(F.filter(F.split(F.array_join(tokens, " "), " "), lambda t: t != ""))


def without(tokens: Column, dropped: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~among(t, dropped))


def drop_title(core: Column) -> Column:
    """Without a title in front, if something else is left."""
    titled = (F.size(core) > 1) & among(F.get(core, F.lit(0)), V.TITLES)
    return F.when(titled, F.slice(core, 2, F.greatest(F.size(core), F.lit(1)))).otherwise(core)


def own_map(df: DataFrame, key: str, tokens: Column, table: DataFrame) -> DataFrame:
    """(key, _map): of each record the entries of ``table`` (token, target) that its tokens have; records without any aren't there."""
    asked = df.select(F.col(key), F.explode(F.array_distinct(tokens)).alias("token"))
    return asked.join(table.select("token", "target"), "token").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "target"))).alias("_map"))


def normalize_names(df: DataFrame, name: str = "business_name", transliterated: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Adds the name columns. A null name counts as empty and has no tokens.

    ``transliterated`` has (token, target), a target for each token once; it is joined
    to the tokens of native names by record, whose ``key`` must be its own (N13).
    """
    raw = F.coalesce(F.col(name), F.lit(""))
    df = df.withColumn("native", is_native(raw)).withColumn("_clean", clean_name(fold(raw)))
    main, other = split_other_name(F.col("_clean"))
    df, mapping = df.withColumns({"_main": main, "_other": other}), None
    if transliterated is not None:
        found = own_map(df.where("native"), key, F.concat(raw_words(F.col("_main")), raw_words(F.col("_other"))), transliterated)
        df, mapping = df.join(found, key, "left"), F.coalesce("_map", F.create_map().cast("map<string,string>"))
    df = df.withColumns({"name_tok": name_tokens(F.col("_main"), F.col("native"), mapping), "_alt": name_tokens(F.col("_other"), F.col("native"), mapping)})
    dropped = [*V.LEGAL_TOKENS, *(w for w in V.NAME_STOP_WORDS if w not in V.LEGAL_TOKENS)]
    legal = F.filter(F.concat("name_tok", "_alt"), lambda t: among(t, V.LEGAL_TOKENS))
    df = df.withColumns(
        {
            "core_tok": drop_title(without(F.col("name_tok"), dropped)),
            "alt_tok": without(F.col("_alt"), dropped),
            "legal": F.array_join(F.array_sort(F.array_distinct(legal)), " "),
        }
    )
    df = df.withColumns({"name_norm": F.array_join("name_tok", " "), "core": F.array_join("core_tok", " "), "compact": F.array_join("core_tok", "")})
    return df.drop("_clean", "_main", "_other", "_alt", "_map")


def skeleton(c: Column) -> Column:
    """Consonant skeleton of a token; the sound rules one after another, the first letter stays."""
    c = F.lower(c)
    for a, b in V.SKELETON_RULES:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.substring(c, 1, 1), F.regexp_replace(F.substring(c, 2, 1 << 20), "[aeiouh]", ""))
    return F.regexp_replace(c, r"(.)\1+", "$1")


def skeleton_text(tokens: Column) -> Column:
    """Skeletons of a list as one text; one pass over the letters, leftmost rule first; only consonants of the result are collapsed."""
    rules = "|".join(sorted((a for a, _ in V.SKELETON_RULES), key=len, reverse=True))
    parts = lambda t: F.regexp_extract_all(t, F.lit(f"({rules}|.)"), F.lit(1))
    sounds = literal_map(dict(V.SKELETON_RULES))
    one = lambda t: F.array_join(F.transform(parts(t), lambda p: F.coalesce(F.element_at(sounds, p), p)), "")
    short = lambda t: F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1 << 20), "[aeiouh]", ""))
    joined = F.array_join(F.transform(F.transform(tokens, one), short), " ")
    return F.regexp_replace(joined, r"([bdfgjklnprstvk])\1+", "$1")
