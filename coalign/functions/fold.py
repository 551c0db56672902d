"""Texts in ASCII letters. Latin-1 letters are folded in place by built-in functions; only values with others cross to Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V

# Letters that no rule below gives.
SPECIAL = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ŋ": "ng", "Ŋ": "Ng", "ı": "i", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
_SIGNS = {"ANUSVARA": "m", "CANDRABINDU": "m", "VISARGA": "h"}


def latin_fold(c: Column) -> Column:
    """Latin-1 letters without their marks; other letters stay."""
    for two, letters in V.LATIN_TWO.items():
        c = F.replace(c, F.lit(two), F.lit(letters))
    return F.translate(c, V.LATIN_FROM, V.LATIN_TO)


def _indic(name: str) -> str:
    """Consonants without the vowel they imply, long vowels and doubled consonants as single ones."""
    sound = name.rpartition(" ")[2]
    if " SIGN " in name and " VOWEL SIGN " not in name:
        return _SIGNS.get(sound, "")
    sound = sound[1:] if len(sound) > 1 and sound[0] == sound[1] else sound
    return (sound[:-1] if len(sound) > 1 and sound[-1] == "A" and sound[0] not in "AEIOU" else sound).lower()


def _cyrillic(sound: str) -> str:
    if sound in ("SIGN", "YA", "YU", "IE"):
        return {"SIGN": "", "YA": "ya", "YU": "yu", "IE": "e"}[sound]
    return (sound[1:] if len(sound) == 2 and sound[0] == "E" else sound[:-1] if len(sound) > 1 and sound[-1] in "EA" else sound).lower()


def fold_letter(c: str) -> str:
    """What stands for one character: by its compatibility form, its name, its kind of punctuation; letters of other kinds by their number."""
    if c in SPECIAL:
        return SPECIAL[c]
    if ord(c) < 128:
        return c
    name = unicodedata.name(c, "")
    script, _, letter = name.partition(" LETTER ")
    if script in ("HIRAGANA", "KATAKANA") or name.startswith("HANGUL SYLLABLE "):
        return name.rpartition(" ")[2].lower()
    parts = unicodedata.normalize("NFKD", c)
    if parts != c:
        return "".join(map(fold_letter, parts))
    kind = unicodedata.category(c)
    if "ऀ" <= c <= "෿" and kind[0] in "LM":
        return _indic(name)
    if kind[0] == "M" or (kind == "Lm" and not letter):
        return ""
    if kind[0] in "ZC":
        return " "
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind == "Pd":
        return "-"
    if kind in ("Pi", "Pf") or "QUOTATION" in name or "APOSTROPHE" in name:
        return '"' if "DOUBLE" in name or "GUILLEMET" in name else "'"
    if kind[0] != "L":
        return " "
    if name.startswith("LATIN"):
        sound = letter.partition(" WITH ")[0].rpartition(" ")[2]
        return sound if "CAPITAL" in script else sound.lower()
    sound = letter.partition(" WITH ")[0].rpartition(" ")[2]
    if script.startswith("GREEK"):
        return (sound[:2] if sound[:2] in ("TH", "PH", "CH", "PS") else sound[:1]).lower()
    if script.startswith("CYRILLIC"):
        return _cyrillic(sound)
    return sound.lower() if sound.isascii() and sound.isalpha() else f"u{ord(c):x}"


class _Letters(dict):
    """Of each character that has been met: what stands for it. There are no more than Unicode has."""

    def __missing__(self, code: int) -> str:
        self[code] = fold_letter(chr(code))
        return self[code]


_LETTERS = _Letters()


def fold_value(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_LETTERS)


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(fold_value, na_action="ignore")


def fold(c: Column) -> Column:
    """The column in ASCII; null stays null. A value without letters beyond Latin-1 is null on its way to Python."""
    latin = latin_fold(c)
    return F.coalesce(_fold(F.when(latin.rlike("[^\\x00-\\x7F]"), c)), latin)
