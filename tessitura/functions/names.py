"""Keys of names that are spelt in many ways."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that fold together, in order.
PHONETIC = [
    ("ph", "p"), ("bh", "b"), ("gh", "g"), ("kh", "k"), ("jh", "j"), ("dh", "d"), ("th", "t"), ("ch", "c"), ("sh", "s"),
    ("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("ai", "e"), ("ay", "e"), ("au", "o"), ("ow", "o"), ("ou", "o"),
    ("w", "v"), ("z", "j"), ("q", "k"), ("x", "ks"), ("y", "i"), ("j", "c"),
]
# Rewrites of the matching key for scale names, in order.
SCALE_NAMES = [("sh", "s"), ("w", "v"), ("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("ph", "p")]


def _plain() -> tuple[str, str]:
    """Letters with marks and the single letters that they decompose to."""
    pairs = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Marks stripped, lower case, a to z only."""
    return F.regexp_replace(F.lower(F.translate(c, *_plain())), "[^a-z]", "")


def _rewrite(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def phonetic_key(c: Column) -> Column:
    """A key that spellings of one name share; null counts as empty."""
    s = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("ṛ"), F.lit("ri")), F.lit("ṝ"), F.lit("ri"))
    return F.regexp_replace(F.replace(_rewrite(fold(s), PHONETIC), F.lit("m"), F.lit("n")), r"(.)\1+", "$1")


def scale_key(c: Column) -> Column:
    """The key that scale names are matched by: one case ending goes."""
    return F.regexp_replace(_rewrite(fold(F.coalesce(c, F.lit(""))), SCALE_NAMES), "(am|a|i|u|m)$", "")


def edit_budget(key: Column) -> Column:
    return F.when(F.length(key) >= 8, 2).otherwise(1)


# Scales that go by two names, by the spelling that is looked up.
SCALE_ALIASES = {
    "todi": "Hanumatodi", "pantuvarali": "Kamavardhani", "kamavardhini": "Kamavardhani", "sankarabharanam": "Shankarabharanam", "dheerasankarabharanam": "Shankarabharanam",
    "mechakalyani": "Kalyani", "shuddhasaveri": "Shuddha Saveri", "suddhasaveri": "Shuddha Saveri", "suddhadhanyasi": "Shuddha Dhanyasi", "udayaravichandrika": "Shuddha Dhanyasi",
    "natai": "Nattai", "nata": "Nattai", "poorvikalyani": "Purvikalyani", "pantuvarali51": "Kamavardhani",
}


def plain_scale_key(name: str) -> str:
    """``scale_key`` of a string, in the driver: for small tables of names."""
    s = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    s = re.sub("[^a-z]", "", s)
    for a, b in SCALE_NAMES:
        s = s.replace(a, b)
    return re.sub("(am|a|i|u|m)$", "", s)


def resolved_key(c: Column, aliases: dict[str, str] = SCALE_ALIASES) -> Column:
    """The matching key of a scale's name; that of its usual name where it is an alias."""
    key = scale_key(c)
    table = {plain_scale_key(a): plain_scale_key(b) for a, b in aliases.items()}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], key)
