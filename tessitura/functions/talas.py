"""Talas by their names, as they are spelt in many ways."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.music import let
from tessitura.functions.names import PHONETIC, fold, phonetic_key

# Usual names by folded spelling; jathis by spelling; talas that take a jathi.
TALAS = {
    "adi": "Adi", "aadi": "Adi", "rupaka": "Rupaka", "rupakam": "Rupaka", "roopakam": "Rupaka", "rupakachapu": "Rupaka", "misrachapu": "Misra chapu", "mchapu": "Misra chapu",
    "misrachaapu": "Misra chapu", "mishrachapu": "Misra chapu", "khandachapu": "Khanda chapu", "kchapu": "Khanda chapu", "khandachaapu": "Khanda chapu", "kandachapu": "Khanda chapu",
    "triputa": "Triputa", "tripta": "Triputa", "jhampa": "Jhampa", "jampa": "Jhampa", "misrajhampa": "Jhampa", "ata": "Ata", "atta": "Ata", "khandaata": "Khanda Ata", "dhruva": "Dhruva",
    "matya": "Matya", "matyam": "Matya", "eka": "Eka", "ekam": "Eka", "chathushraeka": "Chaturasra Eka", "chatushraeka": "Chaturasra Eka", "chaturasraeka": "Chaturasra Eka",
    "chaturasrareka": "Chaturasra Eka", "tisraeka": "Tisra Eka", "thisraeka": "Tisra Eka", "trisraeka": "Tisra Eka", "khandaeka": "Khanda Eka", "misraeka": "Misra Eka",
    "sankeernaeka": "Sankirna Eka", "sankirnaeka": "Sankirna Eka", "tisratriputa": "Tisra Triputa", "chaturasratriputa": "Adi", "desadi": "Desadi", "madhyadi": "Madhyadi",
}
JATHIS = {
    "tisra": "Tisra", "trisra": "Tisra", "thisra": "Tisra", "chaturasra": "Chaturasra", "chathushra": "Chaturasra", "chatusra": "Chaturasra", "khanda": "Khanda", "kanda": "Khanda",
    "misra": "Misra", "mishra": "Misra", "sankirna": "Sankirna", "sankeerna": "Sankirna",
}
TAKES_JATHI = ("Triputa", "Eka", "Dhruva", "Matya", "Jhampa", "Ata")
# Angas of the seven families (L is the laghu), their usual laghu, jatis, chapus, and names that are shown.
STRUCTURE = {"dhruva": "L2LL", "mathya": "L2L", "rupaka": "2L", "jhampa": "L12", "triputa": "L22", "ata": "LL22", "eka": "L"}
USUAL = {"dhruva": 4, "mathya": 4, "rupaka": 4, "jhampa": 7, "triputa": 3, "ata": 5, "eka": 4}
JATI = {"tisra": 3, "trisra": 3, "catusra": 4, "caturasra": 4, "chatusra": 4, "chaturasra": 4, "khanda": 5, "kanda": 5, "misra": 7, "mishra": 7, "sankirna": 9, "samkirna": 9}
CHAPU = {"misracapu": 7, "khandacapu": 5, "tisracapu": 3, "sankirnacapu": 9}
JATI_NAMES = {3: "Tisra", 4: "Chaturasra", 5: "Khanda", 7: "Misra", 9: "Sankeerna"}
FAMILY_NAMES = {"dhruva": "Dhruva", "mathya": "Matya", "rupaka": "Rupaka", "jhampa": "Jhampa", "triputa": "Triputa", "ata": "Ata", "eka": "Eka"}


def plain_phonetic(name: str) -> str:
    """``phonetic_key`` of a string, in the driver: for small tables of names."""
    s = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    s = re.sub("[^a-z]", "", s)
    for a, b in PHONETIC:
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s.replace("m", "n"))


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def by_sound(table: dict[str, str]) -> dict[str, str]:
    """The first value for each phonetic key."""
    out: dict[str, str] = {}
    for k, v in table.items():
        out.setdefault(plain_phonetic(k), v)
    return out


def match_tala(raw: Column) -> Column:
    """The usual name: by letters, by sound, or a jathi in front of one of the seven; null for what is neither. Chaturasra Triputa is Adi."""
    cleaned = F.regexp_replace(F.regexp_replace(raw, r"\(.*?\)", " "), r"(?i)\b(jati|jathi|talam?|nadai)\b", " ")
    sounds = by_sound(TALAS)
    words = F.filter(F.split(F.trim(cleaned), r"\s+"), lambda w: w != "")
    jathi = _map(JATHIS)[phonetic_key(F.get(words, F.lit(0)))]
    base = _map(sounds)[phonetic_key(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), ""))]
    two = F.when((F.size(words) >= 2) & jathi.isNotNull() & base.isNotNull(), F.when((jathi == "Chaturasra") & (base == "Triputa"), "Adi").when(base.isin(*TAKES_JATHI), F.concat_ws(" ", jathi, base)).otherwise(base))
    return F.coalesce(_map(TALAS)[fold(cleaned)], _map(sounds)[phonetic_key(cleaned)], two)


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z]", ""), "(talam|tala|tal)$", "")


def _longest(n: Column, names) -> Column:
    """The longest of the names that n contains; of equally long ones the first."""
    return F.coalesce(*[F.when(F.contains(n, F.lit(x)), F.lit(x)) for x in sorted(names, key=lambda x: -len(x))])


def family(name: Column) -> Column:
    """capu, adi, or the longest name of a family that the name contains."""
    return let(_bare(name), _family)


def _family(n: Column) -> Column:
    return F.when(F.contains(n, F.lit("capu")), "capu").when(F.contains(n, F.lit("adi")) & ~F.contains(n, F.lit("jati")), "adi").otherwise(_longest(n, STRUCTURE))


def angas(name: Column) -> Column:
    """Beats of the angas; null for what is no tala."""
    return let(_bare(name), lambda n: let(_longest(n, STRUCTURE), lambda fam: _angas(n, fam)))


def _angas(n: Column, fam: Column) -> Column:
    whole = F.coalesce(*[F.when(F.contains(n, F.lit(k)), F.array(F.lit(v))) for k, v in CHAPU.items()])
    halves = F.coalesce(*[F.when(F.startswith(n, F.lit(j)), F.array(F.lit(v // 2), F.lit(v - v // 2))) for j, v in JATI.items()])
    laghu = F.coalesce(_map(JATI)[_longest(n, JATI)], _map(USUAL)[fam])
    shape = let(laghu, lambda x: F.transform(F.split(_map(STRUCTURE)[fam], ""), lambda a: F.when(a == "L", x).otherwise(a.try_cast("int"))))
    adi = F.array(F.lit(4), F.lit(2), F.lit(2))
    return F.when(F.contains(n, F.lit("capu")), F.coalesce(whole, halves)).when(F.contains(n, F.lit("adi")) & ~F.contains(n, F.lit("jati")), adi).when(fam.isNotNull(), shape)


def total(name: Column) -> Column:
    return _total(angas(name))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda t, x: t + x)


def engine_label(name: Column) -> Column:
    """The label that bars are looked up by, as "Khanda Triputa — 9 beats"; null for chapus, Adi and what is no tala."""
    def label(x: Column) -> Column:
        fam, a = x["fam"], x["a"]
        laghu = F.when(fam == "rupaka", F.get(a, F.lit(1))).otherwise(F.get(a, F.lit(0)))
        return F.concat(_map(JATI_NAMES)[laghu], F.lit(" "), _map(FAMILY_NAMES)[fam], F.lit(" — "), _total(a).cast("string"), F.lit(" beats"))

    return let(F.struct(family(name).alias("fam"), angas(name).alias("a")), label)


def clean_name(name: Column) -> Column:
    """Words that were set without a space apart, marks stripped."""
    from tessitura.functions.names import _plain

    return F.trim(F.regexp_replace(F.replace(F.translate(name, *_plain()), F.lit("ı"), F.lit("i")), "([a-z])([A-Z])", "$1 $2"))


def display_tala(name: Column) -> Column:
    """The name that is shown: Adi, the label, or a readable form of the name itself."""
    adi = (family(name) == "adi") | F.contains(name, F.lit("adi")) & ~F.contains(name, F.lit("jati"))
    khanda = lambda: F.when(F.contains(name, F.lit("khanda")), "Khanda Chapu").otherwise(clean_name(name))
    shown = lambda lab: F.when(F.startswith(lab, F.lit("Chaturasra Eka")), "Chaturasra Eka").when(lab.isNull() & F.contains(name, F.lit("capu")), khanda()).otherwise(F.coalesce(lab, clean_name(name)))
    return F.when(adi, "Adi").otherwise(let(engine_label(name), shown))


def tala_and_jathi(label: Column) -> Column:
    """struct<tala,jathi> of a canonical label ("Khanda Triputa", with or without beats) or of a usual name; null for chapus and what is unknown: no bars."""
    def read(x: Column) -> Column:
        m = lambda k: F.regexp_extract(x, r"^(" + "|".join(JATI_NAMES.values()) + r") (" + "|".join(FAMILY_NAMES.values()) + r")( — \d+ beats)?$", k)
        return F.when(x.isin("Adi", "Desadi", "Madhyadi"), F.struct(F.lit("Triputa").alias("tala"), F.lit("Chaturasra").alias("jathi"))).when(m(1) != "", F.struct(m(2).alias("tala"), m(1).alias("jathi")))

    return let(label, read)
