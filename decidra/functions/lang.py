"""Script and Latin-language detection, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Code point ranges of scripts, in order of precedence.
SCRIPTS = {
    "greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "cyrillic": r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
    "armenian": r"\x{0530}-\x{058F}",
    "hebrew": r"\x{0590}-\x{05FF}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "devanagari": r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}",
    "bengali": r"\x{0980}-\x{09FF}",
    "gurmukhi": r"\x{0A00}-\x{0A7F}",
    "gujarati": r"\x{0A80}-\x{0AFF}",
    "oriya": r"\x{0B00}-\x{0B7F}",
    "tamil": r"\x{0B80}-\x{0BFF}",
    "telugu": r"\x{0C00}-\x{0C7F}",
    "kannada": r"\x{0C80}-\x{0CFF}",
    "malayalam": r"\x{0D00}-\x{0D7F}",
    "sinhala": r"\x{0D80}-\x{0DFF}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "lao": r"\x{0E80}-\x{0EFF}",
    "tibetan": r"\x{0F00}-\x{0FFF}",
    "myanmar": r"\x{1000}-\x{109F}",
    "georgian": r"\x{10A0}-\x{10FF}",
    "ethiopic": r"\x{1200}-\x{137F}",
    "khmer": r"\x{1780}-\x{17FF}",
    "hangul": r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}",
    "kana": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}",
    "han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}",
}
LATIN = r"\x{0000}-\x{024F}\x{1E00}-\x{1EFF}"

# Function words of Latin-script languages.
FUNCTION_WORDS = {
    "en": "the and is are was were to of in for with that this it you have has not but on at be as from will can would there their what which please we i",
    "fr": "le la les des une est pour dans que qui avec sur pas plus nous vous être cette mais sont ont aux ce",
    "de": "der die das und ist ein eine den dem nicht mit für auf von zu sich auch werden wurde haben sind oder aber",
    "es": "el los las que por con para una es se del como pero son está este esta todo más muy hay sus",
    "pt": "os as que em um uma para com não é se do da dos das mas são está este esta muito pelo pela",
    "it": "il lo gli che di per con non è si del della sono questo questa anche come più nella alla",
    "nl": "het een van is op te dat niet met voor zijn aan door maar ook worden deze naar wordt",
    "ro": "și să este sunt care pentru din dar după până fără ale lui în fost acum vreau trebuie foarte acest această acesta aceasta mi ți vă nu",
}
# Letters that ordinary English doesn't use, and the rate that counts as evidence.
FOREIGN = "àâäãáåçéèêëíìîïñóòôöõøúùûüýÿßæœăâîșțşţąćęłńśźżčďěňřšťůžőűğıāēģīķļņūđ"
FOREIGN_RATE = 0.02
MOST_CHARS = 4000


def _without(text: Column, letters: str) -> Column:
    """`text` without runs of a class of characters."""
    return F.regexp_replace(text, f"{letters}+", "")


def script_counts(text: Column) -> Column:
    """Letters per script, as an array of (script, n) with n > 0; Latin comes last.

    Latin letters are taken out first, then what is no letter; the other scripts are looked for in what is left, which is nothing in most Latin texts.
    """

    def counted(s: Column) -> Column:
        return let(F.struct((s["all"] - F.length(s["rest"])).alias("latin"), _without(s["rest"], r"\P{L}").alias("letters")), by_script)

    def by_script(s: Column) -> Column:
        latin = F.struct(F.lit("latin").alias("script"), s["latin"].alias("n"))
        others = [F.struct(F.lit(name).alias("script"), (F.length(s["letters"]) - F.length(_without(s["letters"], f"[{ranges}]"))).alias("n")) for name, ranges in SCRIPTS.items()]
        return F.filter(F.when(s["letters"] == "", F.array(latin)).otherwise(F.array(*others, latin)), lambda x: x["n"] > 0)

    return let(F.struct(F.length(text).alias("all"), _without(text, rf"[\p{{L}}&&[{LATIN}]]").alias("rest")), counted)


def dominant_script(counts: Column) -> Column:
    """The script with the most letters; equal ones as listed; `unknown` without letters."""
    top = F.array_max(F.transform(counts, lambda s: s["n"]))
    return F.when(F.size(counts) == 0, "unknown").otherwise(F.filter(counts, lambda s: s["n"] == top)[0]["script"])


def latin_share(counts: Column) -> Column:
    """Share of Latin letters; 1 where there are no letters at all."""
    n = F.aggregate(counts, F.lit(0), lambda a, s: a + s["n"])
    latin = F.aggregate(F.filter(counts, lambda s: s["script"] == "latin"), F.lit(0), lambda a, s: a + s["n"])
    return F.coalesce(F.try_divide(latin.cast("double"), n.cast("double")), F.lit(1.0))


def latin_language(text: Column) -> Column:
    """A struct: language (null if undecided), english_hits, foreign_rate, foreign (boolean).

    A language other than English needs two function words more than English has; letters
    that English doesn't use lower that to as many, but two at least.
    """
    lower = F.lower(text)
    tokens = F.regexp_extract_all(lower, F.lit(r"\p{L}+"), F.lit(0))
    rate = (F.length(lower) - F.length(F.translate(lower, FOREIGN, ""))) / F.greatest(F.length(lower), F.lit(1))

    # Constant lists become hash sets; most tokens are gone before the languages are counted.
    known = sorted({w for words in FUNCTION_WORDS.values() for w in words.split()})
    tokens = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda x: x.isin(known)).alias("w")))[0]
    hits = lambda t, name: F.size(F.filter(t["w"], lambda x: x.isin(FUNCTION_WORDS[name].split())))

    def decide(t: Column) -> Column:
        english = hits(t, "en")
        others = F.array(*[F.struct(hits(t, name).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("l")) for i, name in enumerate(FUNCTION_WORDS) if name != "en"])
        best = F.array_max(others)
        return F.struct(t["n"].alias("words"), english.alias("en"), best.alias("best"), rate.alias("rate"))

    def told(s: Column) -> Column:
        rate, foreign = s["rate"], s["rate"] >= FOREIGN_RATE
        n, en = s["best"]["n"], s["en"]
        language = F.when((n >= 2) & (n >= en + 2), s["best"]["l"]).when(foreign & (n >= 2) & (n >= en), s["best"]["l"]).when((en > 0) & ~foreign, "en")
        few = s["words"] < 4
        return F.struct(
            F.when(~few, language).alias("language"), F.when(few, 0).otherwise(en).alias("english_hits"), rate.alias("foreign_rate"), foreign.alias("foreign"),
        )

    return F.transform(F.array(F.transform(F.array(tokens), decide)[0]), told)[0]


def analysis(text: Column) -> Column:
    """script, language, is_english, undecided, foreign_rate, non_latin of a text's beginning.

    Latin text of an undecided language counts as English unless its letters speak against it.
    """
    head = F.left(text, F.lit(MOST_CHARS))

    def judged(s: Column) -> Column:
        latin, script, found = s["script"] == "latin", s["script"], s["found"]
        language = F.when(latin, found["language"])
        return F.struct(
            script.alias("script"),
            language.alias("language"),
            F.when(script == "unknown", True).when(~latin, False).otherwise((F.coalesce(found["language"], F.lit("")) == "en") | (found["language"].isNull() & ~found["foreign"])).alias("is_english"),
            language.isNull().alias("undecided"),
            F.when(latin, found["foreign_rate"]).otherwise(0.0).alias("foreign_rate"),
            F.when(script == "unknown", 0.0).otherwise(1.0 - s["share"]).alias("non_latin"),
        )

    def measured(c: Column) -> Column:
        return F.struct(dominant_script(c).alias("script"), latin_share(c).alias("share"), latin_language(head).alias("found"))

    return F.transform(F.transform(F.array(script_counts(head)), measured), judged)[0]
