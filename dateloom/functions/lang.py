"""Language of a headline by script, then by the function words of Latin-script languages.

A substitute for a statistical detector: it knows zh-cn, ko, ru, uk and the languages of FUNCTION_WORDS. Texts of other scripts or
without a letter are unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dateloom.functions.text import has, strip

# --- fixed values: frequent function words -------------------------------------------------------------------------
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "for", "on", "with", "as", "at", "by", "from", "after", "over", "says", "was", "are", "be", "it", "that", "this", "will", "his", "an"),
    "es": ("el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "por", "con", "para", "su", "se", "al", "lo", "más", "como", "es"),
    "fr": ("le", "les", "des", "du", "et", "un", "une", "dans", "sur", "pour", "qui", "est", "au", "aux", "avec", "ce", "sa", "par", "la", "de", "vous"),
    "de": ("der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "auf", "für", "ein", "eine", "dem", "nicht", "des", "als", "auch", "in", "wird"),
    "sw": ("ya", "na", "wa", "kwa", "katika", "ni", "la", "za", "kuwa", "baada", "wake", "hii"),
}


def language(text: Column) -> Column:
    """The language code; empty for null or blank text, unknown without letters."""
    t = F.lower(F.coalesce(text, F.lit("")))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    han, hangul, cyrillic = count(r"\p{IsHan}"), count(r"\p{IsHangul}"), count(r"\p{IsCyrillic}")
    latin = count(r"\p{IsLatin}")
    words = F.split(t, r"(?U)[^\w]+")
    listed = lambda names: F.size(F.filter(words, lambda w: w.isin(*names)))
    scores = [F.struct(listed(names).alias("n"), F.lit(-k).alias("turn"), F.lit(name).alias("name")) for k, (name, names) in enumerate(FUNCTION_WORDS.items())]
    best = F.array_max(F.array(*scores))
    return (
        F.when(strip(t) == "", "empty")
        .when((hangul > 0) & (hangul * 2 >= han), "ko")
        .when(han * 3 >= latin, F.when(han > 0, "zh-cn").otherwise(F.when(cyrillic > latin, F.when(has(t, "[іїєґ]"), "uk").otherwise("ru")).otherwise("unknown")))
        .when(cyrillic > latin, F.when(has(t, "[іїєґ]"), "uk").otherwise("ru"))
        .when(latin > 0, F.when(best["n"] > 0, best["name"]).otherwise("en"))
        .otherwise("unknown")
    )
