"""Line-first cleaning in DataFrame expressions only: rules judge lines, failing lines go, documents that lose too much follow.

Every column of a text is an expression over arrays within its row: no shuffle, no Python. Arrays that a lambda indexes
are columns of their own and read more than once there, else the optimizer would put their making into the lambda;
other arrays go side by side through zip_with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule.
SPACE = r"[ \t-\r]"
#: Characters that base counts as symbols, and the end of a sentence within or at the end of a line.
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"[.!?:;…][\"'”’»)]*([ \t-\r]|$)"
#: Words that only separate links.
SEPARATORS = "|•»>/·"
#: Patterns of boilerplate in lower case, in English, German, French and Spanish; and a notice of rights with its year.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "cookies to", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "javascript is", "sign in to", "log in to", "subscribe to our", "newsletter", "read more", "click here",
    "share on", "back to top", "lorem ipsum",
    "alle rechte vorbehalten", "cookies (zulassen|akzeptieren)", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "impressum",
    "weiterlesen", "hier klicken", "jetzt abonnieren", "nach oben",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "mentions légales", "conditions d.utilisation", "lire la suite",
    "cliquez ici", "haut de page",
    "todos los derechos reservados", "aceptar (las )?cookies", "política de privacidad", "aviso legal", "condiciones de uso", "leer más", "haga clic aquí",
    "volver arriba",
    "(©|[(]c[)]|copyright) ?(19|20)[0-9][0-9]",
)


@dataclass(frozen=True)
class LineRules:
    """bars: share of a line's words that are lone separators; symbols: share of its characters that are symbols;
    shouting: share of its words that end in two or more exclamation marks; same: share of its words equal to the next;
    unfinished: words from which a line must hold the end of a sentence; boilerplate: words up to which a phrase condemns a line;
    lost: share of a text's word characters whose loss rejects it."""

    bars: float = 0.2
    symbols: float = 0.1
    shouting: float = 0.3
    same: float = 0.5
    unfinished: int = 12
    boilerplate: int = 40
    lost: float = 0.3


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _lines(documents: DataFrame) -> DataFrame:
    """Adds _text, _all (its lines), _line_words (the words of each) and _words (all words: none crosses a line)."""
    out = documents.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_all", F.split("_text", "\n", -1))
    return out.withColumn("_line_words", F.transform("_all", words)).withColumn("_words", F.flatten("_line_words"))


def _measured(out: DataFrame) -> DataFrame:
    out = out.withColumn("_filled", F.filter("_all", lambda line: line.rlike("[^ \\t-\\r]")))
    n = F.size("_words")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    out = out.withColumn("_windows", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")))
    # windows in order of hash, then place; only texts that hold one twice are sorted
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    hash_at = lambda i: F.get("_sorted", i)["h"]
    twice = lambda x, i: F.coalesce(x["h"] == hash_at(i - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(i + 1), F.lit(False))
    out = out.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", twice), lambda x: x["i"])))
    # each window covers three words, fewer where the next begins within them
    covered = F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3))))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _count("_text", SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        }
    )
    return out.drop("_windows", "_sorted", "_places")


def _count(text, characters: str) -> Column:
    """How many of the characters a text holds; most hold none, which a search tells fast."""
    text = F.col(text) if isinstance(text, str) else text
    held = text.rlike("[" + "".join("\\" + c if c in "$&|" else c for c in characters) + "]")
    return F.when(held, F.char_length(text) - F.char_length(F.translate(text, characters, ""))).otherwise(0)


def base_columns(documents: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows with `text`.

    n_repeat_words counts the words that lie in some 3-word window that the text holds twice or more.
    """
    return _measured(_lines(documents)).drop("_text", "_all", "_line_words", "_words", "_filled")


def line_fails(line: Column, own: Column, rules: LineRules = LineRules()) -> Column:
    """Whether the punctuation, navigation or boilerplate rules condemn a line, given its words; one without words never.

    Cheap counts that bound the exact ones from above come first.
    """
    n = F.size(own)
    some = lambda test: F.size(F.filter(own, test))
    shouting = line.contains("!!") & (some(lambda w: w.endswith("!!")) > rules.shouting * n)
    symbols = _count(line, SYMBOLS) > rules.symbols * F.char_length(line)
    unfinished = (n >= rules.unfinished) & ~line.rlike(SENTENCE_END)
    navigation = (_count(line, SEPARATORS) > rules.bars * n) & (some(lambda w: (F.char_length(w) == 1) & F.lit(SEPARATORS).contains(w)) > rules.bars * n)
    repeated = (F.size(F.array_distinct(own)) < (1 - rules.same) * n + 1) & (some(lambda w, i: F.coalesce(w == F.get(own, i + 1), F.lit(False))) > rules.same * n)
    boilerplate = (n <= rules.boilerplate) & F.lower(line).rlike("|".join(BOILERPLATE))
    return (n > 0) & (symbols | shouting | unfinished | navigation | repeated | boilerplate)


def cleaned(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Adds to each row of documents (doc_id, text, ...): the base columns, n_lines, n_failed_lines, lost (share of the
    text's word characters in failed lines), clean_text, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: false if
    base_failed or if the failed lines hold more than `rules.lost` of the word characters. A null text is empty, and
    empty texts fail; a line without a word is never failed and stays where it is. Rows are judged each by itself,
    however often a doc_id repeats; other columns are passed on, those of a name that is added here are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost", "clean_text", "base_failed", "kept"]
    out = _lines(documents.drop(*added))
    out = out.withColumn("_bad", F.zip_with("_all", "_line_words", lambda line, own: line_fails(line, own, rules)))
    out = _measured(out)
    failed = F.flatten(F.zip_with("_line_words", "_bad", lambda own, bad: F.when(bad, own).otherwise(F.array().cast("array<string>"))))
    out = out.withColumns(
        {
            "n_lines": F.size("_filled").cast("long"),
            "n_failed_lines": F.size(F.filter("_bad", lambda b: b)).cast("long"),
            "lost": F.char_length(F.array_join(failed, "")) / F.greatest(F.lit(1), F.col("word_chars")),
            "clean_text": F.array_join(F.zip_with("_all", "_bad", lambda line, bad: F.when(~bad, line)), "\n"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= rules.lost))
    return out.drop("_text", "_all", "_line_words", "_words", "_filled", "_bad")
