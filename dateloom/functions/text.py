"""Text expressions: normalisation, hints, matches with offsets, clean-up for annotators, JSON from model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dateloom.functions import patterns as P


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs; null counts as no."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def group(text: Column, pattern: str, k: int) -> Column:
    """Group k of the first match; null if there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f reads it: Column code else repeats its expression."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(text: Column) -> Column:
    """Without white space (in the Unicode sense) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ascii_width(text: Column) -> Column:
    """Full-width digits and signs as ASCII, stripped; null is ''."""
    return strip(F.translate(F.coalesce(text, F.lit("")), P.FULL_WIDTH, P.HALF_WIDTH))


def prefer_hint(title: Column) -> Column:
    """future, past or current_period, by hint words anywhere in the title, also within words."""
    return F.when(has(title, P.FUTURE), "future").when(has(title, P.PAST), "past").otherwise("current_period")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<text, start>> of all matches of a pattern that never matches empty; start counts code points.

    Where the text between matches is known, offsets are sums of lengths, so no UDF is needed.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.char_length(x))
    start = lambda x, i: total(F.slice(x["between"], 1, i + 1)) + total(F.slice(x["found"], 1, i))
    # bound: a lambda's code reads again for each match what it names from outside
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("between"))
    located = bound(both, lambda x: F.transform(x["found"], lambda m, i: F.struct(strip(m).alias("text"), start(x, i).alias("start"))))
    empty = F.array().cast("array<struct<text:string,start:int>>")
    return F.when(has(text, pattern), located).otherwise(empty)


def annotator_text(text: Column) -> Column:
    """A headline as an annotator wants it: one line, no control characters, a full stop at the end; 'Empty.' for none."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n\t]+", " ")
    clean = strip(F.regexp_replace(F.regexp_replace(flat, r"[\x00-\x1F\x7F]", ""), r"(?U)\s+", " "))
    ended = F.when((clean == "") | clean.endswith("."), clean).otherwise(F.concat(clean, F.lit(".")))
    return F.when(F.coalesce(text, F.lit("")) == "", "Empty.").otherwise(ended)


def annotator_input(text: Column, published: Column) -> Column:
    """annotator_text with the publication date; texts under 20 characters get the longer phrase."""
    clean, day = annotator_text(text), F.date_format(published, "yyyy-MM-dd")
    phrase = F.when(F.char_length(clean) < 20, " This news was published on ").otherwise(" Published on ")
    return F.concat(clean, phrase, day, F.lit("."))


def json_array_text(reply: Column) -> Column:
    """The JSON array in a model's reply: code fences go, then from the first [ to the last ], else the whole text."""
    bare = strip(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?m)```(?:json)?", ""))
    return F.coalesce(group(bare, r"(?s)\[.*\]", 0), bare)


def reply_text(payload: Column) -> Column:
    """The `response` of a generate call; null if it is empty or not done."""
    done = F.get_json_object(payload, "$.done")
    return F.when(F.coalesce(done, F.lit("true")) != "false", F.nullif(strip(F.get_json_object(payload, "$.response")), F.lit("")))
