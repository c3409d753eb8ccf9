"""Tokenisers and string scalars as Column expressions (all in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word's edges: no letter, digit or underscore of any script beside it. Not \b, whose meaning differs between JDKs.
START, STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
TERM = rf"{START}[a-z0-9]+(?:[-'][a-z0-9]+)*{STOP}"


def term_tokens(text: Column) -> Column:
    """Frequency tokens: lower-case runs of letters and digits, with inner hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """Whole words made of a-z only, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{START}[a-z]+{STOP}"), F.lit(0))


def vector_tokens(text: Column) -> Column:
    """Words of two or more letters, digits or underscores of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def stem_tokens(text: Column) -> Column:
    """The distinct words of three or more letters a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"{START}[a-z]{{3,}}{STOP}"), F.lit(0)))


def index_words(text: Column) -> Column:
    """Runs of a-z and digits of length two or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)


def cased_tokens(text: Column) -> Column:
    """Runs of letters, case kept; an apostrophe splits."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def phrase_count(text: Column, pattern: str = r"\bmost\s+likely\b") -> Column:
    return F.regexp_count(text, F.lit(f"(?i){pattern}"))


def per_thousand(hits: Column, tokens: Column) -> Column:
    """Zero without tokens; rounded half up at four places, the same in every engine."""
    rate = F.when(tokens > 0, 1000.0 * hits / tokens).otherwise(0.0)
    return round4(rate)


def round4(x: Column) -> Column:
    return F.floor(x * 10000.0 + 0.5) / 10000.0


def contains_entity(text: Column, entity: Column) -> Column:
    """Substring if the entity has a blank or hyphen or is shorter than two; else a whole word of ASCII letters and digits."""
    low = F.lower(text)
    plain = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), entity, F.lit(" ")))
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), entity, F.lit(r"\E(?![a-z0-9])"))
    word = F.when(entity.rlike("^[a-z0-9]+$"), plain).otherwise(F.regexp_like(low, quoted))
    return F.when(entity.rlike("[ -]") | (F.length(entity) < 2), F.instr(low, entity) > 0).otherwise(word)


def entity_span(text: Column, entity: Column) -> Column:
    """struct(start, stop) of the entity's first occurrence, in characters from 0, by the rule of ``contains_entity``; null without one."""
    low, e = F.lower(text), F.lower(F.trim(entity))
    word = F.concat(F.lit(r"(?<![a-z0-9])\Q"), e, F.lit(r"\E(?![a-z0-9])"))
    at = F.when(e.rlike("[ -]") | (F.length(e) < 2), F.instr(low, e)).otherwise(F.regexp_instr(low, word)) - 1
    return F.when((e != "") & (at >= 0), F.struct(at.alias("start"), (at + F.length(e)).alias("stop")))


def surrounding_sentence(text: Column, entity: Column, max_chars: int = 320) -> Column:
    """What stands around the entity's first occurrence between ends of sentences: one of .!?, closing quotes and brackets, white space.

    White space is collapsed, long text cut with an ellipsis; empty without an occurrence."""
    span = entity_span(text, entity)
    left, right = F.substring(text, F.lit(1), span["start"]), F.substring(text, span["stop"] + 1, F.length(text))
    closing = r"[\"')\]}]*"
    before = F.regexp_replace(left, rf"(?s)^.*[.!?](?={closing}[ \n\t\r])", "")
    after = F.regexp_extract(right, rf"(?s)^(.*?[.!?]{closing})(?:[ \n\t\r]|\z)", 1)
    whole = F.concat(before, F.substring(text, span["start"] + 1, span["stop"] - span["start"]), F.when(after != "", after).otherwise(right))
    flat = F.regexp_replace(F.regexp_replace(whole, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.coalesce(F.when(F.length(flat) > max_chars, F.concat(F.substring(flat, 1, max_chars - 1), F.lit("…"))).otherwise(flat), F.lit(""))


def excerpt(text: Column, max_chars: int) -> Column:
    """The text's beginning, with an ellipsis where it goes on."""
    flat = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(flat) > max_chars, F.concat(F.substring(flat, 1, max_chars), F.lit("…"))).otherwise(flat)


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case letters and digits joined by underscores; an ampersand reads as "and"; "category" if nothing is left."""
    flat = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "_")
    cut = F.substring(F.regexp_replace(flat, "^_+|_+$", ""), 1, most)
    return F.when(cut == "", "category").otherwise(cut)


def case_pair_slug(a: Column, b: Column) -> Column:
    """Two cases' numbers with three digits, the smaller first."""
    one = lambda c: F.coalesce(F.lpad(F.regexp_extract(c, r"0*(\d+)", 1).try_cast("int").cast("string"), 3, "0"), F.substring(F.regexp_replace(c, r"\W+", "_"), 1, 20))
    return F.concat_ws("_", F.least(one(a), one(b)), F.greatest(one(a), one(b)))


def truncated(text: Column, n: int) -> Column:
    flat = F.trim(text)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def depth_label(a: Column, b: Column) -> Column:
    by = lambda side: F.concat(F.lit(f"{side} more specific by "), F.abs(a - b).cast("string"), F.lit(" levels"))
    return F.when(a > b, by("A")).when(a < b, by("B")).otherwise("Same depth")


def parsed_int(text: Column) -> Column:
    return F.expr("try_cast(try_cast(`{0}` AS DOUBLE) AS INT)".format(text)) if isinstance(text, str) else text.try_cast("double").try_cast("int")
