"""Text cleaning, sentences, chunks, snippets and recovery of JSON from prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations whose full stop ends no sentence: fixed values.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Prof", "mg", "mcg", "vs", "approx", "e.g", "i.e", "U.S")
ABBREVIATION_PATTERN = r"\b(" + "|".join(ABBREVIATIONS).replace(".", r"\.") + r")\."
#: Sections that are read first: fixed values.
PRIORITY_SECTIONS = ("boxed_warning", "warnings_and_precautions", "drug_interactions", "contraindications", "adverse_reactions", "interaction", "cyp450")


def clean(text: Column) -> Column:
    """Control characters and runs of white space become one space."""
    printable = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.trim(F.regexp_replace(printable, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Array of sentences: cut after ``.``, ``!`` or ``?`` where white space and a capital follow."""
    guarded = F.regexp_replace(text, ABBREVIATION_PATTERN, "$1\u0001")
    cut = F.split(F.regexp_replace(guarded, r"([.!?])\s+([A-Z])", "$1\u0002$2"), "\u0002")
    return F.filter(F.transform(cut, lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: s != "")


def chunks(text: Column, target: int = 1000, ceiling: int = 1400, floor: int = 80) -> Column:
    """Sentences packed into chunks; each chunk but the first repeats the sentence before it.

    A chunk closes when the next sentence would pass ``ceiling``, or when it
    has reached ``target``. Lengths count letters without the joining spaces.
    Texts up to the ceiling stay whole; chunks under ``floor`` go.
    """
    def packed(found: Column) -> Column:
        """Spans of sentences (first, number): places only, so that no text is copied on the way."""
        spans = F.array().cast("array<struct<a:int,n:int>>")
        start = F.struct(spans.alias("done"), F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit(0).alias("size"))

        def add(state: Column, sentence: Column) -> Column:
            here, now = state["i"], F.length(sentence)
            full = (here > state["a"]) & ((state["size"] + now > ceiling) | (state["size"] >= target))
            closed = F.concat(state["done"], F.array(F.struct(state["a"].alias("a"), (here - state["a"]).alias("n"))))
            return F.struct(
                F.when(full, closed).otherwise(state["done"]).alias("done"),
                F.when(full, here - 1).otherwise(state["a"]).alias("a"),
                (here + 1).alias("i"),
                F.when(full, F.length(F.get(found, here - 1)) + now).otherwise(state["size"] + now).alias("size"),
            )

        def close(state: Column) -> Column:
            rest = F.array(F.struct(state["a"].alias("a"), (state["i"] - state["a"]).alias("n")))
            return F.when(state["i"] > 0, F.concat(state["done"], rest)).otherwise(state["done"])

        return F.transform(F.aggregate(found, start, add, close), lambda p: F.array_join(F.slice(found, p["a"] + 1, p["n"]), " "))

    # The sentences are bound once, as the only element of an array.
    split = F.get(F.transform(F.array(sentences(text)), packed), F.lit(0))
    whole = F.when(F.length(text) <= ceiling, F.array(text)).otherwise(split)
    return F.filter(whole, lambda c: F.length(c) >= floor)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def content_hash(text: Column) -> Column:
    return F.sha1(F.lower(text).cast("binary"))


def snippet(text: Column, most: int = 280) -> Column:
    """At most ``most`` letters on one line, with an ellipsis where cut."""
    flat = clean(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("...")))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def json_object(reply: Column) -> Column:
    """The outermost braces of a reply, with or without a code fence or prose around; null if there are none."""
    bare = F.regexp_replace(reply, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def without_null_words(text: Column) -> Column:
    """Null for the words that stand for a missing value."""
    return F.when(~F.lower(F.trim(text)).isin("null", "none", "n/a", ""), text)


def quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))


def distinct_ignoring_case(terms: Column) -> Column:
    """Terms in order without later repeats that differ in case only."""
    lowered = F.transform(terms, F.lower)
    return F.filter(terms, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)
