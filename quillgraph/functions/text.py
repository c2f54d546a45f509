"""Text functions. All but Unicode normalisation and the sentence fold are built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations that end no sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof sr jr vs etc inc ltd corp eg ie al fig vol no pp ed rev gen col lt capt sgt ph st ave blvd".split())
STOP_WORDS = frozenset("the this that these those and but for with from into over under about after before when where which while what there their they then than".split())

# Typographic characters and what stands for them in plain output.
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "•": "*", " ": " ", "→": "->", "≤": "<=", "≥": ">="}


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def n_tokens(text: Column) -> Column:
    return F.size(words(text))


def first_words(text: Column, n: int) -> Column:
    w = words(text)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, "...").otherwise(""))


#: Words of an extractive summary by its kind.
SUMMARY_WORDS = {"brief": 100, "standard": 250, "detailed": 500}


def summary(text: Column, kind: str = "standard") -> Column:
    return F.concat(F.lit("Summary: "), first_words(text, SUMMARY_WORDS[kind]))


def chunk_label(text: Column) -> Column:
    """The text before the first full stop, cut to 60 characters."""
    first = F.trim(F.substring_index(text, ".", 1))
    return F.when(F.length(first) > 60, F.concat(F.substring(first, 1, 60), F.lit("..."))).otherwise(first)


def size_ok(tokens: Column, low: int = 500, high: int = 1000) -> Column:
    return tokens.between(low, high)


def word_windows(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Overlapping windows of words; the last one ends with the text, and no word is lost."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    w = words(text)
    n = F.size(w)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(size - overlap)))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))


def salvage_array(text: Column) -> Column:
    """The nested string array between the first ``[`` and the last ``]``; empty if it cannot be read."""
    inner = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(inner, "array<array<string>>"), F.array().cast("array<array<string>>"))


def salvage_object(text: Column) -> Column:
    """The JSON object in a text: from a fenced block if there is one, else from the first ``{`` to the last ``}``; null if none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.when(fenced != "", fenced).otherwise(bare))


def labelled_section(text: Column, name: str, others: tuple[str, ...]) -> Column:
    """What follows ``NAME:`` up to the next of the other names or the end."""
    stop = "|".join(rf"{o}\s*:" for o in others)
    found = F.regexp_extract(text, rf"(?is)\b{name}\s*:\s*(.*?)(?=(?:\b(?:{stop}))|\z)", 1)
    return F.regexp_replace(found, r"\s+\z", "")


def bullets(section: Column) -> Column:
    return F.transform(F.regexp_extract_all(section, F.lit(r"(?m)^\s*[-*•]\s*(.+)$"), 1), lambda x: F.trim(x))


def query_hash(query: Column) -> Column:
    """Of the query in lower case, without punctuation and surplus white space."""
    bare = F.regexp_replace(F.lower(query), r"(?U)[^\w\s]", "")
    return F.sha2(F.trim(F.regexp_replace(bare, r"\s+", " ")), 256)


def answer_hash(answer: Column) -> Column:
    return F.sha2(F.substring(answer, 1, 500), 256)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def plain(text: Column) -> Column:
    """Typographic characters replaced, and what Latin-1 lacks as ``?``."""
    for char, instead in PLAIN.items():
        text = F.replace(text, F.lit(char), F.lit(instead))
    return F.regexp_replace(text, r"[^\x00-\xFF]", "?")


def safe_filename(name: Column, suffix: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(name, "[^A-Za-z0-9]", "_"), 1, 50), F.lit("_"), suffix)


def pipe_table(header: Column, rows: Column) -> Column:
    """A table (array of cells, array of arrays of cells) as lines with pipes; newlines in cells become spaces."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))

    rule = line(F.transform(header, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def stub_entities(text: Column) -> Column:
    """Of the first 50 words the first five alphabetic ones longer than five characters."""
    return F.slice(F.filter(F.slice(words(text), 1, 50), lambda w: (F.length(w) > 5) & w.rlike(r"^\p{L}+$")), 1, 5)


def capitalised_terms(text: Column, limit: int = 20) -> Column:
    """Runs of one or two capitalised words of three letters or more, no stop words, each once and in order. Punctuation is no part of them, other than in ``first_terms``."""
    stops = "|".join(sorted(w.capitalize() for w in STOP_WORDS))
    runs = F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}})(?!(?:{stops})(?!\p{{L}}))(\p{{Lu}}\p{{L}}{{2,}}(?: \p{{Lu}}\p{{L}}+)?)"), 1)
    return F.slice(F.array_distinct(runs), 1, limit)


# Words that begin no term.
COMMON_WORDS = ("the", "and", "for", "with", "that")


def first_terms(text: Column, limit: int = 20) -> Column:
    """The first ``limit`` terms: a capitalised word of three characters or more that is not common, with the next word if that is capitalised too.

    A word that has been part of a term begins no other. One fold over the words, which remembers no more than the terms' words.
    """
    all_words = words(text)
    pairs = F.zip_with(all_words, F.slice(all_words, 2, F.greatest(F.size(all_words) - 1, F.lit(0))), lambda w, after: F.struct(w.alias("w"), F.coalesce(after, F.lit("")).alias("after")))
    begins = F.filter(pairs, lambda p: (F.length(p["w"]) >= 3) & p["w"].rlike(r"^\p{Lu}") & ~F.lower(p["w"]).isin(*COMMON_WORDS))
    none = F.array().cast("array<string>")

    def take(state: Column, p: Column) -> Column:
        two = p["after"].rlike(r"^\p{Lu}")
        term = F.when(two, F.concat_ws(" ", p["w"], p["after"])).otherwise(p["w"])
        seen = F.concat(state["seen"], F.when(two, F.array(p["w"], p["after"])).otherwise(F.array(p["w"])))
        full = F.size(state["terms"]) >= limit
        return F.when(full | F.array_contains(state["seen"], p["w"]), state).otherwise(F.struct(F.concat(state["terms"], F.array(term)).alias("terms"), seen.alias("seen")))

    return F.aggregate(begins, F.struct(none.alias("terms"), none.alias("seen")), take, lambda state: state["terms"])


def triggered_entities(text: Column, triggers: dict[str, str]) -> Column:
    """Entities whose trigger word occurs in the text, in the order given."""
    found = [F.when(F.lower(text).contains(word), F.lit(name)) for word, name in triggers.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def chain_relations(names: Column) -> Column:
    """First to second: RELATED_TO 0.75; second to third: USES 0.65."""
    kind = "struct<source:string,target:string,type:string,confidence:double>"

    def edge(i: int, name: str, confidence: float) -> Column:
        return F.when(F.size(names) > i + 1, F.struct(names[i].alias("source"), names[i + 1].alias("target"), F.lit(name).alias("type"), F.lit(confidence).alias("confidence")).cast(kind))

    return F.filter(F.array(edge(0, "RELATED_TO", 0.75), edge(1, "USES", 0.65)), lambda x: x.isNotNull())


# --- what needs Python --------------------------------------------------------------------------------------------

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f​﻿]")
_NUMBER = re.compile(r"\d+\.\d*$")


def normalised_text(text: str | None) -> str | None:
    if text is None:
        return None
    return " ".join(_CONTROL.sub("", unicodedata.normalize("NFKC", text)).split())


def split_sentences(text: str | None) -> list[str]:
    """Word by word: a sentence ends at ``.!?`` unless the word is an abbreviation or a decimal number, or a lower-case word follows a full stop."""
    found, open_words = [], []
    tokens = (text or "").split()
    for word, after in zip(tokens, [*tokens[1:], ""], strict=False):
        open_words.append(word)
        if word[-1] not in ".!?" or word.rstrip(".!?,;:").lower() in ABBREVIATIONS or _NUMBER.match(word.rstrip(".!?")) or word[-1] == "." and after[:1].islower():
            continue
        found.append(" ".join(open_words))
        open_words = []
    return [*found, " ".join(open_words)] if open_words else found


_QUERY_MARKS = re.compile(r"[^\w\s\-'\".?!]")


@F.pandas_udf(T.StringType())
def normalise(text: pd.Series) -> pd.Series:
    """NFKC, control characters out, one space between words."""
    return text.map(normalised_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalise_query(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(_QUERY_MARKS.sub("", unicodedata.normalize("NFKC", t).lower()).split()), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(text: pd.Series) -> pd.Series:
    return text.map(split_sentences)
