"""Chunkers: per-document state machines as pandas UDFs that return arrays of chunks.

Sizes are counted in words. Spark splits the documents over tasks; a function sees one document at a time. Helpers are pure Python on
one text; the UDFs are to be used with ``explode`` on few rows, the operators at the end (``parent_child_rows`` and the like) on tables of any size: a UDF's batch
of results is held at once, an operator gives chunks on in small slices.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.mentions import automaton, folded, occurrences
from .text import split_sentences

PARENT, CHILD, OVERLAP, SHORT = 1500, 800, 200, 400
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_SENTENCE_END = re.compile(r"[.!?]\s+")


def _n(text: str) -> int:
    return len(text.split())


def pack(parts: list[str], size: int, overlap: int, joiner: str) -> list[list[int]]:
    """Indexes of consecutive parts up to ``size`` words; each group begins with the last parts of the one before, up to ``overlap`` words.

    A part longer than ``size`` is a group of its own.
    """
    groups: list[list[int]] = []
    group, total = [], 0
    sizes = [_n(p) for p in parts]
    for i, n in enumerate(sizes):
        if group and total + n > size:
            groups.append(group)
            kept, carried = [], 0
            for j in reversed(group):
                if carried + sizes[j] > overlap or carried + sizes[j] + n > size:
                    break
                kept.insert(0, j)
                carried += sizes[j]
            group, total = kept, carried
        group.append(i)
        total += n
    return [*groups, group] if group else groups


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of words that cover the text; the last ends with it."""
    w = text.split()
    if len(w) <= size:
        return [" ".join(w)] if w else []
    return [" ".join(w[i : i + size]) for i in range(0, len(w) - overlap, size - overlap)]


def _units(text: str, size: int) -> list[str]:
    """Sentences, those over ``size`` cut into words."""
    return [piece for s in split_sentences(text) for piece in (windows(s, size, 0) if _n(s) > size else [s])]


def packed_sentences(text: str, size: int, overlap: int) -> list[str]:
    units = _units(text, size)
    return [" ".join(units[i] for i in g) for g in pack(units, size, overlap, " ")]


def parents_and_children(text: str, parent: int = PARENT, child: int = CHILD, overlap: int = OVERLAP, short: int = SHORT) -> list[dict]:
    """Parents of whole paragraphs (sentences, if there is only one paragraph), each with children of whole sentences.

    A last child under ``short`` words joins the one before it.
    """
    paragraphs = [p.strip() for p in text.split("\n") if p.strip()]
    units = paragraphs if len(paragraphs) > 1 else split_sentences(text)
    units = [piece for u in units for piece in (windows(u, parent, 0) if _n(u) > parent else [u])]
    joiner = "\n" if len(paragraphs) > 1 else " "
    out = []
    for number, group in enumerate(pack(units, parent, overlap, joiner)):
        body = joiner.join(units[i] for i in group)
        sentences = _units(body, child)
        groups = pack(sentences, child, overlap, " ")
        if len(groups) > 1 and sum(_n(sentences[i]) for i in groups[-1]) < short:
            last = groups.pop()
            groups[-1] = sorted({*groups[-1], *last})
        out.append({"idx": number, "text": body, "token_count": _n(body), "children": [" ".join(sentences[i] for i in g) for g in groups]})
    return out


def section_chunks(text: str, size: int = 800, overlap: int = 200) -> list[dict]:
    """Paragraphs packed inside the sections that headings ``#`` to ``######`` open; each chunk knows its path of headings.

    A first-level heading takes the place of the root.
    """
    path: list[tuple[int, str]] = [(0, "Document")]
    sections: list[tuple[list[str], list[str]]] = [(["Document"], [])]
    for line in text.split("\n"):
        heading = _HEADING.match(line)
        if heading:
            level = len(heading[1])
            path = [x for x in path if 0 < x[0] < level or x[0] == 0 and level > 1]
            path.append((level, heading[2]))
            sections.append(([name for _, name in path], []))
        elif line.strip():
            sections[-1][1].append(line.strip())
    out: list[dict] = []
    for names, paragraphs in sections:
        units = [piece for p in paragraphs for piece in (windows(p, size, 0) if _n(p) > size else [p])]
        for group in pack(units, size, overlap, "\n"):
            body = "\n".join(units[i] for i in group)
            out.append({"idx": len(out), "text": body, "token_count": _n(body), "section_path": names})
    return out


def entity_chunks(text: str, entities: list[str], around: int = 400, merge_gap: int = 500, least: int = 200, most: int = 1200, fill_gap: int = 1000, size: int = 800, overlap: int = 200, step: int = 100) -> list[dict]:
    """Chunks around mentions of entities, and plain chunks for what lies between.

    Mentions are widened by ``around`` characters to sentence ends, joined where gaps are at most ``merge_gap`` words, grown by ``step``
    characters to ``least`` words, split over ``most`` words; gaps of ``fill_gap`` words or more are chunked on their own. A chunk carries the
    entities that occur in it; the primary one has the longest name.
    """
    names = [e for e in dict.fromkeys(entities) if e and e.strip()]
    known = tuple(dict.fromkeys(folded(e) for e in names))
    machine = automaton(known)
    hits = sorted((start, end) for _, start, end in occurrences(text, machine))  # places in the text itself: folding keeps its length
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]

    def widened(a: int, b: int) -> tuple[int, int]:
        low, high = max(0, a - around), min(len(text), b + around)
        before, after = bisect_right(ends, low), bisect_left(ends, high)
        return ends[before - 1] if before else 0, ends[after] if after < len(ends) else len(text)

    spans: list[list[int]] = []
    for a, b in (widened(*h) for h in hits):
        if spans and (a <= spans[-1][1] or _n(text[spans[-1][1] : a]) <= merge_gap):
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for i, s in enumerate(spans):
        low = spans[i - 1][1] if i else 0
        high = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        while _n(text[s[0] : s[1]]) < least and (s[0] > low or s[1] < high):
            s[0], s[1] = max(low, s[0] - step), min(high, s[1] + step)
    out: list[tuple[int, str, str]] = []
    at = 0
    for a, b in [*spans, [len(text), len(text)]]:
        gap = text[at:a]
        if _n(gap) >= fill_gap or not spans and gap.strip():
            out += [(at, piece, "background") for piece in packed_sentences(gap, size, overlap)]
        body = text[a:b].strip()
        if body:
            out += [(a, piece, "entity") for piece in (packed_sentences(body, size, overlap) if _n(body) > most else [body])]
        at = b
    chunks = []
    for number, (_, body, kind) in enumerate(out):
        there = {known[number] for number, _, _ in occurrences(body, machine)}
        inside = [e for e in names if folded(e) in there]
        chunks.append({"idx": number, "text": body, "token_count": _n(body), "kind": kind, "entities": inside, "primary_entity": max(inside, key=len, default=None)})
    return chunks


def regex_sentence_chunks(text: str, size: int = 1000, carry: int = 2) -> list[str]:
    """Sentences cut at ``.!?`` and white space, packed to ``size`` words; the last two sentences are carried on."""
    parts = [p.strip() for p in _SENTENCE_END.split(text) if p.strip()]
    out, group = [], []
    for p in parts:
        if group and sum(map(_n, group)) + _n(p) > size:
            out.append(" ".join(group))
            group = group[-carry:] if sum(map(_n, group[-carry:])) + _n(p) <= size else []
        group.append(p)
    return [*out, " ".join(group)] if group else out


def resized(chunks: list[dict], low: int = 500, high: int = 1000, overlap: int = 100) -> list[dict]:
    """Chunks ``text, description`` under ``low`` words join the next one (the last: the one before); those over ``high`` are split."""
    merged: list[dict] = []
    for c in chunks:
        if merged and _n(merged[-1]["text"]) < low:
            before = merged[-1]
            merged[-1] = {"text": f"{before['text']} {c['text']}", "description": "; ".join(x for x in (before["description"], c["description"]) if x)}
        else:
            merged.append(dict(c))
    if len(merged) > 1 and _n(merged[-1]["text"]) < low:
        last = merged.pop()
        merged[-1] = {"text": f"{merged[-1]['text']} {last['text']}", "description": "; ".join(x for x in (merged[-1]["description"], last["description"]) if x)}
    return [{"text": piece, "description": c["description"]} for c in merged for piece in windows(c["text"], high, overlap)]


def batches(paragraphs: list[str], size: int = 3000, overlap: int = 200) -> list[str]:
    """Paragraphs in batches for one extraction each."""
    return ["\n\n".join(paragraphs[i] for i in g) for g in pack(paragraphs, size, overlap, "\n\n")]


# --- UDFs ---------------------------------------------------------------------------------------------------------

_INT, _TEXT = T.IntegerType(), T.StringType()
_TEXTS = T.ArrayType(_TEXT)


def _structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in fields.items()]))



@F.pandas_udf(_structs(idx=_INT, text=_TEXT, token_count=_INT, children=_TEXTS))
def parent_child_chunks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: parents_and_children(t or ""))


@F.pandas_udf(_structs(idx=_INT, text=_TEXT, token_count=_INT, section_path=_TEXTS))
def chunk_sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: section_chunks(t or ""))


@F.pandas_udf(_structs(idx=_INT, text=_TEXT, token_count=_INT, kind=_TEXT, entities=_TEXTS, primary_entity=_TEXT))
def chunk_around_entities(text: pd.Series, entities: pd.Series) -> pd.Series:
    return pd.Series([entity_chunks(t or "", list(e) if e is not None else []) for t, e in zip(text, entities, strict=True)], dtype=object)


@F.pandas_udf(_TEXTS)
def chunk_by_regex_sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: regex_sentence_chunks(t or ""))


@F.pandas_udf(_structs(text=_TEXT, description=_TEXT))
def resize_chunks(texts: pd.Series, descriptions: pd.Series) -> pd.Series:
    return pd.Series([resized([{"text": t, "description": x} for t, x in zip(a, b, strict=True)]) for a, b in zip(texts, descriptions, strict=True)], dtype=object)


@F.pandas_udf(_TEXTS)
def extraction_batches(text: pd.Series) -> pd.Series:
    return text.map(lambda t: batches([p.strip() for p in (t or "").split("\n") if p.strip()]))


def packed(size: int, overlap: int):
    """A UDF that packs sentences to ``size`` words with ``overlap``: (600, 200) and (800, 200) for background, (800, 100) as fallback."""

    @F.pandas_udf(_TEXTS)
    def f(text: pd.Series) -> pd.Series:
        return text.map(lambda t: packed_sentences(t or "", size, overlap))

    return f


# --- operators ----------------------------------------------------------------------------------------------------

#: Characters of chunks (about) that a task holds before it gives them on.
SLICE_CHARS = 1_000_000


def _characters(value: object) -> int:
    if isinstance(value, str):
        return len(value)
    if isinstance(value, (list, tuple, dict)):
        return sum(map(_characters, value.values() if isinstance(value, dict) else value))
    return 8


def by_slices(df: DataFrame, function: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """The rows that ``function`` makes of each row's values. What is given on is cut by ``SLICE_CHARS``, so that a task's memory does not grow with its rows."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    return df.mapInArrow(lambda batches: _sliced(batches, function, kinds), schema)


def _sliced(batches: Iterator[pa.RecordBatch], function: Callable[..., list[tuple]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    def cut(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    rows, held = [], 0
    for batch in batches:
        for values in zip(*batch.columns, strict=True):
            for made in function(*(v.as_py() for v in values)):
                rows.append(made)
                held += _characters(made)
                if held >= SLICE_CHARS or len(rows) == 10_000:
                    yield cut(rows)
                    rows, held = [], 0
    if rows:
        yield cut(rows)


def _chunks(df: DataFrame, fields: dict[str, str], function: Callable[..., list[dict]], key: str, *columns: str | Column) -> DataFrame:
    """``key`` and the fields of each chunk that ``function`` makes of a row's columns."""
    kind = df.schema[key].dataType.simpleString()

    def made(ident: object, *values: object) -> list[tuple]:
        return [(ident, *(c[f] for f in fields)) for c in function(*values)]

    return by_slices(df.select(key, *columns), made, ", ".join([f"{key} {kind}", *(f"{f} {t}" for f, t in fields.items())]))


def parent_child_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, idx, text, token_count, children``: a row for each parent chunk."""
    return _chunks(df, {"idx": "int", "text": "string", "token_count": "int", "children": "array<string>"}, lambda t: parents_and_children(t or ""), key, text)


def section_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, idx, text, token_count, section_path``: a row for each chunk of a section."""
    return _chunks(df, {"idx": "int", "text": "string", "token_count": "int", "section_path": "array<string>"}, lambda t: section_chunks(t or ""), key, text)


def entity_rows(df: DataFrame, key: str, entities: Column, text: str = "text") -> DataFrame:
    """``key, idx, text, token_count, kind, entities, primary_entity``: a row for each chunk around entities or between."""
    fields = {"idx": "int", "text": "string", "token_count": "int", "kind": "string", "entities": "array<string>", "primary_entity": "string"}
    return _chunks(df, fields, lambda t, e: entity_chunks(t or "", e or []), key, text, entities.alias("entities"))


def regex_rows(df: DataFrame, key: str, label: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """``key, idx, text, description``: regex sentence chunks, labelled and then resized."""
    kind = df.schema[key].dataType.simpleString()
    parts = by_slices(df.select(key, text), lambda k, t: [(k, regex_sentence_chunks(t or ""))], f"{key} {kind}, chunks array<string>")

    def joined(chunks: list[str], labels: list[str]) -> list[dict]:
        made = resized([{"text": c, "description": x} for c, x in zip(chunks, labels, strict=True)])
        return [{"idx": i, **c} for i, c in enumerate(made)]

    return _chunks(parts, {"idx": "int", "text": "string", "description": "string"}, joined, key, "chunks", F.transform("chunks", label).alias("labels"))


def batch_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, batches``: a row for each document, with the texts of its extraction batches."""
    kind = df.schema[key].dataType.simpleString()
    return by_slices(df.select(key, text), lambda k, t: [(k, batches([p.strip() for p in (t or "").split("\n") if p.strip()]))], f"{key} {kind}, batches array<string>")


def chunk_id(document_id: Column, idx: Column) -> Column:
    return F.concat(F.lit("chunk_"), document_id, F.lit("_"), idx.cast("string"))
