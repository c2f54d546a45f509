"""Mentions of a dictionary of names in texts: one pass over each text, whatever the number of names.

The different names, folded, are dealt to pieces of a bounded size. For each piece every task builds an Aho-Corasick automaton, runs its texts through it and gives
all places where a name of the piece stands. The driver holds one piece at a time; a text is one row's work; entities that share a name share its mentions.

Folding is by character, so that places in the folded text are places in the text: a character whose small form is several characters stands for itself.

Defined results: null or blank names are found nowhere, names are trimmed; null texts have no mentions; mentions of different names may overlap, those of
one name do not (the first from the left counts); ``whole_words`` asks that no letter or digit touches the mention; equal rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .graph import settled

#: Characters of names that are searched at once.
PIECE_CHARS = 4_000_000


def folded(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@F.pandas_udf(StringType())
def folded_name(names: pd.Series) -> pd.Series:
    """The form in which ``find`` gives names."""
    return names.map(lambda x: folded(x.strip()), na_action="ignore")


def automaton(names: tuple[str, ...]) -> ahocorasick.Automaton:
    """Of folded names that are not empty; its values are their numbers."""
    found = ahocorasick.Automaton()
    for i, name in enumerate(names):
        found.add_word(name, (i, len(name)))
    found.make_automaton()
    return found


def occurrences(text: str, names: ahocorasick.Automaton, whole_words: bool = False) -> Iterator[tuple[int, int, int]]:
    """``number, start, end`` of each mention, by its end."""
    if not len(names):
        return
    low = folded(text)
    free: dict[int, int] = {}
    for last, (number, length) in names.iter(low):
        start, end = last + 1 - length, last + 1
        if whole_words and (start and low[start - 1].isalnum() or end < len(low) and low[end].isalnum()):
            continue
        if start >= free.get(number, 0):
            free[number] = end
            yield number, start, end


@lru_cache(maxsize=2)
def _kept(names: tuple[str, ...]) -> ahocorasick.Automaton:
    """A worker's tasks of one piece share its automaton."""
    return automaton(names)


def find(texts: DataFrame, names: DataFrame, whole_words: bool = False, key: str = "id", text: str = "text", name: str = "name", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``id, name, start, end`` for each mention in ``texts`` of a name of ``names``; ``name`` as it is folded. Joined by that, it leads to entities (``folded_name``)."""
    spark = texts.sparkSession
    kind = texts.schema[key].dataType.simpleString()
    known = names.select(folded_name(F.col(name)).alias("name")).where(F.col("name") != "").distinct()
    known = settled(known.withColumn("length", F.length("name")))
    total = known.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    pieces = -(-total // piece_chars)
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    parts = []
    for piece in range(pieces):
        mine = tuple(r.name for r in known.where(F.pmod(F.xxhash64("name"), F.lit(pieces)) == piece).select("name").collect())  # about piece_chars: checked above
        parts.append(rows.mapInArrow(_search(spark.sparkContext.broadcast(mine), whole_words), f"id {kind}, name string, start int, end int"))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], f"id {kind}, name string, start int, end int")) if len(parts) != 1 else parts[0]


def _search(names, whole_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = names.value
        machine = _kept(words)
        for batch in batches:
            ids, found, rows = batch.column(0), [], []
            for at, text in enumerate(batch.column(1)):
                for number, start, end in occurrences(text.as_py(), machine, whole_words):
                    rows.append(at)
                    found.append((words[number], start, end))
                    if len(found) == 65_536:
                        yield _rows(ids, rows, found)
                        rows, found = [], []
            if found:
                yield _rows(ids, rows, found)

    return run


def _rows(ids: pa.Array, at: list[int], found: list[tuple]) -> pa.RecordBatch:
    name, start, end = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["id", "name", "start", "end"])
