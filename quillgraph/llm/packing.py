"""Packing: concatenate and cut.

Pass 1 tokenizes each input split once, with a running sum of tokens, and writes ids and local offsets to the
shared folder. The splits' totals (one number a task) give every split its global offset. Pass 2 reads the written ids,
cuts them at multiples of the sequence length and emits one record for each piece; a piece that goes on from the
sequence before or into the next is marked. No row is shuffled, so no key can be hot, and only the very last sequence
is not full.

Defined results: a null or empty text has the end token alone; repeated rows are packed each; the empty table gives
an empty table; columns besides the key and text are ignored. A document longer than a sequence spans several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written

_encoders: dict[str, object] = {}


def encoder(path: str):
    """A function from text to an array of ids, kept for the worker's life: what tokenizers gives at its defaults without special tokens added.

    ``.json``: tokenizers. ``.tiktoken``: the vocabulary of the ``.json`` beside it as ranks, several times as fast; texts
    that ranks cannot do alike (those with an added token, or with white space too long for the pattern) go to the ``.json``.
    """
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import base64
            import json

            import public_tokenizers
            import tiktoken

            whole = path.removesuffix(".tiktoken") + ".json"
            with open(whole, "rb") as file:
                added = [token["content"] for token in json.load(file)["added_tokens"]]
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def encode(text: str) -> np.ndarray:
                if any(token in text for token in added):
                    return encoder(whole)(text)
                try:
                    return np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
                except ValueError:  # the pattern's stack ends at about a million white-space characters in a row
                    return encoder(whole)(text)

            _encoders[path] = encode
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _encoders[path] = lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return _encoders[path]


def tokenized(df: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Pass 1: ``part, local_start, doc_id, n, ids``, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            idents, texts = batch.column(0), batch.column(1)
            for first in range(0, batch.num_rows, 512):
                ids = [np.concatenate([encode(t.as_py()), end]) if t.is_valid else end for t in texts[first : first + 512]]
                counts = np.array([len(x) for x in ids], dtype="i8")
                ends = at + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part), pa.int32()),
                        pa.array(ends - counts),
                        idents[first : first + 512],
                        pa.array(counts),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["part", "local_start", "doc_id", "n", "ids"],
                )
                at = int(ends[-1])

    kind = df.schema[key].dataType.simpleString()
    return written(df.select(key, text).mapInArrow(run, f"part int, local_start long, doc_id {kind}, n long, ids binary"), "tokens", group_mb=16)


def cut(tokens: DataFrame, length: int) -> DataFrame:
    """Pass 2: one row a piece, with its ids. ``tokens`` must be a written table: the parts must not change.

    The splits' totals come to the driver: one row for each task of pass 1, like the task's own status.
    """
    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("n")).orderBy("part").collect()
    first, at = {}, 0
    for row in totals:
        first[row.part] = at
        at += row.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, locals_, idents, counts, ids = batch.columns
            rows: list[tuple] = []
            for part, local, ident, n, data in zip(parts.to_pylist(), locals_.to_pylist(), idents.to_pylist(), counts.to_pylist(), ids, strict=True):
                begin, raw = first[part] + local, data.as_buffer()
                start = 0
                while start < n:
                    sequence, offset = divmod(begin + start, length)
                    size = min(n - start, length - offset)
                    rows.append((ident, start, size, n, sequence, offset, start > 0, start + size < n, raw.slice(4 * start, 4 * size).to_pybytes()))
                    start += size
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [idents.type] + [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "continues", "continued", "ids"]
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, continues boolean, continued boolean, ids binary"
    return tokens.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    return cut(tokenized(df, key, text, tokenizer_path, end_id), length)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select(
        F.col("doc_id").cast("long").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "continues", "continued",
    )


def query_over(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_over(table(spark, sf_dir, "documents"))
