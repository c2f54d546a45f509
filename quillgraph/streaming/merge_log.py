"""An idempotent merge of batches that may be delivered more than once, or break off: a log of changes with a commit file for each batch.

A batch's rows are written to a folder of their own, and count from the moment its commit file stands, which is written beside and renamed. A batch whose number
is committed is skipped; what a batch that broke off has written is never read. Nothing is overwritten in place, so readers see whole
batches at all times. ``compact`` folds the log to one folder, under a commit of its own, and ``vacuum`` removes folders that no commit names.

State of a key: the last row of the last batch that has it, up to the first batch that leaves it with the status ``ready``; later rows of such a key are
skipped. ``created_at`` is the time of the first batch that had the key, ``updated_at`` of the last that counted.

Defined results: rows without key are dropped; of several rows of a key in a batch the last by the order columns counts (nulls first); an empty batch is committed
and changes nothing; a log without commits is an empty table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.graph import union_all

READY = "ready"


class MergeLog:
    """``schema``: of the rows that are merged, with column ``key``; ``order``: which of a batch's rows of one key is the last."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", order: tuple[str, ...] = (), status: str = "status"):
        self.spark, self.path, self.schema, self.key, self.order, self.status = spark, path.rstrip("/"), schema, key, order, status
        self._stored = StructType(list(schema.fields)).add("_batch", "long").add("_created", "timestamp").add("_updated", "timestamp")

    # --- files: names and small texts alone; rows go through Spark -----------------------------------------------------

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        fs = self._files()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._at(folder))) if fs.exists(self._at(folder)) else []

    def _commit(self, name: str, content: dict) -> bool:
        """Whether this commit now stands, and did not before."""
        fs = self._files()
        if fs.exists(self._at(f"commits/{name}")):
            return False
        beside = self._at(f"commits/.{uuid.uuid4().hex}")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return bool(fs.rename(beside, self._at(f"commits/{name}")))

    def _commits(self) -> Iterator[tuple[int, bool, dict]]:
        """``number, whether it folds all before it, content`` of the commits that count, in order."""
        names = [n for n in self._listed("commits") if not n.startswith(".")]
        folds = [int(n[5:]) for n in names if n.startswith("fold-")]
        base = max(folds, default=-1)
        wanted = [(int(n[6:]), False, n) for n in names if n.startswith("batch-") and int(n[6:]) > base]
        if folds:
            wanted.insert(0, (base, True, f"fold-{base:019}"))
        texts = {r.name.rsplit("/", 1)[-1]: json.loads(r.text) for r in self._texts([n for *_, n in wanted])}
        for number, folded, name in sorted(wanted):
            yield number, folded, texts[name]

    def _texts(self, names: list[str]) -> list:
        if not names:
            return []
        read = self.spark.read.text([f"{self.path}/commits/{n}" for n in names], wholetext=True)
        return read.select(F.input_file_name().alias("name"), F.col("value").alias("text")).collect()  # one line for each batch since the last fold

    # --- the log -------------------------------------------------------------------------------------------------------

    def has(self, number: int) -> bool:
        names = self._listed("commits")
        return f"batch-{number:019}" in names or any(n.startswith("fold-") and int(n[5:]) >= number for n in names)

    def append(self, batch: DataFrame, number: int, at: datetime) -> bool:
        """Merges a batch, unless its number is known already."""
        if self.has(number):
            return False
        folder = f"rows-{number:019}-{uuid.uuid4().hex}"
        last = Window.partitionBy(self.key).orderBy(*[F.col(c).desc_nulls_last() for c in self.order or (self.key,)])
        rows = batch.where(F.col(self.key).isNotNull()).select(*self.schema.names).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        time = F.lit(at).cast("timestamp")
        rows.withColumns({"_batch": F.lit(number).cast("long"), "_created": time, "_updated": time}).write.parquet(f"{self.path}/{folder}")
        return self._commit(f"batch-{number:019}", {"folder": folder})

    def _rows(self) -> DataFrame:
        folders = [c["folder"] for _, _, c in self._commits()]
        if not folders:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*[f"{self.path}/{f}" for f in folders])

    def _state(self) -> DataFrame:
        ready = F.min(F.when(F.col(self.status) == READY, F.col("_batch"))) if self.status in self.schema.names else F.lit(None).cast("long")
        # a row for each key and batch: the groups are as long as the log since its last fold
        keys = Window.partitionBy(self.key)
        rows = self._rows().withColumn("_ready", ready.over(keys) if self.status in self.schema.names else ready)
        counted = rows.where(F.col("_ready").isNull() | (F.col("_batch") <= F.col("_ready")))
        created = F.min("_created").over(keys)
        ranked = counted.withColumn("_created", created).withColumn("_n", F.row_number().over(keys.orderBy(F.desc("_batch"))))
        return ranked.where("_n = 1").select(*self._stored.names)

    def table(self) -> DataFrame:
        """The merged rows, with ``created_at`` and ``updated_at``."""
        return self._state().select(*self.schema.names, F.col("_created").alias("created_at"), F.col("_updated").alias("updated_at"))

    def compact(self) -> bool:
        """Folds all committed batches to one folder. Batches that are committed meanwhile have higher numbers and stay."""
        numbers = [n for n, *_ in self._commits()]
        if not numbers or self._commits_folded(numbers):
            return False
        folder = f"fold-{numbers[-1]:019}-{uuid.uuid4().hex}"
        self._state().write.parquet(f"{self.path}/{folder}")
        return self._commit(f"fold-{numbers[-1]:019}", {"folder": folder})

    def _commits_folded(self, numbers: list[int]) -> bool:
        return len(numbers) == 1 and f"fold-{numbers[0]:019}" in self._listed("commits")

    def vacuum(self) -> list[str]:
        """Removes what no commit that counts names: batches that broke off, and folders that were folded. No reader or writer may be at work."""
        kept = {c["folder"] for _, _, c in self._commits()}
        gone = [n for n in self._listed("") if n.split("-")[0] in ("rows", "fold") and n not in kept]
        for name in gone:
            self._files().delete(self._at(name), True)
        return gone

    def merging(self, stream: DataFrame, clock=datetime.now) -> DataStreamWriter:
        """A sink that merges each micro-batch; one that is repeated after a failure is skipped if it was committed."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.append(batch, number, clock()))


def merged(logs: list[MergeLog]) -> DataFrame:
    """The tables of several logs, one after the other."""
    return union_all([log.table() for log in logs])
