"""What the operators of this subpackage share: the scratch folder, written tables, table access and groups of repeated rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts count it: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Repeated rows are handled as groups; a larger group is cut to chunks of so many rows, which other tasks may take.
CHUNK = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine, whose master is ``local``, may do without: it gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured


def written(df: DataFrame, name: str, group_mb: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back. ``group_mb``: what a writer holds of its file at once, for rows that are large.

    This cuts the lineage: what follows survives the loss of any executor, and a task that is
    repeated reads the same rows again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillgraph-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer if group_mb is None else writer.option("parquet.block.size", group_mb << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grouped_rows(df: DataFrame, n: str) -> DataFrame:
    """The different rows of ``df``, with their number in column ``n``. Counted before the shuffle: a repeated row is no hot key."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(n))


def chunked(groups: DataFrame, n: str, chunk: str, size: int = CHUNK) -> DataFrame:
    """Splits rows with a count ``n`` over ``size``; ``chunk`` numbers the parts, and ``n`` counts what each has."""
    out = groups.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / size).cast("long"))))
    return out.withColumn(n, F.least(F.lit(size).cast("long"), F.col(n) - F.col(chunk) * size))
