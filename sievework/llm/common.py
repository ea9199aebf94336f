"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts in an Arrow batch.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share: the one set on the context, or else ``spark.checkpoint.dir``.

    Where neither is set, a session of one process (``local[...]``, as in
    tests) gets a temporary folder; a cluster gets an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def mapped(texts: DataFrame, f, spec) -> DataFrame:
    """``texts.mapInArrow(f, spec)`` for rows that hold whole texts.

    Arrow batches of 10,000 texts take tens of MB on either side of the pipe,
    and the JVM keeps what it once took, so the session's batches are made
    smaller (``BATCH_ROWS``) where they have the default size.
    """
    conf = texts.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return texts.mapInArrow(f, spec)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """While it lasts, Python tasks that start get Arrow batches of at most ``rows`` rows: for rows that hold much."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows_where(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, whose texts ``judge`` (an Arrow array of texts to booleans) accepts."""
    plain, at = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at)), pa.bool_()))

    return mapped(plain, run, plain.schema).toDF(*docs.columns)


def few(df: DataFrame, at_most: int) -> DataFrame:
    """``df`` with the hint to broadcast it if it has no more rows than that."""
    return F.broadcast(df) if df.count() <= at_most else df


def joined(rows: DataFrame, table: DataFrame, key: str, at_most: int, salts: int = 16) -> DataFrame:
    """``rows`` left-joined with ``table`` (a row a key): by broadcast where it is small, else so that a hot key's rows go to several tasks."""
    if table.count() <= at_most:
        return rows.join(F.broadcast(table), key, "left")
    salt = fresh(rows, "salt")
    spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(spread, [key, salt], "left").drop(salt)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
