"""Imports of files from elsewhere: batch exports as chunks, transcripts of any form, with rejects kept.

Files are read by Spark (whole, a row a file) and parsed where they lie, so they
may be in any store that Spark reads. What can't be read leaves a row with the
reason, never an error: a broken file doesn't stop its folder.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U
from .captures import MOST_RECORDS, RECORD, TRANSCRIPT_HEADS

FIELDS = ("grade_year", "semester", "subject_group", "subject", "grade", "credits", "achievement")
#: Names of the fields in JSON transcripts; fixed values.
JSON_HEADS = {"gradeYear": "grade_year", "semester": "semester", "group": "subject_group", "subject": "subject", "grade": "grade", "credits": "credits", "achievement": "achievement"}
_NEEDED = ("grade_year", "semester", "subject")
_ROWS = "path string, row int, " + ", ".join(f"{f} string" for f in FIELDS) + ", rejected string"
#: Records that a chunk of an imported batch holds.
CHUNK_RECORDS = 150
BATCH = f"provider string, collectorVersion string, collectedAt string, snapshots array<struct<url:string,navigationKey:string,collectionPage:int>>, records array<{RECORD}>, _bad string"


def _table(text: str) -> tuple[list[str], list[list[str]]]:
    """Header and rows: tab-separated if the first line has a tab, else by commas; quotes may hold both and line ends."""
    sep = "\t" if "\t" in text.split("\n", 1)[0] else ","
    lines = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=True))
    return [h.strip() for h in lines[0]], [r for r in lines[1:] if any(c.strip() for c in r)]


def _parsed(path: str, content: bytes) -> list[tuple]:
    """Rows of a file in the order of ``_ROWS``; a row or a file that can't be read has its reason alone."""
    reject = lambda row, why: [(path, row, *(None,) * len(FIELDS), why)]
    try:
        text = content.decode("utf-8").removeprefix("﻿").strip()
    except UnicodeDecodeError:
        return reject(None, "not-utf8")
    if not text:
        return reject(None, "empty")
    if text.startswith("{"):
        try:
            subjects = json.loads(text)["subjects"]
            if not isinstance(subjects, list):
                return reject(None, "no-subjects")
        except (ValueError, KeyError, TypeError):
            return reject(None, "malformed-json")
        out = []
        for i, s in enumerate(subjects, 1):
            out += [(path, i, *(None if not isinstance(s, dict) or s.get(k) is None else str(s[k]).strip() for k in JSON_HEADS), None)] if isinstance(s, dict) else reject(i, "no-object")
        return out or reject(None, "no-rows")
    try:
        head, rows = _table(text)
    except csv.Error:
        return reject(None, "unclosed-quote")
    names = [TRANSCRIPT_HEADS.get(h, JSON_HEADS.get(h, h)) for h in head]
    if len(set(names)) < len(names):
        return reject(None, "columns-twice")
    if not set(_NEEDED) <= set(names):
        return reject(None, "columns-missing")
    at = {n: i for i, n in enumerate(names)}
    out = []
    for i, r in enumerate(rows, 1):
        out += [(path, i, *((r[at[f]].strip() or None) if f in at else None for f in FIELDS), None)] if len(r) == len(names) else reject(i, "columns-differ")
    return out or reject(None, "no-rows")


def transcripts(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, row, the fields as texts, rejected: rows of all transcripts of a folder, whether separated by commas or tabs or JSON.

    With ``most``, files of more bytes are rejected as ``too-large`` without being read into a worker.
    """
    raw = spark.read.format("binaryFile").load(path)
    large = F.col("length") > most if most is not None else F.lit(False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ROWS.split(", ")]
        for part in batches:
            rows = [x for p, content in zip(part["path"], part["content"], strict=True) for x in _parsed(p, bytes(content))]
            yield pd.DataFrame(rows, columns=names).astype({"row": "Int32"})

    too_large = raw.filter(large).select("path", F.lit("too-large").alias("rejected"))
    none = [F.lit(None).cast("int").alias("row"), *(F.lit(None).cast("string").alias(f) for f in FIELDS)]
    return raw.filter(~large).select("path", "content").mapInPandas(run, _ROWS).unionByName(too_large.select("path", *none, "rejected"))


def batch_files(spark: SparkSession, path: str) -> DataFrame:
    """path, provider, collectorVersion, collectedAt, snapshots, records, rejected: batch exports, a file each; one that is no JSON says so."""
    b = spark.read.schema(BATCH).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).select("*", F.col("_metadata.file_path").alias("path"))
    rejected = F.when(F.col("_bad").isNotNull(), "malformed-json").when(F.col("records").isNull() & F.col("snapshots").isNull(), "no-batch")
    return b.withColumn("rejected", rejected).drop("_bad")


def batch_chunks(batches: DataFrame, year_key: str = "searchSyr", size: int = CHUNK_RECORDS) -> DataFrame:
    """runId, chunkId, provider, page, records: the batches as ingest chunks of ``size`` records at most.

    A record belongs to the page that its source address and page number name,
    or to none (``unpaged``, by type and source). A page that a snapshot shows
    but no record is from comes as an empty chunk, so that it counts as
    collected. Ids follow from the file and the page: a file that is imported
    again gives the same chunks, and their ingest stores nothing twice.
    """
    if not 1 <= size <= MOST_RECORDS:
        raise ValueError(f"1 to {MOST_RECORDS} records a chunk")
    good = batches.filter("rejected is null").withColumns({"runId": F.concat(F.lit("import-"), F.substring(F.sha2("path", 256), 1, 16)), "provider": F.coalesce("provider", F.lit("unknown"))})
    family = lambda c: F.coalesce(U.family_key(c), F.lit(""))
    year = lambda c: U.parameter(c, year_key).try_cast("int")
    page = lambda fam, y, n: F.struct(fam.alias("familyKey"), y.alias("requestedYear"), n.alias("page"), F.lit("completed").alias("state"), F.lit(0).alias("retryCount"), F.lit(None).cast("string").alias("errorType"))
    r = good.select("runId", "provider", F.posexplode("records").alias("at", "r"))
    source = F.col("r.sourcePage")
    paged = (F.coalesce("r.sourcePageNumber", F.lit(0)) > 0) & (family(source) != "")
    r = r.select("runId", "provider", "at", "r", F.when(paged, page(family(source), F.coalesce(year(source), F.col("r.year")), F.col("r.sourcePageNumber"))).alias("page"), F.when(~paged, F.concat_ws(":", F.lit("unpaged"), F.coalesce("r.recordType", F.lit("record")), F.coalesce(source, F.lit("")))).alias("other"))
    named = F.sha2(F.concat_ws("|", F.coalesce(F.to_json("page"), F.lit("")), F.coalesce("other", F.lit(""))), 256)
    r = r.withColumn("group", F.substring(named, 1, 16))
    nth = F.floor((F.row_number().over(W.partitionBy("runId", "group").orderBy("at")) - 1) / size)
    full = r.withColumn("n", nth).groupBy("runId", "provider", "group", "n").agg(F.first("page").alias("page"), F.array_sort(F.collect_list(F.struct("at", "r")), lambda a, b: a["at"] - b["at"]).alias("x"))  # ``size`` records a group
    full = full.withColumn("records", F.transform("x", lambda x: x["r"])).drop("x")
    s = good.select("runId", "provider", F.explode("snapshots").alias("s")).filter(F.coalesce("s.collectionPage", F.lit(0)) > 0)
    s = s.select("runId", "provider", page(family(F.col("s.url")), year(F.col("s.url")), F.col("s.collectionPage")).alias("page")).filter("page.familyKey <> ''").distinct()
    s = s.withColumn("group", F.substring(F.sha2(F.concat_ws("|", F.to_json("page"), F.lit("")), 256), 1, 16))
    empty = s.join(full.select("runId", "group").distinct(), ["runId", "group"], "left_anti").withColumns({"n": F.lit(0).cast("long"), "records": F.array().cast(f"array<{RECORD}>")})
    chunk = F.concat_ws("-", "group", F.col("n").cast("string")).alias("chunkId")
    return full.unionByName(empty).select("runId", chunk, "provider", "page", "records")
