"""Reading captures: snapshots, ingest chunks, stored pages and transcripts, with fixed schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

SNAPSHOT = """
title string, url string, navigationKey string, collectedAt timestamp,
session struct<needsLogin:boolean,authenticated:boolean>, pageState struct<isError:boolean,errorType:string>,
listMeta struct<totalItems:int,visibleDataRows:int>, context array<string>, selectionContext array<string>, blocks array<string>,
tables array<struct<caption:string,rows:array<array<string>>>>,
navigationLinks array<struct<label:string,url:string,exportUrl:string>>, resourceLinks array<struct<label:string,url:string>>, collectionPage int, collectionPagination struct<pageSize:int>
"""
RECORD = (
    "struct<sourceRowFingerprint:string,recordType:string,university:string,campus:string,department:string,admission:string,"
    "sourcePage:string,confidence:string,rawEvidence:string,year:int,sourcePageNumber:int,sourceRowOrdinal:int,metrics:map<string,string>>"
)
CHUNK = f"runId string, chunkId string, provider string, records array<{RECORD}>, page struct<familyKey:string,requestedYear:int,page:int,state:string,retryCount:int,errorType:string>, _bad string"
MOST_RECORDS = 250
#: Signs of a page that asks to prove that its reader is human.
CHALLENGE = "cf-challenge|captcha|just a moment|checking your browser|access denied"
TRANSCRIPT_HEADS = {"학년": "grade_year", "학기": "semester", "교과": "subject_group", "과목": "subject", "등급": "grade", "학점": "credits", "이수단위": "credits", "성취도": "achievement"}


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).option("columnNameOfCorruptRecord", "_bad").json(path)


def chunk_errors() -> Column:
    """What is wrong with a chunk; an empty array if nothing is."""
    return F.array_compact(F.array(
        F.when(F.col("_bad").isNotNull(), "malformed"), F.when(F.coalesce(F.col("runId"), F.lit("")) == "", "no-run"), F.when(F.coalesce(F.col("chunkId"), F.lit("")) == "", "no-chunk"),
        F.when(F.coalesce(F.size("records"), F.lit(0)) > MOST_RECORDS, "too-many-records"),
    ))


def chunk_records(good: DataFrame) -> DataFrame:
    """Records of valid chunks with their keys."""
    r = good.select("runId", "chunkId", "provider", F.posexplode("records").alias("at", "r")).select("runId", "chunkId", "provider", "at", "r.*")
    fallback = F.concat(F.lit("fallback-"), V.fnv1a(F.to_json(F.struct("recordType", "year", "university", "campus", "department", "admission", "sourcePage", "sourcePageNumber", "sourceRowOrdinal", "rawEvidence"), {"ignoreNullFields": "false"})))
    return r.withColumn("fingerprint", F.coalesce(F.nullif(F.trim("sourceRowFingerprint"), F.lit("")), fallback))


def rechunked(records: DataFrame, page: list[str], order: str, size: int = 150) -> DataFrame:
    """Adds chunk: records of a page in groups of ``size``."""
    from pyspark.sql import Window as W

    return records.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(*page).orderBy(order)) - 1) / size).cast("int"))


def stored_pages(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, html, rejected: stored HTML files, decoded by the character set that they declare.

    A file of more than ``most`` bytes (the older collector: 2,500,000; all by
    default) or one that doesn't begin as markup has no html but says why:
    ``too-large``, ``not-html``; one that asks to prove that its reader is human
    says ``challenge`` and keeps its html.
    """
    @F.pandas_udf("string")
    def from_korean(content: pd.Series) -> pd.Series:  # Spark's own decode knows the UTF character sets only
        return content.map(lambda b: bytes(b).decode("cp949", "replace"))

    raw = spark.read.format("binaryFile").load(path)
    large = F.col("length") > most if most is not None else F.lit(False)
    head = F.lower(F.decode(F.substring("content", 1, 2048), "ISO-8859-1"))
    korean = head.rlike(r"charset\s*=\s*[\"']?\s*(?:euc-kr|cp949|ks_c_5601)")
    markup = head.rlike(r"^[^<]{0,64}<\s*(?:!doctype|html|head|body|meta|title|table|div|\?xml|!--|[a-z])")
    reason = F.when(large, "too-large").when(~markup, "not-html").when(head.rlike(CHALLENGE), "challenge")
    html = F.when(reason.isNull() | (reason == "challenge"), F.when(korean, from_korean("content")).otherwise(F.decode("content", "UTF-8")))
    return raw.select("path", html.alias("html"), reason.alias("rejected"))



def transcript(spark: SparkSession, path: str, tab: bool = False) -> DataFrame:
    """Rows of transcript files with their columns under fixed names, all as texts."""
    rows = spark.read.option("header", True).option("sep", "\t" if tab else ",").option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    names = {c: TRANSCRIPT_HEADS.get(c.replace("﻿", "").strip(), c.replace("﻿", "").strip()) for c in rows.columns}
    return rows.withColumnsRenamed(names)


def transcript_checked(rows: DataFrame, student: list[str]) -> DataFrame:
    """Typed transcript rows with errors: an array of what is wrong, empty for valid rows."""
    from pyspark.sql import Window as W

    def given(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")

    def number(c: str) -> Column:
        return V.finite(F.when(~given(c).isin("-", "미기재"), given(c)).try_cast("double"))

    unread = lambda c: given(c).isNotNull() & ~given(c).isin("-", "미기재") & number(c).isNull()
    t = rows.select(
        *student, given("grade_year").try_cast("int").alias("grade_year"), given("semester").try_cast("int").alias("semester"), F.substring(F.coalesce(given("subject_group"), F.lit("")), 1, 60).alias("subject_group"),
        given("subject").alias("subject"), number("grade").alias("grade"), number("credits").alias("credits"), F.upper(F.coalesce(given("achievement"), F.lit(""))).alias("achievement"),
        (unread("grade") | unread("credits")).alias("_unread"),
    )
    same = F.count("*").over(W.partitionBy(*student, "grade_year", "semester", "subject"))
    place = F.col("grade_year").between(1, 3) & F.col("semester").between(1, 2) & F.col("subject").isNotNull() & (F.length("subject") <= 120)
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(place, F.lit(False)), "place"), F.when(F.col("_unread"), "number"), F.when((F.col("grade") < 1) | (F.col("grade") > 9) | (F.col("grade") % 1 != 0), "grade"),
        F.when((F.col("credits") <= 0) | (F.col("credits") > 30), "credits"), F.when(~F.col("achievement").isin("", "A", "B", "C", "D", "E", "P"), "achievement"), F.when(same > 1, "duplicate"),
    ))
    return t.withColumn("errors", errors).drop("_unread")


def transcript_summary(checked: DataFrame, student: list[str]) -> DataFrame:
    from ..operators.decide import weighted_mean

    g, c = F.col("grade"), F.col("credits")
    return checked.groupBy(*student).agg(
        F.count("*").alias("rows"), F.count("grade").alias("graded"), F.count_if(g.isNull()).alias("ungraded"), F.count_if(g.isNotNull() & c.isNull()).alias("missing_credits"),
        F.when(F.max(F.size("errors")) == 0, weighted_mean(g, c)).alias("own_weighted_grade"),
    )
