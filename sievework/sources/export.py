"""Exports: sections as JSON lines with a manifest, or nested documents a key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nested(parents: DataFrame, children: DataFrame, key: str, child_order: list[str], name: str) -> DataFrame:
    """key, document: each parent with its children nested in order. A document holds one parent's children only."""
    inner = [c for c in children.columns if c != key]
    rows = F.struct(*child_order, *(c for c in inner if c not in child_order))
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(rows)).alias(name), F.count("*").alias("n_children"))
    both = parents.join(grouped, key, "left")
    return both.select(key, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.to_json(F.struct(*parents.columns, name)).alias("document"))


def write_sections(spark: SparkSession, folder: str, sections: dict[str, DataFrame], header: dict) -> None:
    """Each section goes to its own folder of JSON lines, written in parallel; the manifest comes last and marks the export complete."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    manifest = header | {"sections": sorted(sections)}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def light_snapshot(snapshots: DataFrame) -> DataFrame:
    """Snapshots without the links that only navigation needs."""
    return snapshots.drop("navigationLinks", "resourceLinks")
