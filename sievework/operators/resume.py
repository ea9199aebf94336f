"""Checkpoint relations: which pages to collect again, progress, queues with leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COOLDOWN_SECONDS = 6 * 3600
LEASE_SECONDS = 300
MOST_ATTEMPTS = 4


def deferred(error_type: Column, retries: Column, updated_at: Column, now: Column, cooldown: int = COOLDOWN_SECONDS) -> Column:
    """A page that failed at the server twice or more waits for the cool-down."""
    age = F.unix_timestamp(now) - F.unix_timestamp(updated_at)
    return F.coalesce((error_type == "server-error") & (retries >= 2) & (age < cooldown), F.lit(False))


def resume_plan(families: DataFrame, pages: DataFrame, key: list[str], now: Column, start_page: int = 1, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """key, page, status for every page that a family should have: completed, retry, deferred or missing.

    ``families`` has the keys and total_pages; ``pages`` has the keys, page,
    state, retry_count, error_type, updated_at. The expected pages are
    generated where the family lies, so only families and states are shuffled.
    """
    expected = families.filter(F.col("total_pages") >= start_page).select(*key, F.explode(F.sequence(F.lit(start_page), F.col("total_pages").cast("int"))).alias("page"))
    known = pages.select(*key, F.col("page").cast("int").alias("page"), "state", "retry_count", "error_type", "updated_at")
    status = (
        F.when(F.col("state").isNull(), "missing")
        .when(F.col("state") == "completed", "completed")
        .when(deferred(F.col("error_type"), F.col("retry_count"), F.col("updated_at"), now, cooldown), "deferred")
        .otherwise("retry")
    )
    return expected.join(known, [*key, "page"], "left").select(*key, "page", status.alias("status"), "retry_count")


def limited(plan: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The first ``limit`` pages of each status with truncated: whether a list reached the limit."""
    group = W.partitionBy(*key, "status")
    placed = plan.withColumn("_n", F.row_number().over(group.orderBy("page"))).withColumn("truncated", F.count("*").over(group) >= limit)
    return placed.filter(F.col("_n") <= limit).drop("_n")


def pending_with_known_total(pages: DataFrame, key: list[str]) -> DataFrame:
    """Pages that are not completed, with the highest page known of their family (all states)."""
    return pages.withColumn("max_page", F.max("page").over(W.partitionBy(*key))).filter("state <> 'completed'")


def progress(pages: DataFrame, key: list[str]) -> DataFrame:
    done, failed = F.col("state") == "completed", F.col("state") == "error"
    return pages.groupBy(*key).agg(
        F.max("page").alias("max_page"), F.count("*").alias("known_pages"), F.count_if(done).alias("completed_pages"), F.count_if(failed).alias("error_pages"),
        F.count_if(~done & ~failed).alias("open_pages"),
    )


def errors_by_type(pages: DataFrame) -> DataFrame:
    return pages.filter("error_type is not null").groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def release_expired(tasks: DataFrame, now: Column) -> DataFrame:
    """Leases that ran out return to the queue; a task at its last attempt fails."""
    out = (F.col("state") == "claimed") & (F.col("lease_expires_at") < now)
    spent = out & (F.col("attempt_count") >= MOST_ATTEMPTS)
    return tasks.withColumns({
        "state": F.when(spent, "failed").when(out, "pending").otherwise(F.col("state")),
        "lease_owner": F.when(~out, F.col("lease_owner")),
        "lease_expires_at": F.when(~out, F.col("lease_expires_at")),
    })


def claim(tasks: DataFrame, owner: str, now: Column, per_provider: int, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Leases the first pending tasks of each provider by priority, then age."""
    free = (F.col("state") == "pending") & (F.col("attempt_count") < MOST_ATTEMPTS)
    order = W.partitionBy("provider", free).orderBy(F.desc("priority"), "updated_at", "task_id")
    taken = free & (F.row_number().over(order) <= per_provider)
    return tasks.withColumn("_t", taken).withColumns({
        "state": F.when(F.col("_t"), "claimed").otherwise(F.col("state")),
        "attempt_count": F.col("attempt_count") + F.col("_t").cast("int"),
        "lease_owner": F.when(F.col("_t"), F.lit(owner)).otherwise(F.col("lease_owner")),
        "lease_expires_at": F.when(F.col("_t"), F.timestamp_seconds(F.unix_timestamp(now) + lease_seconds)).otherwise(F.col("lease_expires_at")),
    }).drop("_t")


def complete(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Completes claimed tasks of ``done`` (task_id, lease_owner); a lease that passed to another owner stays."""
    ok = done.select("task_id", F.col("lease_owner").alias("_owner")).distinct()
    return tasks.join(ok, "task_id", "left").withColumn(
        "state", F.when((F.col("state") == "claimed") & (F.col("_owner") == F.col("lease_owner")), "completed").otherwise(F.col("state"))
    ).drop("_owner")


def neighbours(pages: DataFrame, key: list[str], page: str, last: str) -> DataFrame:
    """Pages that lack evidence, and the pages beside them, each once."""
    return pages.select(*key, F.explode(F.array(F.col(page) - 1, F.col(page), F.col(page) + 1)).alias("page"), last).filter(F.col("page").between(1, F.col(last))).select(*key, "page").distinct()


def ordinal(page: Column, size: Column, row: Column) -> Column:
    return (page - 1) * size + row


def duplicate_year_views(views: DataFrame, family: list[str]) -> DataFrame:
    """Adds view_of: the family's newest year whose list has the same total, size and fingerprint."""
    newest = F.max_by(F.struct("year", "total", "size", "fingerprint"), "year").over(W.partitionBy(*family))
    same = (newest["total"] == F.col("total")) & (newest["size"] == F.col("size")) & (newest["fingerprint"] == F.col("fingerprint")) & (F.col("year") < newest["year"])
    return views.withColumn("view_of", F.when(same, newest["year"]))
