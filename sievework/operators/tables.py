"""Relations over keyed rows: conflict policies, merges, latest rows, changes, carried values.

Every choice between rows has an explicit order, so that results do not depend
on how rows are partitioned. Ties are broken by the columns named in ``order``;
rows equal in all of them are equal for the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], best) -> DataFrame:
    """A row a key by an aggregate, which combines before the exchange: no task gets all rows of a hot key."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = best(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*(F.col(f"`{c}`") for c in df.columns))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in ``order`` (a conflict is ignored)."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ``order`` (a conflict replaces)."""
    return _pick(df, keys, order, F.max_by)


latest = keep_last


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not known yet, one a key. Null keys never conflict."""
    fresh = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return keep_first(fresh.filter(whole), keys, order).unionByName(fresh.filter(~whole))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], policies: dict[str, str]) -> DataFrame:
    """Merge rows by key with a policy a column.

    ``last`` takes the latest row's value, ``keep`` the latest that is not
    null, ``text`` the latest that is not blank, ``first`` the earliest, and
    ``max`` and ``min`` the extreme.
    """
    at = F.struct(*order)
    rows = existing.withColumn("_old", F.lit(0)).unionByName(incoming.withColumn("_old", F.lit(1)), allowMissingColumns=True)
    at = F.struct("_old", *order)
    how = {
        "last": lambda c: F.max_by(c, at),
        "keep": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)),
        "text": lambda c: F.max_by(c, F.when(F.trim(F.col(c)) != "", at)),
        "first": lambda c: F.min_by(c, at),
        "max": F.max,
        "min": F.min,
    }
    return rows.groupBy(*keys).agg(*(how[p](c).alias(c) for c, p in policies.items()))


def merge_observations(captures: DataFrame, keys: list[str], at: str, tie: str, carried: list[str]) -> DataFrame:
    """One row a content identity: how often and when it was seen, first context, latest evidence."""
    newest = F.struct(at, tie)
    return captures.groupBy(*keys).agg(
        F.count("*").alias("seen_count"), F.min(at).alias("first_observed_at"), F.max(at).alias("last_observed_at"), *(F.max_by(c, newest).alias(c) for c in carried)
    )


def merge_by_rank(events: DataFrame, key: str, state: str, ranks: dict[str, int], at: str, tie: str) -> DataFrame:
    """The furthest state of each key; of equal states the newest. Unknown states rank below all."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col(state)], F.lit(-1))
    furthest = F.struct("_rank", at, tie)
    return (
        events.withColumn("_rank", rank)
        .groupBy(key)
        .agg(F.max_by(state, furthest).alias("state"), F.max("_rank").alias("state_rank"), F.min(at).alias("first_persisted_at"), F.max_by(at, furthest).alias("state_at"), F.count("*").alias("n_events"))
    )


def changes_only(df: DataFrame, key: str, at: list[str], content: str) -> DataFrame:
    """Rows whose content differs from the row before, nulls being a content of their own."""
    by = W.partitionBy(key).orderBy(*at)
    first = F.row_number().over(by) == 1
    same = F.lag(content).over(by).eqNullSafe(F.col(content))
    return df.withColumn("_new", first | ~same).filter("_new").drop("_new")


def transitions(df: DataFrame, key: str, at: list[str], state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds previous_state and legal: the first state is legal, so is staying."""
    by = W.partitionBy(key).orderBy(*at)
    moves = F.array(*(F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs)) if any(allowed.values()) else F.array().cast("array<string>")
    before = F.lag(state).over(by)
    legal = before.isNull() | (before == F.col(state)) | F.array_contains(moves, F.concat(before, F.lit(">"), F.col(state)))
    return df.withColumns({"previous_state": before, "legal": legal})


def carried(df: DataFrame, key: list[str], at: list[str], value: Column) -> Column:
    """The newest non-null ``value`` up to each row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*key).orderBy(*at).rowsBetween(W.unboundedPreceding, 0))


def segments(df: DataFrame, key: list[str], at: list[str], opens: Column) -> DataFrame:
    """Adds segment: how many rows up to this one open a segment; 0 before the first."""
    by = W.partitionBy(*key).orderBy(*at).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(by).cast("long"))


def text_budget(df: DataFrame, key: str, at: list[str], text: str, budget: int) -> DataFrame:
    """Texts of a key in order, cut where their lengths together reach ``budget``; what lies beyond goes."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(key).orderBy(*at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(budget) - before).cast("int")
    return df.withColumn("_left", left).filter("_left > 0").withColumn(text, F.expr(f"substring({text}, 1, _left)")).drop("_left")


def page_signatures(rows: DataFrame, family: list[str], page: str, material: Column) -> DataFrame:
    """family, page, signature, n_rows, owner: pages with equal rows belong to the first of them.

    A page's rows are sorted within the page, so a signature needs all rows of
    one page only; pages are bounded by their source.
    """
    pages = rows.groupBy(*family, page).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(material)), "\n"), 256).alias("signature"), F.count("*").alias("n_rows"))
    return pages.withColumn("owner", F.min(page).over(W.partitionBy(*family, "signature")))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)
