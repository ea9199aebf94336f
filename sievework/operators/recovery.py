"""What is left to collect for the selected applications of a session, kept as one version a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binding import SLOTS
from .store import Versions

OPEN = ("pending", "running")
_SCOPE = "session_id string, identity_key string, missing array<string>, state string, attempts int, updated_at timestamp"


def provider_runs(sessions: DataFrame, columns: dict[str, str]) -> DataFrame:
    """session_id, provider, run_id: the runs that a session names in a column a provider; columns without a run give no row."""
    runs = F.explode(F.array(*(F.struct(F.lit(p).alias("provider"), F.col(c).cast("string").alias("run_id")) for p, c in columns.items())))
    return sessions.select("session_id", runs.alias("_r")).select("session_id", "_r.*").filter("run_id is not null")


def scope(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """session_id, identity_key, missing, state of each selected identity, once a session.

    slots: session_id, occupied, identity_key. candidates: session_id,
    identity_key, missing (lanes, in order); of an identity's several
    candidates the one with most lanes missing counts. Without a candidate the
    selection is stale, with nothing missing complete, else pending.
    """
    selected = slots.filter("occupied and trim(identity_key) <> ''").select("session_id", "identity_key").distinct()
    none = F.array().cast("array<string>")
    known = candidates.withColumn("missing", F.coalesce("missing", none)).groupBy("session_id", "identity_key").agg(F.max_by("missing", F.struct(F.size("missing"), F.array_join("missing", ","))).alias("missing"))
    rows = selected.join(known, ["session_id", "identity_key"], "left")
    state = F.when(F.col("missing").isNull(), "stale").when(F.size("missing") == 0, "complete").otherwise("pending")
    return rows.select("session_id", "identity_key", F.coalesce("missing", none).alias("missing"), state.alias("state"))


def summary(rows: DataFrame, required: int = SLOTS) -> DataFrame:
    """A row a session: scoped, pending (running ones too), complete, stale (all other states), and whether recovery is active: all slots scoped, something pending."""
    counted = rows.groupBy("session_id").agg(
        F.count("*").alias("scoped"), F.count_if(F.col("state").isin(*OPEN)).alias("pending"), F.count_if(F.col("state") == "complete").alias("complete"), F.count_if(~F.col("state").isin(*OPEN, "complete")).alias("stale")
    )
    return counted.withColumn("active", (F.col("scoped") == required) & (F.col("pending") > 0))


class RecoveryScope:
    """The stored scope. Each change writes the sessions it touches anew, as a version of its own; readers see a session's last whole version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = Versions(spark, folder, _SCOPE, "session_id")
        self.table.begin()

    def read(self) -> DataFrame:
        return self.table.read()

    def rebuild(self, sessions: DataFrame, slots: DataFrame, candidates: DataFrame, version: str, at: Column) -> None:
        """Delete and build again the scope of ``sessions``; attempts begin at 0. A session without a selection ends empty."""
        rows = scope(slots, candidates).withColumns({"attempts": F.lit(0), "updated_at": at})
        self.table.replace(rows, sessions, version, at)

    def refresh(self, sessions: DataFrame, candidates: DataFrame, version: str, at: Column) -> None:
        """States and missing lanes of the identities in scope from newer coverage; attempts stay."""
        now = self.table.read(version).join(sessions.select("session_id").distinct(), "session_id", "left_semi")
        found = scope(now.select("session_id", F.lit(True).alias("occupied"), "identity_key"), candidates)
        self.table.replace(found.join(now.select("session_id", "identity_key", "attempts"), ["session_id", "identity_key"]).withColumn("updated_at", at).select(*now.columns), sessions, version, at)

    def finish(self, sessions: DataFrame, state: str, version: str, at: Column) -> None:
        """What is pending or running ends in ``state``."""
        now = self.table.read(version).join(sessions.select("session_id").distinct(), "session_id", "left_semi")
        open_ = F.col("state").isin(*OPEN)
        self.table.replace(now.withColumns({"updated_at": F.when(open_, at).otherwise(F.col("updated_at")), "state": F.when(open_, F.lit(state)).otherwise(F.col("state"))}), sessions, version, at)
