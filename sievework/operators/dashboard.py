"""Cards, sync state and counts of a dashboard, from decision tables kept as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .binding import SLOTS

#: The states of a sync, the first condition that holds, as SQL on the columns of ``sync``; fixed values.
SYNC_STATES: tuple[tuple[str, str], ...] = (
    ("USER_LOGIN_REQUIRED", "login_required"), ("LOGIN_CHECK", "login_checking"), ("RECOVERING", "recovering"),
    ("SYNCING_{0}", "running AND phase = '{0}'"), ("SYNCING", "running"), ("USER_ACTION_REQUIRED", "requires_user_action"),
    ("COMPLETE_WITH_WARNINGS", "status = 'completed' AND contains(lower(completion_reason), 'error')"), ("COMPLETE", "status = 'completed'"),
    ("SYNCING_{0}", "status = 'running' AND persisted_phase = '{0}'"), ("SYNCING", "status = 'running'"), ("IDLE", "true"),
)
FLAGS = ("login_required", "login_checking", "recovering", "running", "requires_user_action")
#: What a card's state is called; others are to be checked. Fixed values.
QUALITY = {"accepted": "공식 전형 연결 확인", "provisional": "공식 전형 연결 확인 필요", "provider-only": "제공처 중심 · 공식 결합 없음", "incomplete": "수집 보강 필요", "stale": "canonical 연결 복구 필요", "empty": "지원안 미선택"}
QUALITY_ELSE = "데이터 품질 확인 필요"
STALE_TITLE, EMPTY_TITLE, OTHER_TITLE = "연결 확인 필요", "비어 있음", "지원안"


def sync_rules(providers: tuple[str, ...]) -> list[tuple[str, str]]:
    """The table with a row a provider where a rule speaks of one."""
    return [(state.format(p.upper()), rule.format(p)) for state, rule in SYNC_STATES for p in (providers if "{0}" in rule else ("",))]


def sync_state(sync: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """Adds state, shown_phase and progress.

    sync: FLAGS (null is no), phase (null: the persisted one), status,
    persisted_phase, completion_reason, targets, confirmed, outstanding.
    """
    s = sync.withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS}).withColumns({
        "status": F.coalesce("status", F.lit("unknown")), "persisted_phase": F.coalesce("persisted_phase", F.lit("idle")), "completion_reason": F.coalesce("completion_reason", F.lit("")),
    }).withColumn("phase", F.coalesce("phase", "persisted_phase"))
    state = F.lit(None).cast("string")
    for name, rule in reversed(sync_rules(providers)):
        state = F.when(F.expr(rule), name).otherwise(state)
    n = {c: F.coalesce(c, F.lit(0)) for c in ("targets", "confirmed", "outstanding")}
    left = F.when(F.col("outstanding") > 0, F.concat(F.lit(" · "), F.col("outstanding"), F.lit(" 남음"))).otherwise("")
    text = F.when(F.col("targets") > 0, F.concat("confirmed", F.lit("/"), "targets", F.lit(" 완료"), left)).when(F.col("state").isin("COMPLETE", "COMPLETE_WITH_WARNINGS"), "수집 완료").otherwise("진행 수치 대기")
    return s.withColumns(n).withColumn("state", state).withColumns({"shown_phase": F.when(F.col("running"), F.col("phase")).otherwise(F.col("persisted_phase")), "progress": text})


def rules_met(sync: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """state, rule, rows, alone of each row of the decision table: rows whose first rule it is, and rows that meet no other but the last.

    A rule that no row is the first to meet is unreachable on these rows; as
    the last rule always holds, every row has exactly one first.
    """
    rules = sync_rules(providers)
    met = F.array_compact(F.array(*(F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(i)) for i, (_, rule) in enumerate(rules))))
    table = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(state).alias("state"), F.lit(rule).alias("rule")) for i, (state, rule) in enumerate(rules))))
    s = sync_state(sync, providers).select(met.alias("_met"))
    per = s.groupBy(F.get("_met", F.lit(0)).alias("i")).agg(F.count("*").alias("rows"), F.count_if(F.size("_met") <= 2).alias("alone"))
    every = s.sparkSession.range(1).select(table.alias("r")).select("r.*")
    return every.join(per, "i", "left").fillna(0, ["rows", "alone"]).select("state", "rule", "rows", "alone")


def quality_label(state: Column) -> Column:
    out = F.lit(QUALITY_ELSE)
    for k, v in QUALITY.items():
        out = F.when(state == k, v).otherwise(out)
    return out


def cards(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """group, slot, state, label, title, subtitle, covered_count, complete, resolvable: a card for each of the ``SLOTS`` slots of a group.

    slots: group, slot, occupied, identity_key, display_label. candidates:
    group, identity_key, university, department, admission, campus,
    quality_state, covered_count, complete. An occupied slot without a
    candidate is stale; a slot that has no row is empty.
    """
    numbers = slots.select("group").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(SLOTS))))
    s = numbers.join(slots.withColumn("slot", F.col("slot").cast("int")), ["group", "slot"], "left").withColumn("occupied", F.coalesce("occupied", F.lit(False)))
    key = F.when(F.col("occupied"), T.blank_to_null(F.col("identity_key")))
    out = s.withColumn("identity_key", key).join(candidates.withColumn("_there", F.lit(True)), ["group", "identity_key"], "left")
    text = {c: T.blank_to_null(F.col(c)) for c in ("university", "department", "admission", "campus")}
    there = F.coalesce("_there", F.lit(False))
    state = F.when(~F.col("occupied"), "empty").when(~there, "stale").otherwise(F.coalesce("quality_state", F.lit("unknown")))
    named = F.nullif(F.concat_ws(" · ", text["university"], text["department"]), F.lit(""))
    numbered = lambda x: F.concat(F.col("slot").cast("string"), F.lit(". "), x)
    title = F.when(~F.col("occupied"), numbered(F.lit(EMPTY_TITLE))).when(~there, numbered(F.coalesce("display_label", F.lit(STALE_TITLE)))).otherwise(F.coalesce(named, numbered(F.lit(OTHER_TITLE))))
    sub = F.when(there, F.concat_ws(" · ", text["admission"], F.concat(F.lit("["), text["campus"], F.lit("]"))))
    return out.select(
        "group", "slot", "occupied", "identity_key", there.alias("resolvable"), state.alias("state"), quality_label(state).alias("label"), title.alias("title"), sub.alias("subtitle"),
        F.coalesce("covered_count", F.lit(0)).alias("covered_count"), F.coalesce("complete", F.lit(False)).alias("complete"),
    )


def summary(deck: DataFrame, audits: DataFrame) -> DataFrame:
    """A row a group: each count of its audit, or where that has none, the count of its cards.

    audits: group, selected, resolvable, accepted, provisional, provider_only, full_coverage, each nullable.
    """
    is_ = lambda s: F.count_if(F.col("state") == s)
    own = {"selected": F.count_if("occupied"), "resolvable": F.count_if("resolvable"), "accepted": is_("accepted"), "provisional": is_("provisional"), "provider_only": is_("provider-only"), "full_coverage": F.count_if("complete")}
    counted = deck.groupBy("group").agg(*(c.alias(f"_{n}") for n, c in own.items()))
    return counted.join(audits, "group", "left").select("group", *(F.coalesce(F.col(n).cast("long"), F.col(f"_{n}")).alias(n) for n in own))


def score_summary(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verified conversions, official outcomes, comparable decisions, holds and predictions; what is null isn't there.

    decisions: conversion_state, official_outcome, decision, prediction_state, structured (boolean).
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return decisions.groupBy(*by).agg(
        F.count("*").alias("applications"), n(F.col("conversion_state") == "verified").alias("verified_conversions"), n(F.col("official_outcome").isNotNull()).alias("official_outcomes"),
        n(F.col("decision") == "comparable").alias("comparable"), F.count_if(~F.coalesce(F.col("decision") == "comparable", F.lit(False))).alias("holds"), n(F.col("prediction_state") == "collected").alias("predictions"), n(F.col("structured")).alias("structured_predictions"),
    )


def finish_gate(runs: DataFrame, pages: DataFrame, most_drains: int = 20) -> DataFrame:
    """run_id, pending, deferred, verdict: whether a run may be finished as completed.

    runs: run_id, uploaded, processed (chunks), drains (how often it waited).
    pages: run_id, state, deferred. A run waits (``drain``) while chunks are
    not processed, ``most_drains`` times at most; then pages that aren't
    completed refuse it (``refused``), unless all of them are deferred errors
    (``completed-with-deferred-errors``).
    """
    open_ = F.coalesce(F.col("state") != "completed", F.lit(True))
    per = pages.groupBy("run_id").agg(F.count_if(open_).alias("pending"), F.count_if(open_ & F.coalesce("deferred", F.lit(False))).alias("deferred"))
    r = runs.join(per, "run_id", "left").fillna(0, ["pending", "deferred"])
    waits = (F.coalesce("processed", F.lit(0)) < F.coalesce("uploaded", F.lit(0))) & (F.coalesce("drains", F.lit(0)) < most_drains)
    verdict = F.when(waits, "drain").when(F.col("pending") > F.col("deferred"), "refused").when(F.col("deferred") > 0, "completed-with-deferred-errors").otherwise("completed")
    return r.select("run_id", "pending", "deferred", verdict.alias("verdict"))
