"""Conservative decisions: whatever evidence is missing leads to a hold, never to a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions import values as V

EPSILON = 1e-9
DIRECTIONS = ("higher-is-better", "lower-is-better")
#: Rule checks of an application review; fixed values.
CHECKS = ("eligibility", "csat", "documents", "multiple_applications")


def _relation(margin: Column) -> Column:
    return F.when(margin > EPSILON, "ABOVE_REFERENCE").when(margin < -EPSILON, "BELOW_REFERENCE").otherwise("AT_REFERENCE")


def score_decision(rows: DataFrame) -> DataFrame:
    """Adds status, decision_code, advantage_margin to rows of (quality, conversion, outcomes).

    conversion: struct of verified, status, score, max_score, scale, direction,
    identity_verified. outcomes: array of structs of verified, value, scale,
    max_score, is_primary. A score is compared with the one outcome of its
    scale that is marked as primary, or the only one there is.
    """
    c = F.col("conversion")
    scale, own, most = F.trim(c["scale"]), V.finite(c["score"]), V.finite(c["max_score"])
    same_max = lambda o: most.isNull() | V.finite(o["max_score"]).isNull() | (F.abs(most - V.finite(o["max_score"])) <= EPSILON)
    fits = lambda o: F.coalesce(o["verified"] & V.finite(o["value"]).isNotNull() & (F.trim(o["scale"]) == scale) & same_max(o), F.lit(False))
    rows = rows.withColumn("_fit", F.filter(F.coalesce("outcomes", F.expr("filter(outcomes, x -> false)")), fits))
    rows = rows.withColumn("_fit", F.when(F.col("outcomes").isNotNull(), F.col("_fit")))
    rows = rows.withColumn("_main", F.filter("_fit", lambda o: F.coalesce(o["is_primary"], F.lit(False))))
    many = lambda x: F.greatest(F.size(x), F.lit(0))  # noqa: E731  (size of null is -1)
    code = (
        F.when(c.isNull() | ~F.coalesce(c["verified"], F.lit(False)) | ~F.coalesce(c["status"] == "verified", F.lit(False)), "UNVERIFIED_CONVERSION")
        .when(c["score"].isNull(), "MISSING_CONVERSION_SCORE")
        .when(T.blank_to_null(c["scale"]).isNull(), "MISSING_SCORE_SCALE")
        .when(~F.coalesce(F.trim(c["direction"]).isin(*DIRECTIONS), F.lit(False)), "UNKNOWN_COMPARISON_DIRECTION")
        .when(~F.coalesce(F.col("quality") == "accepted", F.lit(False)) & ~F.coalesce(c["identity_verified"], F.lit(False)), "UNVERIFIED_APPLICATION_BINDING")
        .when(own.isNull(), "INVALID_CONVERSION_SCORE")
        .when(many("_fit") == 0, "NO_COMPARABLE_OFFICIAL_OUTCOME")
        .when(many("_main") > 1, "AMBIGUOUS_PRIMARY_REFERENCE")
        .when((many("_main") == 0) & (many("_fit") > 1), "AMBIGUOUS_OFFICIAL_REFERENCE")
    )
    reference = V.finite(F.coalesce(F.get("_main", F.lit(0)), F.get("_fit", F.lit(0)))["value"])
    margin = F.when(F.trim(c["direction"]) == "higher-is-better", own - reference).otherwise(reference - own)
    return rows.withColumns({
        "status": F.when(code.isNotNull(), "HOLD").otherwise("COMPARABLE"),
        "decision_code": F.coalesce(code, _relation(margin)),
        "advantage_margin": F.when(code.isNull(), margin),
    }).drop("_fit", "_main")


def application_review(rows: DataFrame, now: Column, domains: tuple[str, ...] = ("ac.kr",)) -> DataFrame:
    """Adds code, relation, margin, missing, risks to rows of (candidate, profile, review), all structs.

    candidate: identity_key, year, category, admission. profile: status, year,
    fingerprint, complete. review: see the columns read below.
    """
    a, p, r = F.col("candidate"), F.col("profile"), F.col("review")
    yes = lambda c: F.coalesce(c, F.lit(False))
    told = lambda c: yes(T.blank_to_null(c).isNotNull())
    bound = yes((r["identity_key"] == a["identity_key"]) & (r["year"] == a["year"]) & (a["identity_key"] != ""))
    whole = yes((p["status"] == "IMPORTED") & (p["year"] == a["year"]) & p["complete"])
    own, ref, most = V.finite(r["own_score"]), V.finite(r["reference_score"]), V.finite(r["max_score"])
    graded = F.coalesce(r["scale"].contains("등급") | F.lower(r["scale"]).contains("grade"), F.lit(False))
    needs = {
        "binding": bound,
        "complete-profile": whole,
        "current-profile": whole & told(p["fingerprint"]) & yes(r["profile_fingerprint"] == p["fingerprint"]),
        "source-review": bound & yes(r["source_reviewed"]),
        "formula-source": U.official(r["formula_source"], domains) & told(r["formula_excerpt"]),
        "outcome-source": U.official(r["outcome_source"], domains) & told(r["outcome_excerpt"]),
        "scale": told(r["scale"]) & yes(~r["scale"].isin("미확인", "unknown", "-")) & told(r["method"]),
        "metric": told(r["metric"]),
        "direction": yes(r["direction"].isin(*DIRECTIONS)),
        "range": yes((own <= most) & (ref <= most)),
        "grade-range": ~graded | yes(own.between(1, 9) & ref.between(1, 9) & (most == 9)),
        "past-year": yes((r["outcome_year"] >= 2000) & (r["outcome_year"] < a["year"])),
    }
    ready = F.lit(True)
    for ok in needs.values():
        ready = ready & ok
    margin = F.when(ready, F.when(r["direction"] == "lower-is-better", ref - own).otherwise(own - ref))
    below = yes(margin < -EPSILON)
    ruled = bound & yes(r["rules_reviewed"]) & U.official(r["rules_source"], domains) & told(r["rules_excerpt"])
    state = {k: F.coalesce(r[k], F.lit(0)) for k in CHECKS}
    open_ = {f"check-{k}": ruled & (v != 0) for k, v in state.items()}
    unmet = F.lit(False)
    for v in state.values():
        unmet = unmet | (ruled & (v == 2))
    expired = ruled & yes(now >= r["deadline"])
    missing = F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in {**needs, **open_, "deadline": ruled & r["deadline"].isNotNull()}.items())))
    risks = F.array_compact(F.array(
        F.when(below, "below-reference"), *(F.when(ruled & (v == 2), F.lit(f"unmet-{k}")) for k, v in state.items()), F.when(expired, "deadline-passed"),
        F.when(yes(a["category"] == "종합") | yes(a["admission"].contains("면접")), "qualitative-assessment"),
    ))
    rows = rows.withColumns({"missing": missing, "risks": risks, "advantage_margin": margin, "relation": F.when(ready, _relation(margin)).otherwise("HOLD")})
    code = F.when(unmet | expired, "CONDITIONS_RECHECK").when(ready & below, "SCORE_RISK").when(F.size("missing") > 0, "HOLD").otherwise("REVIEWABLE")
    return rows.withColumn("code", code)


def portfolio_warnings(cards: DataFrame, owner: list[str], slots: int = 6) -> DataFrame:
    """owner, warning, slots: the same university or interview date in several slots, and open slots.

    cards: owner, slot, university, interview_date, occupied.
    """
    used = cards.filter("occupied")
    listed = lambda kind, c: (
        used.filter(T.blank_to_null(F.col(c).cast("string")).isNotNull()).groupBy(*owner, F.col(c).cast("string").alias("value"))
        .agg(F.array_join(F.array_sort(F.collect_list("slot")), ",").alias("slots"), F.count("*").alias("_n")).filter("_n > 1").select(*owner, F.lit(kind).alias("warning"), "value", "slots")
    )
    short = cards.groupBy(*owner).agg(F.count_if("occupied").alias("_n")).filter(F.col("_n") < slots).select(*owner, F.lit("selection-incomplete").alias("warning"), F.col("_n").cast("string").alias("value"), F.lit("").alias("slots"))
    return listed("same-university", "university").unionByName(listed("same-interview-date", "interview_date")).unionByName(short)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean of a group; null if a row with a value has no weight, or nothing is weighted."""
    whole = F.count_if(value.isNotNull() & weight.isNull()) == 0
    counted = F.when(value.isNotNull(), weight)
    return F.when(whole & (F.sum(counted) > 0), F.sum(value * weight) / F.sum(counted))


def confidence(entity: Column, unit: Column, track: Column) -> Column:
    e, u, t = (T.blank_to_null(c).isNotNull() for c in (entity, unit, track))
    return F.when(e & u & t, "high").when(e & u, "medium").when(e, "low").otherwise("raw")


def prediction_label(structured: Column, bars: Column, score: Column, grade: Column) -> Column:
    said = F.concat_ws(" · ", F.concat(bars.cast("int").cast("string"), F.lit("칸")), F.concat(F.lit("내 점수 "), score.cast("string")), F.concat(F.lit("반영등급 "), grade.cast("string")))
    return F.when(structured.isNull(), "예측: 미확인").when(~structured, "예측: 수집됨 · 값 구조화 대기").when(said == "", "예측: 같은 카드 수치 확인").otherwise(F.concat(F.lit("예측: "), said))


def attach_recent(events: DataFrame, key: str, at: str, armed: Column, context: str, seconds: int = 300) -> DataFrame:
    """Adds bridged: an event's own context, or else the newest armed one of its key within ``seconds`` before."""
    from .tables import carried

    armed_at = carried(events, [key], [at], F.when(armed, F.struct(F.col(at).alias("at"), F.col(context).alias("context"))))
    fresh = F.unix_timestamp(F.col(at)) - F.unix_timestamp(armed_at["at"]) <= seconds
    return events.withColumn("bridged", F.coalesce(F.col(context), F.when(fresh, armed_at["context"])))
