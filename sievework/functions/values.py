"""Column functions on numbers, times and identifiers. A value that can't be read is null, never 0 and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import entity_key, loose_key, text_of

CADENCES = (1, 2, 3, 5, 10, 15, 20, 30, 60, 120)
RATIO_TOLERANCE = 0.015


def finite(c: Column) -> Column:
    """NaN and infinities are no values."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def integer(c: Column) -> Column:
    """Digits with optional thousands commas."""
    s = F.trim(F.replace(c, F.lit(","), F.lit("")))
    return F.when(s.rlike(r"^\d+$"), s.try_cast("long"))


def ratio(c: Column) -> Column:
    """"n:1" or "n대1" as n."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)\s*(?::|대)\s*1", 1), F.lit("")).try_cast("double")


def numeric_like(c: Column) -> Column:
    return F.coalesce(integer(c).isNotNull() | ratio(c).isNotNull() | F.trim(c).rlike("^[-–—]$"), F.lit(False))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def bounded(c: Column, low: int, high: int) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(low, high), n)


def zero_to_null(c: Column) -> Column:
    """The local store's reading of a missing integer; elsewhere 0 stays 0."""
    return F.nullif(c, F.lit(0))


def ratio_fits(quota: Column, applicants: Column, given: Column) -> Column:
    """Whether a published ratio agrees with its counts; anything missing agrees."""
    missing = quota.isNull() | applicants.isNull() | given.isNull()
    none = (applicants == 0) & (F.abs(given) <= 0.005)
    near = F.abs(F.try_divide(applicants.cast("double"), quota.cast("double")) - given) <= RATIO_TOLERANCE
    return F.when(missing, True).when(quota == 0, none).otherwise(near)


def page_count(total: Column, size: Column, most: int = 600) -> Column:
    return clamp(F.ceil(total / size), 1, most).cast("int")


def pair_of_competition(c: Column) -> Column:
    """struct(early, regular): the two ratios that a cell publishes."""
    told = lambda kind: F.nullif(F.regexp_extract(text_of(c), kind + r"\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.struct(told("수시").alias("early"), told("정시").alias("regular"))


def academic_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(c), r"(?<![0-9])(20[0-9]{2})(?:학년도)?(?![0-9])", 1), F.lit("")).try_cast("int")


def past_academic_year(c: Column, cycle: int) -> Column:
    """The one past academic year that a text labels as such; null if there are none or several."""
    years = F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(r"(20[0-9]{2})\s*학년도"), F.lit(1)), lambda y: y.cast("int")))
    past = F.filter(years, lambda y: (y >= 2000) & (y < cycle))
    return F.when(F.size(past) == 1, F.get(past, F.lit(0)))


def row_year(year: Column, evidence: Column, cycle: int) -> Column:
    """A row's year if it is past and literally labelled in the evidence."""
    told = F.regexp_extract_all(text_of(evidence), F.lit(r"(?<![0-9])([0-9]{4})\s*학년도"), F.lit(1))
    return F.when((year >= 2000) & (year < cycle) & F.array_contains(told, year.cast("string")), year)


def source_time(c: Column) -> Column:
    """A page's own time of update (at +09:00), in either of its two forms."""
    a = r"(20\d{2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})[^\d]{0,40}(\d{1,2})\s*:\s*(\d{2})"
    b = r"(20\d{2})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일[^\d]{0,40}(\d{1,2})\s*:\s*(\d{2})"

    def read(pattern: str) -> Column:
        y, mo, d, h, mi = (F.regexp_extract(text_of(c), pattern, i) for i in range(1, 6))
        iso = F.concat(y, F.lit("-"), F.lpad(mo, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"), F.lit("T"), F.lpad(h, 2, "0"), F.lit(":"), mi, F.lit(":00+09:00"))
        return F.when(y != "", F.try_to_timestamp(iso))

    return F.coalesce(read(a), read(b))


def refresh_minutes(c: Column) -> Column:
    """The refresh interval that a notice tells, 1 to 120 minutes."""
    told = (r"(\d{1,3})\s*분\s*(?:단위|마다|간격)?[^\d]{0,30}(?:업데이트|갱신)", r"(?:업데이트|갱신)[^\d]{0,30}(\d{1,3})\s*분")
    return F.coalesce(*(bounded(F.nullif(F.regexp_extract(text_of(c), p, 1), F.lit("")), 1, 120) for p in told))


def effective_refresh(learned: Column, configured: Column, default: int = 10) -> Column:
    return F.when(learned.between(1, 120), learned).otherwise(clamp(F.coalesce(F.nullif(configured, F.lit(0)), F.lit(default)), 1, 120)).cast("int")


def due(now: Column, last_attempt: Column, source_at: Column, interval: Column, lag: int = 1) -> Column:
    """Whether a target is to be fetched at this minute: long enough since the last attempt, and in phase with its source."""
    waited = F.unix_timestamp(now) - F.unix_timestamp(last_attempt)
    phase = F.pmod(F.coalesce(F.minute(source_at) + interval, F.lit(0)) + lag, interval)
    return F.when(last_attempt.isNull(), True).otherwise((waited >= F.greatest(F.lit(60), (interval - 2) * 60)) & (F.pmod(F.minute(now), interval) == phase))


def cadence(previous: Column, current: Column) -> Column:
    """The usual interval that two successive source times suggest."""
    diff = F.round((F.unix_micros(current.cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))) / 60_000_000).cast("long")
    usual = F.array(*(F.lit(n) for n in CADENCES))
    divides = F.filter(usual, lambda n: (diff % n == 0) & (diff / n <= 6))
    return F.when(diff.between(1, 120), F.when(F.array_contains(usual, diff.cast("int")), diff.cast("int")).otherwise(F.get(divides, F.lit(0))))


def digest(*parts: Column) -> Column:
    """sha256 of parts joined by bars; a missing part is empty."""
    return F.sha2(F.concat_ws("|", *(text_of(p) for p in parts)), 256)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over a text's characters (exact for those of the basic plane), as eight hex digits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, x: ((h.bitwiseXOR(x)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), step)), 8, "0"))


def entity_id(entity: Column) -> Column:
    k = entity_key(entity)
    return F.when(k != "", F.concat(F.lit("uni-"), F.substring(F.sha2(k, 256), 1, 24)))


def campus_id(entity: Column, campus: Column) -> Column:
    k, e = loose_key(campus), entity_id(entity)
    return F.when(e.isNotNull() & (k != ""), F.concat(F.lit("campus-"), F.substring(digest(e, k), 1, 24)))


def unit_id(entity: Column, year: Column, unit: Column) -> Column:
    k, e = loose_key(unit), entity_id(entity)
    return F.when(e.isNotNull() & (k != ""), F.concat(F.lit("unit-"), F.substring(digest(year, e, k), 1, 24)))


def track_id(unit: Column, year: Column, track: Column, kind: Column) -> Column:
    a, k = loose_key(track), loose_key(kind)
    return F.when(unit.isNotNull() & ((a != "") | (k != "")), F.concat(F.lit("track-"), F.substring(digest(year, unit, k, a), 1, 24)))


def application_id(entity: Column, campus: Column, year: Column, unit: Column, track: Column, kind: Column, identity: Column) -> Column:
    e = F.coalesce(entity_id(entity), F.lit("unknown-university"))
    c = F.coalesce(campus_id(entity, campus), F.lit("no-campus"))
    u = F.coalesce(unit_id(entity, year, unit), F.lit("unknown-unit"))
    t = F.coalesce(track_id(u, year, track, kind), F.lit("unknown-track"))
    return F.concat(F.lit("app-"), F.substring(digest(year, e, c, u, t, identity), 1, 28))


def identity_key(year: Column, entity: Column, track: Column, campus: Column, unit: Column) -> Column:
    return F.when(entity.isNotNull() & unit.isNotNull(), digest(year, entity, track, campus, unit))


def scoped_fingerprint(provider: Column, year: Column, fingerprint: Column, scoped: tuple[str, ...]) -> Column:
    """Fingerprints of some providers carry their year, so that equal rows of two years stay apart."""
    value = text_of(fingerprint)
    year_text = F.coalesce(year.cast("string"), F.lit("na"))
    return F.when(provider.isin(*scoped) & ~value.startswith("yr:"), F.concat(F.lit("yr:"), year_text, F.lit(":"), value)).otherwise(value)


def row_fingerprint(kind: Column, page: Column, evidence: Column, observed_at: Column, predictions: Column) -> Column:
    """Predictions get a fingerprint a minute, everything else a stable one."""
    scope = F.when(predictions, F.date_format(F.date_trunc("minute", observed_at), "yyyy-MM-dd'T'HH:mm")).otherwise("stable")
    return digest(kind, page, evidence, scope)
