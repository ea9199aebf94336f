"""Column functions on labels and text: keys, match ladders, redaction, HTML to text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the captured pages know it: also the no-break and the ideographic space.
SPACE = r"[\s\u00A0\u3000]"
# Fixed values of the source domain.
UNIT_SUFFIXES = ("학과", "학부", "전공")
TRACK_KINDS = ("종합", "교과")
TRACK_MODIFIERS = (
    "지역인재", "일반", "면접", "자기추천", "학교장추천", "고른기회", "농어촌", "기회균형",
    "사회기여", "배려", "특성화고", "자율전공", "중심", "서류형", "서류",
)
SCOPE_HEADS = ("모집단위", "해당전형", "전형명", "모집전형")
SCOPE_HEAD_PREFIX = "모집단위명"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column, most: int | None = None) -> Column:
    """White space runs become one blank, ends are trimmed, the rest is cut to ``most`` characters."""
    out = F.trim(F.regexp_replace(c, f"{SPACE}+", " "))
    return out if most is None else F.substring(out, 1, most)


def blank_to_null(c: Column) -> Column:
    """Blank texts and the word null stand for a missing value."""
    return F.when(~F.trim(c).isin("", "null"), F.trim(c))


def entity_key(c: Column) -> Column:
    """Join key of an institution's name: no spaces, no bracketed tail, short forms, lower case."""
    s = F.regexp_replace(text_of(c), f"{SPACE}+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\[[^\]]+\]$", ""), "^국립", "")
    return F.lower(F.replace(F.replace(s, F.lit("교육대학교"), F.lit("교육대")), F.lit("대학교"), F.lit("대")))


def loose_key(c: Column, compat: bool = True) -> Column:
    """Letters and digits alone, lower case. Roman track numbers are lost with ``compat`` and become digits without."""
    s = text_of(c)
    s = s if compat else F.translate(s, "ⅠⅡⅰⅱ", "1212")
    return F.regexp_replace(F.lower(s), "[^0-9a-z가-힣]", "")


def unit_stem(key: Column) -> Column:
    """A unit's key without the unit suffix at its end: of units that match, one's stem is the other."""
    return F.regexp_replace(key, f"(?<=.)(?:{'|'.join(UNIT_SUFFIXES)})$", "")


def unit_keys_match(a: Column, b: Column) -> Column:
    suffix = reduce(lambda x, y: x | y, [(F.concat(a, F.lit(s)) == b) | (F.concat(b, F.lit(s)) == a) for s in UNIT_SUFFIXES])
    return F.when((a == "") | (b == ""), "missing").when(a == b, "exact").when(suffix, "suffix-equivalent").otherwise("none")


def unit_match(left: Column, right: Column, compat: bool = True) -> Column:
    """exact, suffix-equivalent, none or missing."""
    return unit_keys_match(loose_key(left, compat), loose_key(right, compat))


def track_keys_match(a: Column, b: Column) -> Column:
    related = (F.length(a) >= 2) & (F.length(b) >= 2) & (F.contains(a, b) | F.contains(b, a))
    return F.when((a == "") | (b == ""), "missing").when(a == b, "exact").when(related, "related").otherwise("none")


def track_match(left: Column, right: Column, compat: bool = True) -> Column:
    """exact, related (one holds the other), none or missing."""
    return track_keys_match(loose_key(left, compat), loose_key(right, compat))


def track_key(c: Column) -> Column:
    return F.replace(F.replace(loose_key(c), F.lit("학생부"), F.lit("")), F.lit("전형"), F.lit(""))


def track_variants(c: Column) -> Column:
    """Which of the numbered variants 1 and 2 a label names."""
    up = F.upper(text_of(c))
    one = F.contains(text_of(c), F.lit("Ⅰ")) | up.rlike("(^|[^A-Z])I([^A-Z]|$)")
    two = F.contains(text_of(c), F.lit("Ⅱ")) | up.rlike("(^|[^A-Z])II([^A-Z]|$)")
    return F.array_compact(F.array(F.when(one, 1), F.when(two, 2)))


def _held(key: Column, known: tuple[str, ...]) -> Column:
    return F.filter(F.array(*(F.lit(k) for k in known)), lambda k: F.contains(key, k))


def cell_track_match(cell: Column, track: Column, kind: Column, compat: bool = True) -> Column:
    """How surely a table cell names a track: exact, related, category-only or none.

    With ``compat`` a cell that keeps no letters counts as related to any track.
    """
    target, have, kind_key = track_key(track), track_key(cell), track_key(kind)
    wanted, given = track_variants(track), track_variants(cell)
    all_given = F.size(F.array_except(wanted, given)) == 0
    single = ~((F.size(given) > 1) & (F.size(wanted) == 1))
    variant_ok = (F.size(wanted) == 0) | ((F.size(given) > 0) & single & all_given)
    kind_of = lambda c: F.get(_held(loose_key(c), TRACK_KINDS), F.lit(0))
    same_kind = F.coalesce(kind_of(track) == kind_of(cell), F.lit(False))
    strict = (F.size(wanted) == 0) | ((F.size(given) == 1) & all_given)
    modifiers = _held(loose_key(track), TRACK_MODIFIERS)
    told = F.when(F.size(modifiers) == 0, (F.size(wanted) > 0) & (F.size(F.array_except(given, wanted)) == 0) & (F.size(given) > 0)).otherwise(
        F.size(F.array_except(modifiers, _held(loose_key(cell), TRACK_MODIFIERS))) == 0
    )
    has = target != ""
    contains = F.contains(have, target) | (F.contains(target, have) if compat else (F.contains(target, have) & (have != "")))
    return (
        F.when(~has & (kind_key == ""), "none")
        .when(has & variant_ok & ((have == target) | ((F.length(target) >= 3) & F.contains(have, target)) | (same_kind & strict & told)), "exact")
        .when(has & (contains | same_kind), "related")
        .when((kind_key != "") & F.contains(loose_key(cell), kind_key), "category-only")
        .otherwise("none")
    )


def _best(values: Column, ladder: tuple[str, ...]) -> Column:
    out = F.lit("none")
    for x in reversed(ladder):
        out = F.when(F.array_contains(values, x), x).otherwise(out)
    return out


def row_track_match(cells: Column, track: Column, kind: Column, compat: bool = True) -> Column:
    return _best(F.transform(cells, lambda c: cell_track_match(c, track, kind, compat)), ("exact", "related", "category-only"))


def row_unit_match(cells: Column, unit: Column) -> Column:
    return _best(F.transform(cells, lambda c: unit_match(unit, c)), ("exact", "suffix-equivalent"))


def declares_scope(cells: Column) -> Column:
    """Whether a table row opens a scope, by its first cell."""
    first = loose_key(F.get(cells, F.lit(0)))
    return first.isin(*SCOPE_HEADS) | first.startswith(SCOPE_HEAD_PREFIX)


def display_label(entity: Column, track: Column, unit: Column, campus: Column) -> Column:
    campus = blank_to_null(campus)
    joined = F.concat_ws(" · ", blank_to_null(entity), blank_to_null(track), blank_to_null(unit), F.when(campus.isNotNull(), F.concat(F.lit("["), campus, F.lit("]"))))
    return F.substring(F.when(joined == "", "미확인 지원안").otherwise(joined), 1, 220)


#: (pattern, replacement) in order; fixed values.
REDACTIONS = (
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[redacted-email]"),
    (r"(?<!\d)01[016789][-\s]?\d{3,4}[-\s]?\d{4}(?!\d)", "[redacted-phone]"),
    (r"(?<!\d)\d{6}[-\s]?[1-4]\d{6}(?!\d)", "[redacted-id]"),
    (r"(?i)(?:password|passwd|비밀번호)\s*[:：=]?\s*\S+", "[redacted-credential]"),
    (r"(?i)(?:user(?:name|id)?|아이디|회원번호)\s*[:：=]\s*[A-Za-z0-9._@-]{3,}", "[redacted-account]"),
)


def redact(c: Column, most: int | None = None) -> Column:
    out = squeeze(text_of(c))
    for pattern, said in REDACTIONS:
        out = F.regexp_replace(out, pattern, said)
    return out if most is None else F.substring(out, 1, most)


#: Named entities, the ampersand last so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))


def decode_entities(c: Column) -> Column:
    """Named and numeric (decimal and hexadecimal) character references become characters, in one pass."""
    # cut before each reference; a part then begins with at most one
    parts = F.split(c, r"(?=&(?:#x[0-9a-fA-F]+|#[0-9]+|amp|lt|gt|quot|apos|nbsp);)")

    def one(part: Column) -> Column:
        number = F.coalesce(
            F.conv(F.nullif(F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10).cast("int"),
            F.nullif(F.regexp_extract(part, r"^&#([0-9]{1,7});", 1), F.lit("")).cast("int"),
        )
        rest = F.regexp_replace(part, r"^&[#A-Za-z0-9]+;", "")
        # a code point as text by way of its UTF-32 bytes
        char = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
        out = F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.concat(char, rest))
        for name, sign in (*ENTITIES, ("&amp;", "&")):
            out = out.when(part.startswith(name), F.concat(F.lit(sign), rest))
        return out.otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def html_text(c: Column) -> Column:
    """The visible text of a piece of HTML."""
    s = F.regexp_replace(text_of(c), r"(?is)<script\b.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style\b.*?</style>", " ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?\s*>", " ")
    return squeeze(decode_entities(F.regexp_replace(s, r"<[^>]+>", " ")))


def html_title(c: Column, most: int | None = None) -> Column:
    return squeeze(F.regexp_replace(F.regexp_extract(text_of(c), r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]+>", " "), most)


def table_rows(html: Column) -> Column:
    """array<array<string>>: the texts of the cells of every table row; empty cells and rows go."""
    rows = F.regexp_extract_all(text_of(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.filter(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), html_text), lambda x: x != ""))
    return F.filter(cells, lambda r: F.size(r) > 0)
