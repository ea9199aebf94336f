"""Column functions on URLs: parts, safe forms, query parameters, acceptance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that may carry a secret; fixed values.
SECRET_KEYS = r"(?i)token|session|auth|csrf|transkey|captcha|password|passwd|secret|credential|userid|ipmac"


def _part(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://"))


def host(url: Column) -> Column:
    return F.lower(_part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def authority(url: Column) -> Column:
    """Host and port; the port that the scheme has anyway is left out."""
    port = _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)")
    usual = F.when(scheme(url) == "https", "443").when(scheme(url) == "http", "80")
    return F.concat(host(url), F.when(port.isNotNull() & ~port.eqNullSafe(usual), F.concat(F.lit(":"), port)).otherwise(""))


def path(url: Column) -> Column:
    """The path, "/" if a URL has none, null if the text is no URL."""
    got = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host(url).isNotNull(), F.when(got == "", "/").otherwise(got))


def query(url: Column) -> Column:
    return _part(url, r"^[^?#]*\?([^#]*)")


def host_within(h: Column, domain: str) -> Column:
    """Whether a host is a domain or lies below it."""
    return F.coalesce((h == domain) | h.endswith(f".{domain}"), F.lit(False))


def safe_path(url: Column, with_scheme: bool = False, most: int = 300) -> Column:
    """Host and path alone, without anything that may identify a user."""
    lead = F.concat(scheme(url), F.lit("://")) if with_scheme else F.lit("")
    return F.substring(F.concat(lead, host(url), path(url)), 1, most)


def _pairs(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(query(url), F.lit("")), "&"), lambda p: p != "")


def canonical(url: Column) -> Column:
    """The URL without its fragment and without query keys that may carry a secret."""
    kept = F.filter(_pairs(url), lambda p: ~F.regexp_extract(p, r"^([^=]*)", 1).rlike(SECRET_KEYS))
    return F.when(
        host(url).isNotNull(),
        F.concat(scheme(url), F.lit("://"), authority(url), path(url), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")),
    )


def frontier_url(url: Column, domains: Column | tuple[str, ...], longest_value: int | None = None) -> Column:
    """The form in which a URL may enter the frontier; null unless https and on one of ``domains``. With ``longest_value`` query keys with longer values go (the older collector: 400)."""
    allowed = F.lit(False)
    for d in domains:
        allowed = allowed | host_within(host(url), d)
    kept = F.filter(
        _pairs(url), lambda p: ~F.regexp_extract(p, r"^([^=]*)", 1).rlike(SECRET_KEYS) & ((F.length(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)) <= longest_value) if longest_value else F.lit(True))
    )
    out = F.concat(F.lit("https://"), authority(url), path(url), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when((scheme(url) == "https") & allowed, out)


def parameter(url: Column, key: str) -> Column:
    """First value of a query parameter, or null."""
    found = F.filter(_pairs(url), lambda p: F.regexp_extract(p, r"^([^=]*)", 1) == key)
    return F.when(F.size(found) > 0, F.regexp_extract(F.get(found, F.lit(0)), r"^[^=]*=?(.*)$", 1))


def with_parameter(url: Column, key: str, value: Column) -> Column:
    """The URL with one query parameter set, in last place."""
    kept = F.filter(_pairs(url), lambda p: F.regexp_extract(p, r"^([^=]*)", 1) != key)
    pairs = F.concat(kept, F.array(F.concat(F.lit(f"{key}="), value.cast("string"))))
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), F.array_join(pairs, "&"))


def family_key(url: Column, menu_key: str = "menuId") -> Column:
    """Lists of one family share a path and a menu."""
    menu = parameter(url, menu_key)
    return F.concat(path(url), F.when(menu.isNotNull(), F.concat(F.lit(f"?{menu_key}="), menu)).otherwise(""))


def mirror_of_year(url: Column, year_key: str, code_key: str) -> Column:
    """The same detail page a year before, for codes of the fixed form."""
    year = F.expr("int(null)") if year_key == "" else parameter(url, year_key).try_cast("int")
    return F.when(parameter(url, code_key).rlike(r"^0\d{6}$") & year.isNotNull(), with_parameter(url, year_key, year - 1))


def same_document(a: Column, b: Column) -> Column:
    return F.coalesce((host(a) == host(b)) & (path(a) == path(b)), F.lit(False))


def official(url: Column, domains: tuple[str, ...] = ("ac.kr",)) -> Column:
    """https, an official domain, neither user info nor fragment, no query key that may carry a secret."""
    on = F.lit(False)
    for d in domains:
        on = on | host_within(host(url), d)
    clean = ~F.coalesce(url, F.lit("")).rlike(r"^[a-z]+://[^/?#]*@|#")
    secret = F.exists(_pairs(url), lambda p: F.regexp_extract(p, r"^([^=]*)", 1).rlike(SECRET_KEYS))
    return F.coalesce((scheme(url) == "https") & on & clean & ~secret, F.lit(False))


def without_dots(path: Column) -> Column:
    """A path that begins with "/" without its "." and ".." segments; ".." at the root stays there."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))


def resolve(base: Column, link: Column) -> Column:
    """A link against its page's URL: absolute, rooted, query-only or relative links; "." and ".." are followed wherever they stand, the port is kept."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    told = F.regexp_extract(link, r"^([^?#]*)", 1)
    # of an absolute link the path alone is without dots
    lead = F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole = F.when((lead != "") & F.contains(told, F.lit("/.")), F.concat(lead, without_dots(F.substring(told, F.length(lead) + 1, F.length(told))), rest)).otherwise(link)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), whole)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .when(link.startswith("#") | (link == ""), F.concat(root, path(base), F.when(query(base).isNotNull(), F.concat(F.lit("?"), query(base))).otherwise("")))
        .when(link.startswith("/"), F.concat(root, without_dots(told), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, told)), rest))
    )


def links(html: Column) -> Column:
    """href values of the page's anchors, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))
