"""Providers as data: what they accept, may be asked for, and how their captures become records.

A provider is a ``Provider``: expressions that say which captures are its own
and which of these may be followed, capabilities, and parsers by page kind,
each a function from captures to records. A registry deals captures to
providers and kinds in one pass and unites what their parsers give under one
schema; a provider is added by adding a ``Provider``, without touching this
module.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

#: Capabilities that a provider may have; fixed values.
CAPABILITIES = ("public-deterministic-collection", "authenticated-user-workflow", "user-view-capture-fallback", "authorized-api-sync", "authorized-export-import", "authorized-report-import")
#: Paths that change a user's state, and files; fixed values.
UNSAFE = "logout|signout|member|mypage|my-page|account|profile|userinfo|payment|billing|purchase|order|spassdata|coupon|refund|withdraw|customer|faq|qna|event|notice|privacy|terms"
FILES = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|ico|css|js|map|woff2?|ttf|eot|zip|hwp|hwpx|pdf)$"
RECORD = "provider string, kind string, capture_id string, record_type string, payload map<string,string>"
Parser = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Provider:
    """``domains``: hosts it lives on. ``kind``: a capture's kind from its columns. ``parsers``: kind to a function that takes captures
    (capture_id and all their columns) and gives capture_id, record_type, payload. ``allowed``: path prefixes that may be followed, all if empty;
    ``denied``: a pattern of paths and queries that may not; ``closed``: hosts that are accepted but not followed."""

    name: str
    domains: tuple[str, ...]
    kind: Callable[[DataFrame], Column]
    parsers: dict[str, Parser] = field(default_factory=dict)
    active: tuple[str, ...] = ()
    discoverable: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    denied: str = ""
    closed: tuple[str, ...] = ()

    def accepts(self, url: Column) -> Column:
        out = F.lit(False)
        for d in self.domains:
            out = out | U.host_within(U.host(url), d)
        return F.coalesce(out & U.scheme(url).isin("http", "https"), F.lit(False))

    def navigable(self, url: Column) -> Column:
        """Whether a batch may follow the address."""
        path = F.lower(U.path(url))
        out = self.accepts(url) & ~F.coalesce(U.host(url).isin(*self.closed), F.lit(False)) if self.closed else self.accepts(url)
        if self.allowed:
            under = F.lit(False)
            for p in self.allowed:
                under = under | F.startswith(path, F.lit(p))
            out = out & under
        if self.denied:
            out = out & ~F.concat(path, F.lit("?"), F.lower(F.coalesce(U.query(url), F.lit("")))).rlike(self.denied) & ~path.rlike(FILES)
        return F.coalesce(out, F.lit(False))


def redirect_decision(cycles: Column, threshold: Column, fresh: Column) -> Column:
    """A target that keeps redirecting to the log-in while the core is known to be fresh is set aside; else the session logs in again."""
    return F.when(F.coalesce(fresh & (threshold > 0) & (cycles >= threshold), F.lit(False)), "target-quarantine").otherwise("global-reauth")


def mission_owner(current: Column, candidate: Column) -> Column:
    """An action without a target of its own leaves the mission with its owner."""
    return F.coalesce(candidate, current)


def may_explore(outstanding: Column) -> Column:
    """Generic exploration waits until no target is outstanding."""
    return F.coalesce(outstanding, F.lit(0)) <= 0


class Providers:
    """Several providers; of those that accept a capture the first in order has it."""

    def __init__(self, *providers: Provider):
        names = [p.name for p in providers]
        if len(set(names)) != len(names):
            raise ValueError(f"a provider's name twice: {names}")
        unknown = {c for p in providers for c in (*p.active, *p.discoverable)} - set(CAPABILITIES)
        if unknown:
            raise ValueError(f"no such capabilities: {sorted(unknown)}")
        self.providers = providers

    def owner(self, url: Column) -> Column:
        return F.coalesce(*(F.when(p.accepts(url), p.name) for p in self.providers)) if self.providers else F.lit(None).cast("string")

    def navigable(self, url: Column) -> Column:
        """As the address's own provider says; no one's address isn't followed."""
        out = F.lit(False)
        for p in reversed(self.providers):
            out = F.when(p.accepts(url), p.navigable(url)).otherwise(out)
        return out

    def capability(self, provider: Column, capability: Column) -> Column:
        """``active``, ``discoverable`` or ``none``."""
        out = F.lit("none")
        for p in self.providers:
            mine = provider == p.name
            out = F.when(mine & capability.isin(*p.active), "active").when(mine & capability.isin(*p.discoverable), "discoverable").otherwise(out) if p.active and p.discoverable else (
                F.when(mine & capability.isin(*(p.active or p.discoverable)), "active" if p.active else "discoverable").otherwise(out) if p.active or p.discoverable else out
            )
        return out

    def dealt(self, captures: DataFrame, url: str = "url") -> DataFrame:
        """Adds provider and kind; captures that no provider accepts go, kinds that a provider doesn't know are ``unknown``."""
        kind = F.lit(None).cast("string")
        for p in self.providers:
            kind = F.when(F.col("provider") == p.name, p.kind(captures)).otherwise(kind)
        return captures.withColumn("provider", self.owner(F.col(url))).filter("provider is not null").withColumn("kind", F.coalesce(kind, F.lit("unknown")))

    def records(self, captures: DataFrame, url: str = "url") -> DataFrame:
        """``RECORD``: what every provider's parsers make of its captures of their kind."""
        dealt, out = self.dealt(captures, url), None
        for p in self.providers:
            for kind, parser in p.parsers.items():
                mine = dealt.filter((F.col("provider") == p.name) & (F.col("kind") == kind))
                got = parser(mine).select(F.lit(p.name).alias("provider"), F.lit(kind).alias("kind"), F.col("capture_id").cast("string").alias("capture_id"), F.col("record_type").cast("string").alias("record_type"), F.col("payload").cast("map<string,string>").alias("payload"))
                out = got if out is None else out.unionByName(got)
        return out if out is not None else captures.sparkSession.createDataFrame([], RECORD)


def purge(tables: dict[str, DataFrame], depends: list[tuple[str, str, dict[str, str]]], roots: dict[str, Column]) -> dict[str, DataFrame]:
    """Tables without the rows that ``roots`` names, and without what depends on these.

    ``roots``: table to the condition of rows that go (null is no). ``depends``:
    (child, parent, {child's column: parent's column}); a child goes with its
    parent, through any number of tables. Each table is filtered by anti-joins
    with the keys of the parents' rows that go, parents first, so no orphan is
    left; a second run finds nothing to do. A circle of tables is an error.
    """
    order, left = [], set(tables)
    while left:
        free = sorted(t for t in left if not any(c == t and p in left for c, p, _ in depends))
        if not free:
            raise ValueError(f"tables depend on each other in a circle: {sorted(left)}")
        order += free
        left -= set(free)
    gone: dict[str, DataFrame] = {}
    out = {}
    for name in order:
        t = tables[name]
        root = F.coalesce(roots[name], F.lit(False)) if name in roots else F.lit(False)
        keep, go = t.filter(~root), t.filter(root)
        for child, parent, on in depends:
            if child == name and parent in gone:
                keys = gone[parent].select(*(F.col(p).alias(c) for c, p in on.items())).distinct()
                go = go.unionByName(keep.join(keys, list(on), "left_semi").select(*t.columns))
                keep = keep.join(keys, list(on), "left_anti").select(*t.columns)
        out[name], gone[name] = keep, go
    return out
