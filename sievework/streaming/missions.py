"""Streams of mission events: one event of a target can change its siblings; failing pages wait, open and go.

Both operators keep their state with Spark (RocksDB state store), so a restart
goes on where it ended, and a batch that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.missions import BY_CONFIRM, BY_COVER, MOVES, OUTSTANDING, RANKS

_CHANGE = "identity_key string, target_id string, lane string, state string, attempts long, reason string, priority int, seq long"


def _events(rows: Iterator[pd.DataFrame]) -> list:
    """The rows of a batch as named tuples; what is missing is None, whatever pandas made of it."""
    return [type(e)(*(None if pd.isna(x) else x for x in e)) for part in rows for e in part.itertuples(index=False)]


class Targets(StatefulProcessor):
    """The targets of an identity in a map by id; every event's changes are emitted, also those of siblings.

    The rules are those of ``operators.missions.fold``. Events of a batch are
    taken in order of ``seq``; one that is older than what the identity has
    seen is late and changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.targets = handle.getMapState("targets", "target_id string", "lane string, state string, attempts long, reason string, priority int")
        self.seen = handle.getValueState("seen", "seq long")

    def _put(self, target: str, now: tuple) -> None:
        self.targets.updateValue((target,), now)

    def _apply(self, e, known: dict[str, tuple]) -> list[str]:
        """Change ``known`` by one event; the ids of what changed."""
        lane, changed, priority = e.lane, [], None if e.priority is None else int(e.priority)
        if e.event == "cover":
            trigger = BY_COVER
        elif e.event == "close":
            for k, (ln, state, n, _, p) in known.items():
                if state in OUTSTANDING:
                    known[k] = (ln, "failed", n, e.reason, p)
                    changed.append(k)
            return changed
        elif e.target_id not in known:
            if e.event == "capture":
                known[e.target_id] = (lane, "pending", 0, None, priority)
                changed.append(e.target_id)
            return changed
        else:
            own_lane, state, n, reason, p = known[e.target_id]
            to, trigger = MOVES.get(e.event), None
            if e.event == "capture" and state in ("pending", "failed"):
                new = (own_lane, state, n, reason, max((x for x in (p, priority) if x is not None), default=None))
            elif e.event == "attempt":
                new = (own_lane, state, n + 1, reason, p)
            elif e.event == "retry" and state == "pending":
                new = (own_lane, state, n, e.reason, p)
            elif to and RANKS[to] >= RANKS[state] and (to != "confirmed" or lane == own_lane):
                new = (own_lane, to, n, {"failed": e.reason, "deferred": reason}.get(to), p)
                trigger = BY_CONFIRM if to == "confirmed" else None
            else:
                return changed
            if new != known[e.target_id]:
                known[e.target_id] = new
                changed.append(e.target_id)
        if trigger:
            for k, (ln, state, n, _, p) in known.items():
                if ln == lane and state == "pending":
                    known[k] = (ln, "skipped", n, trigger, p)
                    changed.append(k)
        return changed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        known = {k[0]: tuple(v) for k, v in self.targets.iterator()}
        last = self.seen.get()[0] if self.seen.exists() else None
        out, touched = [], set()
        for e in sorted(_events(rows), key=lambda e: e.seq):
            if last is not None and e.seq <= last:
                continue
            last = e.seq
            for k in self._apply(e, known):
                touched.add(k)
                out.append((key[0], k, *known[k], last))
        for k in touched:
            self._put(k, known[k])
        if last is not None:
            self.seen.update((int(last),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGE.split(", ")]).astype({"priority": "Int32"})

    def close(self) -> None:
        pass


def target_changes(events: DataFrame) -> DataFrame:
    """Every change of a target, from a stream of (identity_key, target_id, lane, event, reason, priority, seq); the last by seq is its state."""
    e = events.select("identity_key", "target_id", "lane", "event", "reason", F.col("priority").cast("int").alias("priority"), F.col("seq").cast("long").alias("seq"))
    return e.groupBy("identity_key").transformWithStateInPandas(Targets(), _CHANGE, "Update", "None")


_RETRY = "page string, attempt int, outcome string, at_ms long, due_ms long, reason string"


class Breaker(StatefulProcessor):
    """Retries of a page: a failure waits longer each time, several open the breaker, the last is dead.

    The number of failures is kept with the state, so it outlives restarts.
    After failure n the page waits ``base_ms + step_ms * n``; a timer at that
    (event) time releases it. From ``opens_at`` failures on the breaker is
    open: requests are refused until the timer lets one try through. Failure
    ``dead_at`` is DEAD, and so the page stays: what comes later is refused. A
    success closes the breaker and ends the count. A page that nothing happens
    to for ``forget_ms`` is forgotten, dead or not: a second timer ends its state.
    """

    def __init__(self, opens_at: int, dead_at: int, base_ms: int, step_ms: int, forget_ms: int):
        self.opens_at, self.dead_at, self.base_ms, self.step_ms, self.forget_ms = opens_at, dead_at, base_ms, step_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Failures so far, state (WAITING, OPEN, FREE, DEAD), when the wait ends, when the page is forgotten.
        self.state = handle.getValueState("state", "failures int, state string, due_ms long, forget_ms long, reason string")

    def _set(self, before: tuple | None, failures: int, state: str, due: int | None, at: int, reason: str | None) -> None:
        for old in (before[2], before[3]) if before else ():
            if old is not None:
                self.handle.deleteTimer(old)
        forget = max(at, due or at) + self.forget_ms
        for new in (due, forget):
            if new is not None:
                self.handle.registerTimer(new)
        self.state.update((failures, state, due, forget, reason))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        out = []
        for e in sorted(_events(rows), key=lambda e: (e.at, e.event, e.reason or "")):
            now = tuple(self.state.get()) if self.state.exists() else None
            at, failures, state = int(pd.Timestamp(e.at).timestamp() * 1000), now[0] if now else 0, now[1] if now else "FREE"
            if state == "DEAD":
                out.append((key[0], failures, "REFUSED", at, None, now[4]))
            elif e.event == "failure":
                failures += 1
                if failures >= self.dead_at:
                    self._set(now, failures, "DEAD", None, at, e.reason)
                    out.append((key[0], failures, "DEAD", at, None, e.reason))
                else:
                    due, state = at + self.base_ms + self.step_ms * failures, "OPEN" if failures >= self.opens_at else "WAITING"
                    self._set(now, failures, state, due, at, e.reason)
                    out.append((key[0], failures, state, at, due, e.reason))
            elif e.event == "success":
                if now:
                    self._set(now, 0, "FREE", None, at, None)
                    out.append((key[0], failures, "CLOSED", at, None, None))
            elif e.event == "request":
                refused = state == "OPEN"
                out.append((key[0], failures, "REFUSED" if refused else "ALLOWED", at, now[2] if refused else None, now[4] if now else None))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        failures, state, due, forget, reason = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if due is not None and at == due:
            self.state.update((failures, "FREE", None, forget, reason))
            yield self._frame([(key[0], failures, "RELEASED", at, None, reason)])
        elif at == forget:
            self.state.clear()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _RETRY.split(", ")]).astype({"attempt": "int32", "due_ms": "Int64"})

    def close(self) -> None:
        pass


def page_retries(events: DataFrame, lateness: str = "10 seconds", opens_at: int = 3, dead_at: int = 5, base_ms: int = 1_200, step_ms: int = 1_000, forget_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """page, attempt, outcome, at_ms, due_ms, reason from a stream of (page, event, reason, at); timers run by event time."""
    e = events.select("page", "event", "reason", "at").withWatermark("at", lateness)
    return e.groupBy("page").transformWithStateInPandas(Breaker(opens_at, dead_at, base_ms, step_ms, forget_ms), _RETRY, "Append", "EventTime")


def sort_out(folder: str):
    """A foreachBatch function: dead pages go to ``folder``/dead as JSON, all other outcomes to ``folder``/outcomes; a batch that is run again overwrites itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        rows = batch.persist()
        rows.filter("outcome = 'DEAD'").write.mode("overwrite").json(f"{folder}/dead/query={query}/batch={batch_id}")
        rows.filter("outcome <> 'DEAD'").write.mode("overwrite").parquet(f"{folder}/outcomes/query={query}/batch={batch_id}")
        rows.unpersist()

    return run
