"""Named queries and the SQL that they are held against."""

from __future__ import annotations

from . import checkpoints, collection, desk, evidence, ladders, ledgers, readings


def queries() -> dict:
    return checkpoints.R.queries | evidence.R.queries | ledgers.R.queries | collection.R.queries | readings.R.queries | desk.R.queries | ladders.R.queries


def oracle_sql() -> dict[str, str]:
    return checkpoints.R.sql | evidence.R.sql | ledgers.R.sql | collection.R.sql | readings.R.sql | desk.R.sql | ladders.R.sql
