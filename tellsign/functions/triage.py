"""Column functions of the triage queue."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellsign.fixed import TRIAGE_OPEN, TRIAGE_PRIORITIES, TRIAGE_STATUSES


def message_id(user: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\n", user, text)), 1, 16)


def _by_priority(risk: Column, pick) -> Column:
    chain = F
    for name, edge, hours in TRIAGE_PRIORITIES:
        if edge is None:
            return chain.otherwise(F.lit(pick(name, hours)))
        chain = chain.when(risk >= edge, F.lit(pick(name, hours)))
    return chain


def priority(risk: Column) -> Column:
    return _by_priority(risk, lambda name, _: name)


def sla_hours(risk: Column) -> Column:
    return _by_priority(risk, lambda _, hours: hours)


def as_time(now: dt.datetime | Column) -> Column:
    """A point in time given by the caller; nothing in a plan asks the clock."""
    return now if isinstance(now, Column) else F.lit(now)


def sla_due_at(risk: Column, status: Column, updated: Column, created: Column,
               now: dt.datetime | Column) -> Column:
    """Deadline of an open item; closed items have none."""
    due = F.coalesce(updated, created, as_time(now)) + F.make_dt_interval(hours=sla_hours(risk))
    return F.when(status.isin(*TRIAGE_OPEN), due)


def parse_time(value: Column, now: dt.datetime | Column) -> Column:
    """ISO text to timestamp; text without a zone is UTC, unreadable text means now."""
    return F.coalesce(F.try_to_timestamp(value), as_time(now))


def status_rank(status: Column) -> Column:
    chain = F
    for i, name in enumerate(TRIAGE_STATUSES):
        chain = chain.when(status == name, F.lit(i))
    return chain.otherwise(F.lit(99))


def priority_rank(value: Column) -> Column:
    chain = F
    for i, (name, _, _) in enumerate(TRIAGE_PRIORITIES):
        chain = chain.when(value == name, F.lit(i))
    return chain.otherwise(F.lit(9))


def tail(array: Column, size: int) -> Column:
    """The last ``size`` entries; short arrays stay whole."""
    return F.slice(array, F.greatest(F.size(array) - (size - 1), F.lit(1)), F.lit(size))
