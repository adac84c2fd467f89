"""Rule ladders over counts and id sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions.prob import _c


def side_source(before, after, full: int = 9) -> Column:
    """What a fallback added to one side: struct(tag, contributed, fully, topped, completed)."""
    b, a = F.coalesce(_c(before), F.array()), F.coalesce(_c(after), F.array())
    changed = (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    contributed = (F.size(a) > 0) & changed
    empty = F.size(b) == 0
    fully, topped = contributed & empty, contributed & ~empty
    tag = F.when(F.size(a) == 0, "none").when(~contributed, "mlb").when(fully, "full").otherwise("top")
    done = F.size(F.array_distinct(a)) == full
    return F.struct(tag.alias("tag"), contributed.alias("contributed"), fully.alias("fully"), topped.alias("topped"), (contributed & done).alias("completed"))


def slate_floor(n_scraped, n_scheduled) -> Column:
    """Write verdict of a slate: REFUSE on an empty scrape that the schedule cannot excuse, SHORT when some are missing."""
    a, b = _c(n_scraped), _c(n_scheduled)
    return (F.when((a == 0) & b.isNull(), "REFUSE unknown").when((a == 0) & (b > 0), "REFUSE empty").when(a == 0, "OK off-day")
            .when(b.isNotNull() & (a < b), "OK short").otherwise("OK"))


def capture_verdict(n_events, n_failed, n_rows, bulk_failed) -> Column:
    """Verdict of a capture run, first matching rule wins."""
    e, f, r = _c(n_events), _c(n_failed), _c(n_rows)
    return (F.when((e > 0) & (f > 0) & ((f >= e) | (r == 0)), "FAILED").when((e > 0) & _c(bulk_failed), "DEGRADED bulk")
            .when((e > 0) & (r == 0), "DEGRADED empty").when(f > 0, "DEGRADED partial").otherwise("OK"))
