"""The file-version log and share links as streams: events come in late and twice, rows come out as a batch would number them.

These forms go beyond the batch operators: Structured Streaming keeps the state and the checkpoints.  A key's events wait in its state
until the watermark has passed them, so they are taken in their order whatever batch brought them; a timer wakes the key when its
next event is due.  Events that come again within the watermark's delay are left out by their number.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

VERSION_SCHEMA = "owner_id string, path string, event_id long, ts timestamp, version_number long"
USE_SCHEMA = "share_token string, use_id long, used_at timestamp, ok boolean, use_number int"
#: Rows counted so far; times (microseconds) and numbers of the events that wait.
STATE = "n long, at array<long>, ids array<long>"
_FAR = 1 << 62


def _in_order(rows: DataFrame, key: list[str], at: str, event: str, schema: str, counted: Callable[[int, pd.Series], tuple[bool, dict]], forget_after: int | None = None) -> DataFrame:
    """Rows of `schema` for each event of a key in the order of (at, event).

    counted(n, row) tells whether an event counts, n being the number that it would have, and the columns that it gives.
    forget_after: seconds of event time without events after which a key's state goes; its numbers begin anew then.
    """
    names, columns = StructType.fromDDL(schema).names, [c for c in rows.columns if c not in key]

    def take(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held_at, held_ids, *_ = state.get if state.exists else (0, [], [])
        waiting = list(zip(held_at, held_ids, strict=True))
        mark = state.getCurrentWatermarkMs()
        if state.hasTimedOut and not waiting:
            state.remove()
            return
        for batch in batches:
            stamps = batch[at].to_numpy("datetime64[us]").astype(np.int64)
            waiting += zip(stamps.tolist(), batch[event].tolist(), strict=True)
        waiting.sort()
        ready = bisect_left(waiting, (mark * 1000 + 1,))
        due, waiting = waiting[:ready], waiting[ready:]
        given = []
        for stamp, _ in due:
            good, more = counted(n + 1, k, stamp)
            n += good
            given.append(more)
        state.update((n, [w[0] for w in waiting], [w[1] for w in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, mark + 1))
        elif forget_after is not None:
            state.setTimeoutTimestamp(mark + forget_after * 1000 + 1)
        if due:  # most calls only take events in; an empty frame each would cost more than all else
            found = {**dict(zip(key, k, strict=True)), event: [w[1] for w in due], at: np.array([w[0] for w in due], "datetime64[us]")}
            found |= {c: [g[c] for g in given] for c in given[0]}
            yield pd.DataFrame({c: found[c] for c in names})

    return rows.select(*key, *columns).groupBy(*key).applyInPandasWithState(take, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def versions(writes: DataFrame, late: str = "1 day", forget_after: int | None = None) -> DataFrame:
    """owner_id, path, event_id, ts, version_number of a stream of writes, numbered by ts and event_id.

    Writes may be late by `late` (later ones are dropped) and come twice; the rows are those that `operators.versions.numbered`
    gives for all writes.  forget_after: seconds after which an idle path's numbers begin anew; None keeps them.
    """
    once = writes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["owner_id", "path", "event_id"])
    return _in_order(once.select("owner_id", "path", "event_id", "ts"), ["owner_id", "path"], "ts", "event_id", VERSION_SCHEMA, lambda n, k, stamp: (True, {"version_number": n}), forget_after)


def used_links(links: DataFrame, uses: DataFrame, late: str = "1 day") -> DataFrame:
    """share_token, use_id, used_at, ok, use_number of a stream of uses, as `operators.access.used_links` gives them for all.

    links: a table (share_token, is_active, expires_at, max_uses), read with each batch and kept in the group's key, so a link
    that is changed counts anew.  A link that has ended leaves no state: later uses aren't good, whatever came before.
    """
    once = uses.withWatermark("used_at", late).dropDuplicatesWithinWatermark(["share_token", "use_id"])
    known = links.select("share_token", F.coalesce("is_active", F.lit(False)).alias("active"), F.unix_micros(F.col("expires_at").cast("timestamp")).alias("ends"), F.col("max_uses").cast("long").alias("most"))
    rows = once.select("share_token", "use_id", "used_at").join(known, "share_token", "left")
    rows = rows.select("share_token", F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("ends", F.lit(_FAR)).alias("ends"), F.coalesce("most", F.lit(_FAR)).alias("most"), "use_id", "used_at")

    def counted(n: int, k: tuple, stamp: int) -> tuple[bool, dict]:
        _, active, ends, most = k
        able = bool(active) and stamp < ends
        ok = able and n <= most
        return able, {"ok": ok, "use_number": n if ok else None}

    schema = "share_token string, active boolean, ends long, most long, use_id long, used_at timestamp, ok boolean, use_number int"
    found = _in_order(rows, ["share_token", "active", "ends", "most"], "used_at", "use_id", schema, counted)
    return found.select(*StructType.fromDDL(USE_SCHEMA).names)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, of a stream or a table of events; with a stream, late rows beyond the mark are left out."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
