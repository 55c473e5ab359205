"""Keyed state of the submission-time checks.

Rows of one key within one micro-batch are put in time order first; the trigger bounds how many there are. A row that arrives
late, but within ``LATE`` of the newest one, is judged at its own time, and the rows after it whose verdict it changes are judged again:
they come out once more with a higher ``turn``, and the highest turn of a row is its verdict. Later rows than that are dropped by the
watermark. State reaches back as far as a row within the watermark may look, and goes when its key has been silent for that long.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000
MINUTE = 60_000_000


HOUR = 3_600_000_000
LATE = HOUR
#: Event time runs this far ahead of ``t``: a stream's first watermark is 1970, which would drop rows at or before it.
AHEAD = 200 * 365 * DAY


class Forgetting(StatefulProcessor):
    """A processor whose state goes when its key has been silent for ``reach`` and the watermark's delay: an event-time timer, moved with each row."""

    def __init__(self, inner: StatefulProcessor, reach: int) -> None:
        self.inner, self.reach = inner, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")
        self.inner.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = 0

        def watched() -> Iterator[pd.DataFrame]:
            nonlocal newest
            for part in rows:
                newest = max(newest, int(part["t"].max()))
                yield part

        yield from self.inner.handleInputRows(key, watched(), timerValues)
        at = (newest + AHEAD + self.reach + LATE) // 1000 + 1
        if self.timer.exists():
            before = int(self.timer.get()[0])
            if before >= at:
                return
            self.handle.deleteTimer(before)
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.inner.forget()
        self.timer.clear()
        return iter([])


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class RateLimit(StatefulProcessor):
    """Accept at most 10 submissions per address in any 60 seconds; a refused one does not count.

    State: the rows that a late one may still meet, in order, with their verdicts. Verdicts before the earliest new row stay.
    """

    LIMIT = 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "t bigint, doc_id bigint, accepted boolean, turn int")

    def forget(self) -> None:
        self.rows.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["t", "doc_id"])
        known = [(int(r[0]), int(r[1]), bool(r[2]), int(r[3])) for r in self.rows.get()]
        first = (int(batch["t"].iloc[0]), int(batch["doc_id"].iloc[0]))
        stays = bisect.bisect_left(known, first)
        todo = sorted([(*r[:2], r[2], r[3]) for r in known[stays:]] + [(int(t), int(d), None, -1) for t, d in zip(batch["t"], batch["doc_id"], strict=True)], key=lambda r: r[:2])
        judged, out = known[:stays], []
        times = [r[0] for r in judged if r[2]]
        for t, doc, before, turn in todo:
            inside = len(times) - bisect.bisect_right(times, t - MINUTE)
            accepted = inside < self.LIMIT
            if accepted:
                times.append(t)
            if accepted != before:
                turn += 1
                out.append((doc, key[0], t, accepted, turn))
            judged.append((t, doc, accepted, turn))
        keep = bisect.bisect_left(judged, (judged[-1][0] - MINUTE - LATE,))
        self.rows.put(judged[keep:])
        yield pd.DataFrame(out, columns=["doc_id", "ip", "t", "accepted", "turn"])


def clone_scores(counts: pd.Series) -> pd.Series:
    return ((counts - 3) * 0.05 + 0.10).clip(upper=0.30).where(counts > 3, 0.0)


class DeviceClone(StatefulProcessor):
    """Submissions of a device in the 24 hours up to each. State: their times in order, up to an hour longer than that.

    A row up to ``LATE`` behind the newest one is counted among the times around its own, as the batch twin does.
    """

    LATE = LATE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t bigint")

    def forget(self) -> None:
        self.times.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["t", "doc_id"])
        window = [int(r[0]) for r in self.times.get()]
        counts = []
        for t in batch["t"]:
            bisect.insort(window, int(t))
            counts.append(bisect.bisect_right(window, t) - bisect.bisect_left(window, t - DAY))
        self.times.put([(t,) for t in window[bisect.bisect_left(window, window[-1] - DAY - self.LATE) :]])
        n = pd.Series(counts, dtype="int64")
        yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": key[0], "submissions_24h": n, "clone_score": clone_scores(n)})


def _kept_hours(hours: Any, newest: Any, last: int) -> tuple[int, list[int]]:
    """The newest time of a key with that of its new rows, and the hours its state holds: a day's and a few; a new key's state is not read."""
    if not newest.exists():
        return last, []
    return max(last, int(newest.get()[0])), sorted(int(k[0]) for k in hours.keys())


def _keep_hours(hours: Any, newest: Any, now: int, kept: list[int], touched: Iterable[int], rows_of: Callable[[int], list[tuple]]) -> None:
    """Write the touched hours that a later row may still look back to, and drop those none can: most hours of a long batch never reach the state."""
    oldest = (now - DAY - LATE) // HOUR
    for hour in touched:
        if hour >= oldest:
            hours.updateValue((hour,), (rows_of(hour),))
    for hour in kept:
        if hour < oldest:
            hours.removeKey((hour,))
    newest.update((now,))


class DeviceCloneAgain(StatefulProcessor):
    """The same counts by (time, id), where rows that follow a late one are counted again.

    State: a map from hour to that hour's rows. A call reads the hours of its rows and the day before them, and the hours after late ones.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour bigint", "rows array<struct<t:bigint,doc_id:bigint,turn:int>>")
        self.newest = handle.getValueState("newest", "t bigint")

    def forget(self) -> None:
        self.hours.clear()
        self.newest.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["t", "doc_id"])
        first, last = int(batch["t"].iloc[0]), int(batch["t"].iloc[-1])
        newest, kept = _kept_hours(self.hours, self.newest, last)
        window = [(int(r[0]), int(r[1]), int(r[2])) for hour in kept if hour >= (first - DAY) // HOUR for r in self.hours.getValue((hour,))[0]]
        window = sorted(window + [(int(t), int(d), -1) for t, d in zip(batch["t"], batch["doc_id"], strict=True)])
        times, out, touched = [r[0] for r in window], [], {}
        start = bisect.bisect_left(window, (first, int(batch["doc_id"].iloc[0])))
        fresh = [0]
        for _, _, turn in window:
            fresh.append(fresh[-1] + (turn < 0))
        for i in range(start, len(window)):
            t, doc, turn = window[i]
            low = bisect.bisect_left(times, t - DAY)
            if fresh[i + 1] > fresh[low]:  # a new row lies in its day
                out.append((doc, key[0], i + 1 - low, turn + 1))
                window[i] = (t, doc, turn + 1)
                touched.setdefault(t // HOUR, None)
        def rows_of(hour: int) -> list[tuple]:
            return window[bisect.bisect_left(times, hour * HOUR) : bisect.bisect_left(times, (hour + 1) * HOUR)]

        _keep_hours(self.hours, self.newest, newest, kept, touched, rows_of)
        frame = pd.DataFrame(out, columns=["doc_id", "fingerprint", "submissions_24h", "turn"])
        yield frame.assign(clone_score=clone_scores(frame["submissions_24h"]))[["doc_id", "fingerprint", "submissions_24h", "clone_score", "turn"]]


class LastPlaces(StatefulProcessor):
    """For each submission, the last visit of its device to every other place in the day before it, for the travel check.

    State: a map from hour to that hour's visits; a call reads the hours around its rows only. A late visit also comes out as the
    previous one of the visits after it, up to the next visit to its own place.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour bigint", "visits array<struct<t:bigint,doc_id:bigint,ip:string,lat:double,lon:double>>")
        self.newest = handle.getValueState("newest", "t bigint")

    def forget(self) -> None:
        self.hours.clear()
        self.newest.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["t", "doc_id"])
        first, last = int(batch["t"].iloc[0]), int(batch["t"].iloc[-1])
        newest, kept = _kept_hours(self.hours, self.newest, last)
        visits = [(int(r[0]), int(r[1]), r[2], float(r[3]), float(r[4]), False) for hour in kept if hour >= (first - DAY) // HOUR for r in self.hours.getValue((hour,))[0]]
        columns = [batch[c].tolist() for c in ("t", "doc_id", "ip", "lat", "lon")]
        visits += [(int(t), int(doc), ip, float(lat), float(lon), True) for t, doc, ip, lat, lon in zip(*columns, strict=True)]
        visits.sort(key=lambda r: r[:2])
        out, at, by_hour, touched = [], {}, {}, set()
        for t, doc, ip, lat, lon, new in visits:
            by_hour.setdefault(t // HOUR, []).append((t, doc, ip, lat, lon))
            for (plat, plon), (pt, pdoc, pip, pnew) in at.items():
                if (plat, plon) != (lat, lon) and (new or pnew) and pt >= t - DAY:
                    out.append((doc, key[0], t, lat, lon, plat, plon, pt, pdoc, pip))
            at[lat, lon] = (t, doc, ip, new)
            if new:
                touched.add(t // HOUR)
        _keep_hours(self.hours, self.newest, newest, kept, touched, by_hour.__getitem__)
        names = ["doc_id", "fingerprint", "t", "lat", "lon", "plat", "plon", "previous_t", "previous_doc_id", "previous_ip"]
        if out:
            yield pd.DataFrame(out, columns=names)


class SeenHash(StatefulProcessor):
    """First document of each content hash to arrive; later ones are copies of it. A hash is forgotten when no copy came for ``KEPT``."""

    KEPT = 30 * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "doc_id bigint")

    def forget(self) -> None:
        self.first.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A hash seen before needs no look at the batch; only a new one has its rows held to find the earliest.
        if not self.first.exists():
            rows = list(rows)
            earliest = min((int(c["t"].min()), int(c.loc[c["t"] == c["t"].min(), "doc_id"].min())) for c in rows)
            self.first.update((earliest[1],))
        first = int(self.first.get()[0])
        for c in rows:
            yield pd.DataFrame({
                "doc_id": c["doc_id"], "content_hash": key[0], "first_doc_id": first, "is_duplicate": c["doc_id"] != first})
