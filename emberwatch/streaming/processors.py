"""Keyed state for the alerts that look at every log's own time span, and for windows that fire
when they close.

A key holds a bucket of users. Inside it state is a map with an entry per user, part of the users or
stretch of time, so a micro-batch reads and writes only the entries it touches, however many others there are.
Spark calls the methods by keyword, so their parameter names are fixed, and renames columns that
start with an underscore, so the names here do not. The rows of a key in one micro-batch come as
several frames of one call.

The clock is the event time up to which all is taken to have come. Spark drops rows below its
watermark; where late rows are to be seen, the watermark stays `behind` the clock by as much as a
row may be late.
"""

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def clock_of(timer_values, behind: int) -> int:
    """Microseconds; far in the past as long as no row was seen."""
    ms = timer_values.getCurrentWatermarkInMs()
    return ms * 1000 + behind if ms > 0 else -(2**62)


def wake_at(us: int, behind: int) -> int:
    """The timer millisecond that fires as soon as the clock is at `us` or later.

    A timer fires once the watermark is greater than its millisecond.
    """
    return -(-(us - behind) // 1000) - 1


def _text(who: object) -> str | None:
    return None if pd.isna(who) else who


LOG = ["at_who", "at_part", "at_chunk", "at_us"]

#: users of a bucket are dealt to so many parts, each with one entry of state per chunk of time
PARTS = 16


class SpanBurstProcessor(StatefulProcessor):
    """Keeps, for parts of users and chunks of time, the log times whose span is open, with counts.

    Each call on the state costs far more than a few users' times, so the users of a part share an
    entry: a micro-batch reads and writes each entry it touches once, and their number does not
    grow with the users. Logs behind a chunk are kept for the spans of the chunk that hold them, but
    open no span there. One value tells which entries there are and when the first span of each
    ends, and one timer waits for the earliest end; it judges every span the clock has passed and
    drops those times. Where late rows are dropped, a judged count is final. Where they are taken, a
    late log's span is judged at once, with the logs still kept.
    """

    def __init__(self, span: int, width: int, threshold: int, behind: int = 0) -> None:
        self.span, self.width, self.threshold, self.behind = span, width, threshold, behind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.logs = handle.getMapState(
            "logs", "part int, chunk long", "who array<string>, us array<long>, n array<long>"
        )
        # the first end of each entry, and the end the timer waits for
        self.due = handle.getValueState(
            "due", "part array<int>, chunk array<long>, us array<long>, timer long"
        )

    def _until(self, logs: pd.DataFrame) -> pd.Series:
        """How long a log is needed: to the end of its span, or of all spans of the chunk."""
        if self.behind:
            return logs["at_us"] + self.span
        return np.minimum(logs["at_us"], logs["at_chunk"] + self.width) + self.span

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a busy user's logs of one time are worth counting before they are kept
        come = _counted(pd.concat([_counted(frame.assign(n=1)) for frame in rows]))
        yield from self._judge(clock_of(timerValues, self.behind), come)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judge(clock_of(timerValues, self.behind), None)

    def _judge(self, now: int, come: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        """Add what has come and judge all spans that end at the clock or before it."""
        found = self.due.get()
        due: dict[tuple[int, int], int] = {}
        timer = None
        if found is not None:
            due, timer = dict(zip(zip(found[0], found[1], strict=True), found[2], strict=True)), found[3]
        touched = {entry for entry, us in due.items() if us <= now}
        if come is not None:
            touched.update(come[["at_part", "at_chunk"]].drop_duplicates().itertuples(index=False, name=None))
        if not touched:
            return
        logs = self._load(touched & due.keys())
        if come is not None:
            logs = _counted(pd.concat([logs, come])) if len(logs) else come
        until = self._until(logs)
        done = until <= now
        alerts = self._held(logs, done & (logs["at_us"] < logs["at_chunk"] + self.width))
        if len(alerts):
            yield alerts
        left = logs.assign(at_until=until)[~done]
        left["at_who"] = left["at_who"].astype(object).where(left["at_who"].notna(), None)
        known = set(due)
        for entry in touched:
            due.pop(entry, None)
        for (part, chunk), own in left.groupby(["at_part", "at_chunk"], sort=False):
            entry = int(part), int(chunk)
            due[entry] = int(own["at_until"].min())
            self.logs.updateValue(entry, tuple(own[name].tolist() for name in ("at_who", "at_us", "n")))
        for entry in (touched & known) - due.keys():
            self.logs.removeKey(entry)
        self._wait(due, timer, now)

    def _load(self, entries: set[tuple[int, int]]) -> pd.DataFrame:
        whos, us, n, sizes = [], [], [], []
        for entry in entries:
            held = self.logs.getValue(entry)
            whos += held[0]
            us += held[1]
            n += held[2]
            sizes.append(len(held[0]))
        parts, chunks = ([entry[i] for entry in entries] for i in (0, 1))
        return pd.DataFrame(
            {
                "at_who": pd.Series(whos, dtype=object),
                "at_part": np.repeat(np.array(parts, dtype=np.int64), sizes),
                "at_chunk": np.repeat(np.array(chunks, dtype=np.int64), sizes),
                "at_us": np.array(us, dtype=np.int64),
                "n": np.array(n, dtype=np.int64),
            }
        )

    def _wait(self, due: dict[tuple[int, int], int], timer: int | None, now: int) -> None:
        """Store when the entries' first spans end and set the timer for the earliest end."""
        if not due:
            self.due.clear()
            return
        earliest = min(due.values())
        if timer is None or earliest < timer or timer <= now:
            self.handle.registerTimer(wake_at(earliest, self.behind))
            timer = earliest
        parts, chunks = ([entry[i] for entry in due] for i in (0, 1))
        self.due.update((parts, chunks, list(due.values()), timer))

    def _held(self, logs: pd.DataFrame, judged: pd.Series) -> pd.DataFrame:
        """The judged spans with enough logs in them.

        All logs and all ends of judged spans are put in order of group and time; between a
        log and the end of its span the running count grows by what the span holds.
        """
        spans = logs[judged]
        groups = logs.groupby(["at_who", "at_chunk"], dropna=False, sort=False).ngroup().to_numpy()
        group = np.concatenate([groups, groups[judged]])
        at = np.concatenate([logs["at_us"], spans["at_us"] + self.span])
        n = np.concatenate([logs["n"], np.zeros(len(spans), dtype=np.int64)])
        is_end = np.arange(len(at)) >= len(logs)
        order = np.lexsort((is_end, at, group))
        count = np.empty(len(at), dtype=np.int64)
        count[order] = np.cumsum(n[order])
        held = count[is_end] - count[~is_end][judged]
        found = spans.assign(count=held)[held > self.threshold]
        return found[["at_who", "at_us", "count"]]

    def close(self) -> None:
        pass


class FollowedBySpanProcessor(StatefulProcessor):
    """Counts each user's denials since the last reset; an access reads and resets the count.

    The first denial after a reset starts a timer, whose end resets too. A timer ends by event
    time: before a row, the timers earlier than the row's time, or than the clock, have ended.
    Spark's own timers only free the state of users that were left alone since, so they may come
    late and one serves all users of a stretch of time.
    """

    STRETCHES = 16  # stretches of time a span is divided into

    def __init__(self, span: int, threshold: int, cancel: bool, behind: int = 0) -> None:
        self.span, self.threshold, self.cancel, self.behind = span, threshold, cancel, behind
        self.stretch = max(span // self.STRETCHES, 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.users = handle.getMapState("users", "who string", "n long, ends array<long>")
        self.due = handle.getMapState("due", "us long", "who array<string>")

    def _wake(self, us: int) -> int:
        """The end of the stretch that the end of a timer lies in, in whole milliseconds."""
        return (us // self.stretch + 1) * self.stretch // 1000 * 1000

    def _load(self, who: str | None, now: int) -> tuple[int, list[int], bool]:
        held = self.users.getValue((who,))
        if held is None:
            return 0, [], False
        n, ends = held[0], list(held[1])
        left = [us for us in ends if us >= now]
        return (n if len(left) == len(ends) else 0), left, True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(
            ["at_us", "at_order"], kind="stable", na_position="first"
        )
        now = clock_of(timerValues, self.behind)
        alerts, due = [], defaultdict(list)
        for name, own in batch.groupby("at_who", dropna=False, sort=False):
            who = _text(name)
            n, ends, known = self._load(who, now)
            before = max(ends, default=None)
            heapify(ends)
            for us, denied in zip(own["at_us"].tolist(), own["at_denied"].tolist(), strict=True):
                while ends and ends[0] < us:
                    heappop(ends)
                    n = 0
                if denied:
                    if n == 0:
                        heappush(ends, us + self.span)
                    n += 1
                else:
                    if n >= self.threshold:
                        alerts.append((who, us, n))
                    n = 0
                    if self.cancel:
                        ends.clear()
            if ends:
                self.users.updateValue((who,), (n, ends))
                if max(ends) != before:
                    due[self._wake(max(ends))].append(who)
            elif known:
                self.users.removeKey((who,))
        for wake, whos in due.items():
            held = self.due.getValue((wake,))
            if held is None:
                self.handle.registerTimer(wake_at(wake, self.behind))
            self.due.updateValue((wake,), ((list(held[0]) if held else []) + whos,))
        if alerts:
            yield pd.DataFrame(alerts, columns=["at_who", "at_us", "denied_count"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wake = (expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000 + self.behind
        held = self.due.getValue((wake,))
        if held is not None:
            self.due.removeKey((wake,))
            now = clock_of(timerValues, self.behind)
            for who in set(held[0]):
                n, ends, known = self._load(who, now)
                if ends:
                    self.users.updateValue((who,), (n, ends))
                elif known:
                    self.users.removeKey((who,))
        return iter([])

    def close(self) -> None:
        pass


class ClosingWindowProcessor(StatefulProcessor):
    """Counts logs in windows that are sent when they close, and again for every later log.

    Counts are kept in panes, as wide as the greatest stretch that divides window and slide, so a
    log touches one pane and not all its windows. A window closes when the clock reaches its end;
    one timer waits for the next end, and one per pane for the end of the lateness, when the pane
    goes. A log of a closed window sends each closed window it lies in anew, as long as the clock
    is less than `lateness` past the window's end; after that it does not count in it.
    """

    def __init__(self, window: int, slide: int, threshold: int, lateness: int, behind: int) -> None:
        self.window, self.slide, self.threshold = window, slide, threshold
        self.lateness, self.behind = lateness, behind
        self.pane = gcd(window, slide)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long", "who array<string>, n array<long>")
        # the panes with a window still to close, the clock up to which windows are closed, and
        # the end the timer waits for
        self.open = handle.getValueState("open", "panes array<long>, closed long, due long")

    def _ends(self, pane: int) -> range:
        """Ends of the windows that hold a pane."""
        first = -(-(pane + self.pane - self.window) // self.slide) * self.slide
        return range(first + self.window, pane + self.window + 1, self.slide)

    def _load(self, held: dict[int, dict], pane: int) -> dict[str | None, int]:
        if pane not in held:
            found = self.panes.getValue((pane,))
            held[pane] = {} if found is None else dict(zip(*found, strict=True))
        return held[pane]

    def _state(self) -> tuple[list[int], int, int | None]:
        found = self.open.get() if self.open.exists() else None
        return ([], -(2**62), None) if found is None else (list(found[0]), found[1], found[2])

    def _closed(self, panes: list[int], closed: int, now: int, held: dict) -> list[tuple]:
        """Alerts of the windows whose end the clock has passed since the last look."""
        ends = sorted({end for pane in panes for end in self._ends(pane) if closed < end <= now})
        alerts = []
        for end in ends:
            total: dict[str | None, int] = defaultdict(int)
            for pane in range(end - self.window, end, self.pane):
                for who, n in self._load(held, pane).items():
                    total[who] += n
            alerts += [
                (who, end - self.window, n, False) for who, n in total.items() if n > self.threshold
            ]
        return alerts

    def _wait(self, panes: list[int], now: int, due: int | None) -> None:
        """Store the panes still open and set the timer for the next end."""
        panes = [pane for pane in panes if self._ends(pane)[-1] > now]
        next_end = min((end for pane in panes for end in self._ends(pane) if end > now), default=None)
        if next_end is not None and (due is None or next_end < due or due <= now):
            self.handle.registerTimer(wake_at(next_end, self.behind))
            due = next_end
        self.open.update((sorted(panes), now, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = clock_of(timerValues, self.behind)
        logs = pd.concat(list(rows))
        panes, closed, due = self._state()
        held: dict[int, dict[str | None, int]] = {}
        alerts = self._closed(panes, closed, now, held)
        logs["at_pane"] = logs["at_us"] // self.pane * self.pane
        first_end = {pane: self._ends(pane)[0] for pane in logs["at_pane"].unique().tolist()}
        late = logs["at_pane"].map(first_end) <= now
        known = set(panes)
        changed: set[int] = set()
        counts = logs[~late].groupby(["at_pane", "at_who"], dropna=False, sort=False).size()
        for (pane, who), n in counts.items():
            own = self._load(held, int(pane))
            own[_text(who)] = own.get(_text(who), 0) + int(n)
            changed.add(int(pane))
        behind = logs[late].sort_values(["at_us", "at_order"], kind="stable", na_position="first")
        for name, pane in zip(behind["at_who"].tolist(), behind["at_pane"].tolist(), strict=True):
            ends = [end for end in self._ends(pane) if end + self.lateness > now]
            if not ends:
                continue
            who, own = _text(name), self._load(held, pane)
            own[who] = own.get(who, 0) + 1
            changed.add(pane)
            for end in ends:
                if end > now:
                    break
                within = range(end - self.window, end, self.pane)
                n = sum(self._load(held, p).get(who, 0) for p in within)
                if n > self.threshold:
                    alerts.append((who, end - self.window, n, True))
        for pane in changed:
            if not self.panes.containsKey((pane,)):
                gone = self._ends(pane)[-1] + self.lateness
                self.handle.registerTimer(wake_at(gone, self.behind))
            own = held[pane]
            self.panes.updateValue((pane,), (list(own), list(own.values())))
        self._wait(sorted(known | changed), now, due)
        if alerts:
            yield _alerts(alerts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = clock_of(timerValues, self.behind)
        panes, closed, due = self._state()
        alerts = self._closed(panes, closed, now, {})
        self._wait(panes, now, due)
        # the panes whose last window ended `lateness` before the time this timer was set for
        end = (expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000 + self.behind - self.lateness
        start = end - self.window
        for pane in range(start, start + self.slide, self.pane):
            if self._ends(pane)[-1] + self.lateness <= now and self.panes.containsKey((pane,)):
                self.panes.removeKey((pane,))
        if alerts:
            yield _alerts(alerts)

    def close(self) -> None:
        pass


def _alerts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["at_who", "at_us", "count", "refired"])


def _counted(logs: pd.DataFrame) -> pd.DataFrame:
    return logs.groupby(LOG, dropna=False, sort=False, as_index=False)["n"].sum()
