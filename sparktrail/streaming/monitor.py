"""A rule over an unbounded log: its automaton's state is kept a case, and each batch reports cases whose verdict changed.

`timed_monitor` orders steps by event time; `offline` gives the same verdicts for a finished log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import formula as fm
from ..plans import temporal


LATEST = 1 << 62


def tabulated(rule: str) -> tuple[dict[tuple[int, str | None], int], list[bool], set[str]]:
    f = fm.parse(rule)
    delta, accepting = fm.automaton(f, [*fm.atoms(f), None])
    return {(s, x): t for s, x, t in delta}, accepting, set(fm.atoms(f))


def monitor(log: DataFrame, rule: str, case: str, order: list[str], atom: str, case_type: str = "long") -> DataFrame:
    """case, state, steps, holds after each batch of a stream. Rows of a case are ordered within a batch; late ones count as later."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    delta, accepting, names = tabulated(rule)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, steps = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for x in rows[atom]:
            at = delta[at, x if x in names else None]
        steps += len(rows)
        state.update((at, steps))
        yield pd.DataFrame({case: [key[0]], "state": [at], "steps": [steps], "holds": [bool(accepting[at])]})

    return log.groupBy(case).applyInPandasWithState(step, f"{case} {case_type}, state int, steps long, holds boolean", "state int, steps long", "update", GroupStateTimeout.NoTimeout)


def timed_monitor(log: DataFrame, rule: str, case: str, time: str, order: str, atom: str, delay: str = "10 minutes", idle_ms: int = 3_600_000, case_type: str = "long") -> DataFrame:
    """case, last, state, steps, holds, final: steps in event-time order, for streams whose rows come out of order by `delay` at most.

    Rows wait in state until the watermark has passed their time; then those of a case step through the automaton by (time,
    order), and the case is reported with its last time. Rows that come behind the watermark are left out (Spark counts them as
    dropped). A case without a row for `idle_ms` of event time is reported once more with final = true and forgotten; later rows
    start a new run of it, however batches fall. Rows without a case, a time or an order are left out; a null atom is a step of no name. State of a
    case is what waits within the delay, not its history. The session needs the RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor

    delta, accepting, names = tabulated(rule)

    class Monitor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.run = handle.getValueState("run", "at int, steps long, last long")
            self.waiting = handle.getListState("waiting", "ms long, pos long, name string")

        def wake(self, ms: int) -> None:
            """One timer a case: the next time at which there is something to do."""
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)

        def told(self, key: tuple, run: tuple[int, int, int], final: bool) -> pd.DataFrame:
            at, steps, last = run
            return pd.DataFrame({case: [key[0]], "last": [pd.Timestamp(last, unit="ms")], "state": [at], "steps": [steps], "holds": [bool(accepting[at])], "final": [final]})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            first = LATEST
            for pdf in rows:
                ms, pos, name = (pdf.iloc[:, c].tolist() for c in (-3, -2, -1))  # by place: Spark renames columns here
                self.waiting.appendList([(int(t), int(k), x if x in names else None) for t, k, x in zip(ms, pos, name, strict=True)])
                first = min([first, *ms])
            if first < min(self.handle.listTimers(), default=LATEST):
                self.wake(first)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            due, rest = sorted(r for r in ((t, k, x is not None, x) for t, k, x in rows) if r[0] <= now), [r for r in rows if r[0] > now]
            run = tuple(self.run.get()) if self.run.exists() else None
            for t, _, _, x in due:
                if run and t - run[2] >= idle_ms:
                    yield self.told(key, run, True)
                    run = None
                at, steps, _ = run or (0, 0, 0)
                run = (delta[at, x], steps + 1, t)
            if due:
                yield self.told(key, run, False)
                self.waiting.clear()
                if rest:
                    self.waiting.put(rest)
            if run and now >= run[2] + idle_ms:
                yield self.told(key, run, True)
                self.run.clear()
                run = None
            elif run:
                self.run.update(run)
            if rest or run:
                self.wake(min([*(r[0] for r in rest), *([run[2] + idle_ms] if run else [])]))

        def close(self) -> None:
            pass

    rows = log.filter(F.col(case).isNotNull() & F.col(time).isNotNull() & F.col(order).isNotNull()).withWatermark(time, delay)
    rows = rows.select(case, time, F.unix_millis(time).alias("_ms"), F.col(order).cast("long").alias("_pos"), F.col(atom).alias("_name"))
    return rows.groupBy(case).transformWithStateInPandas(Monitor(), f"{case} {case_type}, last timestamp, state int, steps long, holds boolean, final boolean", "Update", "EventTime")


def offline(log: DataFrame, rule: str, case: str, order: list[str], atom: str) -> DataFrame:
    return temporal.verdicts(log, {"holds": rule}, case, order, atom)
