"""Login levels, alert pauses and perimeter alerts as streams: keyed rules that see each key's rows in order of time.

Rows wait in their key's state until the watermark has passed them, then meet the rule sorted by time and id, so a batch's
order and small delays change nothing and the rows that come out are those of the batch forms in operators. They wait as
sorted pages, which are merged as they are read, so a task holds a page of each sorted run and never a key's whole rows.
A rule's memory is a few numbers; a key whose memory can no longer matter is dropped by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEVELS = ((10, "ban"), (5, "alert"), (3, "warn"))
#: Rows that are sorted together as they come in, rows of a page in state, and rows that a rule sees at once.
RUN_ROWS, PAGE_ROWS, STEP_ROWS = 65_536, 4_096, 8_192
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


class Rule:
    """What happens to a key's rows: columns of a row after (ts_us, id), of the memory, and of what comes out."""

    payload = memory = output = ""
    #: Whether rows of one time must come together, and the payload if equal ones of one time count once.
    whole_times, once = True, ()

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, memory: tuple, rows: list[tuple], end: int) -> tuple[tuple, list[tuple]]:
        """The memory after rows in order, all before end and after all earlier ones, and what comes out."""
        raise NotImplementedError

    def keep_until(self, memory: tuple) -> int | None:
        """When the memory may be dropped; None: not before another row."""
        raise NotImplementedError

    def wake(self, memory: tuple) -> int | None:
        """When to step without rows."""
        return self.keep_until(memory)


class LevelRule(Rule):
    """3, 5, 10 failures in under window_us since the last success warn, alert, ban; each change of level is a row.

    The memory is the times of the failures in the window, one entry for each distinct time, and the last level."""

    payload, memory, output = "outcome string", "times array<long>, counts array<long>, level string", "ts_us long, event_id long, n long, level string"

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def start(self) -> tuple:
        return ([], [], None)

    def step(self, memory: tuple, rows: list[tuple], end: int) -> tuple[tuple, list[tuple]]:
        times, counts, level = list(memory[0]), list(memory[1]), memory[2]
        out, i = [], 0
        while i < len(rows):
            t, event, outcome = rows[i]
            if outcome != "fail":
                if outcome == "success":
                    times, counts, level = [], [], None
                i += 1
                continue
            j = i
            while j < len(rows) and rows[j][0] == t and rows[j][2] == "fail":
                j += 1
            times.append(t)
            counts.append(j - i)
            gone = next(k for k, x in enumerate(times) if x > t - self.window_us)
            times, counts = times[gone:], counts[gone:]
            n = sum(counts)
            now = next((name for least, name in LEVELS if n >= least), None)
            if now is not None and now != level:
                level = now
                out.append((t, event, n, level))
            i = j
        return (times, counts, level), out

    def keep_until(self, memory: tuple) -> int | None:
        """None: a level counts as given until a success, so the last one is kept; without one the failures' window ends."""
        return None if memory[2] is not None else (memory[0][-1] + self.window_us if memory[0] else 0)


class PauseRule(Rule):
    """The first alert goes out, then each that comes pause_us or more after the last one sent, or is riskier than it by increase or more."""

    payload, memory, output = "risk double", "sent_us long, risk double", "ts_us long, id long, risk double"
    whole_times = False

    def __init__(self, pause_us: int, increase: float | None) -> None:
        self.pause_us, self.increase = pause_us, increase

    def start(self) -> tuple:
        return (None, None)

    def step(self, memory: tuple, rows: list[tuple], end: int) -> tuple[tuple, list[tuple]]:
        sent, risk = memory
        out = []
        for t, i, r in rows:
            if sent is None or t - sent >= self.pause_us or (self.increase is not None and r >= risk + self.increase):
                sent, risk = t, r
                out.append((t, i, r))
        return (sent, risk), out

    def keep_until(self, memory: tuple) -> int | None:
        return memory[0] + self.pause_us


class PerimeterRule(Rule):
    """A source that reaches threshold distinct ports in the trailing window, both ends included, is an alert, pause_us or more after its last one."""

    payload, memory, output = "dst_port long", "ports array<long>, times array<long>, sent_us long", "ts_us long, ports long"
    once = ("dst_port",)

    def __init__(self, threshold: int, window_us: int, pause_us: int) -> None:
        self.threshold, self.window_us, self.pause_us = threshold, window_us, pause_us

    def start(self) -> tuple:
        return ([], [], None)

    def step(self, memory: tuple, rows: list[tuple], end: int) -> tuple[tuple, list[tuple]]:
        last, sent, out = dict(zip(*memory[:2], strict=True)), memory[2], []
        for i, (t, _, port) in enumerate(rows):
            last.pop(port, None)
            last[port] = t  # in order of sight
            if i + 1 < len(rows) and rows[i + 1][0] == t:
                continue
            while t - next(iter(last.values())) > self.window_us:
                last.pop(next(iter(last)))
            if len(last) >= self.threshold and (sent is None or t - sent >= self.pause_us):
                sent = t
                out.append((t, len(last)))
        return (list(last), list(last.values()), sent), out

    def keep_until(self, memory: tuple) -> int | None:
        return max([t + self.window_us + 1 for t in memory[1][-1:]] + [t + self.pause_us for t in memory[2:] if t is not None], default=0)


class InOrder(StatefulProcessor):
    """Applies a rule to each key's rows (ts_us, id, payload) in order, once the watermark has passed them."""

    def __init__(self, rule: Rule, names: list[str]) -> None:
        self.rule, self.names = rule, names
        self.kinds = dict(c.split() for c in f"ts_us long, id long, {rule.payload}".split(", "))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([(c, _ARROW[kind]) for c, kind in self.kinds.items()])
        self.pages = handle.getMapState("pages", "number long", "rows binary, size long")
        self.index = handle.getValueState("index", "numbers array<long>, firsts array<long>")
        self.memory = handle.getValueState("memory", self.rule.memory)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        index, new = self._index(), []
        run, n = [], 0
        for arrived in rows:
            run.append(self._batch(arrived))
            n += len(arrived)
            if n >= RUN_ROWS:
                self._keep(self._sorted(run), index, new)
                run, n = [], 0
        if n:
            self._keep(self._sorted(run), index, new)
        self._put_index(index + new)
        self.handle.registerTimer(min(first for first, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = timerValues.getCurrentWatermarkInMs() * 1000
        memory = tuple(self.memory.get()) if self.memory.exists() else self.rule.start()
        for rows, before in self._ready(end):
            memory, out = self.rule.step(memory, rows, before)
            yield from self._frames(key, out)
        memory, out = self.rule.step(memory, [], end)
        yield from self._frames(key, out)
        wake = self.rule.wake(memory) if memory != self.rule.start() else None
        until = self.rule.keep_until(memory) if memory != self.rule.start() else 0
        if until is not None and until <= end:
            self.memory.clear()
        else:
            self.memory.update(memory)
            if wake is not None:
                self.handle.registerTimer(wake // 1000 + 1)

    def close(self) -> None:
        pass

    def _frames(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.names)

    def _index(self) -> list[tuple[int, int]]:
        """(first time, number) of the pages in state."""
        if not self.index.exists():
            return []
        numbers, firsts = self.index.get()
        return list(zip(firsts, numbers, strict=True))

    def _put_index(self, index: list[tuple[int, int]]) -> None:
        if index:
            self.index.update(([number for _, number in index], [first for first, _ in index]))
        else:
            self.index.clear()

    def _batch(self, rows: pd.DataFrame) -> pa.RecordBatch:
        """In pandas a column of whole numbers with nulls is one of reals with NaN; NaN in a column of reals stays."""
        return pa.RecordBatch.from_arrays([pa.array(rows[c], _ARROW[kind], from_pandas=kind != "double") for c, kind in self.kinds.items()], names=list(self.kinds))

    @staticmethod
    def _sorted(run: list[pa.RecordBatch]) -> pa.Table:
        return (rows := pa.Table.from_batches(run).combine_chunks()).sort_by([(c, "ascending") for c in rows.column_names])

    def _keep(self, rows: pa.Table, *index: list[tuple[int, int]]) -> None:
        """Puts sorted rows into state as pages and their entries into the last index; numbers go on from those of all."""
        number = max((number for part in index for _, number in part), default=-1) + 1
        for page in rows.combine_chunks().to_batches(PAGE_ROWS):
            data = page.serialize()
            self.pages.updateValue((number,), (pa.compress(data, "zstd", asbytes=True), data.size))
            index[-1].append((page["ts_us"][0].as_py(), number))
            number += 1

    def _page(self, number: int) -> pa.RecordBatch:
        rows, size = self.pages.getValue((number,))
        return pa.ipc.read_record_batch(pa.decompress(bytes(rows), size, "zstd"), self.schema)

    def _ready(self, end: int) -> Iterator[tuple[list[tuple], int]]:
        """The waiting rows before end, in order and a few at a time, each time with a bound: the given rows are before it and all
        later ones are not. Pages are read by their first times; what is before the next page's is complete."""
        index = sorted(self._index())
        if not index or index[0][0] >= end:
            return
        held, n, enough, at = [], 0, RUN_ROWS, 0
        while at < len(index) and index[at][0] < end:
            number = index[at][1]
            held.append(self._page(number))
            self.pages.removeKey((number,))
            n += len(held[-1])
            at += 1
            bound = min(end, index[at][0]) if at < len(index) else end
            if n < enough and bound < end:
                continue
            rows = self._sorted(held)
            cut = int(np.searchsorted(rows["ts_us"].to_numpy(), bound))
            yield from self._steps(rows.slice(0, cut), bound)
            rows = rows.slice(cut)
            held, n = rows.to_batches(), len(rows)
            enough = n + max(n, RUN_ROWS)  # no row is sorted again more than a few times
        left: list[tuple[int, int]] = []
        if n:
            self._keep(pa.Table.from_batches(held), index, left)
        self._put_index(index[at:] + left)
        if index[at:] + left:
            self.handle.registerTimer(min(first for first, _ in index[at:] + left) // 1000 + 1)

    def _steps(self, rows: pa.Table, end: int) -> Iterator[tuple[list[tuple], int]]:
        if self.rule.once and len(rows):
            found = rows.group_by(["ts_us", *self.rule.once], use_threads=False).aggregate([("id", "min")])
            rows = self._sorted(pa.table({c: found["id_min" if c == "id" else c] for c in self.kinds}).to_batches())
        times, at = rows["ts_us"].to_numpy(), 0
        while at < len(times):
            to = at + STEP_ROWS
            if to < len(times) and self.rule.whole_times:
                to = int(np.searchsorted(times, times[to])) if times[to] > times[at] else int(np.searchsorted(times, times[at], "right"))
            part = rows.slice(at, to - at)
            yield list(zip(*(c.to_pylist() for c in part.columns), strict=True)), int(times[to]) if to < len(times) else end
            at = to


def _in_order(rows: DataFrame, keys: list[str], rule: Rule, late: str) -> DataFrame:
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    output = f"{kinds}, {rule.output}"
    seen = rows.withColumn("seen", F.timestamp_micros("ts_us")).withWatermark("seen", late)
    return seen.groupBy(*keys).transformWithStateInPandas(InOrder(rule, [c.split()[0] for c in output.split(", ")]), output, "append", "eventTime")


def live_levels(logins: DataFrame, window_us: int = 60_000_000, late: str = "1 minute") -> DataFrame:
    """operators.state.login_levels of a stream of (ip, ts_us, event_id, outcome). Attempts later than late are dropped."""
    return _in_order(logins.select("ip", "ts_us", F.col("event_id").alias("id"), "outcome"), ["ip"], LevelRule(window_us), late)


def live_pauses(alerts: DataFrame, keys: list[str], pause_us: int, increase: float | None = None, late: str = "1 minute") -> DataFrame:
    """operators.pauses.sent_alerts of a stream of (keys, ts_us, id, risk). Alerts later than late are dropped."""
    return _in_order(alerts.select(*keys, "ts_us", "id", "risk"), keys, PauseRule(pause_us, increase), late)


def perimeter_alerts(flows: DataFrame, threshold: int = 5, window_us: int = 30_000_000, pause_us: int = 30_000_000, late: str = "1 minute") -> DataFrame:
    """The cooldown of operators.state.perimeter_scans of a stream of (src_ip, ts_us, event_id, dst_port). Flows later than late are dropped."""
    rows = flows.filter("dst_port IS NOT NULL").select("src_ip", "ts_us", F.col("event_id").alias("id"), F.col("dst_port").cast("long").alias("dst_port"))
    return _in_order(rows, ["src_ip"], PerimeterRule(threshold, window_us, pause_us), late)
