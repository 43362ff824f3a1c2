"""Rows of a stream wait in state as pages; a rule sees a few at a time, whatever a micro-batch holds."""

import numpy as np
import pandas as pd
import pytest

from flowsentry.streaming import keyed, runs
from flowsentry.streaming.windows import WindowRule
from tests.test_live import Clock, Map, Memory

STEP = 30_000_000


class Pages(Map):
    getValue = lambda self, key: self.kept[key]  # noqa: E731, N815


class Handle(Memory):
    def getMapState(self, name, key, value):  # noqa: N802
        return Pages(self.kept.setdefault(name, {}))


class Seen(keyed.Rule):
    """Gives the rows back, and notes how many came at once and between which bounds."""

    payload, memory, output = "port long, name string, size double", "n long", "ts_us long, id long, port long, name string, size double"

    def __init__(self, whole_times=True):
        self.whole_times, self.steps = whole_times, []

    def start(self):
        return (0,)

    def step(self, memory, rows, end):
        assert rows == sorted(rows, key=lambda r: r[:2]) and all(r[0] <= end for r in rows) and all(r[0] < end for r in rows if self.whole_times)
        self.steps.append((len(rows), end))
        return (memory[0] + len(rows),), rows

    def keep_until(self, memory):
        return None


def made(rng, n, least, most):
    return pd.DataFrame({"key": "k", "ts_us": rng.integers(least, most, n), "id": rng.permutation(n), "port": np.where(rng.random(n) < 0.1, np.nan, rng.integers(1, 99, n)), "name": [None if x % 7 == 0 else str(x) for x in range(n)], "size": rng.random(n)})


@pytest.fixture
def small(monkeypatch):
    for name, n in (("RUN_ROWS", 100), ("PAGE_ROWS", 8), ("STEP_ROWS", 16)):
        monkeypatch.setattr(keyed, name, n)


@pytest.mark.parametrize("whole_times", [True, False])
def test_a_key_of_any_size_meets_its_rule_in_pages(small, whole_times):
    rng, rule, handle = np.random.default_rng(4), Seen(whole_times), Handle()
    order = keyed.InOrder(rule, ["key", "ts_us", "id", "port", "name", "size"])
    order.init(handle)
    want, got = [], []
    for batch, (least, most, end) in enumerate(((0, 3_000_000, 2_000_000), (2_000_000, 5_000_000, 4_000_000), (4_000_000, 6_000_000, 7_000_000))):
        rows = made(rng, 1500, least, most)
        rows["ts_us"] = rows["ts_us"] // 500 * 500 if batch else rows["ts_us"]
        list(order.handleInputRows(("k",), iter([rows[:700], rows[700:710], rows[710:]]), None))
        assert max(len(order._page(number)) for (number,) in handle.kept["pages"]) <= 8
        assert handle.timers[-1] == int(rows["ts_us"].min()) // 1000 + 1
        want += [(int(r.ts_us), int(r.id), None if np.isnan(r.port) else int(r.port), r.name, r.size) for r in rows.itertuples(index=False)]
        for frame in order.handleExpiredTimer(("k",), Clock(end // 1000), None):
            got += [(r[1], r[2], None if pd.isna(r[3]) else int(r[3]), None if pd.isna(r[4]) else r[4], r[5]) for r in frame.itertuples(index=False)]
        assert got == sorted((r for r in want if r[0] < end), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
        assert handle.kept["memory"] == (len(got),)
    assert len(got) == 4500 and not handle.kept["pages"] and "index" not in handle.kept
    assert len(rule.steps) > 4500 / 32 and max(n for n, _ in rule.steps) <= (32 if whole_times else 16)


def test_one_time_may_hold_any_number_of_rows(small):
    handle, rule = Handle(), Seen()
    order = keyed.InOrder(rule, ["key", "ts_us", "id", "port", "name", "size"])
    order.init(handle)
    rows = made(np.random.default_rng(5), 400, 5_000_000, 5_000_001)
    list(order.handleInputRows(("k",), iter([rows[:300], rows[300:]]), None))
    frames = list(order.handleExpiredTimer(("k",), Clock(5_000), None))  # the watermark is not past them
    assert not frames and len(handle.kept["index"][0]) == len(handle.kept["pages"]) > 400 / 8
    (frame,) = order.handleExpiredTimer(("k",), Clock(6_000), None)
    assert frame["id"].tolist() == list(range(400)) and rule.steps[-2][0] == 400


def test_state_stores_share_one_bound(spark):
    names = [*runs._BOUNDS]
    runs.keyed_state(spark)
    assert [spark.conf.get(n) for n in names] == ["true", "256"]
    spark.conf.set(names[1], "99")
    runs.keyed_state(spark)
    assert spark.conf.get(names[1]) == "99"
    spark.conf.unset(names[1])


def test_windows_do_not_depend_on_where_rows_are_cut():
    """Not even inside one time or around a day's silence, before which the last windows are written."""
    rng, rule = np.random.default_rng(6), WindowRule(3)
    times = np.cumsum(rng.choice([0, 100_000, 7_000_000, 40_000_000, 900_000_000, 2 * 86_400_000_000], 150, p=[0.2, 0.35, 0.3, 0.1, 0.03, 0.02]))
    rows = [(int(t), i, int(rng.integers(50, 56)), f"10.0.0.{rng.integers(4)}", ["SF", "S0"][i % 2], 10, 0.5, i % 9 == 0) for i, t in enumerate(times)]
    assert max(np.diff(times)) > 86_400_000_000
    end = rows[-1][0] + 20 * STEP
    _, want = rule.step(rule.start(), rows, end)
    for pieces in (2, 7, 60):
        memory, got = rule.start(), []
        for part in np.array_split(np.arange(len(rows)), pieces):
            memory, out = rule.step(memory, [rows[i] for i in part], rows[part[-1] + 1][0] if part[-1] + 1 < len(rows) else end)
            got += out
        assert got == want
    silent = int(np.argmax(np.diff(times)))
    assert any(times[silent] < ts <= times[silent] + STEP and n for _, ts, n, *_ in want)  # the window that holds the last flow


def test_a_port_counts_once_at_a_time_before_the_rule_sees_it():
    rng, handle, steps = np.random.default_rng(7), Handle(), []

    class Noted(keyed.PerimeterRule):
        def step(self, memory, rows, end):
            steps.append(len(rows))
            return super().step(memory, rows, end)

    rule = Noted(5, STEP, STEP)
    order = keyed.InOrder(rule, ["src_ip", "ts_us", "ports"])
    order.init(handle)
    rows = pd.DataFrame({"ts_us": rng.choice([1, 2, 3, 40], 60_000) * 1_000_000, "id": np.arange(60_000), "dst_port": rng.integers(20, 30, 60_000)})
    list(order.handleInputRows(("h",), iter([rows[:30_000], rows[30_000:]]), None))
    (frame,) = order.handleExpiredTimer(("h",), Clock(50_000), None)
    assert sum(steps) == 4 * 10 and frame.values.tolist() == [["h", 1_000_000, 10], ["h", 40_000_000, 10]]
    every = sorted(map(tuple, rows.values.tolist()))
    assert keyed.PerimeterRule.step(rule, rule.start(), every, 50_000_000)[1] == [(1_000_000, 10), (40_000_000, 10)]
