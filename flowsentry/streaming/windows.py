"""The sliding-window features of sources as a stream: all measures, 30 s, 1 min and 5 min, empty windows included.

The keyed state of a source is a ring of its last panes, each with its sums and its counts by port and by address, as in
operators.windows; a timer at each window's end writes it whether or not flows came.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame

from flowsentry.functions.expressions import HORIZONS, STEP_US, is_local, is_noise
from flowsentry.operators.windows import features
from flowsentry.streaming.keyed import Rule, _in_order

SUMS = ("n", "failed", "dns", "external", "bytes", "duration", "gaps", "gap_sum", "gap_squares", "ports", "plogp", "ips")
_REALS = ("duration", "gap_sum", "gap_squares", "plogp")
QUIET_US, FORGET_US = STEP_US * max(HORIZONS.values()), 86_400_000_000


class Pane:
    """Sums of one step of a source."""

    def __init__(self, number: int, kept: dict | None = None) -> None:
        self.number = number
        self.sums = dict.fromkeys(SUMS[:9], 0) if kept is None else kept["sums"]
        self.ports, self.ips = ({}, {}) if kept is None else (kept["ports"], kept["ips"])
        self.first, self.last = (None, None) if kept is None else (kept["first"], kept["last"])

    def add(self, t: int, port: int | None, ip: str | None, state: str | None, size: int | None, duration: float | None) -> None:
        s = self.sums
        s["n"] += 1
        s["failed"] += state in ("REJ", "S0")
        s["dns"] += port == 53
        s["external"] += not (ip or "").startswith("192.168.")
        s["bytes"] += int(size or 0)
        s["duration"] += max(duration or 0, 0)
        if self.last is not None:
            gap = (t - self.last) / 1e6
            s["gaps"], s["gap_sum"], s["gap_squares"] = s["gaps"] + 1, s["gap_sum"] + gap, s["gap_squares"] + gap * gap
        self.first, self.last = t if self.first is None else self.first, t
        for counts, value in ((self.ports, port), (self.ips, ip)):
            counts[str(value)] = counts.get(str(value), 0) + 1


class WindowRule(Rule):
    """Rows of each source's windows from its least_flows-th flow on; windows lie on a grid that starts a step after its
    first flow. Windows go on, empty, for the longest horizon after a source's last flow; if it comes back within a
    day, those left out follow first, else a new grid starts."""

    payload = "dst_port long, dst_ip string, conn_state string, bytes long, duration double, noise boolean"
    memory, whole_times = "kept string", False
    output = ", ".join(["k long", "ts_us long", *(f"{c}_{h} {'double' if c in _REALS else 'long'}" for h in HORIZONS for c in SUMS)])

    def __init__(self, least_flows: int) -> None:
        self.least_flows = least_flows

    def start(self) -> tuple:
        return (None,)

    def step(self, memory: tuple, rows: list[tuple], end: int) -> tuple[tuple, list[tuple]]:
        out: list[tuple] = []
        kept = json.loads(memory[0]) if memory[0] else None
        panes = [Pane(p["number"], p) for p in kept["panes"]] if kept else []
        t0, k, seen, last = (kept["t0"], kept["k"], kept["seen"], kept["last"]) if kept else (None, 0, 0, None)
        for t, _, port, ip, state, size, duration, noise in rows:
            if last is not None and t >= last + FORGET_US:
                self._write(out, t0, k, (last + QUIET_US - t0) // STEP_US, seen, panes)
                t0, k, seen, panes = None, 0, 0, []
            if t0 is None:
                t0 = t + STEP_US
            number = (t - t0) // STEP_US + 1
            k, panes = self._write(out, t0, k, number - 1, seen, panes)
            seen, last = seen + 1, t
            if not noise:
                if not panes or panes[-1].number != number:
                    panes.append(Pane(number))
                panes[-1].add(t, port, ip, state, size, duration)
        if t0 is not None:
            k, panes = self._write(out, t0, k, (min(end, last + QUIET_US) - t0) // STEP_US, seen, panes)
        held = {"t0": t0, "k": k, "seen": seen, "last": last, "panes": [vars(p) for p in panes]}
        return ((json.dumps(held),) if t0 is not None else (None,)), out

    def _write(self, out: list[tuple], t0: int, k: int, to: int, seen: int, panes: list[Pane]) -> tuple[int, list[Pane]]:
        while k <= to:
            if seen >= self.least_flows:
                out.append((k, t0 + k * STEP_US, *(x for m in HORIZONS.values() for x in self._window([p for p in panes if k - m < p.number <= k]))))
            k += 1
            panes = [p for p in panes if p.number > k - max(HORIZONS.values())]
        return k, panes

    @staticmethod
    def _window(panes: list[Pane]) -> list[float]:
        sums = {c: sum(p.sums[c] for p in panes) for c in SUMS[:9]}
        for before, after in zip(panes, panes[1:], strict=False):
            gap = (after.first - before.last) / 1e6
            sums["gaps"], sums["gap_sum"], sums["gap_squares"] = sums["gaps"] + 1, sums["gap_sum"] + gap, sums["gap_squares"] + gap * gap
        ports: dict[str, int] = {}
        for p in panes:
            for port, c in p.ports.items():
                ports[port] = ports.get(port, 0) + c
        sums |= {"ports": len(ports), "plogp": math.fsum(c * math.log2(c) for c in ports.values()), "ips": len(set().union(*(p.ips for p in panes)))}
        return [float(sums[c]) if c in _REALS else int(sums[c]) for c in SUMS]

    def keep_until(self, memory: tuple) -> int | None:
        return json.loads(memory[0])["last"] + FORGET_US

    def wake(self, memory: tuple) -> int | None:
        kept = json.loads(memory[0])
        at = kept["t0"] + kept["k"] * STEP_US
        return at if at <= kept["last"] + QUIET_US else kept["last"] + FORGET_US


def live_windows(flows: DataFrame, least_flows: int = 10, late: str = "1 minute") -> DataFrame:
    """operators.windows.window_features of a stream of flows with ts_us: each window once the stream is late past its end,
    from a source's least_flows-th flow on. Flows later than late are dropped. State: a source's flows of the last late
    and its ports and addresses of five minutes."""
    rows = flows.filter(is_local("src_ip")).selectExpr("src_ip", "ts_us", "event_id AS id", "dst_port", "dst_ip", "conn_state", "coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0) AS bytes", "coalesce(CAST(duration AS DOUBLE), 0e0) AS duration", f"{is_noise()} AS noise")
    sums = _in_order(rows, ["src_ip"], WindowRule(least_flows), late)
    return sums.selectExpr("src_ip", "k", "ts_us", *[f"{e} AS {c}" for h, m in HORIZONS.items() for c, e in features(h, m * STEP_US // 1_000_000).items()])
