"""The 24-hour state of hosts as a stream: at every tick the rows that operators.state.state_risk gives of the flows so far.

Flows are first summed by host, role, 30-second pane and port or address, which combines them inside each task, so a host
that holds a third of all flows reaches its keyed state as one row a pane and port. The state holds the last pane of each
port or address and the counts of each pane; a timer at every tick writes the host's row, drops what is older than a
day and, once nothing is left, the key itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsentry.functions.expressions import SENSITIVE_PORTS, is_noise
from flowsentry.operators.state import AGO, either_risk

PANE_US, DAY_US = 30_000_000, 86_400_000_000
COUNTS = ("fails", "ssh_fails", "dns", "successes")
_TICK = "host string, role string, tick_us long, ports_30s long, ports_5m long, ports_1h long, ports_all long, sensitive int, fails_30s long, fails_5m long, fails_1h long, fails_all long, ssh_fails_5m long, ssh_fails_1h long, dns_1h long, successes long, external_ips long, internal_ips long"


def host_panes(flows: DataFrame, late: str = "1 minute") -> DataFrame:
    """(host, role, pane_us, part, counts) of a stream of flows: pane_us is the end of the 30-second pane that holds the
    flow, its start excluded; part is a victim's port or an outbound source's peer."""
    failed = "conn_state IN ('S0', 'REJ')"
    n = lambda c: f"CASE WHEN {c} THEN 1L ELSE 0L END"
    victim = f"named_struct('host', dst_ip, 'role', 'victim', 'part', CAST(dst_port AS STRING), 'fails', {n(failed)}, 'ssh_fails', {n(f'{failed} AND dst_port = 22')}, 'dns', 0L, 'successes', 0L)"
    source = f"named_struct('host', src_ip, 'role', 'outbound', 'part', dst_ip, 'fails', 0L, 'ssh_fails', 0L, 'dns', {n('dst_port = 53')}, 'successes', {n("dst_port <> 53 AND conn_state = 'SF'")})"
    roles = f"filter(array(CASE WHEN dst_ip LIKE '192.168.%' THEN {victim} END, CASE WHEN src_ip LIKE '192.168.%' AND dst_ip <> src_ip THEN {source} END), x -> x IS NOT NULL)"
    seen = flows.filter(f"NOT {is_noise()}").withColumn("seen", F.expr("timestamp_micros(ts_us - 1)")).withWatermark("seen", late)
    rows = seen.select("seen", F.explode(F.expr(roles)).alias("r")).select("seen", "r.*")
    panes = rows.groupBy(F.window("seen", f"{PANE_US // 1_000_000} seconds").alias("pane"), "host", "role", "part").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return panes.select("host", "role", F.unix_micros("pane.end").alias("pane_us"), "part", *COUNTS)


class HostMemory(StatefulProcessor):
    """A day of one host in one role; rows at every tick (multiples of every_us) while anything is remembered."""

    def __init__(self, every_us: int, memory_us: int = DAY_US) -> None:
        self.every_us, self.memory_us = every_us, memory_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "tick_us long")
        self.parts = handle.getMapState("parts", "part string", "pane_us long")
        self.panes = handle.getMapState("panes", "pane_us long", ", ".join(f"{c} long" for c in COUNTS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values("pane_us", kind="stable")
        tick = self.next.get()[0] if self.next.exists() else None
        out = []
        for pane, group in arrived.groupby("pane_us"):
            pane = int(pane)
            while tick is not None and tick < pane:  # what came before this pane is complete: write the ticks that it ends
                tick = self._tick(key, tick, out)
            if tick is None:
                tick = -(-pane // self.every_us) * self.every_us
            for part in group["part"]:
                self.parts.updateValue((part,), (pane,))
            self.panes.updateValue((pane,), tuple(int(group[c].sum()) for c in COUNTS))
        self._wait(tick)
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tick, out = self.next.get()[0] if self.next.exists() else None, []
        while tick is not None and tick <= timerValues.getCurrentWatermarkInMs() * 1000:
            tick = self._tick(key, tick, out)
        self._wait(tick)
        yield from self._frames(out)

    def close(self) -> None:
        pass

    def _wait(self, tick: int | None) -> None:
        if tick is None:
            self.next.clear()
        else:
            self.next.update((tick,))
            self.handle.registerTimer(-(-tick // 1000))

    @staticmethod
    def _frames(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TICK.split(", ")])

    def _tick(self, key: tuple, tick: int, out: list[tuple]) -> int | None:
        """Appends the row of a tick to out; gives the next tick, or none if nothing is remembered."""
        parts, panes = [], []
        for (part,), (pane,) in list(self.parts.iterator()):
            if pane <= tick - self.memory_us:
                self.parts.removeKey((part,))
            else:
                parts.append((part, tick - pane))
        for (pane,), counts in list(self.panes.iterator()):
            if pane <= tick - self.memory_us:
                self.panes.removeKey((pane,))
            else:
                panes.append((tick - pane, *counts))
        if not parts:
            return None
        within = lambda i, us: sum(p[i] for p in panes if p[0] < us)
        victim = key[1] == "victim"
        ports = [sum(age < us for _, age in parts) if victim else 0 for us in (*AGO.values(), self.memory_us)]
        inner = sum(p.startswith("192.168.") for p, _ in parts)
        out.append((key[0], key[1], tick, *ports, int(victim and any(int(p) in SENSITIVE_PORTS for p, _ in parts)), *[within(1, us) for us in (*AGO.values(), self.memory_us)], within(2, AGO["5m"]), within(2, AGO["1h"]), within(3, AGO["1h"]), within(4, self.memory_us), *((0, 0) if victim else (len(parts) - inner, inner))))
        return tick + self.every_us


def live_state(flows: DataFrame, every: int = 300, late: str = "1 minute", memory_hours: int = 24) -> DataFrame:
    """(tick_us, host, role, state_risk, patterns) of a stream of flows with ts_us: at every multiple of every seconds the
    hosts with a state risk above 0, over the flows up to it. Flows later than late are dropped; a tick is written once
    the stream is late past it."""
    if every * 1_000_000 % PANE_US:
        raise ValueError(f"every must be a multiple of {PANE_US // 1_000_000} seconds")
    ticks = host_panes(flows, late).groupBy("host", "role").transformWithStateInPandas(HostMemory(every * 1_000_000, memory_hours * 3_600_000_000), _TICK, "append", "eventTime")
    return either_risk(ticks, "tick_us").filter("state_risk > 0")
