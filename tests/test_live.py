"""Streams over rows that arrive in several files, against the batch forms over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import baselines, pauses, risk, state, stored_model, windows
from flowsentry.sources.flows import flows
from flowsentry.streaming import keyed, runs
from flowsentry.streaming import risk as live_risk
from flowsentry.streaming import state as live_state
from flowsentry.streaming import windows as live_windows
from tests.test_pauses import alerts, made_logins

HOUR = 3_600_000_000


def fed(spark, folder, rows, schema, files=3, shuffle=True):
    """A stream that reads rows from files in order of time, one a batch; rows inside a file in any order."""
    rows = sorted(rows, key=lambda r: r[1])
    for i, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        order = np.random.default_rng(i).permutation(part) if shuffle else part
        spark.createDataFrame([rows[j] for j in order.tolist()], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_live_levels_equal_batch(spark, tmp_path):
    schema = "ip string, ts_us long, event_id long, outcome string"
    rows = [(ip, (t + 1000) * 1_000_000, i, o) for ip, t, i, o in made_logins(3, 500)]
    end = ("end", 10**12, 10**6, "success")  # takes the watermark past all others
    stream = fed(spark, tmp_path / "in", [*rows, end], schema)
    got = runs.run_to_end(keyed.live_levels(stream, 120_000_000)).collect()
    want = state.login_levels(spark.createDataFrame(rows, schema), 120_000_000)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(tuple(r)) for r in want.select("ip", "ts_us", "event_id", "n", "level").collect()) and len(got) > 20


def test_live_pauses_equal_batch(spark, tmp_path):
    schema = "key string, ts_us long, id long, risk double"
    rows = [(k, (t + 1000) * 1_000_000, i, r) for k, t, i, r in alerts(5, 250)]  # a stream begins at time 0, after which rows must come
    stream = fed(spark, tmp_path / "in", [*rows, ("end", 10**12, 0, 0.0)], schema)
    got = runs.run_to_end(keyed.live_pauses(stream, ["key"], 100_000_000, 25.0)).collect()
    want = pauses.sent_alerts(spark.createDataFrame(rows, schema), ["key"], 100_000_000, 25.0)
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in want.collect()) and len(got) > 60


def test_a_rule_forgets_what_no_longer_matters():
    levels = keyed.LevelRule(100)
    memory, out = levels.step(levels.start(), [(0, 1, "fail"), (5, 2, "fail"), (5, 3, "fail"), (104, 4, "fail"), (105, 5, "fail")], 200)
    assert out == [(5, 2, 3, "warn")] and memory == ([104, 105], [1, 1], "warn") and levels.keep_until(memory) is None
    assert levels.step(memory, [(106, 6, "success")], 200) == (([], [], None), [])
    assert levels.keep_until(([7], [1], None)) == 107
    assert keyed.PauseRule(50, None).keep_until((3, 0.0)) == 53


FLOWS = "event_id long, ts_us long, src_ip string, dst_ip string, dst_port long, conn_state string"


def attacks():
    """Scans and failures in bursts, then a day and more of little else."""
    rng = np.random.default_rng(8)
    rows = []
    for burst in (0, 2 * HOUR, 25 * HOUR):
        for i in range(60):
            at = burst + int(rng.integers(1, 400)) * 1_000_000 + int(rng.integers(0, 10))
            rows.append((len(rows), at, "203.0.113.9", "192.168.1.1", int(rng.integers(20, 45)) if i % 2 else 22, "S0"))
            rows.append((len(rows), at + 5, "192.168.1.1", f"198.51.100.{rng.integers(0, 30)}", 53 if i % 3 else 443, "SF"))
    return rows


def test_live_state_equals_batch_at_each_tick(spark, tmp_path):
    rows = attacks()
    end = (10**6, 60 * HOUR, "10.0.0.1", "10.0.0.2", 1, "SF")
    stream = fed(spark, tmp_path / "in", [*rows, end], FLOWS)
    got = sorted(tuple(r) for r in runs.run_to_end(live_state.live_state(stream, every=3600)).select("tick_us", "host", "role", "state_risk", "patterns").collect())
    frame, want = spark.createDataFrame(rows, FLOWS), []
    for tick in (HOUR, 3 * HOUR, 24 * HOUR, 26 * HOUR, 40 * HOUR, 49 * HOUR, 50 * HOUR, 51 * HOUR):
        want += [(tick, r["host"], r["role"], r["state_risk"], r["patterns"]) for r in state.state_risk(frame, tick + 1).collect()]
    ticks = {r[0] for r in want}
    assert [r for r in got if r[0] in ticks] == sorted(want) and len(want) > 5
    assert max(r[0] for r in got) <= 50 * HOUR  # a day after the last burst nothing is remembered


class Memory:
    """The parts of a state handle that HostMemory uses, as dictionaries."""

    def __init__(self):
        self.kept, self.timers = {}, []

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self.kept, name)

    def getMapState(self, name, key, value):  # noqa: N802
        return Map(self.kept.setdefault(name, {}))

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Value:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    exists = lambda self: self.name in self.kept
    get = lambda self: self.kept[self.name]
    clear = lambda self: self.kept.pop(self.name, None)

    def update(self, value):
        self.kept[self.name] = value


class Map:
    def __init__(self, kept):
        self.kept = kept

    iterator = lambda self: iter(self.kept.items())
    removeKey = lambda self, key: self.kept.pop(key)  # noqa: E731, N815

    def updateValue(self, key, value):  # noqa: N802
        self.kept[key] = value


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_state_shrinks_after_a_day():
    import pandas as pd

    memory, host = Memory(), live_state.HostMemory(300_000_000)
    host.init(memory)
    pane = lambda at, part: pd.DataFrame({"pane_us": [at], "part": [part], "fails": [1], "ssh_fails": [0], "dns": [0], "successes": [0]})
    out = list(host.handleInputRows(("h", "victim"), iter([pane(30_000_000, "80"), pane(12 * HOUR, "81")]), None))
    assert len(out[0]) == 12 * 12 - 1 and len(memory.kept["parts"]) == 2
    list(host.handleExpiredTimer(("h", "victim"), Clock(25 * HOUR // 1000), None))
    assert set(memory.kept["parts"]) == {("81",)} and len(memory.kept["panes"]) == 1 and "next" in memory.kept
    list(host.handleExpiredTimer(("h", "victim"), Clock(40 * HOUR // 1000), None))
    assert not memory.kept["parts"] and not memory.kept["panes"] and "next" not in memory.kept


def test_ticks_are_whole_panes(spark):
    with pytest.raises(ValueError, match="multiple of 30"):
        live_state.live_state(spark.createDataFrame([], FLOWS), every=45)



def test_live_windows_equal_batch(spark, tmp_path):
    """Two sources with long silences; from the tenth flow on every window of the batch's grid comes out, with the same values."""
    rng = np.random.default_rng(9)
    schema = f"{FLOWS}, orig_bytes long, resp_bytes long, duration long"
    rows = []
    for source in ("192.168.1.5", "192.168.1.6"):
        times = np.cumsum(rng.choice([100_000, 7_000_000, 40_000_000, 900_000_000], 80, p=[0.5, 0.3, 0.15, 0.05])) + 10**9
        rows += [(len(rows) + i, int(t), source, "224.0.0.251" if i % 9 == 0 else f"10.0.0.{rng.integers(4)}", int(rng.integers(50, 56)), ["SF", "S0"][i % 2], None if i % 5 == 0 else 10, 3, int(rng.integers(0, 4))) for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, schema)
    end = (10**6, 10**12, "192.168.1.7", "10.0.0.1", 1, "SF", 1, 1, 1)
    stream = fed(spark, tmp_path / "in", [*rows, end], schema)
    got = {(r["src_ip"], r["ts_us"]): r for r in runs.run_to_end(live_windows.live_windows(stream)).collect()}
    tenth = {s: sorted(r[1] for r in rows if r[2] == s)[9] for s in ("192.168.1.5", "192.168.1.6")}
    want = {(r["src_ip"], r["ts_us"]): r for r in windows.window_features(frame).collect() if r["ts_us"] > tenth[r["src_ip"]]}
    assert len(want) > 100 and set(want) <= set(got) and all(got[k].asDict() == want[k].asDict() for k in want)
    extra = [got[k] for k in set(got) - set(want)]
    assert 0 < len(extra) <= 2 * 10 and all(r["connections_30s"] == 0 for r in extra)


def test_a_baseline_written_between_batches_changes_the_next_one(spark, tmp_path):
    """Two runs of one stream: rows of the second are scored by the version that was published between them, and a new model is loaded."""
    folder, table, checkpoint, model = (str(tmp_path / n) for n in ("baselines", "risk", "checkpoint", "model"))
    frame = flows(spark, "/root/testdata/sf0.001")
    rows = windows.window_features(frame).filter("src_ip = '192.168.50.19'")
    early, late = rows.filter("k % 2 = 0").persist(), rows.filter("k % 2 = 1").persist()
    profiles = baselines.profiles(frame, least_flows=1).persist()
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="no baselines"):
        spark.createDataFrame([], "baseline_version long").write.parquet(f"{tmp_path}/none/marks")
        live_risk.newest(spark, f"{tmp_path}/none")
    live_risk.publish(profiles, folder, 1)
    stored_model.fit(early, model, "1")
    early.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live_risk.run_live_risk(stream(), folder, table, checkpoint, model)
    strict = profiles.withColumns({c: F.lit(0.5) for c in ("connections_30s_p999", "unique_dst_ports_30s_p999", "dns_rate_1m_p999")})
    live_risk.publish(strict, folder, 2)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live_risk.run_live_risk(stream(), folder, table, checkpoint, model)
    got = {r["k"]: r for r in spark.read.parquet(table).collect()}
    assert len(got) == rows.count() and {r["baseline_version"] for k, r in got.items() if k % 2 == 0} == {1} and {r["baseline_version"] for k, r in got.items() if k % 2} == {2}
    loaded = stored_model.load(spark, model)
    for part, found in ((early, profiles), (late, strict)):
        flagged = windows.with_flags(part).join(stored_model.scores(part, loaded).select("src_ip", "k", "anomaly_score"), ["src_ip", "k"])
        want = {r["k"]: r["risk_score"] for r in risk.risk_rows(baselines.with_thresholds(flagged, found)).collect()}
        assert want == {k: got[k]["risk_score"] for k in want} and want
    plain = {r["k"]: r["risk_score"] for r in risk.risk_rows(baselines.with_thresholds(windows.with_flags(late), profiles)).collect()}
    assert any(plain[k] != got[k]["risk_score"] for k in plain)
