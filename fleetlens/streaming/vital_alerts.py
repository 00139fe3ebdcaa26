"""Alert rules over a stream of captures: an instance's newest values, ticks by event time, cooldown.

An instance's state is the newest capture of each surface, captures that no
tick has reached yet, the deadlocks of the last minutes and when each rule
fired last. A tick comes every ``period`` seconds of event time, the first at
the first capture. One that is overdue by a period or more, as after a gap in
the stream, comes once, as of now, and the next one a whole period later:
missed ticks aren't made up for.

State lies in RocksDB (``spark.sql.streaming.stateStore.providerClass``), as
Spark's arbitrary state with timers does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.telemetry import COOLDOWN_SECONDS
from fleetlens.operators.vitals import _COMPARE, ALERT_RULES

#: Seconds between ticks, seconds in which deadlocks count, and how late a capture may come.
PERIOD, WINDOW, LATE = 60, 300, "2 minutes"
#: Metrics that add up over a capture's rows; of others the greatest counts.
_SUMS = ("blocked", "signal_ms", "wait_ms")
#: The metrics that a row of a stored table gives, and what tells apart the rows of one capture.
_METRICS = {
    "cpu_pressure_snapshot": ({"runnable_tasks": "case when online_schedulers > 0 then runnable_tasks / online_schedulers end"}, "''"),
    "memory_headroom_snapshot": ({"ple_seconds": "page_life_expectancy", "pending_grants": "pending_memory_grants", "memory_gb": "case when total_server_memory_kb > 0 then total_server_memory_kb / 1048576 end"}, "''"),
    "plan_cache_snapshot": ({"single_use_pct": "case when total_size_kb > 0 then single_use_size_kb * 100 / total_size_kb end"}, "''"),
    "tempdb_contention_snapshot": ({"pagelatch_waiters": "pagelatch_waiters"}, "''"),
    "io_latency_delta": ({"data_latency_ms": "case when not coalesce(upper(file_type) = 'LOG', false) then greatest(avg_read_latency_ms, avg_write_latency_ms) end", "log_latency_ms": "case when upper(file_type) = 'LOG' then avg_write_latency_ms end"}, "concat_ws('/', database_name, file_logical_name)"),
    "wait_stats_delta": ({"signal_ms": "signal_wait_ms_delta", "wait_ms": "wait_time_ms_delta"}, "wait_type"),
    "live_request_snapshot": ({"blocked": "case when blocking_session_id is not null then 1 else 0 end"}, "concat_ws('/', session_id, request_id)"),
    "deadlock_capture": ({}, "graph_hash"),
}
SCHEMA = "instance_id long, fired_at timestamp, rule_id string, severity string, value double, threshold double"


def captures(table: str, rows: DataFrame) -> DataFrame:
    """(instance_id, surface, item, captured_at, metrics): rows of a stored table, a stream or not, as the alerts take them. Rows without an instance or a time are left out."""
    metrics, item = _METRICS[table]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).cast("double").alias("value")) for k, v in metrics.items()]) if metrics else F.array().cast("array<struct<key:string,value:double>>")
    told = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return rows.where("instance_id is not null and captured_at is not null").select(F.col("instance_id").cast("long").alias("instance_id"), F.lit(table).alias("surface"), F.coalesce(F.expr(item).cast("string"), F.lit("")).alias("item"), F.col("captured_at").cast("timestamp").alias("captured_at"), told.alias("metrics"))


def combined(newest: dict[str, tuple[int, list[dict]]], deadlocks: int | None) -> dict[str, float]:
    """An instance's metrics from its newest captures."""
    found: dict[str, float] = {} if deadlocks is None else {"deadlocks": float(deadlocks)}
    for _, rows in newest.values():
        for row in rows:
            for k, v in row.items():
                found[k] = found[k] + v if k in found and k in _SUMS else max(v, found.get(k, v))
    if found.get("wait_ms", 0) > 0:
        found["signal_pct"] = 100 * found.get("signal_ms", 0.0) / found["wait_ms"]
    return found


def broken(metrics: dict[str, float], rules: list[tuple] | None = None) -> Iterator[tuple[str, str, float, float]]:
    """(rule, severity, value, threshold) of the rules that these metrics break, as ``vitals.breaches`` has them."""
    for rule, metric, compare, threshold, severity in ALERT_RULES if rules is None else rules:
        limit = max(300.0, metrics.get("memory_gb", 0.0) / 4 * 300) if threshold is None else float(threshold)
        if metric in metrics and _COMPARE[compare](metrics[metric], limit):
            yield rule, severity, metrics[metric], limit


class Ticker(StatefulProcessor):
    """One instance. Times are milliseconds of event time."""

    def __init__(self, period: int, cooldown: int, window: int, rules: list[tuple] | None) -> None:
        self.period, self.cooldown, self.window, self.rules = period * 1000, cooldown * 1000, window * 1000, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, surface string, item string, metrics string")
        self.newest = handle.getMapState("newest", "surface string", "at long, rows string")
        self.locked = handle.getListState("locked", "at long")
        self.fired = handle.getMapState("fired", "rule string", "at long")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            at = frame["captured_at"].astype("datetime64[ms]").astype("int64").tolist()
            for t, surface, item, metrics in zip(at, frame["surface"], frame["item"], frame["metrics"], strict=True):
                self.waiting.appendValue((t, surface, item, json.dumps(dict(metrics or {}), sort_keys=True)))
                first = t if first is None else min(first, t)
        if first is not None and not self.next.exists():
            self.next.update((first,))
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        tick = now if now >= due + self.period else due
        self.next.update((tick + self.period,))
        self.handle.registerTimer(tick + self.period)
        metrics = combined(self._reached(tick), self._deadlocks(tick))
        out = []
        for rule, severity, value, threshold in broken(metrics, self.rules):
            if not self.fired.containsKey((rule,)) or tick - self.fired.getValue((rule,))[0] >= self.cooldown:
                self.fired.updateValue((rule,), (tick,))
                out.append((key[0], pd.Timestamp(tick, unit="ms", tz="UTC").tz_localize(None), rule, severity, value, threshold))
        yield pd.DataFrame(out, columns=["instance_id", "fired_at", "rule_id", "severity", "value", "threshold"])

    def _reached(self, tick: int) -> dict[str, tuple[int, list[dict]]]:
        """Takes captures up to the tick into the newest ones: all rows of a surface's latest instant."""
        newest = {k[0]: (at, json.loads(rows)) for k, (at, rows) in self.newest.iterator()}
        later, locked, changed = [], [], {}
        for at, surface, item, metrics in sorted(self.waiting.get()):
            if at > tick:
                later.append((at, surface, item, metrics))
            elif surface == "deadlock_capture":
                locked.append((at,))
            elif surface not in newest or at >= newest[surface][0]:
                rows = changed.get(surface, {}) if surface in newest and newest[surface][0] == at else {}
                if surface not in changed and surface in newest and newest[surface][0] == at:
                    rows = {str(i): r for i, r in enumerate(newest[surface][1])}
                rows[f"{item}/{metrics}" if item == "" else item] = json.loads(metrics)
                changed[surface] = rows
                newest[surface] = (at, list(rows.values()))
        for surface in changed:
            at, rows = newest[surface]
            self.newest.updateValue((surface,), (at, json.dumps(rows)))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        if locked:
            self.locked.appendList(locked)
        return newest

    def _deadlocks(self, tick: int) -> int:
        recent = [(at,) for (at,) in self.locked.get() if at >= tick - self.window]
        self.locked.clear()
        if recent:
            self.locked.put(recent)
        return len(recent)

    def close(self) -> None:
        pass


def vital_alerts(stream: DataFrame, period: int = PERIOD, cooldown: int = COOLDOWN_SECONDS, window: int = WINDOW, late: str = LATE, rules: list[tuple] | None = None) -> DataFrame:
    """(instance_id, fired_at, rule_id, severity, value, threshold) of a stream of ``captures``.

    A tick sees the captures up to its time, which the watermark of ``late``
    has passed; a capture that comes later than that is left out. Null metrics
    don't fire. Of a surface's captures those of the latest instant count; rows
    of one instant and item are one. A rule that fired is silent for ``cooldown`` seconds.
    """
    kept = stream.withWatermark("captured_at", late)
    return kept.groupBy("instance_id").transformWithStateInPandas(Ticker(period, cooldown, window, rules), SCHEMA, "append", "eventTime")
