"""Windowed alerts, the same plan for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sentrylake import config as C
from sentrylake.functions.text import iso_time


@dataclass(frozen=True)
class Frame:
    """A declared time frame, and the count that must be exceeded in it."""

    minutes: int
    more_than: int


# Declared time frame and threshold of each count rule.
FRAMES = {"ssh": Frame(10, 10), "web_login": Frame(5, 20), "not_found": Frame(5, 30), "windows": Frame(30, 3)}
ALERT = "rule string, key string, window_start timestamp, window_end timestamp, n long, first_ts timestamp"
_OPEN = "start array<long>, n array<long>, first array<long>"


def counted_events(auth: DataFrame | None = None, access: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """(rule, key, ts) of every event that a declared rule counts, from parsed records of the three sources.

    Failed SSH logins by address; refused requests to a login page and 404 by address; failed Windows logons by host.
    """
    parts = []
    if auth is not None:
        parts.append(auth.filter("kind in ('ssh_fail', 'ssh_invalid')").select(F.lit("ssh").alias("rule"), F.col("ip").alias("key"), "ts"))
    if access is not None:
        login = F.lower("path").rlike("|".join(C.LOGIN_PATHS)) & F.col("status").isin(*C.AUTH_FAIL_STATUSES)
        rules = F.array_compact(F.array(F.when(login, "web_login"), F.when(F.col("status") == "404", "not_found")))
        parts.append(access.select(F.explode(rules).alias("rule"), F.col("ip").alias("key"), "ts"))
    if windows is not None:
        parts.append(windows.filter("event.event_code = '4625'").select(F.lit("windows").alias("rule"), F.col("event.host").alias("key"), iso_time(F.col("event.timestamp")).alias("ts")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of_rule(what: dict[str, int]) -> Column:
    out = None
    for rule, value in what.items():
        out = F.when(F.col("rule") == rule, value) if out is None else out.when(F.col("rule") == rule, value)
    return out


def declared_alerts(events: DataFrame, late: str | None = None, frames: dict[str, Frame] = FRAMES) -> DataFrame:
    """ALERT rows of all declared rules over events (rule, key, ts), in one pass: each rule counts in its own time frame.

    In batch one aggregate. In a stream (late: how late a row may come) one stateful
    operator with (rule, key) as the state's key, which holds a key's open frames only;
    a frame is told once the watermark has passed its end. Events of rules that aren't
    declared, and those without a time, count nowhere.
    """
    width, least = {r: f.minutes * 60_000_000 for r, f in frames.items()}, {r: f.more_than for r, f in frames.items()}
    events = events.filter(F.col("rule").isin(*frames) & F.col("ts").isNotNull())
    if not late:
        at = F.unix_micros("ts")
        start = at - F.pmod(at, _of_rule(width))
        g = events.groupBy("rule", "key", start.alias("_start")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts")).filter(F.col("n") > _of_rule(least))
        return g.select("rule", "key", F.timestamp_micros("_start").alias("window_start"), F.timestamp_micros(F.col("_start") + _of_rule(width)).alias("window_end"), "n", "first_ts")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule, name = key
        frame = width[rule]
        held = {s: (n, f) for s, n, f in zip(*state.get)} if state.exists else {}
        for batch in batches:
            at = batch["_at"]
            for s, own in at.groupby(at - at % frame):
                first = int(own.min())
                n, f = held.get(int(s), (0, first))
                held[int(s)] = (n + len(own), min(f, first))
        now = state.getCurrentWatermarkMs() * 1000
        done = sorted(s for s in held if s + frame <= now)
        told = [(rule, name, s, s + frame, *held.pop(s)) for s in done]
        told = [t for t in told if t[4] > least[rule]]
        if held:
            state.update(([*held], [n for n, _ in held.values()], [f for _, f in held.values()]))
            state.setTimeoutTimestamp(max((min(held) + frame) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["rule", "key", "s", "e", "n", "f"])

    marked = events.withWatermark("ts", late).withColumn("_at", F.unix_micros("ts"))
    out = marked.groupBy("rule", "key").applyInPandasWithState(step, "rule string, key string, s long, e long, n long, f long", _OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("rule", "key", F.timestamp_micros("s").alias("window_start"), F.timestamp_micros("e").alias("window_end"), "n", F.timestamp_micros("f").alias("first_ts"))


def late_rows(query: StreamingQuery) -> dict[str, int]:
    """How many rows a running or finished stream of declared_alerts has read, and how many of them came behind the watermark and so were dropped."""
    read = dropped = 0
    for p in query.recentProgress:
        read += p["numInputRows"]
        dropped += sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
    return {"read": read, "used": read - dropped, "dropped": dropped}


def burst_alerts(failures: DataFrame, key: str | list[str], frame: str, threshold: int, ts: str = "ts", late: str | None = None) -> DataFrame:
    """(key, window_start, window_end, n, first_ts): more than `threshold` failures of a key in one frame.

    late: for streams, how late a row may come; later ones are dropped.
    """
    keys = [key] if isinstance(key, str) else key
    df = failures.withWatermark(ts, late) if late else failures
    g = df.groupBy(F.window(ts, frame), *keys).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts")).filter(F.col("n") > threshold)
    return g.select(*keys, F.col("window").alias("frame"), F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "first_ts")


def accounts_after_bursts(bursts: DataFrame, created: DataFrame, minutes: int = 60, frame: str = "30 minutes", late: str | None = None, host: str = "host", ts: str = "ts") -> DataFrame:
    """Accounts made at most `minutes` after a windowed burst began on the same host.

    bursts: from burst_alerts; created: (host, ts, ...). In a stream both sides carry
    watermarks; a coarse bound on the burst's window lets state go, the exact test is
    on the burst's first failure.
    """
    b = bursts.select(F.col(host).alias("_host"), F.window_time("frame").alias("_at"), F.col("first_ts").alias("burst_ts"), F.col("n").alias("burst_n")) if late else bursts.select(F.col(host).alias("_host"), (F.col("window_end") - F.expr("interval 1 microsecond")).alias("_at"), F.col("first_ts").alias("burst_ts"), F.col("n").alias("burst_n"))
    c = created.withWatermark(ts, late) if late else created
    near = (F.col("_host") == F.col(host)) & (F.col(ts) >= F.col("_at") - F.expr(f"interval {frame}")) & (F.col(ts) <= F.col("_at") + F.expr(f"interval {minutes} minutes"))
    exact = (F.col(ts) >= F.col("burst_ts")) & (F.col(ts) <= F.col("burst_ts") + F.expr(f"interval {minutes} minutes"))
    return c.join(b, near).filter(exact).drop("_host", "_at")
