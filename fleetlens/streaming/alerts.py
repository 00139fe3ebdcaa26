"""Alert cooldown and rolling baselines over streams: the state of each key outlives the micro-batch."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from fleetlens.operators.telemetry import COOLDOWN_SECONDS, MIN_DELTA_MS, MIN_SAMPLES, Z_SCORE


def fired_alerts(breaches: DataFrame, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """Of a stream (keys, at seconds), those that fire.

    As the batch form does, if batches come in order: all columns but ``at``, the
    rule and in a fleet the instance, are the key. A breach from before the last
    that fired doesn't fire; nulls, of keys too, don't either. A key's state is one number.
    """
    keys = [c for c in breaches.columns if c != "at"]

    def fire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, fired = state.get[0] if state.exists else None, []
        for t in sorted({int(t) for f in frames for t in f["at"].dropna()}):
            if last is None or t - last >= cooldown:
                fired.append(t)
                last = t
        if fired:
            state.update((last,))
        yield pd.DataFrame({**{k: [v] * len(fired) for k, v in zip(keys, key, strict=True)}, "fired_at": fired})

    schema = StructType([*[breaches.schema[k] for k in keys], StructField("fired_at", LongType())])
    return breaches.dropna(subset=[*keys, "at"]).groupBy(*keys).applyInPandasWithState(fire, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def counter_deltas(snapshots: DataFrame, counters: list[str], max_gap_seconds: int = 3600) -> DataFrame:
    """Of a stream of whole snapshots (instance_id, at seconds, key, counters), the growth of each key's counters.

    A snapshot's rows come in one batch. The decision is the snapshot's: the
    first one, one over ``max_gap_seconds`` after the last, one from before it, or
    one where any counter went down, only sets the state anew. A key that the
    last snapshot lacks grew from 0; rows without growth are left out. State
    is the last snapshot of an instance.
    """

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, prior = (state.get[0], json.loads(state.get[1])) if state.exists else (None, {})
        rows, out = pd.concat(list(frames)), []
        for t, now in rows.sort_values("at").groupby("at", sort=True):
            own = {str(k): [int(x) for x in v] for k, *v in zip(now["key"], *[now[c].fillna(0) for c in counters], strict=True)}
            fair = at is not None and 0 <= t - at <= max_gap_seconds and not any(a < b for k, v in own.items() for a, b in zip(v, prior.get(k, [0] * len(v)), strict=True))
            if fair:
                for k, v in own.items():
                    grown = [a - b for a, b in zip(v, prior.get(k, [0] * len(v)), strict=True)]
                    if any(grown):
                        out.append((key[0], int(t), k, *grown))
            at, prior = int(t), own
        state.update((at, json.dumps(prior)))
        yield pd.DataFrame(out, columns=["instance_id", "at", "key", *counters])

    schema = "instance_id long, at long, key string, " + ", ".join(f"{c} long" for c in counters)
    return snapshots.dropna(subset=["instance_id", "at", "key"]).groupBy("instance_id").applyInPandasWithState(grow, schema, "at long, prior string", "append", GroupStateTimeout.NoTimeout)


def events_once(events: DataFrame, text: str, keep: str = "30 days") -> DataFrame:
    """Of a stream (captured_at timestamp, text), each text's first event with the first 16 hex digits of its SHA-256; a text that comes again after ``keep`` counts anew."""
    hashed = events.where(F.col(text).isNotNull()).withColumn("text_hash", F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 16))
    return hashed.withWatermark("captured_at", keep).dropDuplicatesWithinWatermark(["text_hash"])


def judged_samples(samples: DataFrame) -> DataFrame:
    """Of a stream (query_id, captured_at, event_id, ms), the samples that stand out from their query's samples so far.

    Each is judged before it joins the baseline: count, mean and sum of squared
    deviations. Samples of a batch go by time and id, those of an earlier time
    in a later batch as they come; values that are null or not finite are passed over.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["captured_at", "event_id"])
        out = []
        for at, event, ms in zip(rows["captured_at"], rows["event_id"], rows["ms"], strict=True):
            if not math.isfinite(ms):
                continue
            sd = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
            if n >= MIN_SAMPLES and sd > 0 and ms - mean >= max(Z_SCORE * sd, MIN_DELTA_MS):
                out.append((key[0], at, event, n, mean, ms))
            n += 1
            step = ms - mean
            mean += step / n
            m2 += step * (ms - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame(out, columns=["query_id", "captured_at", "event_id", "n", "mean_ms", "ms"])

    kind = samples.schema["captured_at"].dataType.simpleString()
    return samples.where(F.col("ms").isNotNull() & F.col("query_id").isNotNull()).groupBy("query_id").applyInPandasWithState(judge, f"query_id long, captured_at {kind}, event_id long, n long, mean_ms double, ms double", "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)
