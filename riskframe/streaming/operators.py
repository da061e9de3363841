"""Streaming operators: delayed labels, drift, windowed alerts and incremental history.

Every stateful Python step sees (key, time) buckets that a native windowed aggregation has already
summed and closed, never raw rows. Closed buckets arrive in time order, so rows of one step cannot
see each other and late rows are dropped by the watermark. Unknown keys are dropped by an aggregate
after the window: a plain filter would be pushed below the watermark and hide the event times of
the rows it removes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskframe.session import scratch_path
from riskframe.streaming.replay import HEARTBEATS, heartbeat, run_available


def windowed_alerts(stream: DataFrame, time: str, label: str, alert: str, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows (labelled or not), positives, alerts and captured positives per tumbling or sliding window.

    Heartbeat rows, which only move the watermark, carry no alert and are not counted.
    """
    w = F.window(time, width, slide) if slide else F.window(time, width)
    y, a = F.col(label).cast("bigint"), F.col(alert).cast("bigint")
    counted = stream.withWatermark(time, delay).groupBy(w.alias("w")).agg(
        F.count(alert).alias("rows"), F.sum(y).alias("positives"), F.sum(a).alias("alerts"), F.sum(y * a).alias("captured")
    )
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "positives", "alerts", "captured")


def delayed_label_eval(
    scores: DataFrame, labels: DataFrame, identity: str, score_time: str, label_time: str, score: str, label: str,
    max_delay: str, threshold: float = 0.5, width: str = "1 day", lateness: str = "1 hour",
) -> DataFrame:
    """Score first, evaluate when the label arrives, per score-time window.

    A stream-stream left outer join keeps scores whose label never came; both sides carry a watermark
    and the join a time bound, so its state stays bounded.
    """
    left = scores.withWatermark(score_time, lateness).select(F.col(identity), F.col(score_time), F.col(score))
    right = labels.withWatermark(label_time, lateness).select(F.col(identity).alias("_id"), F.col(label_time).alias("_lt"), F.col(label).alias("_y"))
    bound = (F.col(identity) == F.col("_id")) & (F.col("_lt") >= F.col(score_time)) & (F.col("_lt") <= F.col(score_time) + F.expr(f"INTERVAL {max_delay}"))
    joined = left.join(right, bound, "leftOuter")
    hit, y = F.col(score) >= F.lit(threshold), F.col("_y")
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    out = joined.groupBy(F.window(score_time, width).alias("w")).agg(
        F.count("*").alias("rows"), count((y == 1) & hit).alias("tp"), count((y == 0) & hit).alias("fp"),
        count((y == 1) & ~hit).alias("fn"), count((y == 0) & ~hit).alias("tn"), count(y.isNull()).alias("unlabelled"),
    )
    return out.select(F.col("w.start").alias("start"), "rows", "tp", "fp", "fn", "tn", "unlabelled")


def report(table: DataFrame, fn_cost: float = 10.0, fp_cost: float = 1.0) -> DataFrame:
    """Batch report over the closed windows of ``delayed_label_eval``."""
    from riskframe.operators.metrics import rates

    return table.withColumns(rates(fn_cost, fp_cost))


#: How far closed buckets of one batch may lie behind those of the batch before.
BUCKET_DELAY = "1 day"

# ---- drift -------------------------------------------------------------------------------------

DRIFT_STATE = "fast double, slow double, alpha double, seen bigint"
DRIFT_OUTPUT = "key bigint, start timestamp, rows bigint, mean_cost double, fast double, slow double, alpha double, drift int"
# Blend weight after a drift, its decay per bucket, and its floor.
DRIFT_ALPHA, ALPHA_DECAY, ALPHA_FLOOR = 0.85, 0.98, 0.5


def cost_buckets(stream: DataFrame, key: str, time: str, label: str, score: str, width: str = "6 hours", delay: str = "1 hour", fn_cost: float = 10.0) -> DataFrame:
    """Cost-weighted error summed per (key, window): the input of the drift monitor."""
    y, guess = F.col(label), (F.col(score) >= 0.5).cast("int")
    cost = F.when((y == 1) & (guess == 0), F.lit(float(fn_cost))).otherwise((y != guess).cast("double"))
    counted = stream.withWatermark(time, delay).groupBy(F.col(key).alias("key"), F.window(time, width).alias("w")).agg(
        F.count("*").alias("rows"), F.sum(cost).alias("cost"), F.max(key).alias("_known")
    )
    return counted.where(F.col("_known").isNotNull()).select("key", F.col("w.start").alias("start"), "rows", "cost")


def drift_monitor(
    buckets: DataFrame, fast: float = 0.3, slow: float = 0.03, tolerance: float = 0.5, warmup: int = 8, idle_days: int = 90
) -> DataFrame:
    """Flag keys whose recent cost departs from its long-run level.

    Two exponentially weighted means per key; on a departure the blend weight jumps, then decays to
    its floor. ``buckets`` must be closed (key, start) sums. The state of a key without a bucket for
    ``idle_days`` is dropped; a key that returns later starts anew.
    """
    idle = idle_days * 86_400_000

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("start")
        f, s, alpha, seen = state.get if state.exists else (0.0, 0.0, ALPHA_FLOOR, 0)
        out = []
        for start, n, cost in rows[["start", "rows", "cost"]].itertuples(index=False):
            x = cost / n
            f, s = (x, x) if seen == 0 else (f + fast * (x - f), s + slow * (x - s))
            seen += 1
            drifted = seen > warmup and abs(f - s) > tolerance * s
            alpha = DRIFT_ALPHA if drifted else max(ALPHA_FLOOR, alpha * ALPHA_DECAY)
            out.append((key[0], start, n, x, f, s, alpha, int(drifted)))
        state.update((f, s, alpha, seen))
        state.setTimeoutTimestamp(max(int(rows["start"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame(out, columns=["key", "start", "rows", "mean_cost", "fast", "slow", "alpha", "drift"])

    timed = buckets.withWatermark("start", BUCKET_DELAY)
    return timed.groupBy("key").applyInPandasWithState(step, DRIFT_OUTPUT, DRIFT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- incremental history -----------------------------------------------------------------------


def history_buckets(stream: DataFrame, entity: str, other: str, time: str, cents: str, shards: int = 4, delay: str = "2 hours") -> DataFrame:
    """Exact sums per (entity, shard, step, other), closed by the watermark.

    Each row lands in the shard of its ``other`` value; the other shards get an empty marker for the
    step, so every shard reports on every step of the entity. Markers of a step merge map-side.
    """
    own = F.pmod(F.xxhash64(other), F.lit(shards)).cast("int")
    entry = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(i.cast("int").alias("shard"), (i == own).alias("mine")))
    spread = stream.withWatermark(time, delay).withColumn("_e", F.explode(entry))
    mine = F.col("_e.mine")
    wide = F.col(cents).cast("decimal(19,0)")
    counted = spread.groupBy(
        F.window(time, "1 hour").alias("w"), F.col(entity).alias("entity"), F.col("_e.shard").alias("shard"), F.when(mine, F.col(other)).alias("other")
    ).agg(
        F.sum(mine.cast("bigint")).alias("n"), F.sum(F.when(mine, F.col(cents)).otherwise(0)).alias("s"),
        F.sum(F.when(mine, (wide * wide).cast("decimal(38,0)")).otherwise(0)).alias("ss"), F.max(F.when(mine, F.col(cents))).alias("mx"), F.max(entity).alias("_known"),
    )
    return counted.where(F.col("_known").isNotNull()).select(
        F.floor(F.unix_seconds(F.col("w.start")) / 3600).cast("bigint").alias("hour"), "entity", "shard", "other", "n", "s", F.col("ss").cast("string").alias("ss"), "mx"
    )


def _partial_schema(windows: Sequence[int]) -> str:
    fields = ["entity bigint", "shard int", "hour bigint", "last_hour bigint"]
    for w in windows:
        fields += [f"n_{w} bigint", f"s_{w} bigint", f"ss_{w} string", f"mx_{w} bigint", f"distinct_{w} bigint"]
    return ", ".join(fields)


class HistoryState(StatefulProcessor):
    """Partial history of one (entity, shard), in state that a batch reads and writes by key.

    ``hours``: sums of each step with rows, and ``fresh``, the number of counterparties last seen in it, so that
    distinct counts are sums over steps and never a walk over counterparties. ``latest``: last step of a
    counterparty. ``members``: counterparties of a step, read once, when the step leaves the widest window.
    ``last``: last step with rows, which recency needs for ever. A timer per step lets an idle entity forget it.

    A state call costs far more than the bytes it brings. Where the steps held are few and small beside the counterparties
    of the batch, their members are read, one call a step, and tell the last step of each; else each is asked for.
    """

    HOUR_MS = 3_600_000
    #: Bytes of step members that may be read in place of one call for a counterparty.
    BYTES_A_CALL = 512

    def __init__(self, windows: Sequence[int]):
        self.windows, self.reach = tuple(windows), max(windows)
        self.row = Row(*(c.split()[0] for c in _partial_schema(windows).split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour bigint", "n bigint, s bigint, ss string, mx bigint, fresh bigint")
        self.latest = handle.getMapState("latest", "other bigint", "hour bigint")
        self.members = handle.getMapState("members", "hour bigint", "others binary")
        self.last = handle.getValueState("last", "hour bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Steps by number as [n, s, ss, mx, fresh]; only those inside the widest window are ever held.
        held = {k[0]: [v[0], v[1], int(v[2]), v[3], v[4]] for k, v in self.hours.iterator()}
        before = {h: v[4] for h, v in held.items()}
        was = self.last.get()
        last = was[0] if was else None
        rows = list(rows)
        joined: dict[int, np.ndarray] = {}
        seen: dict[int, int | None] = {}  # counterparties this batch touched, with their last step
        known: dict[int, int | None] = {}  # and what state held for them
        told: dict[int, int] | None = {}  # last step of every counterparty in state, where it was cheaper to read
        due = sorted(h for h, fresh in before.items() if fresh)
        touched = len({r.other for r in rows if r.n > 0 and r.other is not None})
        if len(due) <= touched and 8 * sum(held[h][0] for h in due) <= self.BYTES_A_CALL * touched:
            for h in due:
                joined[h] = np.frombuffer(self.members.getValue((h,))[0], np.int64)
                told.update(dict.fromkeys(joined[h].tolist(), h))
        elif due:
            told = None

        def last_seen(other: int) -> int | None:
            if other not in seen:
                if told is not None:
                    at = told.get(other)
                else:
                    found = self.latest.getValue((other,))
                    at = None if found is None else found[0]
                seen[other] = known[other] = at
            return seen[other]

        out, added = [], set()  # steps of this batch
        by_hour = attrgetter("hour")
        for hour, group in groupby(sorted(rows, key=by_hour), by_hour):
            for old in [h for h in held if h < hour - self.reach]:
                fresh = held.pop(old)[4]
                for other in self._others(old, joined) if fresh else ():
                    if last_seen(other) == old:
                        seen[other] = None
            record = [*key, hour, last]
            for w in self.windows:
                inside = [v for h, v in held.items() if h >= hour - w]
                record += [sum(v[0] for v in inside), sum(v[1] for v in inside), str(sum(v[2] for v in inside))]
                record += [max((v[3] for v in inside), default=None), sum(v[4] for v in inside)]
            out.append(self.row(*record))
            mine = [r for r in group if r.n > 0]
            if mine:
                others = np.array([r.other for r in mine if r.other is not None], np.int64)
                for other in others.tolist():
                    at = last_seen(other)
                    if at in held:
                        held[at][4] -= 1
                    seen[other] = hour
                joined[hour], last = others, hour
                added.add(hour)
                held[hour] = [sum(r.n for r in mine), sum(r.s for r in mine), sum(int(r.ss) for r in mine), max(r.mx for r in mine), len(others)]

        for hour in before.keys() - held.keys():
            self._remove(hour)
            self.handle.deleteTimer((hour + self.reach + 1) * self.HOUR_MS)
        for hour, (n, s, ss, mx, fresh) in held.items():
            if hour in added or before[hour] != fresh:
                self.hours.updateValue((hour,), (n, s, str(ss), mx, fresh))
            if hour in added:
                self.members.updateValue((hour,), (joined[hour].tobytes(),))
                self.handle.registerTimer((hour + self.reach + 1) * self.HOUR_MS)
        for other, hour in seen.items():
            if hour is not None and hour != known[other]:
                self.latest.updateValue((other,), (hour,))
            elif hour is None and known[other] is not None:
                self.latest.removeKey((other,))
        if last is not None and (last,) != was:
            self.last.update((last,))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """No later row can reach back to the step of this timer."""
        hour = expiredTimerInfo.getExpiryTimeInMs() // self.HOUR_MS - self.reach - 1
        held = self.hours.getValue((hour,))
        if held is not None:
            for other in self._others(hour, {}) if held[4] else ():
                at = self.latest.getValue((other,))
                if at is not None and at[0] == hour:
                    self.latest.removeKey((other,))
            self._remove(hour)
        return iter(())

    def _others(self, hour: int, joined: dict[int, np.ndarray]) -> list[int]:
        """Counterparties of a step, of this batch or an earlier one; read once."""
        return (joined.pop(hour) if hour in joined else np.frombuffer(self.members.getValue((hour,))[0], np.int64)).tolist()

    def _remove(self, hour: int) -> None:
        self.hours.removeKey((hour,))
        self.members.removeKey((hour,))

    def close(self) -> None:
        pass


def streaming_history(buckets: DataFrame, windows: Sequence[int] = (1, 6, 24)) -> DataFrame:
    """Partial history per (entity, shard, step): emit from strictly earlier steps, then update.

    A batch reads and writes the steps and counterparties it meets (``HistoryState``), never the whole
    state of an entity. Run it with ``run_available(..., store=BY_KEY)``: state variables need that store.
    """
    timed = buckets.withColumn("at", F.timestamp_seconds(F.col("hour") * 3600)).withWatermark("at", BUCKET_DELAY)
    return timed.groupBy("entity", "shard").transformWithState(HistoryState(windows), _partial_schema(windows), "Append", "EventTime")


def combine_shards(partials: DataFrame, windows: Sequence[int] = (1, 6, 24)) -> DataFrame:
    """Shards hold disjoint ``other`` values, so counts, moments and distinct counts add up."""
    from riskframe.functions.scalars import std_from_moments

    sums = partials.groupBy("entity", "hour").agg(
        F.max("last_hour").alias("_last"),
        *[
            f
            for w in windows
            for f in (
                F.sum(f"n_{w}").alias(f"n_{w}"), F.sum(f"s_{w}").alias(f"s_{w}"), F.sum(F.col(f"ss_{w}").cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"ss_{w}"),
                F.max(f"mx_{w}").alias(f"mx_{w}"), F.sum(f"distinct_{w}").alias(f"distinct_{w}"),
            )
        ],
    )
    out = []
    for w in windows:
        n, s = F.col(f"n_{w}"), F.col(f"s_{w}")
        out += [
            n.alias(f"count_{w}"),
            F.coalesce(F.try_divide(s.cast("double"), F.lit(100.0) * n), F.lit(0.0)).alias(f"mean_{w}"),
            F.coalesce(F.col(f"mx_{w}") / F.lit(100.0), F.lit(0.0)).alias(f"max_{w}"),
            F.coalesce(std_from_moments(n, s, F.col(f"ss_{w}")), F.lit(0.0)).alias(f"std_{w}"),
            F.col(f"distinct_{w}"),
        ]
    return sums.select("entity", "hour", F.coalesce(F.col("hour") - F.col("_last"), F.lit(-1)).alias("recency"), *out)


def two_stage(
    spark: SparkSession, rows: DataFrame, time: str, first, second, name: str, slices: int = 2, store: str | None = None
) -> DataFrame:
    """Run ``first`` (native buckets) and ``second`` (state on closed buckets) as two queries over a replay.

    The bucket table between them is an ordinary append-only table; each query has its own
    checkpoint and can be restarted alone. ``store`` names the state store of both: the first holds
    every bucket of a slice until the watermark closes it, which memory alone need not have room for.
    """
    base = scratch_path(spark, name)
    low, high = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    width = (high - low) // slices + 1
    at = F.unix_micros(time)
    parts = [rows.where((at >= low + i * width) & (at < low + (i + 1) * width)) for i in range(slices)]
    schema = None
    for part in [*parts, *[heartbeat(rows, time)] * HEARTBEATS]:
        part.write.mode("append").parquet(f"{base}/in")
        source = first(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        schema = source.schema
        run_available(source, f"{base}/buckets", f"{base}/checkpoint-buckets", store=store)
        state = second(spark.readStream.schema(schema).parquet(f"{base}/buckets"))
        run_available(state, f"{base}/out", f"{base}/checkpoint-state", store=store)
    return spark.read.parquet(f"{base}/out")
