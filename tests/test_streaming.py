"""State of the streaming operators ends with what it is needed for; the online learner equals a sequential one."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskframe.streaming.learner import OnlineLearner, replay_online
from riskframe.streaming import operators as X
from riskframe.streaming.replay import BY_KEY, run_available

BUCKET = "hour bigint, entity bigint, shard int, other bigint, n bigint, s bigint, ss string, mx bigint"


def drive(spark, base, batches, schema, operator, store=None, variables=()):
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        run_available(operator(spark.readStream.schema(schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/checkpoint", store=store)
    out = spark.read.parquet(f"{base}/out").collect()
    read = lambda **named: spark.read.format("statestore").options(**named).load(f"{base}/checkpoint").collect()
    return out, {v: read(stateVarName=v) for v in variables} if variables else read()


def drive_history(spark, base, batches):
    """Rows, and state by variable as {entity: {map key or None: first field of the value}}."""
    out, state = drive(spark, base, batches, BUCKET, X.streaming_history, BY_KEY, ("hours", "latest", "members", "last"))
    told = {}
    for name, rows in state.items():
        told[name] = {}
        for r in rows:
            r = r.asDict()
            value = r["value"] if "value" in r else r["user_map_value"]
            told[name].setdefault(r["key"][0], {})[r["user_map_key"][0] if "user_map_key" in r else None] = value[0]
    return out, told


def test_history_state_shrinks_after_the_window(spark, tmp_path):
    start = 480_000  # hours since 1970
    row = lambda hour, entity, other: (start + hour, entity, 0, other, 1, 500, "250000", 500)
    batches = [[row(0, 1, 7), row(2, 1, 8), row(3, 2, 7)], [row(h, 2, 9) for h in (60, 90)], [row(200, 2, 7)], [row(201, 1, 7), row(201, 2, 7)]]
    out, state = drive_history(spark, str(tmp_path / "whole"), batches)
    since = lambda h: None if h is None else h - start
    told = {(r["entity"], since(r["hour"])): (since(r["last_hour"]), r["n_24"], r["distinct_24"]) for r in out}
    assert told[(1, 2)] == (0, 1, 1) and told[(1, 201)] == (2, 0, 0) and told[(2, 201)] == (200, 1, 1)
    out, state = drive_history(spark, str(tmp_path / "part"), batches[:3])
    assert 1 not in state["hours"] and 1 not in state["latest"] and 1 not in state["members"]
    assert state["last"] == {1: {None: start + 2}, 2: {None: start + 200}}
    assert list(state["hours"][2]) == list(state["members"][2]) == [start + 200] and state["latest"][2] == {7: start + 200}


def test_history_of_a_hot_entity_equals_recounting_and_holds_its_window_only(spark, tmp_path):
    rng, start = random.Random(9), 480_000
    # One entity, 120 steps, counterparties that come back and ones that never do.
    steps = {h: {rng.randrange(40) if rng.random() < 0.5 else 1_000 + 50 * h + k: rng.randrange(1, 900) for k in range(rng.randrange(1, 50))} for h in range(120) if h % 7}
    rows = [(start + h, 5, 0, o, 1, c, str(c * c), c) for h, by in steps.items() for o, c in by.items()]
    marks = [(start + h, 5, 0, None, 0, 0, "0", None) for h in range(0, 120, 7)]
    whole = sorted(rows + marks, key=lambda r: r[0])
    cut = lambda a, b: [r for r in whole if a <= r[0] - start < b]
    for name, bounds in (("one", [0, 120]), ("many", [0, 10, 11, 50, 90, 120])):
        out, state = drive_history(spark, str(tmp_path / name), [cut(a, b) for a, b in zip(bounds, bounds[1:])])
        assert len(out) == 120
        for r in out:
            hour = r["hour"] - start
            for w in (1, 6, 24):
                inside = [(o, c) for h in range(max(0, hour - w), hour) for o, c in steps.get(h, {}).items()]
                want = (len(inside), sum(c for _, c in inside), str(sum(c * c for _, c in inside)), max((c for _, c in inside), default=None), len({o for o, _ in inside}))
                assert tuple(r[f"{f}_{w}"] for f in ("n", "s", "ss", "mx", "distinct")) == want
        live = {o: start + h for h in range(119 - 24, 120) for o in steps.get(h, {})}
        assert state["latest"][5] == live and min(state["hours"][5]) >= start + 119 - 24
        assert sum(state["hours"][5].values()) == sum(len(by) for h, by in steps.items() if h >= 119 - 24)


def test_drift_state_of_idle_keys_is_dropped(spark, tmp_path):
    from datetime import datetime, timedelta

    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    batches = [[(1, day(0), 5, 1.0), (2, day(0), 5, 1.0)], [(2, day(20), 5, 2.0)], [(2, day(40), 5, 2.0)], [(2, day(60), 5, 2.0)]]
    out, state = drive(spark, str(tmp_path), batches, "key bigint, start timestamp, rows bigint, cost double", lambda s: X.drift_monitor(s, idle_days=10))
    assert len(out) == 5 and [list(r["key"])[0] for r in state] == [2]


def sequential(rows, labels, period, rate):
    """Rows (id, time, x) and labels (id, time, y): every row's score, period by period."""
    x, w, out = {i: v for i, _, v in rows}, [0.0] * 3, {}
    prob = lambda v: 1 / (1 + math.exp(-(w[0] + w[1] * v[0] + w[2] * v[1])))
    for p in sorted({t // period for _, t, _ in [*rows, *labels]}):
        out.update({i: prob(v) for i, t, v in rows if t // period == p})
        due = [(prob(x[i]) - y, x[i]) for i, t, y in labels if t // period == p]
        if due:
            mean = [sum(e * f for e, f in zip((d for d, _ in due), fs)) / len(due) for fs in zip(*[(1.0, *v) for _, v in due])]
            w = [a - rate * g for a, g in zip(w, mean)]
    return out


def test_online_learner_equals_a_sequential_one(spark, tmp_path):
    rng, day = random.Random(4), 86_400
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
    rows = [(i, start + rng.randrange(6 * day), (rng.random(), rng.gauss(0, 1))) for i in range(300)]
    labels = [(i, t + rng.randrange(3 * day), int(v[1] > 0)) for i, t, v in rows if i % 7]
    at = lambda t: datetime.fromtimestamp(t, timezone.utc)
    scores = spark.createDataFrame([(i, at(t), *v) for i, t, v in rows], "id long, ts timestamp, a double, b double")
    arrived = spark.createDataFrame([(i, at(t), y) for i, t, y in labels], "id long, label_ts timestamp, label int")
    want = sequential(rows, labels, day, 0.8)
    for slices in (1, 3):
        learner = replay_online(spark, str(tmp_path / f"s{slices}"), (scores, "ts"), (arrived, "label_ts"), ["a", "b"], "id", "label", day, 0.8, slices)
        found = {r["id"]: r["raw"] for r in learner.scored().collect()}
        assert len(found) == 300 and all(found[i] == pytest.approx(want[i]) for i in want)
    assert len({round(v, 3) for v in want.values()}) > 50


def test_a_batch_that_runs_again_changes_nothing_and_late_rows_count(spark, tmp_path):
    row = lambda i, day, y: (i, datetime(2024, 1, 1) + timedelta(days=day), [float(i)], y)
    schema = "id long, at timestamp, x array<double>, y double"
    batches = [[row(1, 0, None), row(2, 1, None), row(1, 1, 1.0)], [row(3, 4, None), row(2, 4, 0.0)], [row(4, 0, None), row(5, 5, None), row(3, 5, 1.0)]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    results = []
    for name, order in (("once", [0, 1, 2]), ("again", [0, 1, 1, 2, 2])):
        learner = OnlineLearner(spark, str(tmp_path / name), 1, 86_400, 0.5)
        for b in order:
            learner(frames[b], b)
        learner.finish(99)
        results.append(sorted((r["id"], r["raw"]) for r in learner.scored().collect()))
    assert results[0] == results[1] and [i for i, _ in results[0]] == [1, 2, 3, 4, 5]
    late = dict(results[0])[4]
    assert late != 0.5  # scored by the model of its arrival


class CountedMap(dict):
    """A state map that counts its calls."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


class CountedHandle:
    def __init__(self):
        self.maps, self.timers, self.value = {}, set(), None

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, CountedMap())

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


@pytest.mark.parametrize("cheap", [512, 0])
def test_a_batch_asks_by_step_not_by_counterparty(cheap):
    from pyspark.sql import Row

    handle, state = CountedHandle(), X.HistoryState((1, 6, 24))
    state.BYTES_A_CALL = cheap
    state.init(handle)
    row = lambda hour, other: Row(hour=hour, other=other, n=1, s=5, ss="25", mx=5)
    list(state.handleInputRows((1, 0), [row(h, o) for h in (90, 100) for o in range(h, h + 20)], None))
    out = list(state.handleInputRows((1, 0), [row(h, o) for h in (110, 120) for o in range(h - 5, h + 20)], None))
    # Seen in 90: 90-109, in 100: 100-119, in 110: 105-129; 90 has left the window of 120.
    assert [(r["n_24"], r["distinct_24"]) for r in out] == [(40, 30), (45, 30)]
    assert {o: h for (o,), (h,) in handle.maps["latest"].items()} == {
        o: 100 if o < 105 else 110 if o < 115 else 120 for o in range(100, 140)
    }
    assert handle.timers == {(h + 25) * 3_600_000 for h in (100, 110, 120)}
    assert (handle.maps["latest"].calls == 0) == (cheap > 0)
    assert handle.maps["members"].calls <= 2 or not cheap
