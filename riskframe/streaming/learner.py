"""Online logistic baseline: score first, learn when labels arrive.

Time is cut into periods. Rows of a period are scored by the model that the labels of earlier periods made;
labels count in the period they arrive in, whatever their delay, with the columns of the row they belong to. So
results depend on event times alone, not on how micro-batches fall.

Each micro-batch is first written down under its number, then every period that both streams have passed is
worked off: its rows are scored into its own folder, its labels summed to one gradient, and the model moves one
step. What is open, and the model, are stored under the batch's number too. A batch that runs again after a failure
starts from the state of the batch before it and writes the same files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.scalars import expit


def asked_and_learned(
    scores: DataFrame, labels: DataFrame, identity: str, score_time: str, label_time: str, label: str, features: Sequence[str],
    max_delay: str = "7 days", lateness: str = "1 hour",
) -> DataFrame:
    """One stream of (id, at, x, y): rows to score (y null, at their own time), and again, labelled, when the label arrives."""
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    rows = scores.select(F.col(identity).alias("id"), F.col(score_time).alias("at"), x)
    left = rows.withWatermark("at", lateness)
    right = labels.withWatermark(label_time, lateness).select(F.col(identity).alias("_id"), F.col(label_time).alias("_at"), F.col(label).cast("double").alias("y"))
    bound = (F.col("id") == F.col("_id")) & (F.col("_at") >= F.col("at")) & (F.col("_at") <= F.col("at") + F.expr(f"INTERVAL {max_delay}"))
    arrived = left.join(right, bound).select("id", F.col("_at").alias("at"), "x", "y")
    return rows.withColumn("y", F.lit(None).cast("double")).unionByName(arrived)


class OnlineLearner:
    """Works off micro-batches of ``asked_and_learned``; ``base`` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str, width: int, period_seconds: int, rate: float, lateness_seconds: int = 3_600):
        self.spark, self.base, self.period, self.rate, self.late = spark, base.rstrip("/"), period_seconds, rate, lateness_seconds
        self.start = {"batch": -1, "rows": -1, "weights": [0.0] * (width + 1), "open": None, "asked": None, "learned": None}

    def _state(self, batch: int) -> dict:
        """The state after the last batch before ``batch``."""
        if not self._there("state"):
            return dict(self.start)
        found = self.spark.read.schema("batch long, state string").option("recursiveFileLookup", True).json(f"{self.base}/state").where(F.col("batch") < batch)
        last = found.orderBy(F.desc("batch")).first()
        return json.loads(last["state"]) if last else dict(self.start)

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        state = self._state(batch)
        period = F.floor(F.unix_seconds("at") / self.period)
        # A row that comes after its period was worked off belongs to the first period still open.
        placed = rows.withColumn("period", F.greatest(period, F.lit(state["open"])) if state["open"] is not None else period)
        placed.write.mode("overwrite").parquet(f"{self.base}/rows/batch_{batch}")
        held = self.spark.read.schema(placed.schema).parquet(f"{self.base}/rows/batch_{batch}")
        seen = held.agg(F.max(F.when(F.col("y").isNull(), F.unix_seconds("at"))), F.max(F.when(F.col("y").isNotNull(), F.unix_seconds("at")))).first()
        for name, at in zip(("asked", "learned"), seen):
            if at is not None:
                state[name] = max(at, state[name] or at)
        state["batch"] = state["rows"] = batch
        if state["asked"] is not None and state["learned"] is not None:
            self._work(state, (min(state["asked"], state["learned"]) - self.late) // self.period)
        self._write(batch, state)

    def finish(self, batch: int) -> None:
        """Work off what is left once the streams have ended."""
        state = self._state(batch)
        state["batch"] = batch
        if state["rows"] >= 0:
            self._work(state, None)
        self._write(batch, state)

    def _write(self, batch: int, state: dict) -> None:
        one = self.spark.createDataFrame([(batch, json.dumps(state))], "batch long, state string")
        one.coalesce(1).write.mode("overwrite").json(f"{self.base}/state/batch_{batch}")

    def _work(self, state: dict, end: int | None) -> None:
        """Every period before ``end`` that holds rows and is still open, in order."""
        # Folders of batches that have not finished are not read.
        done = self.spark.read.schema("id long, at timestamp, x array<double>, y double, period long").option("recursiveFileLookup", True)
        rows = done.parquet(*[f"{self.base}/rows/batch_{b}" for b in range(state["rows"] + 1)])
        due = rows if state["open"] is None else rows.where(F.col("period") >= state["open"])
        due = due if end is None else due.where(F.col("period") < end)
        for (period,) in sorted(map(tuple, due.select("period").distinct().collect())):
            part, weights = rows.where(F.col("period") == period), state["weights"]
            margin = F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights[1:])), lambda a, w: a * w), F.lit(weights[0]), lambda s, e: s + e)
            raw = expit(margin)
            asked = part.where(F.col("y").isNull()).select("id", "at", raw.alias("raw"), F.lit(period).cast("long").alias("period"))
            asked.write.mode("overwrite").parquet(f"{self.base}/scored/period_{period}")
            error = raw - F.col("y")
            sums = part.where(F.col("y").isNotNull()).agg(F.count("*"), F.sum(error), *[F.sum(error * F.col("x")[j]) for j in range(len(weights) - 1)]).first()
            if sums[0]:
                state["weights"] = [w - self.rate * g / sums[0] for w, g in zip(weights, sums[1:])]
            state["open"] = period + 1
        if end is not None:
            state["open"] = max(end, state["open"] if state["open"] is not None else end)

    def scored(self) -> DataFrame:
        """id, at, raw and period of every row whose period was worked off."""
        return self.spark.read.schema("id long, at timestamp, raw double, period long").option("recursiveFileLookup", True).parquet(f"{self.base}/scored")


def learn_available(stream: DataFrame, learner: Callable, checkpoint: str) -> None:
    """Process what is there and stop; a later call goes on from the same checkpoint."""
    stream.writeStream.foreachBatch(learner).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay_online(
    spark: SparkSession, base: str, scores: tuple[DataFrame, str], labels: tuple[DataFrame, str], features: Sequence[str], identity: str, label: str,
    period_seconds: int = 86_400, rate: float = 0.5, slices: int = 2,
) -> OnlineLearner:
    """Feed both tables in time slices, with a stop and a restart after each."""
    learner = OnlineLearner(spark, base, len(features), period_seconds, rate)
    spans = [df.agg(F.min(F.unix_micros(t)), F.max(F.unix_micros(t))).first() for df, t in (scores, labels)]
    low, high = min(s[0] for s in spans), max(s[1] for s in spans)
    step = (high - low) // slices + 1
    for i in range(slices):
        for name, (df, t) in (("scores", scores), ("labels", labels)):
            at = F.unix_micros(t)
            df.where((at >= low + i * step) & (at < low + (i + 1) * step)).write.mode("append").parquet(f"{base}/in/{name}")
        left, right = (spark.readStream.schema(df.schema).parquet(f"{base}/in/{n}") for n, (df, _) in (("scores", scores), ("labels", labels)))
        stream = asked_and_learned(left, right, identity, scores[1], labels[1], label, features)
        learn_available(stream, learner, f"{base}/checkpoint")
    learner.finish(1 << 40)
    return learner
