"""Drive streaming queries over a stored table, slice by slice in time order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import scratch_path

# Fixed value: event time of the closing heartbeat, past every real event.
END_OF_STREAM = "2100-01-01 00:00:00"
# A batch works with the watermark of the batch before it, so the first heartbeat raises the
# watermark and the second one emits what it closed.
HEARTBEATS = 2


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the provider that keeps state by key on disk, which state variables and timers need.
BY_KEY = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", store: str | None = None) -> None:
    """Process what is there and stop; a later call goes on from the same checkpoint.

    ``store`` names a state store for this query alone; a query takes the setting over when it starts.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    try:
        if store:
            conf.set(STATE_STORE, store)
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        if store:
            conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)
    query.awaitTermination()


def heartbeat(df: DataFrame, time: str, identity: int = -1) -> DataFrame:
    """One row with an event time and an unused ``id``: it moves the watermark and meets no other row.

    Its own window ends past the watermark it sets, so it is never emitted.
    """
    values = {time: F.lit(END_OF_STREAM), "id": F.lit(identity)}
    fields = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.sparkSession.range(1, numPartitions=1).select(*fields)


def replay(
    spark: SparkSession,
    sources: dict[str, tuple[DataFrame, str]],
    build: Callable[[dict[str, DataFrame]], DataFrame],
    name: str,
    slices: int = 2,
    max_files: int | None = None,
) -> DataFrame:
    """Append each source's rows in time slices to its folder and run the query after each slice.

    Heartbeats per source close the run, so every window is emitted. Returns the sink as a table.
    """
    base = scratch_path(spark, name)
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"

    def run():
        streams = {}
        for s, (df, _) in sources.items():
            reader = spark.readStream.schema(df.schema)
            if max_files:
                reader = reader.option("maxFilesPerTrigger", max_files)
            streams[s] = reader.parquet(f"{base}/in/{s}")
        run_available(build(streams), out, checkpoint)

    spans = {s: df.agg(F.min(F.unix_micros(t)), F.max(F.unix_micros(t))).first() for s, (df, t) in sources.items()}
    low, high = min(v[0] for v in spans.values()), max(v[1] for v in spans.values())
    width = (high - low) // slices + 1
    for i in range(slices):
        for s, (df, t) in sources.items():
            at = F.unix_micros(t)
            part = df.where((at >= low + i * width) & (at < low + (i + 1) * width))
            part.write.mode("append").parquet(f"{base}/in/{s}")
        run()
    for _ in range(HEARTBEATS):
        for i, (s, (df, t)) in enumerate(sources.items()):
            heartbeat(df, t, -1 - i).write.mode("append").parquet(f"{base}/in/{s}")
        run()
    return spark.read.parquet(out)
