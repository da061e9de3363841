"""Canonical inputs derived from the given tables, and the same views in SQL.

``tx``: mobile-money shape from ``events``. ``card``: nullable card components and time in
seconds, from ``events``. ``shop``: merchant payments from ``lineitem`` and ``orders``.
``ledger``: per (fold, seed, model) scores of the rolling test windows of ``tx``; scores are hashed
integers over 1000, raised for positives, so that ties and both clipping bounds occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.prefix import default_ranges
from riskframe.functions.scalars import clip_score, hash_draw, platt_score
from riskframe.operators.splits import apply_boundaries, rolling_boundaries
from riskframe.session import scratch_path

# Models and the score bonus their positives get; seeds; calibration coefficients.
MODELS = {"P0": 0, "PH": 150, "PHW": 300, "PP": 220}
SECOND = {"S0": 0, "SH": 120, "SHW": 260}
SEEDS = (42, 43, 44)
PLATT = (0.8, -0.3)
FOLDS = (3, 0.4, 0.1, 0.1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def since_start(ts: Column) -> Column:
    """Whole seconds since 2024-01-01, whatever the session's time zone."""
    return F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.floor(since_start(F.col("ts")) / F.lit(3600)) + 1).cast("int").alias("step"),
        F.col("user_id").alias("recipient"),
        F.get_json_object("props", "$.k").cast("bigint").alias("origin"),
        F.col("event_type").alias("type"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


TX = """tx AS (
  SELECT event_id AS id,
    CAST(floor((epoch(date_trunc('second', ts)) - 1704067200) / 3600) + 1 AS INTEGER) AS step,
    user_id AS recipient, CAST(json_extract_string(props, '$.k') AS BIGINT) AS origin,
    event_type AS type, CAST(round(value * 100) AS BIGINT) AS amount_cents,
    CAST(event_type = 'error' AS INTEGER) AS label
  FROM events)"""


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entity granularities; one component is missing for a tenth of the rows."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        since_start(F.col("ts")).cast("bigint").alias("t"),
        F.col("user_id").alias("card1"),
        F.when(k % 10 != 0, k % 4).alias("card2"),
        F.when(k % 7 != 0, F.col("event_type")).alias("category"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


CARD = """card AS (
  SELECT id, t, card1, CASE WHEN k % 10 <> 0 THEN k % 4 END AS card2,
    CASE WHEN k % 7 <> 0 THEN event_type END AS category, amount_cents, label
  FROM (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t, user_id AS card1,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type,
      CAST(round(value * 100) AS BIGINT) AS amount_cents,
      CAST(event_type = 'error' AS INTEGER) AS label FROM events))"""


#: What tells a payment apart besides its merchant; ``shop_id`` makes its id of them.
PAYMENT = ("l_orderkey", "l_linenumber", "l_partkey")


def shop_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant payments with the numbers that make their id, which move in fewer bytes than the id.

    Step and cents are worked out before the join, so that it moves small numbers.
    """
    step = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01")))
    li = table(spark, sf_dir, "lineitem").select(
        *PAYMENT,
        step.cast("int").alias("step"),
        F.col("l_suppkey").alias("merchant"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_cents"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"))
    return li.join(o, "l_orderkey").select(*PAYMENT, "step", "merchant", "customer", "amount_cents", "label")


def shop_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "merchant")


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant payments; the four key columns together identify a row."""
    return shop_parts(spark, sf_dir).select(shop_id().alias("id"), "step", "merchant", "customer", "amount_cents", "label")


SHOP = """shop AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS step,
    l_suppkey AS merchant, o_custkey AS customer,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
    CAST(l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def folds(rows: DataFrame, time: str = "step") -> DataFrame:
    n, first, val, test = FOLDS
    return rolling_boundaries(rows, n, first, val, test, time)


def _bounds_sql(source: str, time: str) -> str:
    n, first, val, test = FOLDS
    shift = (1 - (first + val + test)) / (n - 1)
    rows = []
    for f in range(n):
        a = first + f * shift
        b = a + val
        c = min(b + test, 1.0)
        rows.append(f"({f + 1}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)")
    return f"""grid_g AS (SELECT {time} AS gt, count(*) AS gn FROM {source} GROUP BY 1),
grid AS (SELECT gt, row_number() OVER (ORDER BY gt) AS gi, sum(gn) OVER (ORDER BY gt) AS cum,
    sum(gn) OVER () AS total, count(*) OVER () AS tg FROM grid_g),
goal(fold, fa, fb, fc) AS (VALUES {", ".join(rows)}),
b1 AS (SELECT fold, fb, fc, arg_min(gi, (abs(cum - total * fa), gi)) AS ia, max(tg) AS tg
  FROM grid, goal WHERE gi BETWEEN 1 AND tg - 2 GROUP BY ALL),
b2 AS (SELECT fold, fc, ia, b1.tg, arg_min(gi, (abs(cum - total * fb), gi)) AS ib
  FROM grid, b1 WHERE gi BETWEEN ia + 1 AND b1.tg - 1 GROUP BY ALL),
b3 AS (SELECT fold, ia, ib, b2.tg, arg_min(gi, (abs(cum - total * fc), gi)) AS ic
  FROM grid, b2 WHERE gi BETWEEN ib + 1 AND b2.tg GROUP BY ALL),
bounds AS (SELECT fold, split, min(gt) AS start_time, max(gt) AS end_time
  FROM (SELECT fold, gt, CASE WHEN gi <= ia THEN 'train' WHEN gi <= ib THEN 'validation' ELSE 'test' END AS split
    FROM grid, b3 WHERE gi <= ic) GROUP BY ALL)"""


BOUNDS = _bounds_sql("tx", "step")


def scored(rows: DataFrame, models: dict[str, int] | None = None, seeds=SEEDS) -> DataFrame:
    """One row per (model, seed) and input row, with raw, clipped and platt scores."""
    grid = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(b).alias("bonus"), F.lit(s).alias("seed"))
            for m, b in (models or MODELS).items()
            for s in seeds
        ]
    )
    long = rows.withColumn("_g", F.explode(grid))
    draw = hash_draw(F.col("_g.model"), F.col("_g.seed"), F.col("id")) % F.lit(1100)
    k = F.least(F.lit(1000), F.greatest(F.lit(0), draw - 80 + F.col("label") * F.col("_g.bonus")))
    raw = k.cast("double") / F.lit(1000.0)
    return (
        long.withColumns({"seed": F.col("_g.seed"), "model": F.col("_g.model"), "raw": raw})
        .withColumns({"clipped": clip_score(F.col("raw")), "platt": platt_score(F.col("raw"), *PLATT)})
        .drop("_g")
    )


_STORED: dict[tuple[str, ...], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a derived table once per session to the shared folder, then read it from there.

    A ledger is scanned by many operators; the written table cuts its lineage, survives lost
    executors, and gives each scan column pruning and pushdown.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path, compression="zstd")
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def build_ledger(spark: SparkSession, sf_dir: str, split: str = "test", models=None, positive: str = "error") -> DataFrame:
    rows = tx(spark, sf_dir).withColumn("label", (F.col("type") == positive).cast("int"))
    placed = apply_boundaries(rows, folds(rows)).where(F.col("split") == split)
    # Rows are dealt out by id before they are copied to every model and seed. The number of parts is given: adaptive
    # execution would merge them by their few bytes, and then the copies are made, and the ledger's files read, by few tasks.
    kept = placed.select("fold", "id", F.col("step").alias("time"), "amount_cents", "label").repartition(default_ranges(placed), "id")
    return scored(kept, models).select("fold", "seed", "model", "id", "time", "amount_cents", "label", "raw", "clipped", "platt")


def ledger(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    return stored(spark, sf_dir, f"ledger_{split}", lambda: build_ledger(spark, sf_dir, split))


def second_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a second study: another target and other models on the same windows."""
    return stored(spark, sf_dir, "ledger_second", lambda: build_ledger(spark, sf_dir, "test", SECOND, "purchase"))


def _ledger_sql(split: str, source: dict[str, int] | None = None, name: str | None = None, positive: str = "error") -> str:
    models = ", ".join(f"('{m}', {b})" for m, b in (source or MODELS).items())
    name = name or ("ledger" if split == "test" else "led_" + split)
    seeds = ", ".join(f"({s})" for s in SEEDS)
    return f"""{name}_0 AS (SELECT fold, seed, model, id, step AS time, amount_cents, CAST(type = '{positive}' AS INTEGER) AS label,
    least(1000, greatest(0, ('0x' || substr(sha256(concat_ws('|', model, seed, id)), 1, 8))::BIGINT % 1100 - 80
      + CAST(type = '{positive}' AS INTEGER) * bonus)) / 1000::DOUBLE AS raw
  FROM tx JOIN bounds ON split = '{split}' AND step BETWEEN start_time AND end_time,
    (VALUES {models}) m(model, bonus), (VALUES {seeds}) s(seed)),
{name} AS (SELECT *, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, raw)) AS clipped,
    1 / (1 + exp(-({PLATT[0]}::DOUBLE * ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, raw))
      / (1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, raw)))) + {PLATT[1]}::DOUBLE))) AS platt FROM {name}_0)"""


LEDGER = f"{TX},\n{BOUNDS},\n{_ledger_sql('test')}"
LEDGER_VALIDATION = f"{TX},\n{BOUNDS},\n{_ledger_sql('validation')}"
LEDGER_BOTH = LEDGER + ",\n" + _ledger_sql("validation")
LEDGER_TWO = LEDGER + ",\n" + _ledger_sql("test", SECOND, "second", "purchase")
